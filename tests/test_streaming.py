"""Streams over several micro-batches: state that ends, repeated and late rows, batches that are tried again."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cohortcast.streaming import captures


def at(day, h=0, m=0):
    return dt.datetime(2026, 5, day, h, m)


class Feed:
    """A folder that rows are added to, and a stream that reads what is new."""

    def __init__(self, spark, tmp_path, schema, name="in"):
        self.spark, self.schema, self.folder, self.tmp = spark, schema, f"{tmp_path}/{name}", tmp_path

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.folder)

    def read(self):
        return self.spark.readStream.schema(self.schema).parquet(self.folder)

    def run(self, stream, each):
        q = stream.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", f"{self.tmp}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return q


QUOTES = "race int, horse string, taken timestamp, ts timestamp, price double"


def assembled(spark, tmp_path, pieces, at_once):
    feed, got = Feed(spark, tmp_path, QUOTES), []
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, None)], "race int, horse string")
    rows_left = []
    for piece in pieces:
        feed.add(piece)
        stream = captures.complete_batches(feed.read(), expected, "race", "horse", "taken", "ts", "price", late="10 minutes", wait="1 hour", at_once=at_once)
        q = feed.run(stream, lambda b, k: got.extend((r.race, r.batch.day, r.members, k) for r in b.collect()))
        rows_left.append(sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]))
    return got, rows_left


def test_batches_come_out_once_and_are_forgotten(spark, tmp_path):
    t = at(1, 12)
    pieces = [
        [(1, "a", t, t, 3.0), (1, "a", t, t, 3.0), (1, "x", t, t, 9.0), (2, "a", t, t, 2.0), (9, "a", t, t, 2.0), (3, "a", t, t, None)],
        [(1, "b", t, at(1, 12, 5), 2.0), (1, "a", t, at(1, 12, 5), 3.0)],
        [(1, "b", t, at(1, 12, 6), 2.0), (3, "a", at(1, 13), at(1, 13), 5.0)],
        [(3, "a", at(9), at(9), 5.0)],  # the watermark passes everything before
        [(2, "b", t, at(1, 12, 5), 2.0), (3, "a", at(9), at(9), 5.0)],  # late: its batch is over
    ]
    got, left = assembled(spark, tmp_path, pieces, True)
    assert sorted(x[:3] for x in got) == [(1, 1, 2), (3, 1, 1), (3, 9, 1)]
    assert left[1] == 2 and left[-1] == 1  # of the old batches nothing is left


def test_batches_judged_at_their_end(spark, tmp_path):
    t = at(1, 12)
    pieces = [[(1, "a", t, t, 3.0), (2, "a", t, t, 2.0), (3, "a", t, t, 2.0)], [(1, "b", t, t, 2.0), (1, "a", t, t, 4.0), (2, "b", t, t, 2.0), (2, "b", t, t, 2.0)], [(1, "a", at(9), at(9), 3.0)]]
    got, _ = assembled(spark, tmp_path, pieces, False)
    assert sorted(x[:3] for x in got) == [(2, 1, 2), (3, 1, 1)]  # race 1 quotes a at two prices


def test_settlement_before_after_and_never(spark, tmp_path):
    bets, outcomes = Feed(spark, tmp_path, "bet int, placed timestamp", "bets"), Feed(spark, tmp_path, "bet int, told timestamp", "outcomes")
    got = {}

    def each(b, k):
        for r in b.collect():
            assert r.bet not in got
            got[r.bet] = r.outcome_told

    def step(b, o):
        bets.add(b)
        outcomes.add(o)
        bets.run(captures.settlements(bets.read(), outcomes.read(), "bet", "placed", "told", within="2 days", late="1 hour"), each)

    step([(1, at(1)), (2, at(1)), (3, at(1))], [(1, at(1, 5)), (4, at(1, 12))])
    assert got == {1: at(1, 5)}
    step([(4, at(1, 6))], [(2, at(2, 23))])  # the outcome of 4 came before it
    assert got == {1: at(1, 5), 2: at(2, 23), 4: at(1, 12)}
    step([(5, at(9))], [(3, at(4)), (6, at(9))])  # the outcome of 3 is out of its span
    assert got[3] is None and set(got) == {1, 2, 3, 4}


def test_settlement_forgets_bets_that_would_come_too_late(spark, tmp_path):
    bets, outcomes = Feed(spark, tmp_path, "bet int, placed timestamp", "bets"), Feed(spark, tmp_path, "bet int, told timestamp", "outcomes")
    got = []

    def step(b, o):
        bets.add(b)
        outcomes.add(o)
        return bets.run(captures.settlements(bets.read(), outcomes.read(), "bet", "placed", "told", within="2 days", late="1 hour"), lambda b, k: got.extend((r.bet, r.outcome_told) for r in b.collect()))

    step([(1, at(1)), (1, at(1)), (2, at(1))], [(1, at(1, 5))])
    assert got == [(1, at(1, 5))]
    query = step([(1, at(1)), (3, at(9))], [(4, at(9))])
    assert sorted(got, key=str) == [(1, at(1, 5)), (2, None)]
    dedupe = [o for o in query.lastProgress.stateOperators if o.operatorName == "dedupe"]
    assert [o.numRowsTotal for o in dedupe] == [1]  # of bet 3 alone


@pytest.mark.parametrize("kind", ["long", "string"])
def test_settlement_by_bucket(spark, tmp_path, kind):
    """As by a join; bets and outcomes told again change nothing, and a bucket without anything open leaves no state."""
    bets, outcomes = Feed(spark, tmp_path, f"bet {kind}, placed timestamp", "bets"), Feed(spark, tmp_path, f"bet {kind}, told timestamp", "outcomes")
    name = (lambda k: k) if kind == "long" else (lambda k: k if k is None else f"b{k}")
    got = []

    def step(b, o):
        bets.add([(name(k), *t) for k, *t in b])
        outcomes.add([(name(k), *t) for k, *t in o])
        del got[:]
        query = bets.run(captures.settled_by_bucket(bets.read(), outcomes.read(), "bet", "placed", "told", within="2 days", late="1 hour", buckets=3), lambda x, _: got.extend((r.bet, r.placed, r.outcome_told) for r in x.collect()))
        return query.lastProgress.stateOperators[0].numRowsTotal

    said = lambda *rows: sorted(((name(k), *t) for k, *t in rows), key=str)
    left = step([(1, at(1)), (1, at(1)), (2, at(1)), (3, at(1)), (None, at(1)), (8, None)], [(1, at(1, 5)), (1, at(1, 5)), (4, at(1, 12)), (None, at(1))])
    assert sorted(got, key=str) == said((1, at(1), at(1, 5))) and left > 0
    step([(1, at(1)), (4, at(1, 6)), (4, at(1, 20))], [(1, at(1, 5)), (2, at(2, 23)), (1, at(2))])  # the outcome of the first 4 came before it; 1 has another outcome
    assert sorted(got, key=str) == said((1, at(1), at(2)), (2, at(1), at(2, 23)), (4, at(1, 6), at(1, 12)))
    step([(5, at(9))], [(3, at(4)), (6, at(9))])  # the outcome of 3 is out of its span
    assert sorted(got, key=str) == said((3, at(1), None), (None, at(1), None), (4, at(1, 20), None))
    left = step([(7, at(20))], [(7, at(20))])
    assert sorted(got, key=str) == said((5, at(9), None), (7, at(20), at(20))) and left == 1  # the bucket of 7


def test_batches_tried_again_change_nothing(spark, tmp_path):
    path = f"{tmp_path}/out"
    rows = lambda lo, hi: spark.range(lo, hi).selectExpr("id", "id % 3 AS kind", "CAST(id % 2 AS int) AS won")
    run = lambda df, k: captures.evaluate_new(df, k, path, ["id"], ["kind"], {"n": F.lit(1), "wins": F.col("won")}, parts=4)
    run(rows(0, 30), 0)
    run(rows(0, 30), 0)
    run(rows(20, 50).unionAll(rows(20, 25)), 1)
    run(rows(20, 50).unionAll(rows(20, 25)), 1)
    run(rows(0, 50), 2)
    assert sorted((r.kind, r.n, r.wins) for r in captures.evaluation(spark, path, ["kind"], ["n", "wins"]).collect()) == [(0, 17, 8), (1, 17, 9), (2, 16, 8)]
    assert spark.read.parquet(f"{path}/rows").count() == 50


def test_only_touched_parts_are_read(spark, tmp_path):
    path = f"{tmp_path}/out"
    captures.store_new(spark.range(200).toDF("id"), 0, path, ["id"], parts=8)
    plan = captures.fresh_rows(spark.range(5, 6).toDF("id"), 1, path, ["id"], parts=8)._jdf.queryExecution().executedPlan().toString()
    filters = next(x for x in plan.split("PartitionFilters: ")[1:])
    assert "stored_part" in filters.split("PushedFilters")[0] and "stored_batch" in filters.split("PushedFilters")[0]
    assert captures.fresh_rows(spark.range(5, 6).toDF("id"), 1, path, ["id"], parts=8).count() == 0


def test_faults_are_not_taken_for_an_empty_table(spark, tmp_path):
    assert captures.stored(spark, f"{tmp_path}/none") is None
    captures.store_new(spark.range(3).toDF("other"), 0, f"{tmp_path}/out", ["other"])
    with pytest.raises(AnalysisException):
        captures.store_new(spark.range(3).toDF("id"), 1, f"{tmp_path}/out", ["id"])


def in_buckets(spark, tmp_path, files, expected, at_once, buckets):
    """Each list of rows is a micro-batch of its own: (race, members, micro-batch), and the rows of state at the end."""
    feed, got = Feed(spark, tmp_path, QUOTES), []
    for rows in files:
        feed.add(rows)
    source = spark.readStream.schema(QUOTES).option("maxFilesPerTrigger", 1).parquet(feed.folder)
    stream = captures.complete_batches(source, expected, "race", "horse", "taken", "ts", "price", late="10 minutes", wait="1 hour", at_once=at_once, buckets=buckets)
    q = feed.run(stream, lambda b, k: got.extend((r.race, r.members, k) for r in b.collect()))
    return got, sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"])


def test_groups_of_a_bucket_share_state(spark, tmp_path):
    t = at(1, 12)
    expected = spark.createDataFrame([(k, h) for k in range(40) for h in "ab"], "race int, horse string")
    got, left = in_buckets(spark, tmp_path, [[(k, "a", t, t, 2.0) for k in range(40)], [(k, "b", t, t, 2.0) for k in range(0, 40, 2)]], expected, True, 2)
    assert sorted(got) == [(k, 2, 1) for k in range(0, 40, 2)] and left == 2


def test_a_late_quote_holds_up_its_own_group_only(spark, tmp_path):
    t, expected = at(1, 12), spark.createDataFrame([(k, h) for k in (1, 2) for h in "ab"], "race int, horse string")
    files = [[(1, "a", t, t, 2.0), (1, "b", t, t, 2.0), (2, "a", t, t, 2.0)], [(1, "a", at(9), at(9), 2.0)], [(2, "b", t, at(9), 2.0)], [(1, "a", at(12), at(12), 2.0)]]
    got, _ = in_buckets(spark, tmp_path, files, expected, False, 1)
    assert [x[:2] for x in got] == [(1, 2), (2, 2)] and got[0][2] < got[1][2]


def test_a_batch_is_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            made.add(len(f))
            yield f

    for k in range(2):
        captures.store_new(spark.range(k, 100 + k).mapInPandas(counted, "id long"), k, f"{tmp_path}/out", ["id"], parts=4)
    assert made.value == 200 and spark.read.parquet(f"{tmp_path}/out").count() == 101
