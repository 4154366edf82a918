"""Queries that learn or stream. Streams read the events file to its end and write to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortcast.operators import learning
from cohortcast.queries.frames import DATED, dated, once, shared_folder, table, with_sql
from cohortcast.sources import sinks
from cohortcast.streaming import captures

r = lambda c, k=6: F.round(c, k).alias(c)


def _stream(spark, d, source: str = "events"):
    schema = table(spark, d, source).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{source}.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def _finish(stream, spark, name: str, mode: str, each) -> None:
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", shared_folder(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()


def t01_ingest(spark, d):
    """Captures before their user's last purchase, each event once."""
    out = shared_folder(spark, "t01")
    posts = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("post"))
    clicks = _stream(spark, d).where("event_type = 'click'")
    kept = captures.ingest(clicks, posts, "user_id", "ts", ["event_id"])
    _finish(kept, spark, "t01", "append", lambda batch, k: captures.store_new(batch, k, out, ["event_id"]))
    return spark.read.parquet(out).select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


def t03_drift(spark, d):
    out = shared_folder(spark, "t03")
    moves = captures.drift(_stream(spark, d).where("value > 0"), ["event_type"], "ts", "value", "6 hours", "3 hours")
    _finish(moves, spark, "t03", "complete", lambda batch, _: batch.write.mode("overwrite").parquet(out))
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r("opening"), r("closing"))


T03 = """WITH e AS (SELECT *, unnest([time_bucket(INTERVAL 3 HOUR, ts), time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR]) AS start FROM events WHERE value > 0)
SELECT start, event_type, count(*) AS n, round(arg_min(value, ts), 6) AS opening, round(arg_max(value, ts), 6) AS closing FROM e GROUP BY 1, 2"""


def t06_arrivals(spark, d):
    """Each content arrives twice in the stream and is stored once."""
    out = shared_folder(spark, "t06")
    found = _stream(spark, d).select(F.sha2(F.concat_ws("|", "event_type", "props"), 256).alias("sha256"), "event_type")
    both = found.unionByName(found)
    _finish(both, spark, "t06", "append", lambda batch, k: captures.store_new(batch, k, out, ["sha256"]))
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("artifacts"))


def s12_artifacts(spark, d):
    """Contents arrive with the version of their parser, a third of them before the rest: each pair of content and version is stored once."""
    out = shared_folder(spark, "s12")
    e = table(spark, d, "events").select(F.sha2(F.concat_ws("|", "event_type", "props"), 256).alias("sha256"), F.concat(F.lit("v"), (F.col("event_id") % 2).cast("string")).alias("parser_version"), "event_id")
    for k, part in enumerate((e.where("event_id % 3 = 0"), e)):
        captures.store_new(part.drop("event_id"), k, out, ["sha256", "parser_version"])
    return spark.read.parquet(out).groupBy("parser_version", F.col("stored_batch").cast("int").alias("batch")).agg(F.count("*").alias("artifacts"))


S12 = """WITH e AS (SELECT sha256(event_type || '|' || props) AS s, 'v' || (event_id % 2) AS parser_version, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS b FROM events),
f AS (SELECT s, parser_version, min(b) AS batch FROM e GROUP BY 1, 2) SELECT parser_version, CAST(batch AS INT) AS batch, count(*) AS artifacts FROM f GROUP BY 1, 2"""


def _arriving(spark, frames: dict, clock: dict, pieces: int, run) -> None:
    """Writes each frame piece by piece of its time, and lets run(folder of each) read what has come after each piece.

    frames: name to table; clock: name to its time column. Each piece but the first brings a part of the rows before it once more.
    """
    root = shared_folder(spark, "arriving")
    ends = [f.agg(F.min(clock[n]).alias("a"), F.max(clock[n]).alias("z")).first() for n, f in frames.items()]
    first, last = min(e.a for e in ends), max(e.z for e in ends)
    edges = [first + (last - first) * k / pieces for k in range(pieces)] + [None]
    for k in range(pieces):
        for n, f in frames.items():
            at = F.col(clock[n])
            mine = (at >= F.lit(edges[k])) & (at < F.lit(edges[k + 1]) if edges[k + 1] else F.lit(True))
            again = (at < F.lit(edges[k])) & (F.crc32(at.cast("string")) % 10 == 0)
            f.where(mine | again).write.mode("append").parquet(f"{root}/{n}")
        run({n: f"{root}/{n}" for n in frames})


def _read(spark, folder, frame):
    return spark.readStream.schema(frame.schema).parquet(folder)


def _batches(spark, d, at_once: bool):
    """Captures are weeks of a user, its members are kinds of events; every user is expected to quote three. The stream comes in three pieces, with repeated and late rows."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts")).withColumn("week", F.date_trunc("week", "ts"))
    e = e.withColumn("price", F.when(F.col("event_id") % 5 > 0, 1.0).otherwise(2.0))
    users = e.select("user_id").distinct()
    kinds = users.select("user_id", F.explode(F.array(*map(F.lit, ["click", "view", "purchase"]))).alias("event_type"))
    buckets = users.count() // 64 + 1
    out, state = shared_folder(spark, "t02"), shared_folder(spark, "t02-state")

    def run(folders):
        found = captures.complete_batches(_read(spark, folders["events"], e), kinds, "user_id", "event_type", "week", "ts", "price", late="1 hour", wait="8 days", at_once=at_once, buckets=buckets)
        found.writeStream.outputMode("append").foreachBatch(lambda b, k: captures.store_new(b, k, out, ["user_id", "batch"])).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    _arriving(spark, {"events": e}, {"events": "ts"}, 3, run)
    return spark.read.parquet(out).select("user_id", F.col("batch").cast("timestamp_ntz").alias("week"), "members")


def t02_complete_batches(spark, d):
    """Each complete week once, with the quote that completes it."""
    return _batches(spark, d, True)


def t02_clean_batches(spark, d):
    """Complete weeks whose members quote one price each, when their time is over."""
    return _batches(spark, d, False)


T02 = "WITH e AS (SELECT user_id, event_type, date_trunc('week', ts)::TIMESTAMP AS week, CASE WHEN event_id % 5 > 0 THEN 1.0 ELSE 2.0 END AS price, max(ts) OVER () AS last FROM events), m AS (SELECT user_id, week, event_type, count(DISTINCT price) AS prices, max(last) AS last FROM e WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2, 3) SELECT user_id, week, CAST(count(*) AS INT) AS members FROM m GROUP BY 1, 2 HAVING count(*) = 3"


def t04_settlement(spark, d):
    """Bets are orders, their outcomes the first shipping of their lines; either may come first. Two streams with a watermark each; the span is 60 days."""
    bets = table(spark, d, "orders").select(F.col("o_orderkey").alias("bet"), F.col("o_orderdate").cast("timestamp").alias("placed"))
    told = table(spark, d, "lineitem").where("l_orderkey % 10 > 0").groupBy(F.col("l_orderkey").alias("bet")).agg(F.min("l_shipdate").cast("timestamp").alias("told"))
    results = once(told, "results")  # each piece reads them
    buckets = max(bets.count() // 20_000, 2 * spark.sparkContext.defaultParallelism)
    out, state = shared_folder(spark, "t04"), shared_folder(spark, "t04-state")

    def run(folders):
        both = captures.settled_by_bucket(_read(spark, folders["bets"], bets), _read(spark, folders["results"], results), "bet", "placed", "told", within="60 days", late="400 days 90 minutes", buckets=buckets)
        both.writeStream.outputMode("append").foreachBatch(lambda b, k: captures.store_new(b, k, out, ["bet"])).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    _arriving(spark, {"bets": bets, "results": results}, {"bets": "placed", "results": "told"}, 3, run)
    return spark.read.parquet(out).select("bet", F.when(F.col("outcome_told").isNotNull(), "SETTLED").otherwise("EXPIRED").alias("status"), F.datediff("outcome_told", "placed").alias("days"))


T04 = """WITH b AS (SELECT o_orderkey AS bet, o_orderdate::TIMESTAMP AS placed FROM orders), r AS (SELECT l_orderkey AS bet, min(l_shipdate)::TIMESTAMP AS told FROM lineitem WHERE l_orderkey % 10 > 0 GROUP BY 1),
w AS (SELECT least((SELECT max(placed) FROM b), (SELECT max(told) FROM r)) - INTERVAL 400 DAY - INTERVAL 90 MINUTE AS mark)
SELECT b.bet, CASE WHEN told IS NULL THEN 'EXPIRED' ELSE 'SETTLED' END AS status, CAST(date_diff('day', placed, told) AS INT) AS days
FROM b LEFT JOIN r ON r.bet = b.bet AND told >= placed AND told <= placed + INTERVAL 60 DAY, w WHERE told IS NOT NULL OR placed + INTERVAL 60 DAY < mark"""


def t05_evaluation(spark, d):
    """Clicks are forecasts, won if their user buys on the same day. They come in three pieces with repeated rows, and each piece is tried twice; sums are kept by kind of user."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    clicks = e.where("event_type = 'click'").withColumn("p", (F.col("event_id") % 97 + 1) / 100)
    bought = e.where("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("day"), F.lit(1).alias("won")).distinct()
    out, state = shared_folder(spark, "t05"), shared_folder(spark, "t05-state")
    y = F.col("won").cast("double")
    sums = {"n": F.lit(1), "wins": F.col("won"), "brier": F.pow(F.col("p") - y, F.lit(2.0)).cast("decimal(20,10)")}

    def run(folders):
        scored = _read(spark, folders["clicks"], clicks).withColumn("day", F.to_date("ts")).join(bought, ["user_id", "day"], "left").withColumn("won", F.coalesce("won", F.lit(0))).withColumn("kind", (F.col("user_id") % 5).cast("int"))

        def twice(batch, k):
            for _ in range(2):  # as after a fault between the batch and its commit
                captures.evaluate_new(batch, k, out, ["event_id"], ["kind"], sums)

        scored.writeStream.outputMode("append").foreachBatch(twice).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    _arriving(spark, {"clicks": clicks}, {"clicks": "ts"}, 3, run)
    return captures.evaluation(spark, out, ["kind"], list(sums)).select("kind", "n", "wins", F.round(F.col("brier").cast("double") / F.col("n"), 6).alias("brier"))


T05 = "WITH b AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type = 'purchase'), c AS (SELECT e.user_id % 5 AS kind, (event_id % 97 + 1) / 100 AS p, (b.day IS NOT NULL)::INT AS won FROM events e LEFT JOIN b ON b.user_id = e.user_id AND b.day = e.ts::DATE WHERE event_type = 'click') SELECT CAST(kind AS INT) AS kind, count(*) AS n, CAST(sum(won) AS BIGINT) AS wins, round(avg((p - won) ** 2), 6) AS brier FROM c GROUP BY 1"


def l03_sufficiency(spark, d):
    return learning.sufficiency(dated(spark, d), "class", "card", 3000, 12000).select("class", "groups", "rows", "model")


def s17_scope_overwrite(spark, d):
    """Partitions of two classes are written again; the others stay as they were."""
    out = shared_folder(spark, "s17")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    o.write.partitionBy("o_orderstatus").parquet(out)
    sinks.write_scope(o.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(1.0)), out, "o_orderstatus")
    return spark.read.parquet(out).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 1).alias("total"))


QUERIES = {
    "l03_sufficiency": (l03_sufficiency, with_sql(DATED, "SELECT class, count(DISTINCT card) AS groups, count(*) AS rows, CASE WHEN count(DISTINCT card) >= 3000 AND count(*) >= 12000 THEN class ELSE 'pooled' END AS model FROM dated GROUP BY 1")),
    "s17_scope_overwrite": (s17_scope_overwrite, "SELECT o_orderstatus, count(*) AS n, round(sum(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END)::DOUBLE, 1) AS total FROM orders GROUP BY 1"),
    "s12_artifacts": (s12_artifacts, S12),
    "t01_ingest": (t01_ingest, "SELECT e.event_id, e.user_id, e.ts FROM events e JOIN (SELECT user_id, max(ts) AS post FROM events WHERE event_type = 'purchase' GROUP BY 1) p USING (user_id) WHERE event_type = 'click' AND e.ts < post"),
    "t02_complete_batches": (t02_complete_batches, T02),
    "t02_clean_batches": (t02_clean_batches, T02 + " AND max(prices) = 1 AND week + INTERVAL 8 DAY < max(last) - INTERVAL 1 HOUR"),
    "t03_drift": (t03_drift, T03),
    "t04_settlement": (t04_settlement, T04),
    "t05_evaluation": (t05_evaluation, T05),
    "t06_arrivals": (t06_arrivals, "SELECT event_type, count(DISTINCT sha256(event_type || '|' || props)) AS artifacts FROM events GROUP BY 1"),
}
