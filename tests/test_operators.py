"""Operators on small frames: invariants, ties, as-of honesty, idempotent sinks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortcast.operators import aggregates, backtest, joins, quality, scoring, windows
from cohortcast.sources import readers, sinks


def at(h, m=0):
    return dt.datetime(2026, 5, 2, h, m)


def test_no_run_at_or_after_post_is_used(spark):
    post = spark.createDataFrame([(1, at(12)), (2, at(12)), (3, at(12))], "card int, post timestamp")
    runs = spark.createDataFrame([(1, at(11), 10), (1, at(11), 11), (1, at(12), 12), (1, at(13), 13), (2, at(12), 20), (9, at(1), 90)], "card int, ts timestamp, run int")
    got = {r.card: r.run for r in joins.as_of(post, runs, ["card"], "post", "ts", ["run"], "run").collect()}
    assert got == {1: 11, 2: None, 3: None}
    got = {r.card: r.run for r in joins.as_of(post, runs, ["card"], "post", "ts", ["run"], "run", strict=False).collect()}
    assert got == {1: 12, 2: 20, 3: None}
    got = {r.card: r.run for r in joins.as_of(post, runs, ["card"], "post", "ts", ["run"], "run", strict=False, lag="30 minutes", max_age="45 minutes").collect()}
    assert got == {1: None, 2: None, 3: None}


@pytest.mark.parametrize("options", [{}, {"strict": False}, {"lag": "30 minutes", "max_age": "3 days"}])
def test_spans_carry_a_hot_key(spark, options):
    """With spans the same rows are found, and the windows go by key and span: nine tenths of the rows are one key's."""
    import random

    rnd = random.Random(8)
    key = lambda: rnd.choice([1] * 18 + [2, None])
    when = lambda: at(0) + dt.timedelta(minutes=rnd.randrange(60 * 24 * 40))
    left = spark.createDataFrame([(key(), when(), k) for k in range(400)] + [(3, at(1), 400), (1, None, 401)], "card int, post timestamp, id int")
    right = spark.createDataFrame([(key(), when(), k) for k in range(150)] + [(1, at(9), 150), (1, at(9), 151), (3, None, 152)], "card int, ts timestamp, run int")
    plain, spans = (joins.as_of(left, right, ["card"], "post", "ts", ["run"], "run", bucket_days=b, **options) for b in (None, 2))
    assert sorted(map(str, plain.collect())) == sorted(map(str, spans.collect()))
    assert "_span" in spans._jdf.queryExecution().executedPlan().toString().split("Window [last(_right")[1].split("\n")[0]


def test_complete_capture(spark):
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "card int, member string")
    rows = [(1, "a", "x", 1, 3.0), (1, "b", "x", 1, 2.0), (1, "a", "x", 2, 3.0), (1, "a", "y", 3, 3.0), (1, "b", "y", 3, 0.5), (2, "a", "x", 1, 2.0), (2, "a", "y", 1, 2.0)]
    got = joins.complete_capture(spark.createDataFrame(rows, "card int, member string, provider string, ts int, price double"), expected, "card", "member", ["provider"], "ts", "price").collect()
    assert sorted((r.card, r.member, r.ts) for r in got) == [(1, "a", 1), (1, "b", 1)]


def test_harville_sums(spark):
    df = spark.createDataFrame([(1, k, p) for k, p in enumerate([0.4, 0.3, 0.2, 0.1])] + [(2, 0, 0.6), (2, 1, 0.4)], "card int, member int, p double")
    got = joins.harville(df, "card", "member", "p").groupBy("card").agg(F.sum("win").alias("w"), F.sum("place").alias("p"), F.sum("show").alias("s")).orderBy("card").collect()
    assert [round(x, 9) for x in got[0][1:]] == [1.0, 2.0, 3.0] and got[1].p == 2.0


def test_within_days_excludes_the_day_itself(spark):
    day = lambda k: dt.date(2026, 5, 2) - dt.timedelta(k)
    t = spark.createDataFrame([(1, day(0))], "h int, day date")
    h = spark.createDataFrame([(1, day(k), k) for k in (-1, 0, 1, 59, 60, 61)], "h int, past date, k int")
    assert sorted(r.k for r in joins.within_days(t, h, "h", "day", "past", 60).collect()) == [1, 59, 60]


def test_matching(spark):
    a = spark.createDataFrame([(1, "Fast  Horse"), (1, "Slow Hoarse"), (1, "Zebra"), (1, "Twin")], "card int, typed string")
    b = spark.createDataFrame([(1, "FAST HORSE", 7), (1, "Slow Horse", 8), (1, "Twin A", 9), (1, "Twin B", 10), (2, "Zebra", 11)], "card int, name string, id int")
    got = {r.typed: (r.match_id, r.match_type) for r in joins.best_match(a, b, "card", "typed", "name", "id").collect()}
    assert got == {"Fast  Horse": (7, "exact"), "Slow Hoarse": (8, "fuzzy"), "Zebra": (None, "none"), "Twin": (None, "ambiguous")}


def test_softmax_and_scores(spark):
    df = spark.createDataFrame([(1, k, float(k)) for k in range(4)] + [(2, 0, 5.0)], "card int, member int, x double")
    sums = windows.softmax(df, "card", "x", 2.0).groupBy("card").agg(F.sum("p").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums)
    even = spark.createDataFrame([(1, "u", k, 0.25, int(k == 2)) for k in range(4)], "card int, f string, member int, p double, won int")
    s = aggregates.group_scores(even, "card", "f", "p", "won").first()
    assert s.log_loss == pytest.approx(1.3862943611) and s.winner_rank == 2.5 and s.top1 == 0.25
    sure = aggregates.group_scores(even.withColumn("p", F.lit(0.0)), "card", "f", "p", "won").first()
    assert sure.log_loss == pytest.approx(13.815510558)


def test_bootstrap_is_repeatable_and_covers(spark):
    df = spark.range(2000).select("id", (F.pmod(F.xxhash64("id"), F.lit(4)) == 0).cast("double").alias("x"))
    a, b = (aggregates.bootstrap(df, [], "id", "x").first() for _ in range(2))
    assert tuple(a) == tuple(b) and a.lo < a.estimate < a.hi and a.hi - a.lo == pytest.approx(2 * 1.96 * (0.25 * 0.75 / 2000) ** 0.5, rel=0.3)


def test_kendall(spark):
    df = spark.createDataFrame([(1, k, float(k), float(-k)) for k in range(5)] + [(2, 0, 1.0, 1.0)], "card int, member int, a double, b double")
    assert {r.card: r.tau for r in aggregates.kendall_tau(df, "card", "member", "a", "b").collect()} == {1: -1.0, 2: None}


def test_free_slots(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "b", None), (1, "c", None), (1, "d", 2)], "card int, member string, slot int")
    got = {r.member: (r.assigned, r.clash) for r in windows.free_slots(df, "card", "slot", "member", 5).collect()}
    assert got == {"a": (2, True), "b": (1, False), "c": (3, False), "d": (2, True)}


def test_decide_is_idempotent_and_settles(spark):
    p = {1: 0.40, 5: 0.20, 7: 0.12, 4: 0.10, 8: 0.08, 2: 0.06, 6: 0.04}
    d = {1: 3.0, 5: 4.0, 7: 8.0, 4: 10.0, 8: 15.0, 2: 20.0, 6: 30.0}
    df = spark.createDataFrame([("r", k, p[k], d[k]) for k in p], "card string, member int, p double, decimal double")
    bets = backtest.decide(df, "card", "member", "p", "decimal", "v1")
    assert [(r.member, round(r.ev, 6)) for r in bets.collect()] == [(1, 0.2)] or bets.count() <= 1
    assert backtest.decide(df, "card", "member", "p", "decimal", "v1", taken=bets).count() == 0
    out = spark.createDataFrame([("r", k, 1 if k == 1 else 2, False) for k in p], "card string, member int, finish int, scratched boolean")
    assert {r.status for r in backtest.settle(bets, out, "card", "member", F.lit(2.0)).collect()} <= {"WON", "LOST"}
    held = backtest.settle(bets, out.withColumn("finish", F.lit(None).cast("int")), "card", "member", F.lit(2.0))
    assert {r.status for r in held.collect()} <= {"HELD_NO_RESULT"}


def test_one_bad_price_voids_the_market(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (2, 1, 3.0), (2, 2, None)], "card int, member int, decimal double")
    got = scoring.market(df, "card", "decimal")
    assert [r.market_p for r in got.orderBy("card", "member").collect()] == [0.5, 0.5, None, None]


def test_codes_treat_unknown_as_broken(spark):
    df = spark.createDataFrame([(1, None), (2, 1)], "k int, x int")
    got = {r.k: r.c for r in df.select("k", quality.codes(bad_x=F.col("x") != 1).alias("c")).collect()}
    assert got == {1: ["BAD_X"], 2: []}


def test_sinks_are_idempotent(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, None, 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "b", 2), (3, "c", 1), (3, "c", 1)], "k int, v string, t int")
    assert [tuple(r) for r in sinks.new_rows(stored, new, ["k"]).collect()] == [(3, "c", 1)]
    once = sinks.replaced(stored, new, ["k"], "t")
    assert sorted(map(tuple, sinks.replaced(once, new, ["k"], "t").collect())) == sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "b", 2), (3, "c", 1)]
    assert sorted(map(tuple, sinks.filled(stored, new.distinct(), ["k"]).collect())) == [(1, "a", 1), (2, "b", 1), (3, "c", 1)]
    status = {r.k: r.status for r in sinks.versioned(stored, new.distinct().unionByName(stored.where("k = 1")), ["k"], ["v", "t"]).collect()}
    assert status == {1: "UNCHANGED", 2: "SUPERSEDED", 3: "INSERTED"}


def test_reading_with_aliases(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Race Date,Trk,R#,Horse,Fin,Odds,SCR\n05/02/2026,CD,1,Señor (IRE),1,9/2,\nbad,CD,x,,2,+450,✓\n")
    raw = readers.read_delimited(spark, str(tmp_path / "r.csv"), {"race_date": ["Race Date"], "track": ["Trk"], "race_number": ["R#"], "name": ["Horse"], "finish": ["Fin"], "odds": [], "scratched": ["SCR"], "comment": []})
    good, bad = readers.split_bad(readers.typed_results(raw), {"BAD_DATE": F.col("race_date").isNull(), "NO_NAME": F.col("name_key").isNull()})
    row = good.first()
    assert (str(row.race_date), row.name_key, row.decimal_odds, row.scratched) == ("2026-05-02", "SENOR", 5.5, False)
    assert [r.reason for r in bad.collect()] == ["BAD_DATE"]


def test_sections_and_inventory(spark, tmp_path):
    df = spark.createDataFrame([(1, "intro\nRace 1\na\nb\nRace 2\nc"), (2, "none")], "id int, text string")
    assert [(r.section, r.header, r.body) for r in readers.sections(df, "text", r"Race \d+").orderBy("section").collect()] == [(0, "Race 1", "a\nb"), (1, "Race 2", "c")]
    (tmp_path / "CD_R7_2026-05-02.txt").write_text("x")
    row = readers.inventory(spark, [str(tmp_path)]).first()
    assert (row.track, row.race_number, str(row.race_date), row.size) == ("CD", 7, "2026-05-02", 1)


def test_grid_temperature_equals_the_reference_rule(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    grid = [0.25 + 3.75 * k / 199 for k in range(200)]
    cards = {k: (rng.standard_normal(n), rng.dirichlet(np.ones(n))) for k, n in enumerate([2, 3, 5, 8, 12, 20])}
    near = rng.dirichlet(np.ones(6))
    cards |= {10: (np.log(near), near), 11: (np.zeros(4), np.full(4, 0.25)), 12: (np.zeros(1), np.ones(1)), 13: (np.zeros(4), np.array([0.7, 0.1, 0.1, 0.1]))}

    def js(p, q):
        p, q = (np.clip(v, 1e-12, None) / np.clip(v, 1e-12, None).sum() for v in (p, q))
        return 0.5 * np.sum(p * np.log(2 * p / (p + q))) + 0.5 * np.sum(q * np.log(2 * q / (p + q)))

    want = {}
    for k, (x, q) in cards.items():
        want[k] = (1.0, None)
        for t in grid:
            p = np.exp((x - x.max()) * t)
            p /= p.sum()
            if js(p, q) >= 0.001 and (want[k][1] is None or np.mean((p - q) ** 2) < want[k][1] - 1e-15):
                want[k] = (t, np.mean((p - q) ** 2))
    assert want[11] == want[12] == (1.0, None) and want[13][0] == 0.25 and want[10][0] not in (1.0, 0.25, 4.0)
    rows = [(k, i, float(a), float(b)) for k, (x, q) in cards.items() for i, (a, b) in enumerate(zip(x, q))]
    df = spark.createDataFrame([*rows, (14, 0, None, 1.0)], "card int, member int, x double, q double")
    got = {r.card: (r.scale, r.mse) for r in aggregates.grid_temperature(df, "card", "x", "q", grid).collect()}
    assert got.pop(14) == (1.0, None) and set(got) == set(want)
    for k in want:
        assert got[k][0] == pytest.approx(want[k][0]) and got[k][1] == (want[k][1] and pytest.approx(want[k][1])), k


def test_every_card_has_a_temperature(spark, sf_dir):
    from cohortcast.queries.measures import a35_grid

    cards = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert a35_grid(spark, sf_dir).count() == cards


def test_evaluation_cube_and_running_loss(spark):
    rows = [(k, f, 1.0 + (f == "b") + 0.1 * k, 0.5, 1.0, 1.0, "x" if k < 11 else None, at(0) + dt.timedelta(k // 5)) for k in range(13) for f in "ab" if (k, f) != (3, "b")]
    scores = spark.createDataFrame(rows, "card int, f string, log_loss double, brier double, top1 double, winner_rank double, family string, day timestamp").withColumn("day", F.to_date("day"))
    got = {(r.dimension, r.value): r for r in aggregates.evaluation_cube(scores, "card", "f", ["family"], "a", "b").collect()}
    assert set(got) == {("all", None), ("family", "x"), ("family", None)}
    whole, x, none = got["all", None], got["family", "x"], got["family", None]
    assert (whole.groups, whole.paired, whole.thin) == (13, 12, False) and (x.paired, x.thin) == (10, False) and (none.paired, none.thin) == (2, True)
    assert whole.delta_log_loss == pytest.approx(-1.0) and none.candidate_log_loss == pytest.approx(1.0 + 0.1 * 11.5)
    run = aggregates.running_loss(scores, "card", "f", "day", ["a", "b"]).orderBy("day").collect()
    assert [r.groups for r in run] == [4, 9, 12] and run[0].a == pytest.approx(1.175) and run[2].b - run[2].a == pytest.approx(1.0)
