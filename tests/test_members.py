"""Measures of members against values worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from cohortcast.operators import features, joins, members
from cohortcast.queries.members import f05_post_utc


def test_race_shape(spark):
    rows = [(1, k, s) for k, s in enumerate(["front", "presser", "closer", None])] + [(2, 0, "front"), (2, 1, None), (2, 2, None)] + [(3, 0, "stalker"), (3, 1, "stalker")]
    got = {(r.card, r.member): r for r in members.race_shape(spark.createDataFrame(rows, "card int, member int, style string"), "card", "style").collect()}
    assert [got[1, k].shape_fit for k in range(4)] == [0.60, 0.68, 0.55, None]
    assert (got[1, 0].pressure, got[1, 0].band, got[1, 0].collapse, got[1, 0].lone_speed, got[1, 1].lone_speed, got[1, 0].shape_state) == (0.6, "moderate", 0.5, 1, 0, "READY")
    assert got[2, 0].shape_state == got[3, 0].shape_state == "UNAVAILABLE" and got[3, 0].shape_fit is None


def test_evidence_confidence(spark):
    rows = [(1, 0, 0.6, 0.5, 5, 20, False), (1, 1, 0.4, 0.5, 0, 3, True)]
    df = spark.createDataFrame(rows, "card int, member int, p double, m double, starts int, career int, lacks boolean")
    c = F.col
    got = {r.member: r for r in members.evidence_confidence(df, "card", "p", "m", c("starts"), c("career"), c("lacks"), F.lit(True), "member").collect()}
    spread = 0.45 * (1 - 0.6730116670092565 / 0.6931471805599453) + 0.35 + 0.20
    assert got[0].confidence_score == pytest.approx(0.35 + 0.25 * 0.5 + 0.30 * spread + 0.05, abs=6e-4) and got[0].confidence == "MEDIUM" if got[0].confidence_score < 0.7 else "HIGH"
    assert got[1].confidence_score == pytest.approx(0.35 * 0.05 + 0.25 * 0.5 + 0.30 * spread + 0.05, abs=6e-4) and got[1].confidence == "LOW"


def test_edges_need_all_prices(spark):
    df = spark.createDataFrame([(1, 0.5, 2.5), (1, 0.5, 1.6), (2, 0.5, 3.0), (2, 0.5, None)], "card int, p double, decimal double")
    got = members.market_edges(df, "card", "p", "decimal").orderBy("card", F.desc("decimal")).collect()
    assert [(r.edge, r.tag, r.fair_odds) for r in got] == [(0.1098, "bet", 1.0), (-0.1098, "underlay", 1.0), (None, None, 1.0), (None, None, 1.0)]


def test_ranks_and_finishes(spark):
    df = spark.createDataFrame([("g 1 stakes",), ("Open mclm",), ("nothing",), (None,)], "c string")
    assert [r[0] for r in df.select(members.class_rank(F.col("c"))).collect()] == [100, 45, None, None]
    rows = [(1, 5, False, 1.0), (5, 5, False, 0.0), (6, 5, False, None), (1, 1, False, None), (2, 5, True, None)]
    df = spark.createDataFrame(rows, "f int, n int, s boolean, want double")
    assert all(r.got == r.want for r in df.select("want", members.finish_share(F.col("f"), F.col("n"), F.col("s")).alias("got")).collect())


def test_form_and_cohorts_equal_brute_force(spark):
    day = lambda k: datetime.date(2026, 1, 1) + datetime.timedelta(days=k)
    past = [(k % 3, day((k * 37) % 400), (k % 11) / 10 if k % 13 else None) for k in range(300)]
    asked = [(e, day(d)) for e in range(4) for d in (0, 50, 51, 200, 399, 500)]
    h, t = spark.createDataFrame(past, "e int, past date, s double"), spark.createDataFrame(asked, "e int, at date")
    got = {(r.e, r.at): r for r in features.history_form(t, h, ["e"], "at", "past", "s", "e").collect()}
    cohort = {(r.e, r.at): r for r in joins.cohort_stats(h, t, ["e"], "at", "past", "s").collect()}
    for e, at in asked:
        rows = [((at - d).days, s) for x, d, s in past if x == e and s is not None and d < at]
        assert got[e, at].starts == len(rows)
        if rows:
            w = [2.718281828459045 ** (-0.01 * a) for a, _ in rows]
            raw, cover = sum(a * s for a, (_, s) in zip(w, rows)) / sum(w), min(1, sum(a <= 180 for a, _ in rows) / 5)
            assert got[e, at].form == pytest.approx(cover * raw + (1 - cover) * 0.5) and got[e, at].days_off == min(a for a, _ in rows)
        near = [s for a, s in rows if a <= 90]
        assert (cohort[e, at].cohort_n or 0) == len(near)
        if len(near) >= 5:
            assert cohort[e, at].cohort_mean == pytest.approx(sum(near) / len(near))


def test_local_times_become_utc(spark, tmp_path):
    spark.createDataFrame([(1, "click", datetime.datetime(2026, 1, 15, 12)), (2, "click", datetime.datetime(2026, 7, 15, 12)), (3, "signup", datetime.datetime(2026, 7, 15, 12))], "event_id long, event_type string, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.h for r in f05_post_utc(spark, str(tmp_path)).select("event_id", F.hour("utc").alias("h")).collect()}
    assert got == {1: 17, 2: 16, 3: 12}
