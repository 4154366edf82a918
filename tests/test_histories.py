"""Histories on small frames: nothing of the target's day or later counts; ties, nulls and short histories."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cohortcast.operators import histories

DAY = dt.date(2026, 5, 2)


def ago(k):
    return DAY - dt.timedelta(k)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([("a", DAY), ("b", DAY), (None, DAY), ("a", None)], "horse string, at date")


WORKS = "horse string, date date, distance double, seconds double, location string, surface string, rank int, of int, tie long"


def test_works(spark, target):
    rows = [
        ("a", ago(0), 9.0, 10.0, "x", "d", 1, 9, 1), ("a", ago(-3), 9.0, 10.0, "x", "d", 1, 9, 2),  # the day itself, and later
        ("a", ago(5), 5.0, 61.0, "x", "d", 4, 8, 3), ("a", ago(20), 4.0, 50.0, "x", "d", 1, 4, 4), ("a", ago(45), 4.0, 50.0, "x", "d", None, 4, 5), ("a", ago(61), 4.0, 50.0, "x", "d", 2, 4, 6),
        ("a", ago(70), None, None, "x", "d", 3, 4, 7), ("a", ago(71), 4.0, 50.0, "x", "d", 9, 4, 8), ("a", ago(72), 4.0, 50.0, "x", "d", 0, 4, 9), ("a", ago(73), 4.0, 50.0, "x", "d", 4, 4, 10),
        *[("c", ago(30 + k), 5.0, 60.0 + k, "x", "d", None, None, 20 + k) for k in range(4)], ("c", ago(91), 5.0, 99.0, "x", "d", None, None, 30), ("c", ago(10), 5.0, 99.0, "y", "d", None, None, 31), ("c", ago(0), 5.0, 99.0, "x", "d", None, None, 32),
        ("b", ago(2), None, 60.0, "x", "d", None, None, 40),
    ]
    got = {(r.horse, r["at"]): r for r in histories.work_overlay(target, spark.createDataFrame(rows, WORKS), "horse", "at").collect()}
    a = got["a", DAY]
    assert a.rank_n == 5 and a.rank_percentile == pytest.approx((0.5 + 0.75 + 0.5 + 0.25 + 1.0) / 5)
    assert (a.count_30, a.coverage, a.days_since_work, a.normalized) == (2, 1.0, 5, True)
    times = [61.0, 60, 61, 62, 63]
    mean = sum(times) / 5
    z = (61 - mean) / math.sqrt(sum((t - mean) ** 2 for t in times) / 5)
    assert a.velocity_z == pytest.approx(z, abs=1e-4)
    ready = 0.35 * math.exp(-5 / 30) + 0.30 * 2 / 3 + 0.20 * 0.65 + 0.10 / 4 + 0.05 / (1 + math.exp(z))
    assert a.readiness_v2 == pytest.approx(ready, abs=1e-4)
    best = {r.horse: r for r in histories.work_overlay(target.where("at IS NOT NULL"), spark.createDataFrame(rows, WORKS), "horse", "at", rank_of="best").collect()}
    assert best["a"].readiness_v2 == pytest.approx(ready - 0.10 / 4 + 0.10, abs=1e-4)
    for key in (("b", DAY), (None, DAY), ("a", None)):
        r = got[key]
        assert (r.rank_percentile, r.rank_n, r.count_30, r.coverage, r.days_since_work, r.readiness_v2, r.velocity_z, r.normalized) == (None, 0, 0, 0.0, None, None, None, False)
    assert histories.work_overlay(target, spark.createDataFrame([], WORKS), "horse", "at").count() == 4


def test_starts(spark, target):
    schema = "horse string, date date, surface string, route boolean, finish int, field int, scratched boolean, implied double"
    rows = [("a", ago(0), "d", True, 1, 9, False, 0.9), ("a", ago(-1), "d", True, 1, 9, False, 0.9), ("a", ago(10), "d", True, 1, 5, None, 0.4), ("a", ago(100), "d", False, 5, 5, False, None), ("a", ago(200), "t", True, 2, 3, False, 0.2), ("a", ago(4), "d", True, None, 5, True, 0.8), ("a", ago(9), "d", True, 7, 5, False, None)]
    asked = target.selectExpr("*", "'d' AS surface_today", "true AS long_today")
    got = {(r.horse, r["at"]): r for r in histories.start_features(asked, spark.createDataFrame(rows, schema), "horse", "at", "surface_today", "long_today").collect()}
    a = got["a", DAY]
    w = [math.exp(-0.01 * k) for k in (10, 100, 200)]
    share = (w[0] * 1 + w[1] * 0 + w[2] * 0.5) / sum(w)
    assert (a.attempts, a.starts, a.wins, a.places, a.shows, a.excluded, a.starts_90, a.days_since_start, a.fit_n) == (5, 4, 1, 1, 0, 1, 2, 9, 2)
    assert a.scratch_rate == 0.2 and a.coverage == 0.4 and a.finish_share == pytest.approx(0.4 * share + 0.3, abs=1e-4)
    assert a.fit_share == pytest.approx((w[0] + 1) / (w[0] + 2), abs=1e-4) and a.publicness == pytest.approx((0.4 * w[0] + 0.2 * w[2] + 0.3) / (w[0] + w[2] + 3), abs=1e-4)
    b = got["b", DAY]
    assert (b.attempts, b.days_since_start, b.finish_share, b.fit_share, b.publicness, b.scratch_rate, b.excluded) == (0, None, 0.5, 0.5, 0.1, None, 0)


def test_speed_figures_by_source(spark):
    members = spark.createDataFrame([(1, "a", None, None, None), (2, "b", None, 90.0, None), (3, "c", None, None, None), (4, "d", None, None, None), (5, None, None, None, None)], "id int, horse string, last double, best double, avg double")
    results = spark.createDataFrame([("a", k, k, 80 + k, k == 7) for k in range(8)] + [("c", 1, 1, None, False)], "horse string, time int, tie int, figure int, scratched boolean")
    starts = spark.createDataFrame([(3, 1, 2, 5), (3, 2, 1, 5), (3, 6, 1, 5), (4, 1, 3, 1), (1, 1, 1, 5)], "id int, nth int, finish int, field int")
    got = {r.id: tuple(r)[2:] for r in histories.speed_figures(members, results, starts, "id", "horse").collect()}
    assert got == {1: (86.0, 86.0, 84.0, "results"), 2: (None, 90.0, None, "entries"), 3: (105.0, 120.0, 115.0, "derived"), 4: (None, None, None, "none"), 5: (None, None, None, "none")}


def test_targets_go_with_their_history_in_one_shuffle(spark):
    """No join, one shuffle by key into the parts that are asked for; targets without key or day, told twice, or before all history keep their rows."""
    rows = spark.createDataFrame([("a", dt.date(2026, 1, 1), 2.0), ("a", dt.date(2026, 1, 3), 3.0), (None, dt.date(2026, 1, 1), 9.0), ("a", None, 9.0), ("b", dt.date(2026, 1, 2), 5.0)], "horse string, date date, x double")
    asked = spark.createDataFrame([(1, "a", dt.date(2026, 1, 3)), (1, "a", dt.date(2026, 1, 3)), (2, "a", dt.date(2026, 1, 9)), (3, None, dt.date(2026, 1, 9)), (4, "a", None), (5, "b", dt.date(2026, 1, 2)), (6, "c", dt.date(2026, 1, 9))], "id int, horse string, at date")
    got = histories.running_sums(asked, rows, ["horse"], "at", "date", {"s": F.col("x")}, {"w": F.lit(1)}, spans=(7,), seen=F.col("x") < 3, own=("s",), parts=5)
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(horse" in plan and "Join" not in plan and got.rdd.getNumPartitions() == 5
    assert sorted((r.id, r.s, r.s_7, r.s_own, r.days_off) for r in got.collect()) == [(1, 2.0, 2.0, 3.0, 2), (1, 2.0, 2.0, 3.0, 2), (2, 5.0, 3.0, 0.0, 8), (3, 0.0, 0.0, 0.0, None), (4, 0.0, 0.0, 0.0, None), (5, 0.0, 0.0, 5.0, None), (6, 0.0, 0.0, 0.0, None)]
