"""Normalisers, by hand-computed values."""

import pytest
from pyspark.sql import functions as F

from cohortcast.functions import odds, text


def values(spark, expr, inputs, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], f"k int, v {kind}")
    return [r.x for r in df.select("k", expr(F.col("v")).alias("x")).orderBy("k").collect()]


def test_prices(spark):
    got = values(spark, odds.text_to_decimal, ["9/2", "+450", "-200", "5.5", "even", "EVS", "7-2", "0/0", "x", None, "1", "+50"])
    assert got == [5.5, 5.5, 1.5, 5.5, 2.0, 2.0, 4.5, None, None, None, None, None]
    assert values(spark, odds.decimal_to_american, [2.0, 5.5, 1.5, 1.0], "double") == [100, 450, -200, None]
    assert values(spark, odds.fair_to_one, [0.25, 0.0, None], "double") == [3.0, None, None]


def test_stakes(spark):
    df = spark.createDataFrame([(0.5, 3.0), (0.2, 3.0), (0.9, 2.0)], "p double, d double")
    got = [tuple(r) for r in df.select(F.round(odds.kelly(F.col("p"), F.col("d")), 6), odds.kelly(F.col("p"), F.col("d"), 0.1), odds.round_stake(F.col("d") * 2.5, F.lit(2.0))).collect()]
    assert got == [(0.25, 0.1, 6.0), (0.0, 0.0, 6.0), (0.8, 0.1, 4.0)]


def test_power_devig(spark):
    got = spark.createDataFrame([([0.6, 0.3, 0.3],), ([0.5, 1.2],)], "ps array<double>").select(odds.devig_power(F.col("ps")).alias("q")).collect()
    assert sum(got[0].q) == pytest.approx(1) and got[1].q is None and got[0].q[0] > 0.5


def test_distances(spark):
    got = values(spark, text.furlongs, ["6f", "7.0f", "6 1/2 furlongs", "1 1/16 miles", "1m", "1320 yards", "8", "1/2 mile", "far", None])
    assert got == [6.0, 7.0, 6.5, 8.5, 8.0, 6.0, 8.0, 4.0, None, None]


def test_times_money_flags_dates(spark):
    assert values(spark, text.seconds, ["1:10.40", "58.2", "x", None]) == [70.4, 58.2, None, None]
    assert values(spark, text.money, ["$1,250", "7.5", "-"]) == [1250.0, 7.5, None]
    assert values(spark, text.flag, ["✓", "No", "maybe", None, ""]) == [True, False, None, None, False]
    assert [str(x) for x in values(spark, text.any_date, ["2026-05-02", "05/02/2026", "20260502", "May 2, 2026", "soon"])] == ["2026-05-02"] * 4 + ["None"]


def test_names(spark):
    assert values(spark, text.ascii_key, ["  Señor O'Ñeil (IRE)", "A--B", None]) == ["SENOR O NEIL", "A B", None]
    assert values(spark, text.squash_key, ["O'Neil II"]) == ["ONEILII"]
    assert values(spark, text.person_tokens, ["Ortiz, Jr., José L."]) == [["JOSE", "ORTIZ"]]


def test_spelled_distances_and_zones(spark):
    from cohortcast.functions.text import spelled_furlongs, zone
    from cohortcast.operators.joins import by_distinct
    from cohortcast.queries.measures import SPELLINGS

    rows = [*SPELLINGS, ("", None), (None, None), ("miles", None), ("Twenty One Furlongs", 21.0), ("twenty twenty one furlongs", 41.0), ("TWO  miles, and a half", None), ("One And One Sixteenth Miles", 8.5)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, t string")
    got = {r.k: r.f for r in by_distinct(df, "t", "f", spelled_furlongs).collect()}
    assert got == {k: f for k, (_, f) in enumerate(rows)}
    asked = [("NY", 3, "America/New_York"), (" ny ", 3, "America/New_York"), ("CO", 0, None), ("ID", 0, None), ("ID", 1, "America/Denver"), ("OR", 0, "America/Los_Angeles"), ("HI", 0, None), (None, 3, None), ("NY", None, None), ("TN", 3, "America/New_York")]
    z = spark.createDataFrame([(k, *x[:2]) for k, x in enumerate(asked)], "k int, s string, h int").select("k", zone(F.col("s"), F.col("h")).alias("z"))
    assert {r.k: r.z for r in z.collect()} == {k: x[2] for k, x in enumerate(asked)}


def test_dark_horses(spark):
    from cohortcast.operators.scoring import dark_horses

    schema = "card int, m int, p double, index double, development double, energy double, pace double, distance double, publicness double, late_z double, rail_closer boolean, tactical_inner boolean, tactical_outer boolean"
    rows = [(1, 1, 0.5, 1.0, 2.0, 2.0, 5.0, 5.0, 9.0, 0.0, True, False, None), (1, 2, 0.3, 1.0, 1.0, 1.0, 5.0, 5.0, 9.0, 0.0, None, None, True), (1, 3, 0.1, 1.0, 5.0, 5.0, 5.0, 5.0, 9.0, None, False, None, None), (1, 4, 0.07, 1.0, 8.0, 4.0, 6.0, 1.0, 7.0, 0.5, False, False, False), (1, 5, 0.03, 1.0, 9.0, 9.0, 8.0, 1.0, 7.0, 1.0, False, False, False)]
    calm = [(2, m, p, 0.69, *x) for (_, m, p, _, *x) in rows]
    unknown = [(3, 1, 0.0, 0.9, *[None] * 9), (3, 2, 0.0, 0.9, *[None] * 9)]
    got = {(r.card, r.m): r for r in dark_horses(spark.createDataFrame(rows + calm + unknown, schema), "card", "index").collect()}
    moved = min(0.10, 0.6 * 0.5)
    weights = {4: 0.6 * 0.5, 5: 0.9 * 1.0}
    raw = {1: 0.5 * 0.9 - moved, 2: 0.3 * 1.05, 3: 0.1, 4: 0.07 + moved * weights[4] / 1.2, 5: 0.035 + moved * weights[5] / 1.2}
    for m in raw:
        assert abs(got[1, m].p_patched - raw[m] / sum(raw.values())) < 1e-9 and abs(got[2, m].p_patched - got[2, m].p) < 1e-9
    assert [got[1, m].dark_tier for m in range(1, 6)] == ["none", "none", "none", "light", "strong"] == [got[2, m].dark_tier for m in range(1, 6)]
    assert got[3, 1].p_patched is None and not got[3, 1].dark_horse and got[3, 1].dark_tier == "none"
