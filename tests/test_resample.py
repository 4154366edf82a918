"""Bootstrap sums against numpy on the same weights; verdicts; drawdown in two levels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortcast.operators import aggregates, backtest, resample


def test_weights_are_poisson():
    w = resample.weights(np.random.default_rng(1).integers(0, 2**63, 4000).astype(np.uint64), 300)
    assert w.mean() == pytest.approx(1, abs=0.005) and w.var() == pytest.approx(1, abs=0.01)
    assert (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.003) and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.05


def test_intervals_equal_numpy(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.choice(["a", "b", None]), rnd.gauss(1, 2), rnd.choice([1.0, 2.0, None])) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, part string, x double, w double").repartition(5)
    keys = {r.id: r.k for r in df.select("id", resample.group_key("id", 7).alias("k")).collect()}
    for part in ("a", "b", None):
        mine = [r for r in rows if r[1] == part]
        x, d = np.array([r[2] for r in mine]), np.array([r[3] or 0.0 for r in mine])
        w = resample.weights(np.array([keys[r[0]] for r in mine], np.int64).view(np.uint64), 2000)
        got = next(r for r in resample.intervals(df, ["part"], "id", {"mean": ("x", None), "ratio": ("x", "w")}).collect() if r.part == part)
        for name, below in (("mean", w.sum(0)), ("ratio", d @ w)):
            lo, hi = np.quantile(x @ w / below, [0.025, 0.975])
            assert got[name] == pytest.approx(x.sum() / (len(x) if name == "mean" else d.sum()))
            assert (got[f"{name}_lo"], got[f"{name}_hi"]) == (pytest.approx(lo), pytest.approx(hi))
        assert got.n == len(mine)


def test_many_strata_and_no_rows(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id", "id % 700 AS s", "1.0 AS x").repartition(3)
    got = resample.intervals(df, ["s"], "id", {"m": ("x", None)}, reps=20).collect()
    assert len(got) == 700 and all(r.m == 1 and r.m_lo in (None, 1.0) for r in got)
    assert resample.intervals(df.where("false"), ["s"], "id", {"m": ("x", None)}, reps=20).collect() == []


def scores(spark, n, gap, seed=1):
    rnd = random.Random(seed)
    rows = [(k, f, 1.0 + rnd.random() + (gap if f == "a" else 0.0), 0.5 + 0.1 * (f == "a")) for k in range(n) for f in "ab"]
    return spark.createDataFrame(rows, "card int, f string, log_loss double, brier double")


@pytest.mark.parametrize(("n", "gap", "said"), [(29, -0.5, "INSUFFICIENT_DATA"), (60, -0.5, "BETTER_THAN_REFERENCE"), (60, 0.5, "WORSE_THAN_REFERENCE"), (60, 0.0, "NOT_DISTINGUISHABLE")])
def test_verdicts_of_forecasts(spark, n, gap, said):
    got = aggregates.paired_verdict(scores(spark, n, gap), "card", "f", "a", "b").first()
    assert got.verdict == said and got.n == n and got.brier == pytest.approx(0.1) and got.brier_lo == pytest.approx(0.1)
    plain = aggregates.paired(scores(spark, n, gap), "card", "f", "a", "b").first()
    rows = {(r.card, r.f): r.log_loss for r in scores(spark, n, gap).collect()}
    d = np.array([rows[k, "a"] - rows[k, "b"] for k in range(n)])
    assert plain.mean_diff == pytest.approx(d.mean()) and plain.sd == pytest.approx(d.std(ddof=1))
    assert plain.needed == int(np.ceil((1.96 * d.std(ddof=1) / (0.01 * np.mean([rows[k, "b"] for k in range(n)]))) ** 2))


def bets(spark, rows):
    return spark.createDataFrame([("p", k, k // 7, *r) for k, r in enumerate(rows)], "policy string, bet int, day int, status string, net double, p double, decimal double, clv double")


def test_performance_and_verdicts_of_bets(spark):
    rnd = random.Random(9)
    won = [rnd.random() < 0.5 for _ in range(150)]
    rows = [("WON" if w else "LOST", 4.0 if w else -2.0, 0.4, 3.0, rnd.choice([0.1, 0.2, -0.01])) for w in won] + [("REFUNDED_SCRATCH", 0.0, 0.4, 3.0, None), ("HELD_NO_RESULT", 0.0, 0.4, 3.0, None)]
    df = bets(spark, rows)
    got = backtest.performance(df, ["policy"], F.lit(2.0)).first()
    assert (got.bets, got.refunded, got.staked, got.wins) == (150, 1, 300.0, sum(won))
    profit = sum(4.0 if w else -2.0 for w in won)
    assert got.profit == profit and got.roi == pytest.approx(profit / 300) and got.returned == 300 + profit
    assert got.wins_z == pytest.approx((sum(won) - 60) / np.sqrt(150 * 0.24)) and got.positive_clv == pytest.approx(np.mean([r[4] > 0 for r in rows[:150]]))
    said = backtest.verdicts(df, ["policy"], "bet", F.lit(2.0)).first()
    assert said.verdict == "PROFITABLE_AFTER_TAKEOUT" and said.clv_verdict == "BEATING_THE_CLOSE" and said.roi_lo < said.roi < said.roi_hi
    few = backtest.verdicts(bets(spark, rows[:40]), ["policy"], "bet", F.lit(2.0)).first()
    assert few.verdict == few.clv_verdict == "INSUFFICIENT_DATA"
    assert backtest.performance(df.where("false"), ["policy"], F.lit(2.0)).collect() == []


def test_drawdown_in_two_levels(spark):
    rnd = random.Random(5)
    nets = [rnd.choice([-3.0, -1.0, 2.0, 0.5]) for _ in range(400)]
    df = bets(spark, [("LOST", x, 0.1, 3.0, None) for x in nets])
    peak = balance = worst = 0.0
    for x in nets:
        balance += x
        peak = max(peak, balance)
        worst = max(worst, peak - balance)
    assert backtest.max_drawdown(df, ["policy"], "day", ["bet"]).first().max_drawdown == pytest.approx(worst)
