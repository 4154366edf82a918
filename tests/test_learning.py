"""Folds, calibration and serving: nothing learns from its own future, and stored models are found again."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from cohortcast.operators import learning, windows

FIRST = dt.date(2026, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(4)
    out = []
    for card in range(240):
        day, won = FIRST + dt.timedelta(card // 4), rnd.randrange(4)
        for member in range(4):
            out.append((card, member, day, float(member == won), rnd.gauss(2.0 * (member == won), 1.0), 7.0, rnd.choice([None, 1.0])))
    return spark.createDataFrame(out, "card int, member int, day date, label double, x double, flat double, holes double").cache()


def test_folds_never_learn_from_their_future(spark, rows):
    folds = learning.chronological_folds(rows, "day", "card", folds=5, least_groups=30, embargo_days=2)
    assert [f.number for f in folds] == [1, 2, 3, 4, 5]
    seen = []
    for f in folds:
        train, test = learning.training_rows(rows, "day", f), learning.test_rows(rows, "day", f)
        last, first = train.agg(F.max("day")).first()[0], test.agg(F.min("day")).first()[0]
        assert last < first - dt.timedelta(2) and first == f.test_from
        assert train.select("card").distinct().count() == f.train_groups
        seen += [r.day for r in test.select("day").distinct().collect()]
    assert len(seen) == len(set(seen)) == 50 and min(seen) == FIRST + dt.timedelta(10)
    assert [f.number for f in learning.chronological_folds(rows, "day", "card", 5, least_groups=100, embargo_days=2)] == [3, 4, 5]
    times = rows.withColumn("day", F.col("day").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, member)"))
    assert learning.chronological_folds(times, "day", "card", embargo_days=2) == folds
    assert learning.chronological_folds(rows.where("false"), "day", "card") == []


def test_a_constant_feature_gives_the_base_rate(rows):
    """The model can only say one number, which calibration on earlier folds turns into the share of winners."""
    folds = learning.chronological_folds(rows, "day", "card", folds=2)
    oof = learning.out_of_fold(rows, "day", "label", folds, lambda train, test: learning.raw_scores(learning.fit_classifier(train, ["flat"], "label", trees=3), test))
    got = learning.cross_calibrated(oof.join(rows.select("card", "member", "label"), ["card", "member"]), "day", "raw", "label", folds).select("fold", "raw", "calibrated").distinct().collect()
    assert len(got) == 2 and {r.fold: r.calibrated for r in got}[2] == pytest.approx(0.25)


def test_labels_of_the_test_rows_are_not_given(rows):
    folds = learning.chronological_folds(rows, "day", "card")

    def look(train, test):
        assert "label" not in test.columns and "label" in train.columns
        return test.withColumn("raw", F.lit(0.25))

    assert learning.out_of_fold(rows, "day", "label", folds, look).count() == 50 * 16
    assert learning.out_of_fold(rows, "day", "label", [], look) is None


def test_calibrators_see_earlier_folds_only(spark, rows):
    """Labels of a later fold are turned round: what is calibrated before it stays as it is."""
    folds = learning.chronological_folds(rows, "day", "card", folds=4)
    scored = learning.out_of_fold(rows, "day", "label", folds, lambda train, test: test.withColumn("raw", 1 / (1 + F.exp(-F.col("x")))))
    known = scored.join(rows.select("card", "member", "label"), ["card", "member"])
    turned = known.withColumn("label", F.when(F.col("fold") >= 3, 1 - F.col("label")).otherwise(F.col("label")))
    a, b = ({(r.card, r.member): (r.fold, r.raw, r.calibrated) for r in learning.cross_calibrated(df, "day", "raw", "label", folds).collect()} for df in (known, turned))
    assert all(a[k] == b[k] for k in a if a[k][0] <= 3) and any(a[k] != b[k] for k in a if a[k][0] == 4)
    assert all(raw == out for fold, raw, out in a.values() if fold == 1) and all(0 <= out <= 1 for _, _, out in a.values())
    by_raw = sorted((raw, out) for fold, raw, out in a.values() if fold == 4)
    assert all(p[1] <= q[1] + 1e-12 for p, q in zip(by_raw, by_raw[1:]))


def test_isotonic_points_are_few_and_right(spark):
    df = spark.createDataFrame([(0.1, 0.0), (0.1, 1.0), (0.2, 0.0), (0.30001, 1.0), (0.3, 1.0), (None, 1.0), (0.3, None)], "p double, y double")
    model = learning.calibrate(df, "p", "y", digits=2)
    assert model.boundaries.toArray().tolist() == pytest.approx([0.1, 0.2, 0.3]) and model.predictions.toArray().tolist() == pytest.approx([1 / 3, 1 / 3, 1.0])


def test_metrics_against_plain_python(spark, rows):
    df = windows.share(rows.withColumn("e", F.round(F.exp("x"), 1)), "card", "e", "p").withColumn("half", F.col("card") % 2)
    held = {}
    for r in df.collect():
        held.setdefault((r.half, r.card), []).append((-r.p, r.member, r.label))
    for got in learning.forecast_metrics(df, ["half"], "card", "p", "label", "member").collect():
        mine = [sorted(v) for k, v in held.items() if k[0] == got.half]
        flat = [(-p, y) for v in mine for p, _, y in v]
        loss = -sum(y * math.log(max(p, 1e-9)) + (1 - y) * math.log(max(1 - p, 1e-9)) for p, y in flat) / len(flat)
        assert (got.rows, got.groups) == (len(flat), len(mine)) and got.log_loss == pytest.approx(loss) and got.brier == pytest.approx(sum((p - y) ** 2 for p, y in flat) / len(flat))
        assert got.top1 == pytest.approx(sum(v[0][2] for v in mine) / len(mine)) and got.top3 == pytest.approx(sum(max(y for *_, y in v[:3]) for v in mine) / len(mine))


def test_stored_models_serve_segments(spark, rows, tmp_path):
    root = f"{tmp_path}/models"
    model = learning.fit_classifier(rows, ["x", "holes"], "label", trees=3)
    calibrator = learning.calibrate(learning.raw_scores(model, rows), "raw", "label")
    learning.save_fitted(spark, learning.Fitted(model, calibrator, ["x", "holes"]), root, "pooled", "v1")
    learning.save_fitted(spark, learning.Fitted(model, None, ["x", "holes"]), root, "pooled", "v2")
    learning.save_fitted(spark, learning.Fitted(model, calibrator, ["x", "holes"]), root, "dirt", "v1")
    assert learning.load_fitted(spark, root, "dirt").calibrator is not None
    assert learning.load_fitted(spark, root, "turf").calibrator is None  # the newest pooled one
    with pytest.raises(LookupError):
        learning.load_fitted(spark, root, "turf", pooled="none")
    asked = rows.select("card", "member", F.col("x").cast("string").alias("x"), F.lit("extra").alias("note"))
    got = learning.serve(learning.load_fitted(spark, root, "dirt"), asked, "card", "member").collect()
    sums = {}
    for r in got:
        sums.setdefault(r.card, []).append((r.model_rank, r.p, r.note, r.fair_odds))
    assert len(sums) == 240
    for v in sums.values():
        v.sort()
        assert [k for k, *_ in v] == [1, 2, 3, 4] and sum(p for _, p, *_ in v) == pytest.approx(1, abs=1e-5)
        assert all(a[1] >= b[1] for a, b in zip(v, v[1:])) and all(f == pytest.approx(1 / p - 1, abs=0.06, rel=0.01) for _, p, _, f in v if p > 0)


def test_thirds_keep_groups_and_order(spark):
    df = spark.createDataFrame([("f", g, FIRST + dt.timedelta(g // 3)) for g in range(11) for _ in range(2)] + [("g", 1, FIRST)], "family string, card int, day date")
    got = {(r.family, r.card): r.fold for r in learning.third_of_groups(df, "family", "card", "day").collect()}
    assert [got["f", k] for k in range(11)] == ["TRAIN"] * 4 + ["VALIDATION"] * 4 + ["TEST"] * 3 and got["g", 1] == "TRAIN"


def test_boosting_goes_over_points_not_rows(spark, monkeypatch):
    """Ten times the rows are the same points with ten times the weight, and the same model; a step of the label at a value is found."""
    seen, keep = [], learning.cut

    def told(df):
        out = keep(df)
        seen.append((out.count(), out.agg(F.sum("weight")).first()[0] if "weight" in out.columns else None))
        return out

    monkeypatch.setattr(learning, "cut", told)
    few = spark.range(400).select((F.col("id") / 10).alias("x"), (F.col("id") % 3).alias("kind"), F.lit(None).cast("double").alias("none"), (F.col("id") >= 200).cast("double").alias("label"))
    models = [learning.fit_classifier(few.join(spark.range(n).select(), how="cross"), ["x", "kind", "none"], "label", trees=5, bins=8) for n in (1, 10)]
    assert seen[0][0] == seen[1][0] <= 8 * 3 * 2 and [w for _, w in seen] == [400, 4000]
    asked = spark.createDataFrame([(3.0, 1, None), (37.0, 1, 2.0), (None, 2, None), (500.0, None, None)], "x double, kind long, none double")
    one, ten = ([r.raw for r in learning.raw_scores(m, asked).collect()] for m in models)
    assert one == pytest.approx(ten) and one[0] < 0.2 and one[1] > 0.8 and one[3] > 0.8


def test_bins_hold_each_value_or_even_shares():
    few = [1.0] * 600 + [2.0] * 390 + [9.0] * 11
    assert learning.bounds(few, 32) == [2.0, 9.0] and learning.bounds([7.0] * 1001, 32) == [7.0] and learning.bounds([], 32) == [0.0]
    even = learning.bounds([float(k) for k in range(1001)], 5)
    assert even == [250.0, 500.0, 750.0, 1000.0]


def test_forecasts_are_judged_together_in_one_shuffle(spark, rows):
    df = rows.repartition(3, "card").withColumn("half", F.col("card") % 2).withColumn("p", 1 / (1 + F.exp(-F.col("x")))).withColumn("q", (F.col("member") + 1) / 10)
    both = learning.metrics_of(df, ["half"], "card", ["p", "q"], "label", "member")
    assert both._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning(card") == 1
    got = {r.half: r for r in both.collect()}
    for p in ("p", "q"):
        for r in learning.forecast_metrics(df, ["half"], "card", p, "label", "member").collect():
            assert (r.rows, r.groups, r.log_loss, r.brier, r.top1, r.top3) == pytest.approx((got[r.half].rows, got[r.half].groups, *[got[r.half][f"{p}_{c}"] for c in ("log_loss", "brier", "top1", "top3")]))
