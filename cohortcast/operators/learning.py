"""Learning to rank members: features to calibrated probabilities with pyspark.ml, judged and calibrated out of fold."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortcast.operators.cut import cut
from cohortcast.operators.windows import share


def bounds(quantiles: list[float], bins: int) -> list[float]:
    """Where bins begin, but the first: at each value if there are no more than bins, else at evenly spaced quantiles. quantiles: many, in order, least and greatest included."""
    values = sorted(set(quantiles))
    if len(values) > bins:
        values = sorted({quantiles[round(k * (len(quantiles) - 1) / (bins - 1))] for k in range(bins)})
    return values[1:] or values or [0.0]


def fit_classifier(train: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 4, seed: int = 7, bins: int = 32):
    """A pipeline of median imputation, quantile bins, assembly and gradient-boosted trees; its model adds raw_p. Features without any value are 0.

    Trees split at the bounds of bins, so rows of equal bins and label are one point to them, weighted by their number. All rows are read twice, for quantiles
    (to 0.001) and for points; the rounds of boosting go over the points, of which there are no more than bins ** features * labels, however many rows.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Bucketizer, Imputer, VectorAssembler

    filled, binned = [f"{c}_filled" for c in features], [f"{c}_bin" for c in features]
    found = train.select(*[F.col(c).cast("double").alias(c) for c in features]).approxQuantile(features, [k / 1000 for k in range(1001)], 0.001)
    medians = train.sparkSession.createDataFrame([tuple(q[500] if q else 0.0 for q in found)], ", ".join(f"`{c}` double" for c in features))
    imputer = Imputer(inputCols=features, outputCols=filled).fit(medians)
    cutter = Bucketizer(splitsArray=[[-math.inf, *bounds(q, bins), math.inf] for q in found], inputCols=filled, outputCols=binned)
    assembler = VectorAssembler(inputCols=binned, outputCol="features")
    points = cut(cutter.transform(imputer.transform(train)).groupBy(*binned, label).agg(F.count("*").cast("double").alias("weight")).sortWithinPartitions(*binned, label))
    boosted = GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxIter=trees, maxDepth=depth, maxBins=bins, seed=seed).fit(assembler.transform(points))
    return PipelineModel(stages=[imputer, cutter, assembler, boosted])


def raw_scores(model, df: DataFrame, out: str = "raw") -> DataFrame:
    """df with the model's chance of the positive class."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).select(*df.columns, F.get(vector_to_array("probability"), F.lit(1)).alias(out))


def predict(model, df: DataFrame, group: str, out: str = "p") -> DataFrame:
    """Chances of the positive class, made to sum to one in each group."""
    return share(raw_scores(model, df, "_raw"), group, "_raw", out).select(*df.columns, out)


def calibrate(scored: DataFrame, p: str, label: str, digits: int = 4):
    """An isotonic fit of outcomes on probabilities, which are summed by their rounded value first: at most 10**digits + 1 weighted points are fitted, however many rows there are."""
    from pyspark.ml.regression import IsotonicRegression

    points = scored.where(F.col(p).isNotNull() & F.col(label).isNotNull()).groupBy(F.round(p, digits).alias("_p")).agg(F.avg(F.col(label).cast("double")).alias("_y"), F.count("*").cast("double").alias("_w"))
    return IsotonicRegression(featuresCol="_p", labelCol="_y", weightCol="_w").fit(cut(points))


def calibrated(model, df: DataFrame, p: str, out: str) -> DataFrame:
    """df with the calibrator's value of p; between fitted points it is a line, beyond them the end."""
    return model.setFeaturesCol(p).setPredictionCol(out).transform(df)


@dataclass(frozen=True)
class Fold:
    """A block of days to test on, and the day before which rows may be learnt from."""

    number: int
    train_before: dt.date
    test_from: dt.date
    test_to: dt.date
    train_groups: int


def chronological_folds(df: DataFrame, date: str, group: str, folds: int = 5, least_groups: int = 30, embargo_days: int = 1) -> list[Fold]:
    """Folds of an expanding window. Distinct days are cut into folds + 1 blocks; the first is learnt from only, each other is tested once.

    Learnt from are days before the block's first day less the embargo. Folds with fewer than `least_groups` groups to learn from
    are left out. Only a row for each fold comes to the driver; groups are counted by day, so a window goes over days alone.
    """
    if folds < 1:
        raise ValueError("folds must be at least 1")
    days = cut(df.where(F.col(date).isNotNull()).groupBy(F.to_date(date).alias("_day")).agg(F.count_distinct(group).alias("_groups")))  # read three times
    n = days.count()
    per = -(-n // (folds + 1)) or 1
    nth = F.row_number().over(Window.orderBy("_day")) - 1
    numbered = days.withColumn("_fold", F.least(F.floor(nth / per), F.lit(folds)).cast("int"))
    blocks = numbered.where("_fold > 0").groupBy("_fold").agg(F.min("_day").alias("a"), F.max("_day").alias("b")).orderBy("_fold").collect()
    if not blocks:
        return []
    before = [r.a - dt.timedelta(days=embargo_days) for r in blocks]
    known = days.agg(*[F.coalesce(F.sum(F.when(F.col("_day") < F.lit(c), F.col("_groups"))), F.lit(0)).alias(f"c{k}") for k, c in enumerate(before)]).first()
    return [Fold(r["_fold"], c, r.a, r.b, known[k]) for k, (r, c) in enumerate(zip(blocks, before)) if known[k] >= max(least_groups, 1)]


def training_rows(df: DataFrame, date: str, fold: Fold) -> DataFrame:
    return df.where(F.to_date(date) < F.lit(fold.train_before))


def test_rows(df: DataFrame, date: str, fold: Fold) -> DataFrame:
    return df.where(F.to_date(date).between(F.lit(fold.test_from), F.lit(fold.test_to)))


test_rows.__test__ = False  # not a test


def out_of_fold(df: DataFrame, date: str, label: str, folds: list[Fold], fit_predict: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame | None:
    """Forecasts of each fold's rows by what was learnt before it. fit_predict(train, test) gets test rows without labels. A fold is a job over its rows; none at all: None."""
    out = None
    for fold in folds:
        part = fit_predict(training_rows(df, date, fold), test_rows(df, date, fold).drop(label)).withColumn("fold", F.lit(fold.number))
        out = part if out is None else out.unionByName(part)
    return out


def cross_calibrated(oof: DataFrame, date: str, p: str, label: str, folds: list[Fold], out: str = "calibrated") -> DataFrame:
    """oof with each fold's p calibrated by out-of-fold rows before it alone (less the embargo); where there are none, p stays as it is. Store oof before, for each fold reads the ones before it."""
    parts = []
    for fold in folds:
        mine, earlier = oof.where(F.col("fold") == fold.number), training_rows(oof, date, fold)
        known = bool(earlier.where(F.col(label).isNotNull()).head(1))
        parts.append(calibrated(calibrate(earlier, p, label), mine, p, out) if known else mine.withColumn(out, F.col(p)))
    done = parts[0]
    for part in parts[1:]:
        done = done.unionByName(part)
    return done


def metrics_of(df: DataFrame, by: list[str], group: str, forecasts: list[str], label: str, order: str) -> DataFrame:
    """`forecast_metrics` of several forecasts of the same rows, as <forecast>_log_loss and so on, in one pass: windows and sums by group share a shuffle."""
    y, scored, sums, means = F.col(label).cast("double"), df, [], []
    for k, p in enumerate(forecasts):
        q = F.least(F.greatest(F.col(p), F.lit(1e-9)), F.lit(1 - 1e-9))
        nth = F.row_number().over(Window.partitionBy(*by, group).orderBy(F.desc(p), order))
        scored = scored.withColumn(f"_nth{k}", nth)
        loss = -(y * F.log(q) + (1 - y) * F.log(1 - q))
        sums += [F.sum(loss).alias(f"_loss{k}"), F.sum(F.pow(F.col(p) - y, 2)).alias(f"_brier{k}"), F.max(F.when(F.col(f"_nth{k}") == 1, y)).alias(f"_one{k}"), F.max(F.when(F.col(f"_nth{k}") <= 3, y)).alias(f"_three{k}")]
        won = F.col("_won") == 1
        means += [(F.sum(f"_loss{k}") / F.sum("_n")).alias(f"{p}_log_loss"), (F.sum(f"_brier{k}") / F.sum("_n")).alias(f"{p}_brier"), F.avg(F.when(won, F.col(f"_one{k}"))).alias(f"{p}_top1"), F.avg(F.when(won, F.col(f"_three{k}"))).alias(f"{p}_top3")]
    groups = scored.groupBy(*by, group).agg(F.count("*").alias("_n"), F.max(y).alias("_won"), *sums)
    return groups.groupBy(*by).agg(F.sum("_n").alias("rows"), F.count("*").alias("groups"), *means)


def forecast_metrics(df: DataFrame, by: list[str], group: str, p: str, label: str, order: str) -> DataFrame:
    """rows, groups, log loss (p kept 1e-9 from 0 and 1) and Brier score a row; share of groups, of those with a winner, whose most
    probable member won (top1) and whose three most probable hold the winner (top3). Of equal p the smaller `order` comes first."""
    found = metrics_of(df, by, group, [p], label, order)
    return found.select(*by, "rows", "groups", *[F.col(f"{p}_{c}").alias(c) for c in ("log_loss", "brier", "top1", "top3")])


@dataclass
class Fitted:
    """A model, its calibrator (or none) and the columns that it reads, in order."""

    model: object
    calibrator: object
    features: list[str]


def aligned(df: DataFrame, features: list[str]) -> DataFrame:
    """df with every feature as a double: what isn't a number is null, and so is a missing column."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") if c in df.columns else F.lit(None).cast("double") for c in features})


def serve(fitted: Fitted, df: DataFrame, group: str, order: str) -> DataFrame:
    """df with p (calibrated, summing to one in each group, six digits), fair_odds (1 / p - 1) and model_rank (of equal p by `order`)."""
    scored = raw_scores(fitted.model, aligned(df, fitted.features), "_raw")
    if fitted.calibrator is not None:
        scored = calibrated(fitted.calibrator, scored, "_raw", "_cal")
    else:
        scored = scored.withColumn("_cal", F.col("_raw"))
    total = F.sum("_cal").over(Window.partitionBy(group))
    shared = scored.withColumn("_p", F.when(total > 0, F.col("_cal") / total).otherwise(F.col("_cal")))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_p"), order))
    given = df.columns + [c for c in fitted.features if c not in df.columns]
    return shared.withColumn("model_rank", rank).select(*given, F.round("_p", 6).alias("p"), F.when(F.col("_p") > 0, F.round(1 / F.col("_p") - 1, 1)).alias("fair_odds"), "model_rank")


def save_fitted(spark: SparkSession, fitted: Fitted, root: str, segment: str, version: str) -> None:
    """Stores model and calibrator under root, then the registry's row: what has no row isn't seen by `load_fitted`."""
    at = f"{root}/{segment}/{version}"
    fitted.model.write().overwrite().save(f"{at}/model")
    if fitted.calibrator is not None:
        fitted.calibrator.write().overwrite().save(f"{at}/calibrator")
    row = (segment, version, at, fitted.calibrator is not None, fitted.features)
    spark.createDataFrame([row], "segment string, version string, path string, calibrated boolean, features array<string>").coalesce(1).write.mode("append").parquet(f"{root}/registry")


def load_fitted(spark: SparkSession, root: str, segment: str, pooled: str = "pooled") -> Fitted:
    """The segment's model of the greatest version, else the pooled one's."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.regression import IsotonicRegressionModel

    rows = spark.read.parquet(f"{root}/registry").where(F.col("segment").isin(segment, pooled))
    best = rows.orderBy(F.col("segment") != segment, F.desc("version")).first()
    if best is None:
        raise LookupError(f"neither {segment} nor {pooled} has a model")
    return Fitted(PipelineModel.load(f"{best.path}/model"), IsotonicRegressionModel.load(f"{best.path}/calibrator") if best.calibrated else None, list(best.features))


def sufficiency(df: DataFrame, segment: str, group: str, least_groups: int, least_rows: int) -> DataFrame:
    """Segments with their counts, and whether they suffice for a model of their own (else the pooled one serves)."""
    return df.groupBy(segment).agg(F.count_distinct(group).alias("groups"), F.count("*").alias("rows")).withColumn("model", F.when((F.col("groups") >= least_groups) & (F.col("rows") >= least_rows), F.col(segment)).otherwise("pooled"))


def third_of_groups(df: DataFrame, family: str, group: str, date: str) -> DataFrame:
    """(family, group, fold): the groups of each family in order of day and group, cut into TRAIN, VALIDATION and TEST of equal size (the first ones one larger where they must).

    Groups are numbered in two levels, by day and inside a day, so that a family's window goes over its days only.
    """
    groups = df.groupBy(family, group).agg(F.min(F.to_date(date)).alias("_day"))
    days = groups.groupBy(family, "_day").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(family)
    known = days.withColumn("_before", F.coalesce(F.sum("_n").over(w.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_n").over(w)).drop("_n")
    at = F.col("_before") + F.row_number().over(Window.partitionBy(family, "_day").orderBy(group)) - 1
    base, more = F.floor(F.col("_total") / 3), F.col("_total") % 3
    first, second = base + F.least(more, F.lit(1)), 2 * base + F.least(more, F.lit(2))
    placed = groups.join(known, [family, "_day"]).withColumn("_at", at)
    return placed.select(family, group, F.when(F.col("_at") < first, "TRAIN").when(F.col("_at") < second, "VALIDATION").otherwise("TEST").alias("fold"))


def readiness(rows: DataFrame, contracts: DataFrame, family: str, group: str, date: str, least_groups: int = 30, least_wins: int = 30) -> DataFrame:
    """What keeps each family from a trained and calibrated model: counts, coverage, whether three chronological folds are viable, and blockers in order.

    rows: family, group, date, won, and the flags as_of, outcome, lineage, features (null: false); a row that has all four is eligible.
    contracts: family, version, artifact (path), calibration (path), method, audited (time); a family without a row has no artifact.
    """
    flags = ["as_of", "outcome", "lineage", "features"]
    whole = rows.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in flags}).withColumn("_ok", F.expr(" AND ".join(f"coalesce({c}, false)" for c in flags)))
    ok = whole.where("_ok")
    folds = ok.join(third_of_groups(ok, family, group, date), [family, group]).groupBy(family, "fold").agg(F.count_distinct(group).alias("_g"), F.count_if("won").alias("_w"))
    viable = folds.groupBy(family).agg(((F.count("*") == 3) & (F.min("_g") >= least_groups) & (F.min("_w") >= least_wins)).alias("viable"))
    sums = whole.groupBy(family).agg(
        F.count("*").alias("members"), F.count_distinct(group).alias("groups"), F.count_if("_ok").alias("eligible_members"), F.count_distinct(F.when(F.col("_ok"), F.col(group))).alias("eligible_groups"), F.count_if(F.col("_ok") & F.col("won")).alias("eligible_wins"),
        *[F.round(F.avg(F.col(c).cast("double")), 6).alias(f"{c}_coverage") for c in flags],
    )
    known = sums.join(viable, family, "left").join(contracts, family, "left").withColumn("viable", F.coalesce("viable", F.lit(False)))
    missing = F.col("version").isNull()
    artifact = F.when(missing, "MODEL_ARTIFACT_MISSING").when(F.col("artifact").isNull(), "MODEL_ARTIFACT_UNREADABLE").when(F.lower("version").contains("seed"), "SEED_ONLY_NOT_PRODUCTION_ELIGIBLE").otherwise("ARTIFACT_PRESENT_NOT_PRODUCTION_ELIGIBLE")
    calibration = F.when(missing | F.col("artifact").isNull() | F.col("method").isNull(), "CALIBRATION_MISSING").when(F.col("audited").isNull(), "CALIBRATION_UNAUDITED").when(F.col("calibration").isNull(), "CALIBRATION_MISSING").when(~F.col("viable"), "SPLIT_INSUFFICIENT").otherwise("READY_FOR_TRAINING_AND_CALIBRATION")
    none = F.col("eligible_members") == 0
    short = lambda c: none | (F.col(f"{c}_coverage") < 1)
    judged = known.withColumn("artifact_status", artifact).withColumn("calibration_status", calibration)
    blockers = [
        F.when(short("as_of"), "NO_AS_OF_VALID_HISTORICAL_CORPUS"), F.when(short("outcome"), "OUTCOME_LINKAGE_INSUFFICIENT"), F.when(short("features"), "FEATURES_INSUFFICIENT"), F.when(~F.col("viable"), "SPLIT_INSUFFICIENT"),
        F.when(missing, "MODEL_ARTIFACT_MISSING").otherwise("TRAINED_ARTIFACT_NOT_PRODUCTION_ELIGIBLE"), F.when(F.col("calibration_status") != "READY_FOR_TRAINING_AND_CALIBRATION", F.col("calibration_status")),
    ]
    return judged.withColumn("blockers", F.concat_ws(";", F.array_compact(F.array(*blockers)))).drop("version", "artifact", "calibration", "method", "audited")


def first_blocker(blockers: Column) -> Column:
    return F.coalesce(F.nullif(F.substring_index(blockers, ";", 1), F.lit("")), F.lit("NONE"))
