"""Queries that learn: out-of-fold forecasts, calibration on them, metrics, serving, and what keeps families from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortcast.operators import learning, windows
from cohortcast.queries.frames import DATED, dated, once, shared_folder, spread, with_sql

FEATURES = ["price", "post", "n", "cheap"]
r = lambda c, k=6: F.round(c, k).alias(c)


def _rows(spark, d):
    f = dated(spark, d).withColumn("label", (F.col("finish") == 1).cast("double")).withColumn("cheap", F.col("price") / F.col("qty"))
    return f.select("card", "member", "day", "class", "label", "m", *FEATURES)


def _rows_once(spark, d):
    """The rows as a table of the shared folder: folds, learners and labels each read them, and the field is worked out once."""
    return once(_rows(spark, d), "rows")


def _forecasts(spark, d):
    """Out-of-fold forecasts of five folds by boosted trees, raw and calibrated on the folds before."""
    rows = _rows_once(spark, d)
    folds = learning.chronological_folds(rows, "day", "card", folds=5, least_groups=30, embargo_days=1)

    def fit_predict(train, test):
        return learning.raw_scores(learning.fit_classifier(train, FEATURES, "label"), test, "raw").select("card", "member", "day", "seen", "raw")

    # Labels go along under another name, which the learner doesn't read, so that forecasts needn't meet the rows again.
    raw = learning.out_of_fold(rows.withColumn("seen", F.col("label")), "day", "label", folds, fit_predict).withColumnRenamed("seen", "label")
    oof = once(raw, "oof")
    done = learning.cross_calibrated(oof, "day", "raw", "label", folds)
    return windows.share(spread(done, oof.count(), "card"), "card", "calibrated", "p")


def l06_rolling_forecasts(spark, d):
    """Out-of-fold forecasts by fold, raw and calibrated out of fold; then all folds pooled (fold 0)."""
    both = _forecasts(spark, d).withColumn("fold", F.explode(F.array("fold", F.lit(0))))
    found = learning.metrics_of(both, ["fold"], "card", ["p", "raw"], "label", "member")
    return found.select("fold", "rows", "groups", *[f"{p}_{c}" for p in ("p", "raw") for c in ("log_loss", "brier", "top1", "top3")])


def l05_metrics(spark, d):
    """Metrics of the market's shares by class."""
    return learning.forecast_metrics(_rows(spark, d).withColumn("p", F.round("m", 12)), ["class"], "card", "p", "label", "member").select("class", "rows", "groups", *[r(c) for c in ("log_loss", "brier", "top1", "top3")])


L05 = with_sql(DATED, """, s AS (SELECT *, (finish = 1)::INT AS y, round(m, 12) AS q, row_number() OVER (PARTITION BY card ORDER BY round(m, 12) DESC, member) AS k FROM dated),
g AS (SELECT class, card, count(*) AS c, sum(-(y * ln(least(greatest(q, 1e-9), 1 - 1e-9)) + (1 - y) * ln(1 - least(greatest(q, 1e-9), 1 - 1e-9)))) AS l, sum((q - y) ** 2) AS b, max(y) AS won, max(CASE WHEN k = 1 THEN y END) AS one, max(CASE WHEN k <= 3 THEN y END) AS three FROM s GROUP BY 1, 2)
SELECT class, CAST(sum(c) AS BIGINT) AS rows, count(*) AS groups, round(sum(l) / sum(c), 6) AS log_loss, round(sum(b) / sum(c), 6) AS brier, round(avg(CASE WHEN won = 1 THEN one END), 6) AS top1, round(avg(CASE WHEN won = 1 THEN three END), 6) AS top3 FROM g GROUP BY 1""").replace("\n, s AS", ",\ns AS", 1)


def _folds(spark, d):
    return learning.chronological_folds(_rows(spark, d), "day", "card", folds=5, least_groups=30, embargo_days=1)


def l06_folds(spark, d):
    """The folds themselves: days, and cards to learn from."""
    return spark.createDataFrame([(f.number, f.train_before, f.test_from, f.test_to, f.train_groups) for f in _folds(spark, d)], "fold int, train_before date, test_from date, test_to date, train_groups long")


L06 = with_sql(DATED, """, y AS (SELECT day, count(DISTINCT card) AS g, row_number() OVER (ORDER BY day) - 1 AS k, count(*) OVER () AS n FROM dated GROUP BY 1),
b AS (SELECT *, CAST(least(k // CAST(ceil(n / 6) AS BIGINT), 5) AS INT) AS fold FROM y), f AS (SELECT fold, min(day) AS a, max(day) AS z FROM b WHERE fold > 0 GROUP BY 1)
SELECT fold, CAST(a - 1 AS DATE) AS train_before, a AS test_from, z AS test_to, CAST((SELECT sum(g) FROM y WHERE day < a - 1) AS BIGINT) AS train_groups FROM f WHERE (SELECT sum(g) FROM y WHERE day < a - 1) >= 30""").replace("\n, y AS", ",\ny AS", 1)


def l04_calibration(spark, d):
    """Rates by post learnt before each fold, calibrated on the folds before it: what was forecast, calibrated and seen, by fold and tenth."""
    rows = _rows_once(spark, d).withColumn("place", F.least("post", F.lit(8)))
    folds = learning.chronological_folds(rows, "day", "card", folds=5, least_groups=30, embargo_days=1)

    def fit_predict(train, test):
        return test.join(train.groupBy("place").agg(F.avg("label").alias("raw")), "place", "left")

    oof = once(learning.out_of_fold(rows, "day", "label", folds, fit_predict).join(rows.select("card", "member", "label"), ["card", "member"]), "rates")
    done = learning.cross_calibrated(oof.where("raw IS NOT NULL"), "day", "raw", "label", folds)
    return done.groupBy("fold", F.floor(F.col("raw") * 10).cast("int").alias("tenth")).agg(F.count("*").alias("n"), F.round(F.avg("raw"), 4).alias("raw"), F.round(F.avg("calibrated"), 4).alias("calibrated"), F.round(F.avg("label"), 4).alias("seen"))


def l07_serve(spark, d):
    """A model learnt from the first 70 % of days and calibrated on the next 15 % is stored as the pooled one, and serves another segment's cards of the last days. One of its columns is missing there."""
    f = windows.split_by_date(_rows_once(spark, d), "day")
    model = learning.fit_classifier(f.where("part = 'train'"), FEATURES, "label")
    valid = learning.raw_scores(model, f.where("part = 'valid'"), "raw")
    root = shared_folder(spark, "models")
    learning.save_fitted(spark, learning.Fitted(model, learning.calibrate(valid, "raw", "label"), FEATURES), root, "pooled", "v1")
    fitted = learning.load_fitted(spark, root, "turf")
    asked = f.where("part = 'test'").select("card", "member", F.col("price").cast("string").alias("price"), "post", "n")
    return learning.serve(fitted, asked, "card", "member").select("card", "member", "p", "fair_odds", "model_rank")


def l10_readiness(spark, d):
    """Families are classes. Evidence is missing for members of some suppliers; one class has no model, others lack an audit."""
    c = F.col
    f = dated(spark, d).select("class", "card", "day", c("finish") == 1, c("class") != "2-HIGH", (c("class") != "3-MEDIUM") | (c("card") % 7 != 0), F.lit(True), (c("class") != "5-LOW") | (c("jockey") % 11 != 0))
    f = f.toDF("class", "card", "day", "won", "as_of", "outcome", "lineage", "features")
    contracts = spark.createDataFrame([("1-URGENT", "seed_v1", "a", "c", "isotonic", "2026-01-01"), ("2-HIGH", "v2", "a", "c", "isotonic", None), ("3-MEDIUM", "v2", None, "c", "isotonic", "2026-01-01"), ("4-NOT SPECIFIED", "v3", "a", "c", "isotonic", "2026-01-01")], "class string, version string, artifact string, calibration string, method string, audited string")
    out = learning.readiness(f, contracts, "class", "card", "day")
    return out.withColumn("first_blocker", learning.first_blocker(c("blockers")))


L10 = with_sql(DATED, """, f AS (SELECT class, card, day, finish = 1 AS won, class <> '2-HIGH' AS as_of, class <> '3-MEDIUM' OR card % 7 <> 0 AS outcome, true AS lineage, class <> '5-LOW' OR jockey % 11 <> 0 AS features FROM dated),
k AS (SELECT *, as_of AND outcome AND lineage AND features AS ok FROM f),
gr AS (SELECT class, card, min(day) AS day FROM k WHERE ok GROUP BY 1, 2), nu AS (SELECT class, card, row_number() OVER (PARTITION BY class ORDER BY day, card) - 1 AS pos, count(*) OVER (PARTITION BY class) AS t FROM gr),
fo AS (SELECT class, card, CASE WHEN pos < t // 3 + least(t % 3, 1) THEN 0 WHEN pos < 2 * (t // 3) + least(t % 3, 2) THEN 1 ELSE 2 END AS fold FROM nu),
fs AS (SELECT class, fold, count(DISTINCT card) AS g, count(*) FILTER (won) AS w FROM k JOIN fo USING (class, card) WHERE ok GROUP BY 1, 2), vi AS (SELECT class, count(*) = 3 AND min(g) >= 30 AND min(w) >= 30 AS viable FROM fs GROUP BY 1),
co AS (SELECT * FROM (VALUES ('1-URGENT', 'seed_v1', 'a', 'c', 'isotonic', '2026-01-01'), ('2-HIGH', 'v2', 'a', 'c', 'isotonic', NULL), ('3-MEDIUM', 'v2', NULL, 'c', 'isotonic', '2026-01-01'), ('4-NOT SPECIFIED', 'v3', 'a', 'c', 'isotonic', '2026-01-01')) v(class, version, artifact, calibration, method, audited)),
s AS (SELECT class, count(*) AS members, count(DISTINCT card) AS groups, count(*) FILTER (ok) AS eligible_members, count(DISTINCT CASE WHEN ok THEN card END) AS eligible_groups, count(*) FILTER (ok AND won) AS eligible_wins, round(avg(as_of::INT), 6) AS as_of_coverage, round(avg(outcome::INT), 6) AS outcome_coverage, round(avg(lineage::INT), 6) AS lineage_coverage, round(avg(features::INT), 6) AS features_coverage FROM k GROUP BY 1),
j AS (SELECT s.*, coalesce(viable, false) AS viable, version, artifact, calibration, method, audited FROM s LEFT JOIN vi USING (class) LEFT JOIN co USING (class)),
x AS (SELECT *, CASE WHEN version IS NULL THEN 'MODEL_ARTIFACT_MISSING' WHEN artifact IS NULL THEN 'MODEL_ARTIFACT_UNREADABLE' WHEN contains(lower(version), 'seed') THEN 'SEED_ONLY_NOT_PRODUCTION_ELIGIBLE' ELSE 'ARTIFACT_PRESENT_NOT_PRODUCTION_ELIGIBLE' END AS artifact_status,
  CASE WHEN version IS NULL OR artifact IS NULL OR method IS NULL THEN 'CALIBRATION_MISSING' WHEN audited IS NULL THEN 'CALIBRATION_UNAUDITED' WHEN calibration IS NULL THEN 'CALIBRATION_MISSING' WHEN NOT viable THEN 'SPLIT_INSUFFICIENT' ELSE 'READY_FOR_TRAINING_AND_CALIBRATION' END AS calibration_status FROM j),
b AS (SELECT *, concat_ws(';', CASE WHEN eligible_members = 0 OR as_of_coverage < 1 THEN 'NO_AS_OF_VALID_HISTORICAL_CORPUS' END, CASE WHEN eligible_members = 0 OR outcome_coverage < 1 THEN 'OUTCOME_LINKAGE_INSUFFICIENT' END, CASE WHEN eligible_members = 0 OR features_coverage < 1 THEN 'FEATURES_INSUFFICIENT' END, CASE WHEN NOT viable THEN 'SPLIT_INSUFFICIENT' END,
  CASE WHEN version IS NULL THEN 'MODEL_ARTIFACT_MISSING' ELSE 'TRAINED_ARTIFACT_NOT_PRODUCTION_ELIGIBLE' END, CASE WHEN calibration_status <> 'READY_FOR_TRAINING_AND_CALIBRATION' THEN calibration_status END) AS blockers FROM x)
SELECT * EXCLUDE (version, artifact, calibration, method, audited), coalesce(nullif(split_part(blockers, ';', 1), ''), 'NONE') AS first_blocker FROM b""").replace("\n, f AS", ",\nf AS", 1)

QUERIES = {
    "l04_calibration": (l04_calibration, None),
    "l05_metrics": (l05_metrics, L05),
    "l06_folds": (l06_folds, L06),
    "l06_rolling_forecasts": (l06_rolling_forecasts, None),
    "l07_serve": (l07_serve, None),
    "l10_readiness": (l10_readiness, L10),
}
