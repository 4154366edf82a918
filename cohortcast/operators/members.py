"""Measures of a member within its field: rates, readiness, fits, publicness, race shape, confidence, market edges. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How early each running style goes, how much it adds to a field's pressure, and how it fits a band of pressure.
EARLY = {"front": 1.00, "presser": 0.70, "stalker": 0.40, "closer": 0.10}
PRESSURE = {"front": 1.00, "presser": 0.70, "stalker": 0.35, "closer": 0.10}
SHAPE_FIT = {
    "front": {"low": 0.78, "moderate": 0.60, "high": 0.38},
    "presser": {"low": 0.65, "moderate": 0.68, "high": 0.55},
    "stalker": {"low": 0.52, "moderate": 0.64, "high": 0.72},
    "closer": {"low": 0.38, "moderate": 0.55, "high": 0.75},
}
#: Evidence of starts at the distance (four and more: 1), and ranks of class labels.
DISTANCE_EVIDENCE = {0: 0.00, 1: 0.40, 2: 0.70, 3: 0.85}
CLASS_RANKS = {"G1": 100, "G2": 92, "G3": 88, "STAKES": 85, "AOC": 70, "ALW": 65, "SOC": 60, "STR": 55, "MSW": 50, "CLM": 45, "MOC": 42, "MCL": 30}


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """x within [lo, hi]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def rounded(x: Column, digits: int) -> Column:
    """x rounded, a half (within 1e-9) upwards, whatever the last bits of its sum are."""
    return F.round(x + 1e-9, digits)


def scaled(x: Column, lo: float, hi: float) -> Column:
    return F.lit(0.5) if hi == lo else clamp((x - lo) / (hi - lo))


def looked_up(x: Column, table: dict, other=None) -> Column:
    """A small table as an expression; `other` for what it lacks."""
    out = F.lit(other)
    for key, value in table.items():
        out = F.when(x == F.lit(key), F.lit(value)).otherwise(out)
    return out


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.when(whole > 0, F.round(part / whole, digits))


def work_readiness(works: Column, gate: Column) -> Column:
    return F.round(0.6 * clamp(works / 6.0) + 0.4 * clamp(gate / 5.0), 4)


def intent(works: Column, layoff: Column) -> Column:
    """Work load and freshness: full to 14 days, none from 70."""
    return F.round(0.5 * clamp(works / 6.0) + 0.5 * clamp(F.when(layoff.isNotNull(), 1.0 - F.greatest(F.lit(0.0), layoff - 14.0) / 56.0)), 4)


def traffic(style: Column, experience: Column) -> Column:
    return F.round(0.5 * looked_up(style, EARLY) + 0.5 * F.coalesce(experience, F.lit(0.5)), 4)


def surface_fit(starts: Column, wins: Column) -> Column:
    return F.when(starts >= 2, F.round(wins / starts, 4)).when(starts == 1, F.round(0.5 * wins, 4))


def distance_fit(starts: Column, wins: Column, stamina: Column) -> Column:
    return F.round(F.when(starts >= 1, 0.55 * wins / starts).otherwise(0.0) + 0.45 * stamina, 4)


def publicness(df: DataFrame, group: str, price: Column, win_rate: Column) -> DataFrame:
    """implied_p, publicness and underlay (0 to 1): how far a member's price is beyond its rate, within the group."""
    implied = F.round(1.0 / (price + 1.0), 6)
    out = df.withColumn("implied_p", implied).withColumn("publicness", F.when(win_rate > 0, rounded(F.col("implied_p") / win_rate, 4)))
    w = Window.partitionBy(group)
    sd = F.stddev_samp("publicness").over(w)
    z = F.when(sd > 0, (F.col("publicness") - F.avg("publicness").over(w)) / sd)
    return out.withColumn("underlay", F.coalesce(rounded(clamp(z / 3.0 + 0.5), 4), F.lit(0.5)))


def race_shape(df: DataFrame, group: str, style: str) -> DataFrame:
    """pressure, band, collapse, lone_speed, shape_fit and shape_state of each member, by windows of the group."""
    w = Window.partitionBy(group)
    known = looked_up(F.col(style), PRESSURE)
    count = lambda c: F.count(F.when(c, 1)).over(w)
    classified, fronts, pressers = count(known.isNotNull()), count(F.col(style) == "front"), count(F.col(style) == "presser")
    out = df.withColumns({"pressure": rounded(F.avg(known).over(w), 4), "classified": classified, "fronts": fronts, "pressers": pressers, "active": F.count("*").over(w)})
    out = out.withColumn("band", F.when(F.col("pressure") < 0.40, "low").when(F.col("pressure") < 0.65, "moderate").when(F.col("pressure").isNotNull(), "high"))
    fit = F.lit(None).cast("double")
    for s, row in SHAPE_FIT.items():
        fit = F.when(F.col(style) == s, looked_up(F.col("band"), row)).otherwise(fit)
    out = out.withColumn("shape_fit", fit)
    share, kinds = F.col("classified") / F.col("active"), F.size(F.collect_set("shape_fit").over(w))
    out = out.withColumn("shape_state", F.when((share < 0.40) | (kinds <= 1), "UNAVAILABLE").when(share >= 0.70, "READY").otherwise("PARTIAL"))
    return out.withColumns(
        {
            "collapse": F.when(F.col("classified") > 0, rounded((F.col("fronts") + 0.5 * F.col("pressers")) / F.col("classified"), 4)),
            "lone_speed": F.coalesce(((F.col(style) == "front") & (F.col("fronts") == 1)).cast("int"), F.lit(0)),
            "shape_fit": F.when(F.col("shape_state") != "UNAVAILABLE", F.col("shape_fit")),
        }
    ).drop("classified", "fronts", "pressers", "active")


def evidence_confidence(df: DataFrame, group: str, p: str, market_p: str, starts: Column, career: Column, lacks: Column, priced: Column, order: str, no_shape: Column | None = None) -> DataFrame:
    """confidence_score and confidence (LOW, MEDIUM, HIGH) by four parts: the member's evidence .35, the field's .25,
    the forecast's certainty .30, and a neutral .10 for calibration; .05 less where the race's shape is unknown.
    Ties of the first places go to the least `order`."""
    w = Window.partitionBy(group)
    n = F.count("*").over(w)
    own = 0.50 * looked_up(F.least(starts, F.lit(4)), DISTANCE_EVIDENCE | {4: 1.00}) + 0.25 * F.least(career / 15.0, F.lit(1.0)) + 0.25 * F.when(lacks, 0.0).otherwise(1.0)
    race = 0.50 * clamp((n - 4) / 8.0) + 0.50 * F.count(F.when(priced, 1)).over(w) / n
    entropy = -F.sum(F.col(p) * F.log(F.greatest(F.col(p), F.lit(1e-9)))).over(w)
    spread = F.greatest(F.lit(0.0), 1.0 - entropy / F.when(n > 1, F.log(n)).otherwise(1.0))
    first = F.max(p).over(w)
    ranks = df.withColumns({"_k": F.row_number().over(w.orderBy(F.desc(p), order)), "_m": F.row_number().over(w.orderBy(F.desc(market_p), order))})
    gap = F.least((first - F.coalesce(F.max(F.when(F.col("_k") == 2, F.col(p))).over(w), F.lit(0.0))) / 0.10, F.lit(1.0))
    same = F.max(F.when((F.col("_k") == 1) & (F.col("_m") == 1), 1.0).otherwise(0.0)).over(w)
    certain = 0.45 * spread + 0.35 * gap + 0.20 * same
    score = 0.35 * rounded(own, 4) + 0.25 * rounded(race, 4) + 0.30 * rounded(certain, 4) + 0.10 * 0.50
    score = F.when(no_shape, F.greatest(F.lit(0.0), score - 0.05)).otherwise(score) if no_shape is not None else score
    out = ranks.withColumn("confidence_score", score)
    return out.withColumn("confidence", F.when(F.col("confidence_score") < 0.45, "LOW").when(F.col("confidence_score") < 0.70, "MEDIUM").otherwise("HIGH")).withColumn("confidence_score", rounded(F.col("confidence_score"), 3)).drop("_k", "_m")


def market_edges(df: DataFrame, group: str, p: str, decimal: str, bet: float = 0.02, underlay: float = -0.02) -> DataFrame:
    """market_p (de-vigged shares of 1 / decimal; null unless all prices of the group are valid), edge, tag and fair odds."""
    w = Window.partitionBy(group)
    valid = F.min(F.coalesce(F.col(decimal) > 1, F.lit(False))).over(w)
    out = df.withColumn("market_p", F.when(valid, 1 / F.col(decimal) / F.sum(1 / F.col(decimal)).over(w)))
    out = out.withColumn("edge", F.round(F.round(F.col(p), 9) - F.round("market_p", 9), 4))
    tag = F.when(F.col("edge") >= bet, "bet").when(F.col("edge") <= underlay, "underlay").when(F.col("edge").isNotNull(), "neutral")
    return out.withColumn("tag", tag).withColumn("fair_odds", F.round(1 / F.greatest(F.round(F.col(p), 9), F.lit(1e-9)) - 1, 2))


def class_rank(label: Column) -> Column:
    """The rank of the first known label that the text contains."""
    text = F.upper(F.regexp_replace(F.coalesce(label, F.lit("")), " ", ""))
    return F.coalesce(*[F.when(F.contains(text, F.lit(k)), v) for k, v in CLASS_RANKS.items()])


def finish_share(finish: Column, size: Column, scratched: Column) -> Column:
    """1 for the first, 0 for the last of the field; null where the place isn't a valid one."""
    return F.when(~scratched & (size >= 2) & finish.between(1, size), 1.0 - (finish - 1) / (size - 1))
