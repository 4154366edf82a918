"""Feature families over all groups at once; history is strictly before the target's day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortcast.functions.text import norm
from cohortcast.operators.aggregates import blended, shrunk

#: Win rates by days since the last start (from 0, 14, 28, 56 and 120 days).
LAYOFF_RATES = [(14, 0.18), (28, 0.21), (56, 0.23), (120, 0.17)]
LAYOFF_LONG = 0.12
#: Weights of the override composite.
OVERRIDE_WEIGHTS = [0.35, 0.20, 0.20, 0.15, 0.10]


def layoff_rate(days: Column) -> Column:
    out = F.when(days.isNull() | (days < 0), None)
    for upto, r in LAYOFF_RATES:
        out = out.when(days < upto, r)
    return out.otherwise(LAYOFF_LONG)


def beaten_share(finish: Column, field: Column) -> Column:
    """Share of rivals beaten: 1 for the winner, 0 for the last; null for a field of fewer than two or a place beyond it."""
    return F.when((field >= 2) & (finish >= 1) & (finish <= field), 1 - (finish - 1) / (field - 1))


def form_cycle(itm_rate: Column, last_finish: Column) -> Column:
    return 0.6 * itm_rate + 0.4 * (1 - norm(last_finish.cast("double"), 1, 11))


def weighted_known(values: list[Column], weights: list[float]) -> Column:
    """Mean of the values that aren't null, by their weights; null if none is known."""
    total = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in zip(values, weights)), F.lit(0.0))
    return F.when(total > 0, sum((F.coalesce(v, F.lit(0.0)) * w for v, w in zip(values, weights)), F.lit(0.0)) / total)


def race_shape(df: DataFrame, group: str, style: str, forward: list[str]) -> DataFrame:
    """Counts of styles broadcast to the members: pressure (share of forward ones among the classified), a band and a lone-speed flag.
    Under 40 % classified, or with one style only, the shape is unknown (null)."""
    w = Window.partitionBy(group)
    known = F.count(style).over(w)
    front = F.count_if(F.col(style).isin(*forward)).over(w)
    usable = (known / F.count("*").over(w) >= 0.40) & (F.size(F.collect_set(style).over(w)) > 1)
    pressure = F.when(usable, front / known)
    return df.withColumn("pressure", pressure).withColumn("shape", F.when(F.col("pressure") < 0.40, "soft").when(F.col("pressure") < 0.65, "fair").when(F.col("pressure").isNotNull(), "hot")).withColumn("lone_speed", F.when(usable, (front == 1) & F.col(style).isin(*forward)))


def history_form(target: DataFrame, history: DataFrame, keys: list[str], at: str, date: str, score: str, entity: str, enough: float = 5, recent: int = 180) -> DataFrame:
    """target with form (decay-weighted score over all earlier rows, blended to 0.5 by coverage of recent ones), starts and days since the last.

    Histories are summed by day first; then each entity's window runs over its days, one row each. Decay factors
    out of the running sums (weights grow with the day, and cancel in the quotient), so no day meets another.
    """
    number = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01"))
    day = history.where(F.col(score).isNotNull()).groupBy(entity, number(date).alias("_d")).agg(F.count("*").alias("_n"), F.sum(F.col(score).cast("double")).alias("_s"))
    asked = target.select(entity, number(at).alias("_d")).distinct().select(entity, "_d", F.lit(0).cast("long").alias("_n"), F.lit(0.0).alias("_s"))
    days_of = day.unionByName(asked).groupBy(entity, "_d").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    order = Window.partitionBy(entity).orderBy("_d")
    earlier, lately = order.rangeBetween(Window.unboundedPreceding, -1), order.rangeBetween(-recent, -1)
    grown = F.exp(0.01 * F.col("_d"))
    sums = days_of.select(entity, "_d", F.sum(grown * F.col("_s")).over(earlier).alias("_a"), F.sum(grown * F.col("_n")).over(earlier).alias("_b"), F.sum("_n").over(earlier).alias("starts"), F.sum("_n").over(lately).alias("_recent"), (F.col("_d") - F.max(F.when(F.col("_n") > 0, F.col("_d"))).over(earlier)).alias("days_off"))
    sums = sums.select(entity, "_d", F.when(F.col("starts") > 0, F.col("_a") / F.col("_b")).alias("_raw"), "starts", "_recent", "days_off")
    out = target.withColumn("_d", number(at)).join(sums, [entity, "_d"], "left")
    form = blended(F.col("_raw"), F.coalesce("_recent", F.lit(0)), enough)
    return out.withColumn("form", form).withColumn("starts", F.coalesce("starts", F.lit(0))).drop("_d", "_raw", "_recent")


def fit_rate(wins: Column, starts: Column, weight: float = 2, prior: float = 0.5) -> Column:
    """Shrunken win rate under today's conditions."""
    return shrunk(wins, starts, weight, prior)


def readiness(recency: Column, cadence: Column, progress: Column, rank: Column, time: Column) -> Column:
    """Weighted readiness from work facts in 0..1; unknown ones count as neutral."""
    parts = [(recency, 0.35), (cadence, 0.30), (progress, 0.20), (rank, 0.10), (time, 0.05)]
    return sum((w * F.coalesce(c, F.lit(0.5)) for c, w in parts), F.lit(0.0))
