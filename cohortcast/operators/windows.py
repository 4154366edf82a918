"""Operators within groups, as windows: a group is a card, its rows are members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_k(df: DataFrame, by: list[str], order: list, k: int, out: str = "nth") -> DataFrame:
    """The first k rows of each group in this order; `order` must be total for a repeatable result."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(out) <= k)


def price_rank(df: DataFrame, group: str, price: str, out: str = "price_rank") -> DataFrame:
    """Rank 1 is the shortest price; equal prices share the lower rank."""
    return df.withColumn(out, F.rank().over(Window.partitionBy(group).orderBy(F.col(price).asc_nulls_last())))


def probability_rank(df: DataFrame, group: str, p: str, tie: str, out: str = "model_rank") -> DataFrame:
    """Rank 1 is the most probable; of equal ones the first by `tie`."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(F.desc_nulls_last(p), tie)))


def effective_rank(df: DataFrame, group: str, scratched: str, rank: str, out: str = "effective_rank") -> DataFrame:
    """Ranks anew with withdrawn members behind all others."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(F.when(F.col(scratched), 1).otherwise(0), rank)))


def average_rank(df: DataFrame, by: list[str], p: str, out: str = "avg_rank", digits: int = 12) -> DataFrame:
    """Rank by p, the mean of the ranks that equal ones (to `digits` places) take up."""
    w = Window.partitionBy(*by)
    rounded = F.round(p, digits)
    return df.withColumn(out, F.rank().over(w.orderBy(rounded.desc())) + (F.count("*").over(Window.partitionBy(*by, rounded)) - 1) / 2)


def z_score(df: DataFrame, group: str, x: str, floor: float = 1.0, clip: float = 3.0, out: str = "z") -> DataFrame:
    """Distance from the group's mean in sample standard deviations of at least `floor`, within ±clip; null for one member."""
    w = Window.partitionBy(group)
    sd = F.stddev_samp(x).over(w)
    z = (F.col(x) - F.avg(x).over(w)) / F.greatest(sd, F.lit(floor))
    return df.withColumn(out, F.when(sd.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), z))))


def field_norm(df: DataFrame, group: str, x: str, out: str) -> DataFrame:
    """Min-max within the group: null takes the median, a constant or empty group the neutral 0.5."""
    w = Window.partitionBy(group)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    filled = F.coalesce(F.col(x), F.percentile(x, F.lit(0.5)).over(w))
    return df.withColumn(out, F.when(hi > lo, (filled - lo) / (hi - lo)).otherwise(0.5))


def share(df: DataFrame, group: str, x: str, out: str = "share") -> DataFrame:
    """x over the group's sum; null if that is not positive."""
    total = F.sum(x).over(Window.partitionBy(group))
    return df.withColumn(out, F.when(total > 0, F.col(x) / total))


def softmax(df: DataFrame, group: str, x: str, scale: float | Column = 1.0, out: str = "p") -> DataFrame:
    """exp(scale * x) over its sum in the group; the scale multiplies, and the maximum is taken off first."""
    w = Window.partitionBy(group)
    scale = scale if isinstance(scale, Column) else F.lit(scale)
    raw = df.withColumn("_e", F.exp((F.col(x) - F.max(x).over(w)) * scale))
    return raw.withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def cumulative_mean(df: DataFrame, by: list[str], order: list, x: str, out: str = "running_mean") -> DataFrame:
    return df.withColumn(out, F.avg(x).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def drawdown(df: DataFrame, by: list[str], order: list, net: str) -> DataFrame:
    """Running balance, its peak (at least 0), and the fall from it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    balanced = df.withColumn("balance", F.sum(net).over(w))
    return balanced.withColumn("peak", F.greatest(F.lit(0.0), F.max("balance").over(w))).withColumn("fall", F.col("peak") - F.col("balance"))


def top_two_gap(df: DataFrame, group: str, p: str) -> DataFrame:
    """A row for each group: the lead of the most probable member over the next (over 0 if alone)."""
    best = F.sort_array(F.collect_list(p), asc=False)
    return df.groupBy(group).agg(best.alias("_ps")).select(group, (F.get("_ps", F.lit(0)) - F.coalesce(F.get("_ps", F.lit(1)), F.lit(0.0))).alias("gap"))


def prior_mean(df: DataFrame, by: list[str], order: list, x: str, out: str = "prior_mean") -> DataFrame:
    """Mean over the rows before."""
    return df.withColumn(out, F.avg(x).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))


def drift_series(df: DataFrame, by: list[str], order: list, price: str) -> DataFrame:
    """Opening and previous price of each capture, and the relative changes from both."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("opening", F.first(price).over(w)).withColumn("previous", F.lag(price).over(w))
    return out.withColumn("from_opening", F.col(price) / F.col("opening") - 1).withColumn("from_previous", F.col(price) / F.col("previous") - 1)


def date_blocks(df: DataFrame, date: str, blocks: int, out: str = "block") -> DataFrame:
    """Chronological blocks of about equally many distinct days; a day is never split. Times count by their day, so that days are few rows."""
    dates = df.select(F.to_date(date).alias("_day")).distinct().groupBy().agg(F.array_sort(F.collect_set("_day")).alias("_d"))
    numbered = dates.select(F.posexplode("_d").alias("_k", "_day"), F.size("_d").alias("_n")).select("_day", F.floor(F.col("_k") * blocks / F.col("_n")).cast("int").alias(out))
    return df.withColumn("_day", F.to_date(date)).join(numbered, "_day").drop("_day")


def split_by_date(df: DataFrame, date: str, train: float = 0.70, valid: float = 0.15) -> DataFrame:
    """A column `part`: train, valid or test, by the share of distinct days up to each."""
    dates = df.select(F.to_date(date).alias("_day")).distinct().groupBy().agg(F.array_sort(F.collect_set("_day")).alias("_d"))
    at = (F.col("_k") + 1) / F.col("_n")
    labels = dates.select(F.posexplode("_d").alias("_k", "_day"), F.size("_d").alias("_n")).select("_day", F.when(at <= train, "train").when(at <= train + valid, "valid").otherwise("test").alias("part"))
    return df.withColumn("_day", F.to_date(date)).join(labels, "_day").drop("_day")


def free_slots(df: DataFrame, group: str, slot: str, tie: str, most: int) -> DataFrame:
    """Members without a slot take the group's free numbers 1..most in order of `tie`; given ones stay, clashes are flagged."""
    w = Window.partitionBy(group)
    free = F.array_sort(F.array_except(F.sequence(F.lit(1), F.lit(most)), F.collect_set(slot).over(w)))
    nth = F.row_number().over(Window.partitionBy(group, F.col(slot).isNull()).orderBy(tie))
    return df.withColumn("_free", free).withColumn("_nth", nth).withColumn("clash", F.col(slot).isNotNull() & (F.count("*").over(Window.partitionBy(group, slot)) > 1)).withColumn("assigned", F.coalesce(F.col(slot), F.get("_free", F.col("_nth") - 1))).drop("_free", "_nth")
