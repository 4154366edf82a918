"""Set operations on tables and on members of groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stacked(*frames: DataFrame) -> DataFrame:
    """Union by name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def member_difference(expected: DataFrame, observed: DataFrame, group: str, member: str) -> DataFrame:
    """A row for each group: members missing and unexpected (sorted), and whether the sets are equal."""
    sets = lambda df, name: df.groupBy(group).agg(F.collect_set(member).alias(name))
    both = sets(expected, "_e").join(sets(observed, "_o"), group, "full_outer")
    kind = expected.schema[member].dataType.simpleString()
    e, o = (F.coalesce(c, F.expr(f"cast(array() AS array<{kind}>)")) for c in ("_e", "_o"))
    out = both.select(group, F.array_sort(F.array_except(e, o)).alias("missing"), F.array_sort(F.array_except(o, e)).alias("unexpected"))
    return out.withColumn("equal", (F.size("missing") == 0) & (F.size("unexpected") == 0))


def number_gaps(df: DataFrame, group: str, number: str) -> DataFrame:
    """Numbers of 1..count that a group lacks."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.collect_set(number).alias("_s")).select(group, "n", F.array_sort(F.array_except(F.sequence(F.lit(1), F.col("n").cast("int")), F.col("_s"))).alias("gaps"))
