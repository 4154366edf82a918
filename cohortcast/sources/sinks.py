"""Tables to write: each function returns what the table becomes, or what to append; the caller writes it.

Nothing is updated in place: tables are rewritten by partition or appended to, so a rerun changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortcast.functions.text import content_id


def new_rows(stored: DataFrame, arriving: DataFrame, keys: list[str]) -> DataFrame:
    """Arriving rows whose key isn't stored; of equal keys the first in order of all columns."""
    w = Window.partitionBy(*keys).orderBy(*arriving.columns)
    once = arriving.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return once.join(stored.select(*keys).distinct(), keys, "left_anti").select(*arriving.columns)


def replaced(stored: DataFrame, arriving: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table with the latest row of each key; an arriving one wins a tie."""
    rows = stored.withColumn("_new", F.lit(0)).unionByName(arriving.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.desc("_new"))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_new")


def filled(stored: DataFrame, arriving: DataFrame, keys: list[str]) -> DataFrame:
    """The table with its nulls filled from arriving rows, and rows of new keys."""
    columns = [c for c in stored.columns if c not in keys]
    both = stored.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in columns]).join(arriving.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in columns]), keys, "full_outer")
    return both.select(*keys, *[F.coalesce(f"_o_{c}", f"_n_{c}").alias(c) for c in columns])


def versioned(current: DataFrame, arriving: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Arriving rows with content_hash and status against the current version: INSERTED, SUPERSEDED or UNCHANGED."""
    hashed = arriving.withColumn("content_hash", content_id(*columns))
    now = current.select(*keys, content_id(*columns).alias("_was"))
    return hashed.join(now, keys, "left").withColumn("status", F.when(F.col("_was").isNull(), "INSERTED").when(F.col("_was") == F.col("content_hash"), "UNCHANGED").otherwise("SUPERSEDED")).drop("_was")


def without(stored: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """The table less the rows of a scope."""
    return stored.join(scope.select(*keys).distinct(), keys, "left_anti")


def resolved_entities(arriving: DataFrame, known: DataFrame, source_key: str, name: str, entity_id: str) -> DataFrame:
    """arriving with an id: by source key, else by name key, else made from the name; `is_new` tells the last."""
    from cohortcast.functions.text import ascii_key

    by_key = known.where(F.col(source_key).isNotNull()).groupBy(source_key).agg(F.min(entity_id).alias("_a"))
    by_name = known.groupBy(ascii_key(F.col(name)).alias("_nk")).agg(F.min(entity_id).alias("_b"))
    out = arriving.withColumn("_nk", ascii_key(F.col(name))).join(by_key, source_key, "left").join(by_name, "_nk", "left")
    return out.select(*arriving.columns, F.coalesce("_a", "_b", F.xxhash64("_nk")).alias(entity_id), (F.col("_a").isNull() & F.col("_b").isNull()).alias("is_new"))


def write_scope(df: DataFrame, path: str, partition: str) -> None:
    """Overwrites the partitions that df has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
