"""Connected components of a table of links, by star contraction; and the checkpoints and short lists that operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ready(spark) -> None:
    """A checkpoint folder: the one that the cluster names, or the session's warehouse where none is named (tests)."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints")


def settled(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A checkpoint of df, read in partitions of at least about `rows` rows, so that a small table isn't shuffled by many tiny tasks."""
    out = df.checkpoint()
    return out.coalesce(1 + out.count() // rows)


def placed(df: DataFrame) -> DataFrame:
    """A checkpoint of df that keeps how its rows are dealt and sorted, so that joins on them neither shuffle nor sort: an adaptive plan would not tell."""
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    was = conf.get(key)
    conf.set(key, "false")
    try:
        return df.checkpoint()
    finally:
        conf.set(key, was)


def most_frequent(counts: DataFrame, count: str, most: int) -> DataFrame:
    """About the `most` rows of highest count, and no more than that; ties at the end are cut as they come.

    Quantile sketches narrow the table down before anything is ordered, so that what tasks send to the driver
    is a few times `most` rows in all, however many tasks there are. For tables that only save time.
    """
    ready(counts.sparkSession)
    rows = counts.checkpoint()
    n = rows.count()
    while n > 4 * most:
        cut = rows.agg(F.percentile_approx(count, F.lit(1 - 2 * most / n), F.lit(10_000))).first()[0]
        fewer = rows.where(F.col(count) > cut)
        left = fewer.count()
        if left < most or left == n:
            return fewer if left else rows.limit(most)
        rows, n = fewer, left
    return rows.orderBy(F.desc(count)).limit(most)


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], count: str, how: str = "inner", share: int = 256, most: int = 1 << 16) -> DataFrame:
    """rows joined with groups, which has a row for each `on` and the number of rows that have it, in `count`.

    Groups of more than `share` rows go by broadcast, at most `most` of them (those of the highest counts), so that
    no large group is one task's; all others are shuffled, and each has at most `share` rows or one in `most` of all.
    """
    hot = most_frequent(groups.where(F.col(count) > share), count, most).checkpoint()
    if hot.isEmpty():
        return rows.join(groups, on, how)
    keys = F.broadcast(hot.select(*on))
    few = rows.join(F.broadcast(hot), on)
    return few.unionByName(rows.join(keys, on, "left_anti").join(groups.join(keys, on, "left_anti"), on, how))


def few(keys: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A table of narrow keys, checkpointed, and marked for broadcast if it has at most `most` rows."""
    out = settled(keys)
    return F.broadcast(out) if out.limit(most + 1).count() <= most else out


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each linked node with the smallest node that it reaches, itself included.

    Each round points larger neighbours, then smaller ones, to the least neighbour, until nothing changes;
    rounds grow with the logarithm of the longest path. Minima are aggregated before they are joined
    back, so that a node with very many links is no task of its own. Loops are ignored.
    """
    ready(links.sparkSession)
    pairs = settled(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())

    def state(e):
        return e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()

    was = None
    while was != (now := state(pairs)):
        was, parts = now, 1 + now["n"] // 100_000  # pairs never grow in number
        # large star: every larger neighbour of u is pointed to u's least neighbour (or u)
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").coalesce(parts).distinct()
        # small star: u and its smaller neighbours are pointed to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v")
        pairs = small.coalesce(parts).distinct().coalesce(parts).checkpoint()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
