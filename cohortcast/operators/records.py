"""Records over time: overlays, batches, reconciliation ladders, pairing, coverage, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_batch(df: DataFrame, group: str, ts: str, slot: str) -> DataFrame:
    """Rows of each group's last capture; a group whose last capture quotes a slot twice has none."""
    w = Window.partitionBy(group)
    last = df.withColumn("_t", F.max(ts).over(w)).where(F.col(ts) == F.col("_t"))
    counted = last.withColumn("_c", F.count("*").over(Window.partitionBy(group, slot)))
    return counted.withColumn("_worst", F.max("_c").over(w)).where("_worst = 1").drop("_t", "_c", "_worst")


def overlay_if_complete(board: DataFrame, live: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """board with live values for groups in which every member has one; other groups keep theirs."""
    b = board.join(live.select(group, member, F.col(value).alias("_live")), [group, member], "left")
    whole = F.count("_live").over(Window.partitionBy(group)) == F.count("*").over(Window.partitionBy(group))
    return b.withColumn("is_live", whole).withColumn(value, F.when(whole, F.col("_live")).otherwise(F.col(value))).drop("_live")


def pair_keys(cards: DataFrame, results: DataFrame, key: str, near: list[str]) -> DataFrame:
    """Candidate pairs by key: PAIRED, AMBIGUOUS, KEY_MISMATCH (the other side has a row of the same `near` columns), CARD_ONLY or RESULT_ONLY."""
    a = cards.groupBy(key, *near).agg(F.count("*").alias("n_cards"))
    b = results.groupBy(key, *near).agg(F.count("*").alias("n_results"))
    both = a.join(b, [key, *near], "full_outer")
    w = Window.partitionBy(*near)
    cards_near, results_near = F.count("n_cards").over(w), F.count("n_results").over(w)
    status = (
        F.when((F.col("n_cards") > 1) | (F.col("n_results") > 1), "AMBIGUOUS")
        .when(F.col("n_cards").isNotNull() & F.col("n_results").isNotNull(), "PAIRED")
        .when(F.col("n_results").isNull(), F.when(results_near > 0, "KEY_MISMATCH").otherwise("CARD_ONLY"))
        .otherwise(F.when(cards_near > 0, "KEY_MISMATCH").otherwise("RESULT_ONLY"))
    )
    return both.withColumn("status", status)


def first_known(sources: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """The first value that isn't null, and its source's name."""
    label = F.coalesce(*[F.when(c.isNotNull(), F.lit(name)) for name, c in sources])
    return F.coalesce(*[c for _, c in sources]), label


def unpivot_status(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A row for each column of each record: name, value as text, OBSERVED or MISSING."""
    items = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(*keys, F.explode(items).alias("_i")).select(*keys, "_i.*").withColumn("status", F.when(F.col("value").isNull(), "MISSING").otherwise("OBSERVED"))


def made_before(df: DataFrame, posts: DataFrame, key: str, ts: str, post: str) -> DataFrame:
    """df with accepted and reason: rows made before their group's post time."""
    out = df.join(posts.select(key, post), key, "left")
    reason = F.when(F.col(post).isNull(), "NO_POST_TIME").when(F.col(ts).isNull(), "NO_TIME").when(F.col(ts) >= F.col(post), "AT_OR_AFTER_POST").otherwise("OK")
    return out.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "OK")


def coverage(df: DataFrame, by: str, flags: dict[str, Column]) -> DataFrame:
    """Share of rows for which each flag holds, by key."""
    return df.groupBy(by).agg(F.count("*").alias("rows"), *[F.round(F.avg(F.coalesce(c.cast("double"), F.lit(0.0))), 6).alias(k) for k, c in flags.items()])


def dependency_counts(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """A row for each key with the number of its rows in each table."""
    from functools import reduce

    counts = [t.groupBy(key).agg(F.count("*").alias("n")).withColumn("table", F.lit(name)) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, counts).groupBy(key).pivot("table", list(tables)).agg(F.sum("n")).fillna(0, list(tables))


def contiguous_folds(df: DataFrame, group: str, order: str, folds: int = 3) -> DataFrame:
    """Groups in `folds` contiguous parts by their order (a date); a group stays whole. What is numbered in one
    task are the distinct dates, a row each."""
    days = df.groupBy(order).agg(F.count_distinct(group).alias("_g"))
    w = Window.orderBy(order)
    before = F.coalesce(F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.join(days.select(order, F.floor(before * folds / total).cast("int").alias("fold")), order)


def sectioned_rates(df: DataFrame, dims: list[list[str]], names: list[str], hit: Column, sparse: int = 5) -> DataFrame:
    """Counts and hit rates by several key sets in one pass; fewer than `sparse` rows are flagged."""
    out = df.groupingSets([[F.col(c) for c in d] for d in dims], *[F.col(c) for c in names]).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    return out.withColumn("rate", F.round(F.col("hits") / F.col("n"), 6)).withColumn("sparse", F.col("n") < sparse)
