"""The most similar names by edit distance, found through an index instead of by pairs.

Similarity is 1 - distance / the longer length. A name of n characters has n + 1 pairs of neighbouring characters, ends included; an
edit touches two of them. Names at distance d or less therefore share one of their 2 d + 1 rarest pairs, at places at most d
apart. They also share what is left of each when up to d characters are dropped: where names are so dense that pairs tell little (numbered
ones), distances 1 and 2 go by these rests, of which a name of n characters has n + 1 or about n * n / 2. Distances are tried in turn, each for the
names that may still find something better, so that what has a close match never meets what is farther away. Nothing is cut: every name
whose similarity reaches the cutoff and no other's exceeds is found.

Joins are of both sides shuffled: a file of numbered names is small, and what it unfolds to (rows of rests, index entries) isn't, so that Spark would
take it for a table to broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcast.operators.cut import cut

#: Known names that a name may meet through its pairs at distance 2; those that would meet more go by their rests.
OFTEN = 2000

#: Names that one task takes.
NAMES_OF_A_TASK = 20_000


def pairs_of(name) -> F.Column:
    """(pair, nth of its kind, place) of each two neighbours of a name, its ends marked by a blank that squashed names don't hold."""
    padded = F.concat(F.lit(" "), name, F.lit(" "))
    at = F.sequence(F.lit(1), F.length(name) + 1)
    pairs = F.transform(at, lambda k: F.substring(padded, k, F.lit(2)))
    return F.transform(pairs, lambda g, k: F.struct(g.alias("pair"), F.size(F.filter(F.slice(pairs, 1, k + 1), lambda x: x == g)).alias("nth"), k.alias("place")))


def indexed(names: DataFrame, block: str, name: str, rarity: DataFrame) -> DataFrame:
    """(block, name, size, pairs): each distinct name with its pairs, the rarest first. rarity: (pair, times)."""
    one = names.where(F.col(name).isNotNull() & F.col(block).isNotNull() & (F.length(name) > 0)).select(block, name).distinct()
    spread = one.withColumn("_p", F.explode(pairs_of(F.col(name)))).select(block, name, "_p.*").join(rarity, "pair", "left")
    order = F.struct(F.coalesce("times", F.lit(0)).alias("times"), "pair", "nth", "place")
    return spread.groupBy(block, name).agg(F.sort_array(F.collect_list(order)).alias("pairs")).withColumn("size", F.length(name))


def _probe(index: DataFrame, block: str, name: str, distance: int, mark: str) -> DataFrame:
    first = index.withColumn("_p", F.explode(F.slice("pairs", 1, 2 * distance + 1)))
    return first.select(block, F.col("_p.pair").alias("pair"), F.col("_p.nth").alias("nth"), F.col("_p.place").alias(f"place_{mark}"), F.col(name).alias(f"name_{mark}"), F.col("size").alias(f"size_{mark}"))


def candidates(asked: DataFrame, known: DataFrame, block: str, name: str, distance: int) -> DataFrame:
    """(block, name_a, name_b): pairs of names that may be at most so far apart. asked and known are `indexed` alike."""
    a, b = _probe(asked, block, name, distance, "a"), _probe(known, block, name, distance, "b")
    near = (F.abs(F.col("size_a") - F.col("size_b")) <= distance) & (F.abs(F.col("place_a") - F.col("place_b")) <= distance)
    return a.join(b.hint("merge"), [block, "pair", "nth"]).where(near).select(block, "name_a", "name_b").distinct()


def rests_of(name, dropped: int) -> F.Column:
    """The hashes of a name and of what is left of it without up to so many (1 or 2) of its characters."""
    without = lambda x, k: F.concat(F.substring(x, F.lit(1), k - 1), F.substring(x, k + 1, F.length(x)))
    less = lambda x: F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.length(x)), lambda k: without(x, k))).otherwise(F.array(F.lit("")))
    one = F.array_distinct(less(name))
    both = F.concat(F.array(name), one) if dropped == 1 else F.concat(F.array(name), one, F.flatten(F.transform(one, less)))
    return F.array_distinct(F.transform(both, lambda x: F.xxhash64(x)))


def close_candidates(asked: DataFrame, known: DataFrame, block: str, name: str, distance: int) -> DataFrame:
    """`candidates` by the rests of names, for distances 1 and 2: how many a name meets doesn't grow with how often its pairs occur."""
    side = lambda df, mark: df.select(block, F.col(name).alias(f"name_{mark}"), F.explode(rests_of(F.col(name), distance)).alias("_rest"))
    near = F.levenshtein("name_a", "name_b", distance) >= 0  # before the pairs are shuffled
    return side(asked, "a").join(side(known, "b").hint("merge"), [block, "_rest"]).where(near).select(block, "name_a", "name_b").distinct()


def _dealt(df: DataFrame) -> DataFrame:
    """df in parts of bounded names: a name unfolds to many rows, and by its bytes a part would hold hundreds of thousands."""
    return cut(df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / NAMES_OF_A_TASK))))


def nearest_names(asked: DataFrame, known: DataFrame, block: str, name: str, cutoff: float = 0.72) -> DataFrame:
    """(block, name, match, similarity): for each distinct asked name the known names of its block that are most similar, if they reach the cutoff.

    Ties all come. Nulls and empty names match nothing. cutoff: at least 2/3, below which the index could miss names.
    """
    if not 2 / 3 <= cutoff <= 1:
        raise ValueError("cutoff must be from 2/3 to 1")
    told = lambda df: _dealt(cut(df.where(F.col(name).isNotNull() & F.col(block).isNotNull() & (F.length(name) > 0)).select(block, name).distinct().withColumn("size", F.length(name))))
    left, right = told(asked), told(known)
    longest = left.agg(F.max("size")).first()[0] or 0
    found = left.join(right.hint("merge"), [block, name], "left_semi").select(block, name, F.col(name).alias("match"), F.lit(1.0).alias("similarity"))
    open_ = left.join(found.hint("merge"), [block, name], "left_anti")
    reach = lambda d: F.col("size") / (F.col("size") + d)  # noqa: E731  the most that a name at distance d can reach
    for distance in range(1, math.floor(longest * (1 / cutoff - 1) + 1e-9) + 1):
        open_ = cut(open_.where(reach(distance) >= cutoff - 1e-9))
        if open_.isEmpty():
            break
        if distance == 1:
            met = close_candidates(open_, right, block, name, 1)
        else:
            if distance == 2:  # few names come so far: pairs are counted for them alone
                rarity = right.select(F.explode(pairs_of(F.col(name))).alias("_p")).groupBy("_p.pair").agg(F.count("*").alias("times"))
                index = cut(indexed(right, block, name, rarity))
                open_ = cut(open_.join(indexed(open_, block, name, rarity).drop("size").hint("merge"), [block, name]))
            often = F.aggregate(F.slice("pairs", 1, 2 * distance + 1), F.lit(0).cast("long"), lambda n, g: n + g["times"]) > OFTEN
            met = candidates(open_.where(~often) if distance == 2 else open_, index, block, name, distance)
            if distance == 2 and not open_.where(often).isEmpty():
                met = met.unionByName(close_candidates(open_.where(often), right, block, name, 2))
        apart = F.levenshtein("name_a", "name_b", distance)
        close = met.withColumn("_d", apart).where("_d >= 0")
        close = close.select(block, F.col("name_a").alias(name), F.col("name_b").alias("match"), (1 - F.col("_d") / F.greatest(F.length("name_a"), F.length("name_b"))).alias("similarity"))
        close = cut(close.where(F.col("similarity") >= cutoff - 1e-9))
        found = found.unionByName(close)
        best = close.groupBy(block, name).agg(F.max("similarity").alias("_best"))
        open_ = open_.join(best.hint("merge"), [block, name], "left").where(F.col("_best").isNull() | (F.col("_best") <= reach(distance + 1) + 1e-9)).drop("_best")
    top = found.groupBy(block, name).agg(F.max("similarity").alias("_best"))
    return found.join(top.hint("merge"), [block, name]).where(F.col("similarity") >= F.col("_best") - 1e-9).select(block, name, "match", "similarity").distinct()
