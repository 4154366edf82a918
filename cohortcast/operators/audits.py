"""Audits of groups and their sources: identity ladders, previews, rule lists, validity of evidence, settled legs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least stake and step by type of bet; others take the last.
DENOMINATIONS = {"WIN": 2.0, "PLACE": 2.0, "SHOW": 2.0, "EXACTA": 1.0, "TRIFECTA": 0.5, "SUPERFECTA": 0.1}
OTHER_DENOMINATION = 1.0
#: The last finish that wins each type of leg.
NEEDS = {"WIN": 1, "PLACE": 2, "SHOW": 3}
#: A second provider's style codes.
STYLE_CODES = {"E": "front", "E/P": "presser", "P": "stalker", "S": "closer"}


def broken(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules whose condition holds, in their order; a condition that is null doesn't hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))


def identity_ladder(records: DataFrame, entries: DataFrame, group: str, name: str, key: Column, id: str) -> DataFrame:
    """records with id, status and n_candidates: entries of the same group by lower-cased name, else by `key`.

    Entries are counted by group and name first, so that each record meets one row a step and no pairs are formed.
    A null name is unmatched.
    """
    out = records
    for step, c in (("exact", F.lower(name)), ("norm", key)):
        known = entries.groupBy(group, c.alias("_k")).agg(F.count("*").alias(f"_{step}"), F.min(id).alias(f"_{step}_id"))
        out = out.withColumn("_k", c).join(known, [group, "_k"], "left").drop("_k")
    e, n = F.coalesce("_exact", F.lit(0)), F.coalesce("_norm", F.lit(0))
    status = F.when(e == 1, "EXACT_MATCH").when(e > 1, "AMBIGUOUS").when(n == 1, "NORMALIZED_EXACT_MATCH").when(n > 1, "AMBIGUOUS").otherwise("UNMATCHED")
    found = F.when(e == 1, F.col("_exact_id")).when((e == 0) & (n == 1), F.col("_norm_id"))
    return out.select(*records.columns, found.alias(id), status.alias("status"), F.when(e > 0, e).otherwise(n).alias("n_candidates"))


def second_source_errors(laddered: DataFrame, entries: DataFrame, group: str, id: str) -> DataFrame:
    """A row for each group of the second source: count parity, one-to-one identity, nothing ambiguous or unmatched."""
    ours = entries.groupBy(group).agg(F.count("*").alias("_entries"))
    by_id = laddered.groupBy(group, id).agg(F.count("*").alias("_c"), F.count_if(F.col("status") == "AMBIGUOUS").alias("_a"), F.count_if(F.col("status") == "UNMATCHED").alias("_u"))
    theirs = by_id.groupBy(group).agg(F.sum("_c").alias("records"), F.max(F.when(F.col(id).isNotNull(), F.col("_c"))).alias("_most"), F.sum("_a").alias("_a"), F.sum("_u").alias("_u"))
    rules = [("COUNT_MISMATCH", F.col("records") != F.coalesce("_entries", F.lit(0))), ("SEVERAL_TO_ONE", F.col("_most") > 1), ("AMBIGUOUS", F.col("_a") > 0), ("UNMATCHED", F.col("_u") > 0)]
    return theirs.join(ours, group, "left").select(group, "records", broken(rules).alias("errors"))


def match_preview(results: DataFrame, members: DataFrame, group: str, member: str, parts: int | None = None) -> DataFrame:
    """results with status, nothing written: RACE_MISSING, UNMATCHED, DUPLICATE (a member named twice) or MATCHED. Both are shuffled once, by group (into `parts`, if given)."""
    both = results.select(group, member, F.lit(1).alias("_r")).unionByName(members.select(group, member, F.lit(0).alias("_r")))
    both = both.repartition(parts, group) if parts else both
    named = F.col("_r") == 0
    times = both.groupBy(group, member).agg(F.sum("_r").alias("_n"), F.bool_or(named).alias("_m"))
    known = times.withColumn("_g", F.bool_or("_m").over(Window.partitionBy(group))).where("_n > 0")
    status = F.when(~F.col("_g") | F.col(group).isNull(), "RACE_MISSING").when(~F.col("_m") | F.col(member).isNull(), "UNMATCHED").when(F.col("_n") > 1, "DUPLICATE").otherwise("MATCHED")
    return known.select(group, member, F.col("_n").alias("rows"), status.alias("status"))


def feature_validity(status: Column, source: Column, evidence: Column, as_of: Column, decision: Column, bad_status: list[str], bad_sources: list[str], sources: list[str]) -> Column:
    """The first reason why a feature's evidence doesn't count, or an empty string. Unknown values count as bad."""
    s, src = F.upper(F.coalesce(status, F.lit("UNKNOWN"))), F.lower(F.trim(F.coalesce(source, F.lit("unknown"))))
    return (
        F.when(s.isin(bad_status), "ACTIVE_FEATURE_PLACEHOLDER_OR_UNAVAILABLE")
        .when(src.isin(bad_sources), "ACTIVE_FEATURE_SEEDED_OR_DEFAULTED")
        .when(~src.isin(sources), "ACTIVE_FEATURE_UNKNOWN_OR_UNSUPPORTED_SOURCE")
        .when(F.coalesce(evidence, F.lit(0)) <= 0, "ACTIVE_FEATURE_NO_EVIDENCE")
        .when(~F.coalesce(as_of < decision, F.lit(False)), "ACTIVE_FEATURE_AS_OF_INVALID")
        .otherwise("")
    )


def stake_step(kind: Column) -> Column:
    out = F.lit(OTHER_DENOMINATION)
    for name, step in DENOMINATIONS.items():
        out = F.when(F.upper(kind) == name, F.lit(step)).otherwise(out)
    return out


def rounded_stake(stake: Column, kind: Column) -> Column:
    """stake brought down to a whole number of its type's steps; 0 below one step."""
    step = stake_step(kind)
    return F.when(stake >= step, F.round(F.floor(stake / step + 1e-9) * step, 2)).otherwise(0.0)


def leg_status(kind: Column, finish: Column) -> Column:
    """VOID without a finish, else HIT or MISS by the type's last winning finish."""
    needs = F.lit(None).cast("int")
    for name, n in NEEDS.items():
        needs = F.when(kind == name, F.lit(n)).otherwise(needs)
    return F.when(finish.isNull() | (finish == 0), "VOID").when(finish <= needs, "HIT").otherwise("MISS")


def whole_group_override(df: DataFrame, group: str, value: str, code: str, captured: str, post: str) -> DataFrame:
    """value from a second provider's codes where the whole group has known codes captured before its post; else as it was."""
    mapped = F.lit(None).cast("string")
    for k, v in STYLE_CODES.items():
        mapped = F.when(F.upper(F.trim(code)) == k, F.lit(v)).otherwise(mapped)
    good = F.coalesce(mapped.isNotNull() & (F.col(captured) < F.col(post)), F.lit(False))
    whole = F.min(good.cast("int")).over(Window.partitionBy(group)) == 1
    return df.withColumn("observed", whole).withColumn(value, F.when(whole, mapped).otherwise(F.col(value)))


def exact_quantiles(df: DataFrame, x: str, shares: list[float], accuracy: int = 10_000) -> list[float]:
    """Quantiles of x with linear interpolation, exact: nulls don't count; of no values, none.

    A sketch gives each quantile a bracket of about 4 / accuracy of the rows; rows below it are counted, and only those within are ordered, by
    bracket. A bracket that misses its ranks is replaced by the whole range. What comes to the driver is a few numbers a quantile.
    """
    values = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("_x"))
    ends = [min(1.0, max(0.0, q + d)) for q in shares for d in (-2 / accuracy, 2 / accuracy)]
    seen = values.agg(F.count("*").alias("n"), F.percentile_approx("_x", F.array(*map(F.lit, ends)), F.lit(accuracy)).alias("e"), F.min("_x").alias("a"), F.max("_x").alias("z")).first()
    if not seen.n:
        return []
    ranks = [q * (seen.n - 1) for q in shares]
    edge = lambda k: seen.a if ends[k] == 0 else seen.z if ends[k] == 1 else seen.e[k]
    spans = [(edge(2 * k), edge(2 * k + 1)) for k in range(len(shares))]
    for _ in range(2):
        counts = values.agg(*[F.count_if(F.col("_x") < a) for a, _ in spans], *[F.count_if(F.col("_x") <= z) for _, z in spans]).first()
        below, upto = counts[: len(spans)], counts[len(spans) :]
        spans = [(a, z) if below[k] <= math.floor(r) and upto[k] > math.ceil(r) else (seen.a, seen.z) for k, (r, (a, z)) in enumerate(zip(ranks, spans))]
    asked = [(k, int(i)) for k, r in enumerate(ranks) for i in sorted({math.floor(r), math.ceil(r)})]
    inside = F.array_compact(F.array(*[F.when(F.col("_x").between(a, z), F.lit(k)) for k, (a, z) in enumerate(spans)]))
    times = values.select("_x", F.explode(inside).alias("_k")).groupBy("_k", "_x").agg(F.count("*").alias("_n"))
    first = F.element_at(F.array(*map(F.lit, below)), F.col("_k") + 1)
    ordered = times.withColumn("_to", first + F.sum("_n").over(Window.partitionBy("_k").orderBy("_x")))
    hit = F.array_compact(F.array(*[F.when((F.col("_k") == k) & (F.col("_to") > i) & (F.col("_to") - F.col("_n") <= i), F.lit(i)) for k, i in asked]))
    found = {(r["_k"], r.i): r["_x"] for r in ordered.select("_k", "_x", F.explode(hit).alias("i")).collect()}  # two rows a quantile
    low = lambda k: found[k, math.floor(ranks[k])]
    return [low(k) + (found[k, math.ceil(r)] - low(k)) * (r - math.floor(r)) for k, r in enumerate(ranks)]


def quantile_reliability(df: DataFrame, p: str, won: str, bins: int = 10) -> DataFrame:
    """A row for each of at most `bins` quantile bins: n, mean p, share won, gap. Edges are exact; a value that is an edge lies below it."""
    q = df.where(F.col(p).isNotNull()).select(F.col(p).alias("p"), F.col(won).cast("int").alias("won"))
    edges = exact_quantiles(q, "p", [k / bins for k in range(1, bins)])
    bin_of = sum((F.when(F.col("p") > e, 1).otherwise(0) for e in edges), F.lit(0)).cast("long")
    means = q.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("_p"), F.avg("won").alias("_w"))
    return means.select("bin", "n", F.round("_p", 6).alias("mean_p"), F.round("_w", 6).alias("share"), F.round(F.abs(F.col("_p") - F.col("_w")), 6).alias("gap"))
