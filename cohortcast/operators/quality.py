"""Data quality, provenance and readiness as rules over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def codes(**rules: Column) -> Column:
    """Names of the rules that a row breaks, in the order given; a rule that is null is broken too."""
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), name.upper()) for name, broken in rules.items()]))


def source_checks(df: DataFrame, group: str, member: str, slot: str, price: str, required: list[str], expected: str | None = None) -> DataFrame:
    """(group, check, status, detail): repeated members and slots, missing values, prices, field size; one aggregation."""
    one = df.groupBy(group).agg(
        (F.count(member) - F.count_distinct(member)).alias("DUPLICATE_MEMBER"),
        (F.count(slot) - F.count_distinct(slot)).alias("DUPLICATE_SLOT"),
        *[F.count_if(F.col(c).isNull()).alias(f"MISSING_{c.upper()}") for c in required],
        F.count_if(F.col(price) <= 0).alias("BAD_PRICE"),
        *([F.abs(F.count("*") - F.max(expected)).alias("FIELD_SIZE")] if expected else []),
    )
    names = [c for c in one.columns if c != group]
    long = one.select(group, F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("detail")) for c in names])).alias("_c"))
    return long.select(group, "_c.check", F.when(F.col("_c.detail") == 0, "PASS").otherwise("FAIL").alias("status"), "_c.detail")


def run_state(df: DataFrame, group: str, expected: str, matched: str, covered: str, live: str, least_match: float = 0.90, least_cover: float = 0.80) -> DataFrame:
    """A state for each group by its worst lack, and all reasons."""
    facts = df.groupBy(group).agg(F.count("*").alias("members"), F.max(expected).alias("declared"), F.avg(F.col(matched).cast("double")).alias("match_rate"), F.avg(F.col(covered).cast("double")).alias("coverage"), F.max(F.col(live).cast("int")).alias("live"))
    reasons = codes(too_few_members=F.col("members") < 2, size_differs=F.col("members") != F.col("declared"), low_match=F.col("match_rate") < least_match, low_coverage=F.col("coverage") < least_cover, no_live_price=F.col("live") == 0)
    state = F.when(F.array_contains("reasons", "TOO_FEW_MEMBERS"), "BLOCKED").when(F.array_contains("reasons", "SIZE_DIFFERS"), "INCOMPLETE").when(F.array_contains("reasons", "LOW_MATCH"), "UNMATCHED").when(F.array_contains("reasons", "LOW_COVERAGE"), "MARKET_ONLY").when(F.array_contains("reasons", "NO_LIVE_PRICE"), "PRIOR_ONLY").otherwise("READY")
    return facts.withColumn("reasons", reasons).withColumn("state", state)


def degenerate_features(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Features that are constant or null all over a group of two members or more."""
    one = df.groupBy(group).agg(F.count("*").alias("n"), *[(F.min(c).eqNullSafe(F.max(c))).alias(c) for c in features])  # one value or none, without a shuffle of distinct ones
    return one.where("n > 1").select(group, F.array_compact(F.array(*[F.when(F.col(c), c) for c in features])).alias("degenerate"))


def forecast_validity(df: DataFrame, group: str, p: str, won: str | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Codes for each group: probabilities finite, at least 0, summing to one, and with a winner among the members."""
    x = F.col(p)
    facts = df.groupBy(group).agg(F.count_if(x.isNull() | F.isnan(x)).alias("_bad"), F.min(x).alias("_min"), F.sum(x).alias("total"), *([F.sum(F.col(won).cast("int")).alias("_won")] if won else []))
    rules = {"not_finite": F.col("_bad") > 0, "negative": F.col("_min") < 0, "sum_not_one": F.abs(F.col("total") - 1) > tolerance} | ({"no_single_winner": F.col("_won") != 1} if won else {})
    return facts.select(group, "total", codes(**rules).alias("codes"))


def log_integrity(df: DataFrame, run: str, p: str, rank: str, fair: str, lo: float = 0.98, hi: float = 1.02) -> DataFrame:
    """Codes for each logged run: sum in range, each within (0, 1), ranks agreeing with probabilities, not all equal, fair odds finite."""
    w = Window.partitionBy(run)
    again = F.rank().over(w.orderBy(F.desc(p)))
    facts = df.withColumn("_r", again).groupBy(run).agg(F.sum(p).alias("total"), F.min(p).alias("_lo"), F.max(p).alias("_hi"), F.count_if(F.col(rank) < F.col("_r")).alias("_off"), F.count("*").alias("members"), F.count_if(F.col(fair).isNull() | F.isnan(fair)).alias("_fair"))
    return facts.select(run, "members", codes(sum_out_of_range=~F.col("total").between(lo, hi), out_of_bounds=(F.col("_lo") <= 0) | (F.col("_hi") >= 1), rank_mismatch=F.col("_off") > 0, flat=(F.col("_lo") == F.col("_hi")) & (F.col("members") > 1), fair_not_finite=F.col("_fair") > 0).alias("codes"))


def missing_by_row(required: list[str]) -> Column:
    """Names of the columns that a row lacks."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in required]))


def eligibility(df: DataFrame, group: str, row_codes: str) -> DataFrame:
    """Groups whose members all pass, and the union of codes of the others."""
    return df.groupBy(group).agg(F.bool_and(F.size(row_codes) == 0).alias("eligible"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(row_codes)))).alias("blockers"))


def collapsed(df: DataFrame, group: str, p: str, prior: str, least: float = 0.0025) -> DataFrame:
    """Whether a forecast fell back on its prior: no member moved by `least`; not finite counts as collapsed."""
    gap = F.abs(F.col(p) - F.col(prior))
    return df.groupBy(group).agg(F.max(gap).alias("max_move"), F.bool_or(gap.isNull() | F.isnan(gap)).alias("_bad")).select(group, "max_move", (F.col("_bad") | (F.col("max_move") < least)).alias("collapsed"))


def lineage_rows(df: DataFrame, keys: list[str], features: list[str], source: str, as_of: str) -> DataFrame:
    """A row for each feature of each member: value, status, source and as-of time."""
    items = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]
    out = df.select(*keys, source, as_of, F.explode(F.array(*items)).alias("_f")).select(*keys, "_f.feature", "_f.value", F.col(source).alias("source"), F.col(as_of).alias("as_of"))
    return out.withColumn("status", F.when(F.col("value").isNull(), "MISSING").when(F.col("as_of").isNull(), "UNPROVEN").otherwise("OBSERVED"))


def revised(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys whose stored values materially differ from new ones, and in which columns."""
    o, n = old.select(*keys, F.struct(*columns).alias("_o")), new.select(*keys, F.struct(*columns).alias("_n"))
    both = o.join(n, keys, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_o.{c}").eqNullSafe(F.col(f"_n.{c}")), c) for c in columns]))
    return both.select(*keys, F.when(F.col("_o").isNull(), "NEW").when(F.col("_n").isNull(), "GONE").when(F.size(changed) > 0, "REVISED").otherwise("SAME").alias("change"), F.when(F.col("_o").isNotNull() & F.col("_n").isNotNull(), changed).alias("columns"))


def inferred_scratches(members: DataFrame, outcomes: DataFrame, group: str, member: str, most: int = 2) -> DataFrame:
    """Members absent from a graded group are taken as withdrawn if they are at most `most` and fewer than the finishers."""
    seen = outcomes.select(group, member).distinct().withColumn("_seen", F.lit(1))
    w = Window.partitionBy(group)
    out = members.join(seen, [group, member], "left").withColumn("_gone", F.count_if(F.col("_seen").isNull()).over(w)).withColumn("_done", F.count("_seen").over(w))
    flag = F.col("_seen").isNull() & (F.col("_done") > 0) & (F.col("_gone") <= most) & (F.col("_gone") < F.col("_done"))
    return out.withColumn("inferred_scratch", flag).drop("_seen", "_gone", "_done")
