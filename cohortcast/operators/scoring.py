"""From features to probabilities, tags and picks, for all groups at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortcast.operators.windows import field_norm, share, softmax


def weighted_signal(df: DataFrame, group: str, weights: dict[str, float], out: str = "signal") -> DataFrame:
    """Sum of weights (scaled to one) times the features' group norms."""
    total = sum(weights.values())
    for c in weights:
        df = field_norm(df, group, c, f"_norm_{c}")
    signal = sum((F.col(f"_norm_{c}") * (w / total) for c, w in weights.items()), F.lit(0.0))
    return df.withColumn(out, signal).drop(*[f"_norm_{c}" for c in weights])


def probabilities(df: DataFrame, group: str, weights: dict[str, float], scale: float = 8.0, out: str = "p") -> DataFrame:
    return softmax(weighted_signal(df, group, weights, "_signal"), group, "_signal", scale, out).drop("_signal")


def market(df: DataFrame, group: str, decimal: str) -> DataFrame:
    """market_p (implied prices over their sum) and overround; null for a group with any price that is no price."""
    w = Window.partitionBy(group)
    ok = F.min(F.coalesce((F.col(decimal) > 1).cast("int"), F.lit(0))).over(w) == 1
    total = F.sum(F.when(F.col(decimal) > 1, 1 / F.col(decimal))).over(w)
    return df.withColumn("overround", F.when(ok, total)).withColumn("market_p", F.when(ok, 1 / F.col(decimal) / total))


def place_show(p: Column, n: Column) -> tuple[Column, Column]:
    """Rule-of-thumb chances of the first two and three."""
    return F.least(F.lit(1.0), 0.45 * p + 0.55 / n), F.least(F.lit(1.0), 0.35 * p + 0.65 / n)


def confidence(df: DataFrame, group: str, p: str, coverage: str, agree: str) -> DataFrame:
    """A score from the field's lead, evidence and agreement, a level, and the top reasons."""
    w = Window.partitionBy(group)
    best = F.max(p).over(w)
    second = F.nth_value(p, 2).over(w.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lead = F.least(F.lit(1.0), (best - F.coalesce(second, F.lit(0.0))) / 0.25)
    even = 1 - F.least(F.lit(1.0), F.count("*").over(w) / 20)
    score = 0.35 * lead + 0.25 * F.coalesce(coverage, F.lit(0.0)) + 0.30 * F.coalesce(agree, F.lit(0.0)) + 0.10 * even
    reasons = F.slice(F.array_compact(F.array(F.when(lead < 0.25, "NO_CLEAR_LEADER"), F.when(F.coalesce(coverage, F.lit(0.0)) < 0.5, "THIN_EVIDENCE"), F.when(F.coalesce(agree, F.lit(0.0)) < 0.5, "MARKET_DISAGREES"), F.when(even < 0.4, "LARGE_FIELD"))), 1, 3)
    return df.withColumn("confidence_score", score).withColumn("confidence", F.when(F.col("confidence_score") >= 0.70, "HIGH").when(F.col("confidence_score") >= 0.45, "MEDIUM").otherwise("LOW")).withColumn("confidence_reasons", reasons)


def lift_longshots(df: DataFrame, group: str, p: str, flagged: str, floor: float = 0.035, pool: float = 0.05, out: str = "patched_p") -> DataFrame:
    """Takes `pool` of the probability from members above the field's 70 % quantile (unless flagged) and gives
    it to flagged members below that, by their shares; each is at least the floor if flagged; sums to one again."""
    w = Window.partitionBy(group)
    df = df.withColumn("_cut", F.percentile(p, F.lit(0.7)).over(w))
    donor = (F.col(p) >= F.col("_cut")) & ~F.col(flagged)
    taker = F.col(flagged) & (F.col(p) < F.col("_cut"))
    df = df.withColumn("_gave", F.sum(F.when(donor, F.col(p)).otherwise(0.0)).over(w)).withColumn("_got", F.sum(F.when(taker, F.col(p)).otherwise(0.0)).over(w))
    moved = F.when((F.col("_got") > 0) & (F.col("_gave") > 0), pool).otherwise(0.0)
    raw = F.when(donor, F.col(p) - moved * F.col("_gave") * F.col(p) / F.col("_gave")).when(taker, F.greatest(F.lit(floor), F.col(p) + moved * F.col("_gave") * F.col(p) / F.col("_got"))).otherwise(F.col(p))
    return share(df.withColumn("_raw", raw), group, "_raw", out).drop("_raw", "_cut", "_gave", "_got")


def picks(df: DataFrame, group: str, member: str, chances: dict[str, tuple[str, str, float, float]], least_field: int = 5, most: int = 3) -> DataFrame:
    """Up to `most` picks a group: bet types as name: (our chance, the market's, least chance, least lead), best leads first."""
    w = Window.partitionBy(group)
    rows = F.array(*[F.struct(F.lit(k).alias("bet"), F.col(a).cast("double").alias("ours"), F.col(b).cast("double").alias("theirs"), F.lit(p).alias("_p"), F.lit(d).alias("_d")) for k, (a, b, p, d) in chances.items()])
    long = df.withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= least_field).select(group, member, F.explode(rows).alias("_r")).select(group, member, "_r.*")
    good = long.withColumn("lead", F.col("ours") - F.col("theirs")).where((F.col("ours") >= F.col("_p")) & (F.col("lead") >= F.col("_d")))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round("lead", 9)), member, "bet"))
    return good.withColumn("nth", nth).where(F.col("nth") <= most).withColumn("long_shot", F.col("ours") >= 2 * F.col("theirs")).withColumn("break_even", 1 / F.col("ours")).drop("_p", "_d")


def stakes(df: DataFrame, p: str, decimal: str, bankroll: float, fraction: float = 0.25, cap: float = 0.05, unit: float = 2.0) -> DataFrame:
    """Fractional growth-optimal stakes, capped, down to whole units; below one unit the action is PASS."""
    from cohortcast.functions.odds import kelly, round_stake

    stake = round_stake(bankroll * F.least(F.lit(cap), fraction * kelly(F.col(p), F.col(decimal))), F.lit(unit))
    return df.withColumn("stake", F.coalesce(stake, F.lit(0.0))).withColumn("action", F.when(F.col("stake") >= unit, "BET").otherwise("PASS"))


#: Fixed values of the dark-horse patch: the index from which it works, the share of chance moved there and at index 1, the floor, and the multipliers of favourites
#: that close from the rail, press inside, and press outside.
PATCH_FROM, LEAST_MOVED, MOST_MOVED, PATCH_FLOOR = 0.70, 0.05, 0.10, 0.035
RAIL_CLOSER, INNER, OUTER = 0.90, 0.95, 1.05


def dark_horses(df: DataFrame, group: str, index: str, p: str = "p") -> DataFrame:
    """df with the patch for cards of great chaos: dark_horse, upside, p_multiplied, p_floored, beneficiary, p_patched and dark_tier (none, light, strong).

    Columns read: energy, development, pace, distance, publicness (0 to 10), late_z, and the flags rail_closer, tactical_inner, tactical_outer; index is the card's (0 to 1).
    Dark horses have a chance of 0.015 to 0.12, publicness of 7 at most, development or energy of 7, and pace or distance fit of 6. From the index on, favourites are
    multiplied and the best dark horses lifted to the floor; then donors (flagged favourites, or members without upside from the card's 70 % quantile on) give a share of the field's
    chance, at most 0.6 of theirs, by their chance, to beneficiaries by upside times late_z. Null scores are no dark horse's; null flags are false; chances that sum to nothing are null.
    """
    c, w = F.col, Window.partitionBy(group)
    flag = lambda x: F.coalesce(c(x).cast("boolean"), F.lit(False))
    total = F.sum(p).over(w)
    out = df.withColumn("_b", F.when(total > 0, c(p) / total)).withColumn("_on", F.coalesce(c(index) >= PATCH_FROM, F.lit(False)))
    dark = c("_b").between(0.015, 0.12) & (c("publicness") <= 7) & ((c("development") >= 7) | (c("energy") >= 7)) & ((c("pace") >= 6) | (c("distance") >= 6))
    out = out.withColumn("dark_horse", F.coalesce(dark, F.lit(False))).withColumn("upside", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (0.5 * c("development") + 0.5 * c("energy")) / 10)))
    factor = F.when(flag("rail_closer"), RAIL_CLOSER).otherwise(1.0) * F.when(flag("tactical_inner"), INNER).otherwise(1.0) * F.when(flag("tactical_outer"), OUTER).otherwise(1.0)
    out = out.withColumn("p_multiplied", F.when(c("_on"), c("_b") * factor).otherwise(c("_b")))
    late = F.coalesce("late_z", F.lit(-9.0))
    lifted = c("_on") & c("dark_horse") & (c("upside") >= 0.7) & (late >= 0.7) & (c("pace") >= 7)
    out = out.withColumn("p_floored", F.when(lifted, F.greatest("p_multiplied", F.lit(PATCH_FLOOR))).otherwise(c("p_multiplied")))
    out = out.withColumn("beneficiary", F.coalesce(c("dark_horse") & (c("upside") >= 0.5) & (late >= 0) & (c("pace") >= 6), F.lit(False)))
    out = out.withColumn("_cut", F.percentile("_b", F.lit(0.7)).over(w))
    plain = F.coalesce((c("upside") <= 0.4) & (c("_b") >= c("_cut")), F.lit(False))
    donor = ~c("dark_horse") & ~flag("tactical_outer") & (flag("rail_closer") | flag("tactical_inner") | plain)
    out = out.withColumn("_gives", F.when(donor, c("_b")).otherwise(0.0)).withColumn("_takes", F.when(c("beneficiary"), c("upside") * F.greatest(late, F.lit(0.1))).otherwise(0.0))
    given, taken = F.sum("_gives").over(w), F.sum("_takes").over(w)
    share_moved = F.least(F.lit(MOST_MOVED), F.greatest(F.lit(LEAST_MOVED), LEAST_MOVED + (MOST_MOVED - LEAST_MOVED) * (c(index) - PATCH_FROM) / (1 - PATCH_FROM)))
    out = out.withColumn("_given", given).withColumn("_taken", taken).withColumn("_moved", F.when(c("_on") & (c("_given") > 0) & (c("_taken") > 0), F.least(share_moved, 0.6 * c("_given"))).otherwise(0.0))
    raw = c("p_floored") - F.when(c("_given") > 0, c("_gives") / c("_given") * c("_moved")).otherwise(0.0) + F.when(c("_taken") > 0, c("_takes") / c("_taken") * c("_moved")).otherwise(0.0)
    tier = F.when(~c("dark_horse"), "none").when(c("upside") >= 0.7, "strong").otherwise("light")
    return share(out.withColumn("_raw", raw), group, "_raw", "p_patched").withColumn("dark_tier", tier).drop("_b", "_on", "_cut", "_gives", "_takes", "_given", "_taken", "_moved", "_raw")
