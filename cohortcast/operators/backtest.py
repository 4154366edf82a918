"""Paper trading under as-of rules: decide before the event, settle after it, report without pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decide(df: DataFrame, group: str, member: str, p: str, decimal: str, policy: str, least_edge: float = 0.02, least_ev: float = 0.05, most: int = 1, taken: DataFrame | None = None) -> DataFrame:
    """At most `most` bets a group by expected value (then member): edge against the de-vigged price and value above the limits.
    Groups already in `taken` (policy, group) decide nothing again. Columns: policy, group, member, p, decimal, edge, ev, decision_id."""
    from cohortcast.operators.scoring import market

    priced = market(df, group, decimal).withColumn("edge", F.col(p) - F.col("market_p")).withColumn("ev", F.col(p) * F.col(decimal) - 1)
    good = priced.where((F.col("edge") >= least_edge) & (F.col("ev") >= least_ev))
    if taken is not None:
        good = good.join(taken.where(F.col("policy") == policy).select(group).distinct(), group, "left_anti")
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round("ev", 9)), member))
    best = good.withColumn("_nth", nth).where(F.col("_nth") <= most)
    return best.select(F.lit(policy).alias("policy"), group, member, p, decimal, "edge", "ev", F.sha2(F.concat_ws("|", F.lit(policy), group, member), 256).alias("decision_id"))


def settle_status(finish: Column, scratched: Column, dead_heat: Column, graded: Column) -> Column:
    return F.when(scratched, "REFUNDED_SCRATCH").when(~graded, "HELD_NO_RESULT").when(finish.isNull(), "HELD_MEMBER_MISSING").when((finish == 1) & dead_heat, "VOID_DEAD_HEAT").when(finish == 1, "WON").otherwise("LOST")


def net(status: Column, stake: Column, decimal: Column) -> Column:
    """Units won or lost; nothing while held, refunded or void."""
    return F.when(status == "WON", stake * (decimal - 1)).when(status == "LOST", -stake).otherwise(0.0)


def settle(bets: DataFrame, outcomes: DataFrame, group: str, member: str, stake: Column) -> DataFrame:
    """bets with status and net; outcomes: (group, member, finish, scratched). A group without any finish is not graded yet."""
    per = outcomes.groupBy(group).agg(F.count("finish").alias("_done"), F.count_if(F.col("finish") == 1).alias("_firsts"))
    out = bets.join(outcomes.select(group, member, "finish", "scratched"), [group, member], "left").join(per, group, "left")
    status = settle_status(F.col("finish"), F.coalesce("scratched", F.lit(False)), F.col("_firsts") > 1, F.coalesce(F.col("_done"), F.lit(0)) > 0)
    return out.withColumn("status", status).withColumn("net", net(F.col("status"), stake, F.col("decimal"))).drop("_done", "_firsts")


def report(settled: DataFrame, by: list[str], stake: Column) -> DataFrame:
    """Per policy and class: bets, wins, turnover, net, return, expected wins and how far wins are from them."""
    live = F.col("status").isin("WON", "LOST")
    out = settled.groupBy(*by).agg(F.count_if(live).alias("bets"), F.count_if(F.col("status") == "WON").alias("wins"), F.sum(F.when(live, stake).otherwise(0.0)).alias("turnover"), F.sum("net").alias("net"), F.sum(F.when(live, F.col("p"))).alias("expected_wins"), F.sum(F.when(live, F.col("p") * (1 - F.col("p")))).alias("_v"))
    return out.withColumn("roi", F.when(F.col("turnover") > 0, F.col("net") / F.col("turnover"))).withColumn("z", F.when(F.col("_v") > 0, (F.col("wins") - F.col("expected_wins")) / F.sqrt("_v"))).drop("_v")


#: Settled bets without which no verdict on the return, or on closing-line value, is given.
LEAST_BETS, LEAST_CLOSES = 100, 50


def closing_line_value(taken: Column, closing: Column) -> Column:
    """How much better the price taken was than the last one."""
    return F.when(closing > 0, taken / closing - 1)


def performance(settled: DataFrame, by: list[str], stake: Column) -> DataFrame:
    """Of won and lost bets by `by`: bets, refunded, staked, returned, profit, roi, hit_rate, expected_hit_rate, wins, expected_wins, wins_z, mean_decimal,
    mean_clv, positive_clv, and needed (bets without which a return of 5 % isn't seen). settled: status, net, p, decimal and clv."""
    live = F.col("status").isin("WON", "LOST")
    on = lambda c: F.when(live, c)
    won = (F.col("status") == "WON").cast("double")
    out = settled.withColumn("_stake", stake.cast("double")).groupBy(*by).agg(
        F.count_if(live).alias("bets"), F.count_if(F.col("status") == "REFUNDED_SCRATCH").alias("refunded"), F.coalesce(F.sum(on(F.col("_stake"))), F.lit(0.0)).alias("staked"), F.coalesce(F.sum(on(F.col("net"))), F.lit(0.0)).alias("profit"),
        F.avg(on(won)).alias("hit_rate"), F.avg(on(F.col("p"))).alias("expected_hit_rate"), F.count_if(F.col("status") == "WON").alias("wins"), F.sum(on(F.col("p"))).alias("expected_wins"), F.sum(on(F.col("p") * (1 - F.col("p")))).alias("_v"),
        F.avg(on(F.col("decimal"))).alias("mean_decimal"), F.avg(on(F.col("clv"))).alias("mean_clv"), F.avg(on((F.col("clv") > 0).cast("double"))).alias("positive_clv"), F.stddev_samp(on(F.col("net") / F.col("_stake"))).alias("_sd"),
    )
    z = F.when(F.col("_v") > 0, (F.col("wins") - F.col("expected_wins")) / F.sqrt("_v"))
    roi = F.when(F.col("staked") > 0, F.col("profit") / F.col("staked"))
    needed = F.when(F.col("_sd") > 0, F.ceil(F.pow(1.96 * F.col("_sd") / 0.05, 2)))
    return out.withColumn("returned", F.col("staked") + F.col("profit")).withColumn("roi", roi).withColumn("wins_z", z).withColumn("needed", needed).drop("_v", "_sd")


def verdicts(settled: DataFrame, by: list[str], bet: str, stake: Column, reps: int = 2000, seed: int = 7) -> DataFrame:
    """roi and mean closing-line value of won and lost bets with bootstrap intervals over bets (told by the column `bet`), and what they allow to say."""
    from cohortcast.operators.resample import intervals

    live = settled.where(F.col("status").isin("WON", "LOST")).select(*by, bet, F.col("net").alias("_net"), stake.cast("double").alias("_stake"), F.col("clv").alias("_clv"), F.col("clv").isNotNull().cast("double").alias("_closed"))
    out = intervals(live, by, bet, {"roi": ("_net", "_stake"), "clv": ("_clv", "_closed")}, reps, seed)
    said = F.when(F.col("n") < LEAST_BETS, "INSUFFICIENT_DATA").when(F.col("roi_lo") > 0, "PROFITABLE_AFTER_TAKEOUT").when(F.col("roi_hi") < 0, "LOSING").otherwise("NOT_DISTINGUISHABLE_FROM_BREAKEVEN")
    close = F.when(F.col("n") < LEAST_CLOSES, "INSUFFICIENT_DATA").when(F.col("clv_lo") > 0, "BEATING_THE_CLOSE").when(F.col("clv_hi") < 0, "WORSE_THAN_THE_CLOSE").otherwise("NOT_DISTINGUISHABLE_FROM_THE_CLOSE")
    return out.withColumn("verdict", said).withColumn("clv_verdict", close)


def max_drawdown(settled: DataFrame, by: list[str], day: str, order: list[str], net: str = "net") -> DataFrame:
    """The greatest fall of the running balance from its peak (at least 0), for each of `by`, in order of day, then `order`.

    Two levels: windows inside a day give each day's total, highest and lowest balance and own fall; a window over days, one row
    each, carries balance and peak on. No task holds all rows of a hot key.
    """
    inside = Window.partitionBy(*by, day).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = settled.withColumn("_b", F.sum(net).over(inside)).withColumn("_h", F.greatest(F.lit(0.0), F.max("_b").over(inside)))
    days = sums.groupBy(*by, day).agg(F.sum(net).alias("_t"), F.max("_h").alias("_high"), F.min("_b").alias("_low"), F.max(F.col("_h") - F.col("_b")).alias("_fall"))
    past = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    carried = days.withColumn("_before", F.coalesce(F.sum("_t").over(past), F.lit(0.0)))
    peak = F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("_before") + F.col("_high")).over(past), F.lit(0.0)))
    falls = carried.withColumn("_peak", peak)
    return falls.groupBy(*by).agg(F.max(F.greatest(F.col("_fall"), F.col("_peak") - F.col("_before") - F.col("_low"))).alias("max_drawdown"))
