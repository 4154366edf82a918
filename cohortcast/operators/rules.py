"""Predicates and classifications of members and cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def field_size_bucket(n: Column) -> Column:
    return F.when(n.isNull() | (n <= 0), "Unknown").when(n <= 6, "small").when(n <= 9, "medium").when(n <= 12, "large").otherwise("full")


def distance_category(furlongs: Column, cut: float = 8.5) -> Column:
    """sprint below the cut, route from it on; the cut is a parameter, for sources differ."""
    return F.when(furlongs < cut, "sprint").when(furlongs >= cut, "route")


def surface_key(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.startswith("d") | t.contains("dirt"), "dirt").when(t.startswith("t") | t.contains("turf") | t.contains("grass"), "turf").when(t.startswith("a") | t.contains("synth"), "synthetic")


def value_tag(edge: Column, high: float = 0.02, low: float = -0.02) -> Column:
    """bet, underlay or neutral; null without a market."""
    return F.when(edge.isNull(), None).when(edge >= high, "bet").when(edge <= low, "underlay").otherwise("neutral")


def grade_tag(p: Column, m: Column, decimal: Column) -> Column:
    """STRONG, VALUE, WATCH, FADE or PASS by edge and expected value."""
    edge, ev = p - m, p * decimal - 1
    return F.when(p.isNull() | m.isNull() | decimal.isNull(), "PASS").when((edge >= 0.05) & (ev >= 0.20), "STRONG").when((edge >= 0.02) & (ev >= 0.05), "VALUE").when(ev > 0, "WATCH").when(edge <= -0.05, "FADE").otherwise("PASS")


def market_eligibility(kind: Column, captured: Column, post: Column) -> Column:
    """A struct (eligible, reason): live evidence must be captured before the post time, prior prices are never live."""
    reason = F.when(kind == "morning_line", "PRIOR_NOT_LIVE").when(captured.isNull(), "NO_CAPTURE_TIME").when(post.isNull(), "NO_POST_TIME").when(captured >= post, "AT_OR_AFTER_POST").otherwise("OK")
    return F.struct((reason == "OK").alias("eligible"), reason.alias("reason"))


def as_of_class(known: Column, event_date: Column, event_ts: Column) -> Column:
    """How a row's time proves that it was known before its event; a date alone proves only earlier days."""
    return (
        F.when(known.isNull(), "UNPROVEN_NO_TIME")
        .when(event_ts.isNotNull() & (known < event_ts), "PROVEN_BEFORE_POST")
        .when(event_ts.isNotNull(), "AFTER_POST")
        .when(event_date.isNull(), "UNPROVEN_NO_EVENT")
        .when(F.to_date(known) < event_date, "PROVEN_EARLIER_DAY")
        .otherwise("UNPROVEN_SAME_DAY")
    )


def served(mode: Column, base: Column, learned: Column) -> Column:
    """The learned value only in live mode; any unknown mode serves the base."""
    return F.when(F.lower(mode) == "live", F.coalesce(learned, base)).otherwise(base)


def guarded_tag(tag: Column, confidence: Column) -> Column:
    return F.when((confidence == "LOW") & (tag == "bet"), "neutral").otherwise(tag)


def contain(df: DataFrame, valid: Column, columns: list[str], reason: Column) -> DataFrame:
    """Actionable columns become null where a row isn't valid, which the column `withheld` explains."""
    return df.withColumns({c: F.when(valid, F.col(c)) for c in columns} | {"withheld": F.when(~valid, reason)})


def choose_rule(df: DataFrame, rules: DataFrame, keys: list[str], value: str, default: str) -> DataFrame:
    """The rule table's value for the keys, else the default, and which of them it is. Rules are a parameter of a few rows."""
    out = df.join(F.broadcast(rules.select(*keys, F.col(value).alias("_v")).dropDuplicates(keys)), keys, "left")
    return out.withColumn(value, F.coalesce("_v", F.lit(default))).withColumn(f"{value}_reason", F.when(F.col("_v").isNull(), "default").otherwise("rule")).drop("_v")


def follows_prices(df: DataFrame, group: str, p: str, price_p: str, tolerance: float = 1e-6) -> DataFrame:
    """Whether a group's forecast is only its price shares: no member differs by the tolerance."""
    w = Window.partitionBy(group)
    gap = F.abs(F.col(p) / F.sum(p).over(w) - F.col(price_p) / F.sum(price_p).over(w))
    return df.withColumn("_gap", gap).groupBy(group).agg((F.max("_gap") < tolerance).alias("follows_prices"))


def workflow_status(scored: Column, graded: Column) -> Column:
    return F.when(~scored, "unscored").when(~graded, "scored_no_result").otherwise("calibrated")
