"""Queries within fields: shares, ranks, norms, softmax, chances, drawdown, slots."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortcast.functions import odds
from cohortcast.operators import joins, rules, windows
from cohortcast.queries.frames import DATED, FIELD, dated, field, table, with_sql

r = lambda c, k=6: F.round(c, k).alias(c)


def field_probabilities(spark, d):
    f = windows.probability_rank(field(spark, d), "card", "p", "post")
    return f.select("card", "member", r("p"), "model_rank", odds.fair_to_one(F.col("p")).alias("fair_odds"), odds.edge(F.col("p"), F.col("m")).alias("edge"), rules.value_tag(F.round(F.col("p") - F.col("m"), 9)).alias("tag"))


FIELD_PROBABILITIES = with_sql(FIELD, """SELECT card, member, round(p, 6) AS p, CAST(row_number() OVER (PARTITION BY card ORDER BY p DESC, post) AS INT) AS model_rank, round(1 / p - 1, 2) AS fair_odds, round(p - m, 4) AS edge,
CASE WHEN round(p - m, 9) >= 0.02 THEN 'bet' WHEN round(p - m, 9) <= -0.02 THEN 'underlay' ELSE 'neutral' END AS tag FROM field""")


def w05_price_rank(spark, d):
    f = windows.price_rank(field(spark, d), "card", "price")
    return f.select("card", "member", "price", "price_rank")


def w02_effective_rank(spark, d):
    f = field(spark, d).withColumn("scratched", F.col("surface") == "R")
    return windows.effective_rank(f, "card", "scratched", "post").select("card", "member", "scratched", "effective_rank")


def w06_average_rank(spark, d):
    return windows.average_rank(field(spark, d), ["card"], "m").select("card", "member", r("avg_rank"))


def w07_z_score(spark, d):
    return windows.z_score(field(spark, d), "card", "qty").select("card", "member", r("z"))


def w08_field_norm(spark, d):
    f = field(spark, d).withColumn("x", F.when(F.col("surface") != "N", F.col("price")))
    return windows.field_norm(f, "card", "x", "norm").select("card", "member", r("norm"))


def w10_race_shape(spark, d):
    from cohortcast.operators.features import race_shape

    f = field(spark, d).withColumn("style", F.when(F.col("member") % 5 < 4, F.element_at(F.array(*map(F.lit, ["front", "presser", "stalker", "closer"])), (F.col("member") % 5 + 1).cast("int"))))
    return race_shape(f, "card", "style", ["front", "presser"]).select("card", "member", r("pressure"), "shape", "lone_speed")


W10 = with_sql(FIELD, """, s AS (SELECT *, CASE member % 5 WHEN 0 THEN 'front' WHEN 1 THEN 'presser' WHEN 2 THEN 'stalker' WHEN 3 THEN 'closer' END AS style FROM field),
c AS (SELECT card, count(style) AS known, count(*) FILTER (style IN ('front', 'presser')) AS front, count(DISTINCT style) AS kinds FROM s GROUP BY card),
u AS (SELECT s.card, s.member, s.style, front, CASE WHEN known / n >= 0.4 AND kinds > 1 THEN front / known END AS pressure FROM s JOIN c USING (card))
SELECT card, member, round(pressure, 6) AS pressure, CASE WHEN pressure < 0.4 THEN 'soft' WHEN pressure < 0.65 THEN 'fair' WHEN pressure IS NOT NULL THEN 'hot' END AS shape,
CASE WHEN pressure IS NOT NULL THEN CASE WHEN front <> 1 THEN false ELSE style IN ('front', 'presser') END END AS lone_speed FROM u""").replace("\n, s AS", ",\ns AS", 1)


def w13_drawdown(spark, d):
    o = table(spark, d, "orders").withColumn("net", F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(-1.0))
    return windows.drawdown(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "net").groupBy("o_custkey").agg(F.max("fall").alias("max_drawdown"), F.max("peak").alias("peak"))


def w14_top_two_gap(spark, d):
    return windows.top_two_gap(field(spark, d), "card", "p").select("card", r("gap"))


def w15_prior_mean(spark, d):
    return windows.prior_mean(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_orderkey", r("prior_mean"))


def w12_running_mean(spark, d):
    return windows.cumulative_mean(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_orderkey", r("running_mean"))


def w16_drift(spark, d):
    e = windows.drift_series(table(spark, d, "events").where("value IS NOT NULL AND value > 0"), ["user_id"], ["ts", "event_id"], "value")
    return e.select("event_id", r("from_opening"), r("from_previous"), odds.price_drift(F.col("opening"), F.col("value")).alias("drift"))


def w17_date_blocks(spark, d):
    o = windows.date_blocks(table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")), "day", 5)
    return o.groupBy("block").agg(F.count("*").alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def w18_split(spark, d):
    o = windows.split_by_date(table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")), "day")
    return o.groupBy("part").agg(F.count("*").alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def w20_free_slots(spark, d):
    f = field(spark, d).withColumn("slot", F.when(F.col("member") % 3 == 0, (F.col("member") % 20 + 1).cast("int")))
    return windows.free_slots(f, "card", "slot", "member", 40).select("card", "member", "slot", "assigned", "clash")


W20 = with_sql(FIELD, """, s AS (SELECT card, member, CASE WHEN member % 3 = 0 THEN CAST(member % 20 + 1 AS INT) END AS slot FROM field),
x AS (SELECT *, list_sort(list_filter(range(1, 41), lambda v: NOT list_contains(coalesce(list(slot) FILTER (slot IS NOT NULL) OVER (PARTITION BY card), []), v))) AS free,
row_number() OVER (PARTITION BY card, slot IS NULL ORDER BY member) AS nth, count(*) OVER (PARTITION BY card, slot) AS c FROM s)
SELECT card, member, slot, CAST(coalesce(slot, free[nth]) AS INT) AS assigned, slot IS NOT NULL AND c > 1 AS clash FROM x""").replace("\n, s AS", ",\ns AS", 1)


def k04_best_candidates(spark, d):
    f = field(spark, d).withColumn("ev", F.round(F.col("p") * F.col("decimal") - 1, 9))
    return windows.latest_k(f, ["card"], [F.desc("ev"), "member"], 2).select("card", "member", r("ev"), "nth")


def a34_softmax(spark, d):
    return windows.softmax(field(spark, d), "card", "p", 4.0, "s").select("card", "member", r("s"))


def j16_harville(spark, d):
    return joins.harville(field(spark, d), "card", "member", "m").select("card", "member", r("win"), r("place"), r("show"))


J16 = with_sql(FIELD, """, s AS (SELECT a.card, a.member, sum(CASE WHEN b.m < 1 THEN b.m * a.m / (1 - b.m) ELSE 0 END) AS v FROM field a JOIN field b ON a.card = b.card AND a.member <> b.member GROUP BY 1, 2),
t AS (SELECT a.card, a.member, sum(CASE WHEN 1 - b.m - c.m > 1e-12 AND b.m < 1 THEN b.m * c.m / (1 - b.m) * a.m / (1 - b.m - c.m) ELSE 0 END) AS v
FROM field a JOIN field b ON a.card = b.card AND a.member <> b.member JOIN field c ON a.card = c.card AND c.member <> a.member AND c.member <> b.member GROUP BY 1, 2)
SELECT f.card, f.member, round(f.m, 6) AS win, round(CASE WHEN n <= 2 THEN 1 ELSE least(1, f.m + coalesce(s.v, 0)) END, 6) AS place,
round(CASE WHEN n <= 3 THEN 1 ELSE least(1, f.m + coalesce(s.v, 0) + coalesce(t.v, 0)) END, 6) AS show
FROM field f LEFT JOIN s USING (card, member) LEFT JOIN t USING (card, member)""").replace("\n, s AS", ",\ns AS", 1)


def f14_devig_power(spark, d):
    f = field(spark, d).groupBy("card").agg(F.array_sort(F.collect_list(1 / F.col("decimal"))).alias("ps")).where((F.size("ps") > 1) & (F.array_max("ps") < 1))
    q = f.withColumn("q", odds.devig_power("ps"))
    return q.select("card", F.round(F.aggregate("q", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("q").alias("members"), F.forall("q", lambda x: (x > 0) & (x < 1)).alias("valid"))


def p03_race_type(spark, d):
    f = dated(spark, d).withColumn("furlongs", F.round(F.col("qty") / 5, 2))
    kind = rules.distance_category(F.col("furlongs"))
    return f.select("card", "member", "furlongs", kind.alias("category"), F.concat_ws("_", F.lower("surface"), kind).alias("race_type"), rules.field_size_bucket(F.col("n")).alias("size_bucket"))


def p07_choose_rule(spark, d):
    rows = [("A", "sprint", "light"), ("A", "route", "none"), ("N", "route", "heavy"), ("R", "sprint", "light")]
    f = field(spark, d).withColumn("category", rules.distance_category(F.col("qty") / 5))
    return rules.choose_rule(f, spark.createDataFrame(rows, "surface string, category string, tier string"), ["surface", "category"], "tier", "none").select("card", "member", "tier", "tier_reason")


def p14_grade(spark, d):
    f = field(spark, d)
    return f.select("card", "member", rules.grade_tag(F.round("p", 9), F.round("m", 9), F.round("decimal", 6)).alias("grade"))


def p22_follows_prices(spark, d):
    f = field(spark, d).withColumn("x", F.when(F.col("card") % 4 == 0, F.col("m") * 3).otherwise(F.col("p")))
    return rules.follows_prices(f, "card", "x", "m")


QUERIES = {
    "field_probabilities": (field_probabilities, FIELD_PROBABILITIES),
    "w05_price_rank": (w05_price_rank, with_sql(FIELD, "SELECT card, member, price, CAST(rank() OVER (PARTITION BY card ORDER BY price) AS INT) AS price_rank FROM field")),
    "w02_effective_rank": (w02_effective_rank, with_sql(FIELD, "SELECT card, member, surface = 'R' AS scratched, CAST(row_number() OVER (PARTITION BY card ORDER BY CASE WHEN surface = 'R' THEN 1 ELSE 0 END, post) AS INT) AS effective_rank FROM field")),
    "w06_average_rank": (w06_average_rank, with_sql(FIELD, "SELECT card, member, round(rank() OVER (PARTITION BY card ORDER BY round(m, 12) DESC) + (count(*) OVER (PARTITION BY card, round(m, 12)) - 1) / 2, 6) AS avg_rank FROM field")),
    "w07_z_score": (w07_z_score, with_sql(FIELD, "SELECT card, member, round(CASE WHEN stddev_samp(qty) OVER w IS NOT NULL THEN greatest(-3, least(3, (qty - avg(qty) OVER w) / greatest(stddev_samp(qty) OVER w, 1))) END, 6) AS z FROM field WINDOW w AS (PARTITION BY card)")),
    "w08_field_norm": (w08_field_norm, with_sql(FIELD, "SELECT card, member, round(CASE WHEN max(x) OVER w > min(x) OVER w THEN (coalesce(x, quantile_cont(x, 0.5) OVER w) - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) ELSE 0.5 END, 6) AS norm FROM (SELECT *, CASE WHEN surface <> 'N' THEN price END AS x FROM field) WINDOW w AS (PARTITION BY card)")),
    "w10_race_shape": (w10_race_shape, W10),
    "w12_running_mean": (w12_running_mean, "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 6) AS running_mean FROM orders"),
    "w13_drawdown": (w13_drawdown, "WITH b AS (SELECT *, sum(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) OVER w AS balance FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)), p AS (SELECT *, greatest(0.0, max(balance) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)) AS peak FROM b) SELECT o_custkey, max(peak - balance) AS max_drawdown, max(peak) AS peak FROM p GROUP BY 1"),
    "w14_top_two_gap": (w14_top_two_gap, with_sql(FIELD, "SELECT card, round(max(p) - coalesce(list(p ORDER BY p DESC)[2], 0), 6) AS gap FROM field GROUP BY 1")),
    "w15_prior_mean": (w15_prior_mean, "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS prior_mean FROM orders"),
    "w16_drift": (w16_drift, "WITH e AS (SELECT *, first_value(value) OVER w AS o, lag(value) OVER w AS b FROM events WHERE value > 0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, round(value / o - 1, 6) AS from_opening, round(value / b - 1, 6) AS from_previous, CASE WHEN value / o - 1 <= -0.05 THEN 'shortening' WHEN value / o - 1 >= 0.05 THEN 'drifting' ELSE 'steady' END AS drift FROM e"),
    "w17_date_blocks": (w17_date_blocks, "WITH d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)) SELECT CAST(floor(k * 5 / n) AS INT) AS block, count(*) AS rows, min(day) AS first_day, max(day) AS last_day FROM orders JOIN d ON day = CAST(o_orderdate AS DATE) GROUP BY 1"),
    "w18_split": (w18_split, "WITH d AS (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)) SELECT CASE WHEN k / n <= 0.7 THEN 'train' WHEN k / n <= 0.7 + 0.15 THEN 'valid' ELSE 'test' END AS part, count(*) AS rows, min(day) AS first_day, max(day) AS last_day FROM orders JOIN d ON day = CAST(o_orderdate AS DATE) GROUP BY 1"),
    "w20_free_slots": (w20_free_slots, W20),
    "k04_best_candidates": (k04_best_candidates, with_sql(FIELD, "SELECT card, member, round(ev, 6) AS ev, nth FROM (SELECT card, member, round(p * decimal - 1, 9) AS ev, CAST(row_number() OVER (PARTITION BY card ORDER BY round(p * decimal - 1, 9) DESC, member) AS INT) AS nth FROM field) WHERE nth <= 2")),
    "a34_softmax": (a34_softmax, with_sql(FIELD, "SELECT card, member, round(e / sum(e) OVER (PARTITION BY card), 6) AS s FROM (SELECT card, member, exp((p - max(p) OVER (PARTITION BY card)) * 4) AS e FROM field)")),
    "j16_harville": (j16_harville, J16),
    "f14_devig_power": (f14_devig_power, with_sql(FIELD, "SELECT card, 1.0::DOUBLE AS total, CAST(count(*) AS INT) AS members, true AS valid FROM field GROUP BY 1 HAVING count(*) > 1 AND max(1 / decimal) < 1")),
    "p03_race_type": (p03_race_type, with_sql(DATED, "SELECT card, member, round(qty / 5, 2) AS furlongs, CASE WHEN round(qty / 5, 2) < 8.5 THEN 'sprint' ELSE 'route' END AS category, lower(surface) || '_' || CASE WHEN round(qty / 5, 2) < 8.5 THEN 'sprint' ELSE 'route' END AS race_type, CASE WHEN n <= 6 THEN 'small' WHEN n <= 9 THEN 'medium' WHEN n <= 12 THEN 'large' ELSE 'full' END AS size_bucket FROM dated")),
    "p07_choose_rule": (p07_choose_rule, with_sql(FIELD, "SELECT card, member, coalesce(r.tier, 'none') AS tier, CASE WHEN r.tier IS NULL THEN 'default' ELSE 'rule' END AS tier_reason FROM field f LEFT JOIN (VALUES ('A', 'sprint', 'light'), ('A', 'route', 'none'), ('N', 'route', 'heavy'), ('R', 'sprint', 'light')) r(s, c, tier) ON f.surface = r.s AND CASE WHEN qty / 5 < 8.5 THEN 'sprint' ELSE 'route' END = r.c")),
    "p14_grade": (p14_grade, with_sql(FIELD, "SELECT card, member, CASE WHEN e >= 0.05 AND v >= 0.2 THEN 'STRONG' WHEN e >= 0.02 AND v >= 0.05 THEN 'VALUE' WHEN v > 0 THEN 'WATCH' WHEN e <= -0.05 THEN 'FADE' ELSE 'PASS' END AS grade FROM (SELECT card, member, round(p, 9) - round(m, 9) AS e, round(p, 9) * round(decimal, 6) - 1 AS v FROM field)")),
    "p22_follows_prices": (p22_follows_prices, with_sql(FIELD, "SELECT card, max(abs(x / s - m / t)) < 1e-6 AS follows_prices FROM (SELECT card, m, CASE WHEN card % 4 = 0 THEN m * 3 ELSE p END AS x, sum(CASE WHEN card % 4 = 0 THEN m * 3 ELSE p END) OVER (PARTITION BY card) AS s, sum(m) OVER (PARTITION BY card) AS t FROM field) GROUP BY 1")),
}
