"""Queries over cards: feature families, run diagnostics, segment decisions, provenance, readiness and normalisers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortcast.functions import odds, text
from cohortcast.operators import aggregates as agg
from cohortcast.operators import features, quality, records, rules, scoring, windows
from cohortcast.queries.frames import DATED, FIELD, dated, field, table, with_sql

r = lambda c, k=6: F.round(c, k).alias(c)


def _then(frame: str, ctes: str, body: str) -> str:
    return f"WITH {frame.strip()},\n{ctes}\n{body}"


def p05_bins(spark, d):
    f = field(spark, d).withColumn("gap", F.round(F.col("p") - F.col("m"), 9))
    b = F.when(F.col("gap") < -0.10, "far_below").when(F.col("gap") < -0.02, "below").when(F.col("gap") <= 0.02, "even").when(F.col("gap") <= 0.10, "above").otherwise("far_above")
    return f.groupBy(b.alias("bin"), rules.field_size_bucket(F.col("n")).alias("size")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("finish") == 1).cast("double")), 6).alias("win_rate"))


P05 = with_sql(FIELD, "SELECT CASE WHEN g < -0.10 THEN 'far_below' WHEN g < -0.02 THEN 'below' WHEN g <= 0.02 THEN 'even' WHEN g <= 0.10 THEN 'above' ELSE 'far_above' END AS bin, CASE WHEN n <= 6 THEN 'small' WHEN n <= 9 THEN 'medium' WHEN n <= 12 THEN 'large' ELSE 'full' END AS size, count(*) AS n, round(avg((finish = 1)::INT), 6) AS win_rate FROM (SELECT *, round(p - m, 9) AS g FROM field) GROUP BY 1, 2")


def p16_served(spark, d):
    f = field(spark, d).withColumn("mode", F.when(F.col("card") % 3 == 0, "LIVE").when(F.col("card") % 3 == 1, "shadow")).withColumn("learned", F.when(F.col("member") % 5 != 0, F.col("m")))
    return f.select("card", "member", F.round(rules.served(F.col("mode"), F.col("p"), F.col("learned")), 6).alias("served"))


def p19_workflow(spark, d):
    f = dated(spark, d).groupBy("card").agg(F.first("class").alias("class"))
    s = rules.workflow_status(F.col("card") % 7 != 0, F.col("card") % 5 != 0)
    return f.groupBy("class", s.alias("status")).agg(F.count("*").alias("cards"))


def j18_three_sources(spark, d):
    """Values of three sources by key: agreed, or which differ."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    a, b, e = (c.where(f"c_custkey % {k} <> 0").withColumnRenamed("c_acctbal", n) for k, n in ((4, "a"), (5, "b"), (6, "e")))
    both = a.join(b.withColumn("b", F.when(F.col("c_custkey") % 7 == 0, F.col("b") + 1).otherwise(F.col("b"))), "c_custkey", "full_outer").join(e, "c_custkey", "full_outer")
    differ = lambda x, y: F.coalesce(F.col(x) != F.col(y), F.lit(False))
    return both.select("c_custkey", F.coalesce("a", "b", "e").alias("value"), F.array_join(F.array_compact(F.array(F.when(differ("a", "b"), "a_b"), F.when(differ("b", "e"), "b_e"), F.when(differ("a", "e"), "a_e"))), ",").alias("conflicts"))


J18 = "WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS a, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END END AS b, CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal END AS e FROM customer) SELECT c_custkey, coalesce(a, b, e) AS value, concat_ws(',', CASE WHEN a <> b THEN 'a_b' END, CASE WHEN b <> e THEN 'b_e' END, CASE WHEN a <> e THEN 'a_e' END) AS conflicts FROM x WHERE coalesce(a, b, e) IS NOT NULL"


def a07_equal_bins(spark, d):
    f = field(spark, d).withColumn("bin", F.floor(F.round("p", 9) * 10).cast("int")).where("bin < 10")
    return f.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg((F.col("finish") == 1).cast("double")), 6).alias("observed")).withColumn("sparse", F.col("n") < 20)


def a18_kelly_roi(spark, d):
    f = dated(spark, d).where("round(p - m, 9) >= 0.02").withColumn("stake", odds.kelly(F.col("p"), F.col("decimal"), 0.05))
    win = F.when(F.col("finish") == 1, F.col("stake") * (F.col("decimal") - 1)).otherwise(-F.col("stake"))
    return f.groupBy("class").agg(F.round(F.sum("stake"), 4).alias("staked"), F.round(F.sum(win), 4).alias("net"), F.round(F.sum(win) / F.sum("stake"), 5).alias("roi"))


A18 = with_sql(DATED, "SELECT class, round(sum(s), 4) AS staked, round(sum(CASE WHEN finish = 1 THEN s * (decimal - 1) ELSE -s END), 4) AS net, round(sum(CASE WHEN finish = 1 THEN s * (decimal - 1) ELSE -s END) / sum(s), 5) AS roi FROM (SELECT *, least(greatest((p * decimal - 1) / (decimal - 1), 0), 0.05) AS s FROM dated WHERE round(p - m, 9) >= 0.02) GROUP BY 1")


def a26_career(spark, d):
    f = dated(spark, d).select("jockey", "card", "member", "day", "finish")
    last = F.row_number().over(Window.partitionBy("jockey").orderBy(F.desc("day"), F.desc("card"), F.desc("member")))
    return f.withColumn("k", last).groupBy("jockey").agg(F.count("*").alias("starts"), F.count_if(F.col("finish") == 1).alias("wins"), F.count_if((F.col("k") <= 5) & (F.col("finish") <= 3)).alias("last5_itm"), F.max("day").alias("last_day"))


A26 = with_sql(DATED, "SELECT jockey, count(*) AS starts, count(*) FILTER (finish = 1) AS wins, count(*) FILTER (k <= 5 AND finish <= 3) AS last5_itm, max(day) AS last_day FROM (SELECT *, row_number() OVER (PARTITION BY jockey ORDER BY day DESC, card DESC, member DESC) AS k FROM dated) GROUP BY 1")


def a29_summaries(spark, d):
    l = table(spark, d, "lineitem")
    return l.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("states"))


def q11_provenance(spark, d):
    f = dated(spark, d).select("card", "member", F.when(F.col("member") % 4 != 0, F.concat(F.lit("a"), F.col("member") % 50)).alias("artifact"), "day")
    a = table(spark, d, "part").where("p_partkey <= 40").select(F.concat(F.lit("a"), F.col("p_partkey") % 50).alias("artifact"), (F.col("p_partkey") % 3 == 0).alias("attested"))
    state = F.when(F.col("artifact").isNull(), "NO_ARTIFACT").when(F.col("attested").isNull(), "UNKNOWN_ARTIFACT").when(~F.col("attested"), "RETAINED").otherwise("ATTESTED")
    return f.join(a, "artifact", "left").groupBy(state.alias("provenance")).agg(F.count("*").alias("n"))


Q11 = with_sql(DATED, "SELECT CASE WHEN member % 4 = 0 THEN 'NO_ARTIFACT' WHEN a.k IS NULL THEN 'UNKNOWN_ARTIFACT' WHEN a.k % 3 <> 0 THEN 'RETAINED' ELSE 'ATTESTED' END AS provenance, count(*) AS n FROM dated LEFT JOIN (SELECT p_partkey AS k FROM part WHERE p_partkey <= 40) a ON member % 50 = a.k AND member % 4 <> 0 GROUP BY 1")


def q23_misstored(spark, d):
    """Stored totals that differ from the sum of their lines."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("again"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("stored"))
    return o.join(l, "o_orderkey").where(F.abs(F.col("stored") - F.col("again")) > 1e-9).withColumn("ratio", F.round(F.col("again") / F.col("stored"), 6))


def q26_blockers(spark, d):
    f = dated(spark, d).groupBy("card").agg(F.count("*").alias("members"), F.count_if(F.col("decimal") <= 1).alias("bad"), F.count_if(F.col("member") % 23 == 0).alias("unnamed"))
    return f.select("card", F.array_join(quality.codes(too_few=F.col("members") < 2, bad_price=F.col("bad") > 0, unnamed=F.col("unnamed") > 0), ",").alias("blockers"))


def q25_fill(spark, d):
    f = field(spark, d).select("card", "member", "post", F.when(F.col("member") % 6 != 0, F.col("qty")).alias("weight"))
    other = field(spark, d).where("member % 4 <> 1").select("card", "post", F.col("qty").alias("other"))
    value, source = records.first_known([("first", F.col("weight")), ("second", F.col("other"))])
    return f.join(other, ["card", "post"], "left").select("card", "member", value.alias("weight"), source.alias("source"))


def x01_speed(spark, d):
    f = dated(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("jockey").orderBy(F.desc("day"), F.desc("card"), F.desc("member"))))
    return f.groupBy("jockey").agg(F.max(F.when(F.col("k") == 1, F.col("price"))).alias("last"), F.max("price").alias("best"), F.round(F.avg(F.when(F.col("k") <= 3, F.col("price"))), 1).alias("recent"))


X01 = with_sql(DATED, "SELECT jockey, max(CASE WHEN k = 1 THEN price END) AS last, max(price) AS best, round(avg(CASE WHEN k <= 3 THEN price END), 1) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY jockey ORDER BY day DESC, card DESC, member DESC) AS k FROM dated) GROUP BY 1")


def x05_class_delta(spark, d):
    f = dated(spark, d).withColumn("level", F.log(F.col("price") + 1))
    return windows.z_score(f, "card", "level", 0.01, 3.0, "class_delta").select("card", "member", r("level"), r("class_delta"))


X05 = _then(DATED, "l AS (SELECT card, member, ln(price + 1) AS level FROM dated)", "SELECT card, member, round(level, 6) AS level, round(CASE WHEN stddev_samp(level) OVER w IS NOT NULL THEN greatest(-3, least(3, (level - avg(level) OVER w) / greatest(stddev_samp(level) OVER w, 0.01))) END, 6) AS class_delta FROM l WINDOW w AS (PARTITION BY card)")


def x15_starts_90d(spark, d):
    f = dated(spark, d).select("jockey", "day").distinct()
    starts = dated(spark, d).groupBy("jockey", F.col("day").alias("past")).agg(F.count("*").alias("k"), F.count_if(F.col("finish") == 1).alias("w"))
    from cohortcast.operators.joins import within_days

    return within_days(f, starts, "jockey", "day", "past", 90).groupBy("jockey", "day").agg(F.sum("k").alias("starts"), F.round(agg.shrunk(F.sum("w"), F.sum("k"), 3, 0.1), 6).alias("rate"))


X15 = with_sql(DATED, "SELECT a.jockey, a.day, CAST(sum(k) AS BIGINT) AS starts, round((sum(w) + 0.3::DOUBLE) / (sum(k) + 3), 6) AS rate FROM (SELECT DISTINCT jockey, day FROM dated) a JOIN (SELECT jockey, day, count(*) AS k, count(*) FILTER (finish = 1) AS w FROM dated GROUP BY 1, 2) b ON a.jockey = b.jockey AND date_diff('day', b.day, a.day) BETWEEN 1 AND 90 GROUP BY 1, 2")


def m04_pre_market(spark, d):
    """The signal without what is derived from prices, its weights scaled up again."""
    return scoring.probabilities(field(spark, d), "card", {"qty": 0.3, "post": 0.1}, 8.0, "q").select("card", "member", r("q"))


_N = "CASE WHEN max({c}) OVER w > min({c}) OVER w THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE 0.5 END"
M04 = _then(FIELD, f"s AS (SELECT card, member, 0.75 * ({_N.format(c='qty')}) + 0.25 * ({_N.format(c='post')}) AS s FROM field WINDOW w AS (PARTITION BY card)), e AS (SELECT card, member, exp(8 * (s - max(s) OVER (PARTITION BY card))) AS e FROM s)", "SELECT card, member, round(e / sum(e) OVER (PARTITION BY card), 6) AS q FROM e")


def m11_diagnostics(spark, d):
    f = field(spark, d)
    e = agg.entropy_measures(f, "card", "p", "m").join(f.groupBy("card").agg(F.max(F.abs(F.col("p") - F.col("m"))).alias("max_edge")), "card")
    return e.groupBy("n").agg(F.count("*").alias("cards"), F.round(F.avg("kl"), 6).alias("mean_kl"), F.round(F.avg("normal_entropy"), 6).alias("mean_entropy"), F.round(F.max("max_edge"), 6).alias("max_edge"))


M11 = _then(FIELD, "g AS (SELECT card, count(*) AS n, sum(p * ln(p / greatest(m, 1e-12))) AS kl, CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) END AS h, max(abs(p - m)) AS e FROM field GROUP BY 1)", "SELECT n, count(*) AS cards, round(avg(kl), 6) AS mean_kl, round(avg(h), 6) AS mean_entropy, round(max(e), 6) AS max_edge FROM g GROUP BY 1")


def e08_segment_decisions(spark, d):
    f = dated(spark, d).groupBy("class", "surface").agg(F.count_distinct("card").alias("cards"), F.round(F.avg(F.pow(F.col("p") - (F.col("finish") == 1).cast("double"), 2)), 7).alias("a"), F.round(F.avg(F.pow(F.col("m") - (F.col("finish") == 1).cast("double"), 2)), 7).alias("b"))
    return f.withColumn("decision", F.when(F.col("cards") < 500, "INSUFFICIENT").when(F.col("b") - F.col("a") >= 0.001, "PASS").when(F.col("a") - F.col("b") >= 0.02, "FAIL").otherwise("HOLD")).withColumnsRenamed({"a": "brier_model", "b": "brier_market"})


E08 = _then(DATED, "g AS (SELECT class, surface, count(DISTINCT card) AS cards, round(avg((p - (finish = 1)::INT) ** 2), 7) AS a, round(avg((m - (finish = 1)::INT) ** 2), 7) AS b FROM dated GROUP BY 1, 2)", "SELECT class, surface, cards, a AS brier_model, b AS brier_market, CASE WHEN cards < 500 THEN 'INSUFFICIENT' WHEN b - a >= 0.001 THEN 'PASS' WHEN a - b >= 0.02 THEN 'FAIL' ELSE 'HOLD' END AS decision FROM g")


def e04_outcomes(spark, d):
    """Each card's pick, price favourites (ties kept) and winner."""
    f = windows.price_rank(windows.probability_rank(field(spark, d), "card", "p", "post").withColumn("price_key", F.round("decimal", 9)), "card", "price_key")
    return f.groupBy("card").agg(F.max(F.when(F.col("model_rank") == 1, F.col("member"))).alias("pick"), F.count_if(F.col("price_rank") == 1).alias("favourites"), F.bool_or((F.col("price_rank") == 1) & (F.col("finish") == 1)).alias("favourite_won"), F.max(F.when(F.col("finish") == 1, F.col("member"))).alias("winner"))


E04 = with_sql(FIELD, "SELECT card, max(CASE WHEN mr = 1 THEN member END) AS pick, count(*) FILTER (pr = 1) AS favourites, bool_or(pr = 1 AND finish = 1) AS favourite_won, max(CASE WHEN finish = 1 THEN member END) AS winner FROM (SELECT *, row_number() OVER (PARTITION BY card ORDER BY p DESC, post) AS mr, rank() OVER (PARTITION BY card ORDER BY round(decimal, 9)) AS pr FROM field) GROUP BY 1")


def l02_matrix(spark, d):
    f = dated(spark, d).where("card % 13 <> 0")
    coded = F.coalesce(F.array_position(F.array(*map(F.lit, ["A", "N"])), F.col("surface")), F.lit(0)) - 1
    return f.select("card", "member", F.col("finish").eqNullSafe(1).cast("int").alias("label"), coded.cast("int").alias("surface_code"), F.round(features.norm(F.col("qty"), 1, 51), 6).alias("qty_norm"))


def f03_times(spark, d):
    l = table(spark, d, "lineitem").groupBy(F.concat(F.lit("1:"), F.lpad(F.col("l_quantity").cast("int").cast("string"), 2, "0"), F.lit(".40")).alias("raw")).agg(F.count("*").alias("n"))
    return l.withColumn("seconds", F.round(text.seconds(F.col("raw")), 6)).withColumn("money", text.money(F.concat(F.lit("$"), F.col("n").cast("string"), F.lit(",000"))))


def f04_dates(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("day", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("day", "MM/dd/yyyy")).otherwise(F.date_format("day", "yyyyMMdd"))
    return o.select("o_orderkey", text.any_date(raw).alias("day"))


QUERIES = {
    "p05_bins": (p05_bins, P05),
    "p16_served": (p16_served, with_sql(FIELD, "SELECT card, member, round(CASE WHEN card % 3 = 0 AND member % 5 <> 0 THEN m ELSE p END, 6) AS served FROM field")),
    "p19_workflow": (p19_workflow, with_sql(DATED, "SELECT class, CASE WHEN card % 7 = 0 THEN 'unscored' WHEN card % 5 = 0 THEN 'scored_no_result' ELSE 'calibrated' END AS status, count(DISTINCT card) AS cards FROM dated GROUP BY 1, 2")),
    "j18_three_sources": (j18_three_sources, J18),
    "a07_equal_bins": (a07_equal_bins, with_sql(FIELD, "SELECT CAST(floor(round(p, 9) * 10) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg((finish = 1)::INT), 6) AS observed, count(*) < 20 AS sparse FROM field WHERE floor(round(p, 9) * 10) < 10 GROUP BY 1")),
    "a18_kelly_roi": (a18_kelly_roi, A18),
    "a26_career": (a26_career, A26),
    "a29_summaries": (a29_summaries, "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS returned, count(*) AS n, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS states FROM lineitem GROUP BY 1"),
    "q11_provenance": (q11_provenance, Q11),
    "q23_misstored": (q23_misstored, "SELECT o_orderkey, o_totalprice AS stored, again, round(again / o_totalprice, 6) AS ratio FROM orders JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS again FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE abs(o_totalprice - again) > 1e-9"),
    "q25_fill": (q25_fill, with_sql(FIELD, "SELECT card, member, CASE WHEN member % 6 <> 0 OR member % 4 <> 1 THEN qty END AS weight, CASE WHEN member % 6 <> 0 THEN 'first' WHEN member % 4 <> 1 THEN 'second' END AS source FROM field")),
    "q26_blockers": (q26_blockers, with_sql(DATED, "SELECT card, concat_ws(',', CASE WHEN count(*) < 2 THEN 'TOO_FEW' END, CASE WHEN bool_or(decimal <= 1) THEN 'BAD_PRICE' END, CASE WHEN bool_or(member % 23 = 0) THEN 'UNNAMED' END) AS blockers FROM dated GROUP BY 1")),
    "x01_speed": (x01_speed, X01),
    "x05_class_delta": (x05_class_delta, X05),
    "x15_starts_90d": (x15_starts_90d, X15),
    "m04_pre_market": (m04_pre_market, M04),
    "m11_diagnostics": (m11_diagnostics, M11),
    "e04_outcomes": (e04_outcomes, E04),
    "e08_segment_decisions": (e08_segment_decisions, E08),
    "l02_matrix": (l02_matrix, with_sql(DATED, "SELECT card, member, (finish = 1)::INT AS label, CASE surface WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE -1 END AS surface_code, round(greatest(0, least(1, (qty - 1) / 50)), 6) AS qty_norm FROM dated WHERE card % 13 <> 0")),
    "f03_times": (f03_times, "SELECT '1:' || lpad(CAST(l_quantity AS INT)::VARCHAR, 2, '0') || '.40' AS raw, count(*) AS n, round(60 + CAST(l_quantity AS INT) + 0.4::DOUBLE, 6) AS seconds, count(*) * 1000.0::DOUBLE AS money FROM lineitem GROUP BY l_quantity"),
    "f04_dates": (f04_dates, "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders"),
}
