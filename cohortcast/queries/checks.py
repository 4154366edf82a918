"""Queries of data quality, provenance and readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortcast.operators import quality, rules
from cohortcast.queries.frames import DATED, FIELD, dated, field, table, with_sql

r = lambda c, k=6: F.round(c, k).alias(c)


def q01_source_checks(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("card"), F.col("l_partkey").alias("member"), F.col("l_linenumber").alias("slot"), F.when(F.col("l_discount") > 0.0, F.col("l_extendedprice") * F.col("l_discount")).otherwise(0.0).alias("price"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax"))
    return quality.source_checks(l, "card", "member", "slot", "price", ["tax"])


Q01 = """WITH l AS (SELECT l_orderkey AS card, l_partkey AS member, l_linenumber AS slot, CASE WHEN l_discount > 0 THEN l_extendedprice * l_discount ELSE 0 END AS price, CASE WHEN l_tax > 0 THEN l_tax END AS tax FROM lineitem),
a AS (SELECT card, count(member) - count(DISTINCT member) AS DUPLICATE_MEMBER, count(slot) - count(DISTINCT slot) AS DUPLICATE_SLOT, count(*) FILTER (tax IS NULL) AS MISSING_TAX, count(*) FILTER (price <= 0) AS BAD_PRICE FROM l GROUP BY 1),
u AS (SELECT card, 'DUPLICATE_MEMBER' AS c, DUPLICATE_MEMBER AS detail FROM a UNION ALL SELECT card, 'DUPLICATE_SLOT', DUPLICATE_SLOT FROM a UNION ALL SELECT card, 'MISSING_TAX', MISSING_TAX FROM a UNION ALL SELECT card, 'BAD_PRICE', BAD_PRICE FROM a)
SELECT card, c AS "check", CASE WHEN detail = 0 THEN 'PASS' ELSE 'FAIL' END AS status, detail FROM u"""


def q06_run_state(spark, d):
    f = dated(spark, d).withColumn("declared", F.col("n") + (F.col("card") % 10 == 0).cast("int")).withColumn("matched", F.col("member") % 10 != 0).withColumn("covered", F.col("member") % 3 != 0).withColumn("live", F.col("card") % 2 == 0)
    return quality.run_state(f, "card", "declared", "matched", "covered", "live").select("card", "members", r("match_rate"), r("coverage"), "state", F.array_join("reasons", ",").alias("reasons"))


Q06 = with_sql(DATED, """, g AS (SELECT card, count(*) AS members, max(n + (card % 10 = 0)::INT) AS declared, avg((member % 10 <> 0)::INT) AS mr, avg((member % 3 <> 0)::INT) AS co, card % 2 = 0 AS live FROM dated GROUP BY 1),
x AS (SELECT *, concat_ws(',', CASE WHEN members < 2 THEN 'TOO_FEW_MEMBERS' END, CASE WHEN members <> declared THEN 'SIZE_DIFFERS' END, CASE WHEN mr < 0.9 THEN 'LOW_MATCH' END, CASE WHEN co < 0.8 THEN 'LOW_COVERAGE' END, CASE WHEN NOT live THEN 'NO_LIVE_PRICE' END) AS reasons FROM g)
SELECT card, members, round(mr, 6) AS match_rate, round(co, 6) AS coverage, CASE WHEN members < 2 THEN 'BLOCKED' WHEN members <> declared THEN 'INCOMPLETE' WHEN mr < 0.9 THEN 'UNMATCHED' WHEN co < 0.8 THEN 'MARKET_ONLY' WHEN NOT live THEN 'PRIOR_ONLY' ELSE 'READY' END AS state, reasons FROM x""").replace("\n, g AS", ",\ng AS", 1)


def q07_degenerate(spark, d):
    f = field(spark, d).withColumn("flat", F.lit(1.0))
    return quality.degenerate_features(f, "card", ["surface", "flat", "jockey"]).select("card", F.array_join("degenerate", ",").alias("degenerate"))


def q20_log_integrity(spark, d):
    f = field(spark, d).withColumn("x", F.when(F.col("card") % 20 == 0, F.round(F.col("p") * 0.9, 9)).otherwise(F.round("p", 9))).withColumn("rk", F.when(F.col("card") % 7 == 0, 1).otherwise(F.col("n"))).withColumn("fair", F.when(F.col("member") % 50 != 0, 1 / F.col("p")))
    return quality.log_integrity(f, "card", "x", "rk", "fair").select("card", "members", F.array_join("codes", ",").alias("codes"))


Q20 = with_sql(FIELD, """, f AS (SELECT card, n, CASE WHEN card % 20 = 0 THEN round(p * 0.9, 9) ELSE round(p, 9) END AS x, CASE WHEN card % 7 = 0 THEN 1 ELSE n END AS rk, member % 50 <> 0 AS fair FROM field),
k AS (SELECT *, rank() OVER (PARTITION BY card ORDER BY x DESC) AS again FROM f),
g AS (SELECT card, sum(x) AS t, min(x) AS lo, max(x) AS hi, count(*) FILTER (rk < again) AS off, count(*) AS members, count(*) FILTER (NOT fair) AS nf FROM k GROUP BY 1)
SELECT card, members, concat_ws(',', CASE WHEN NOT t BETWEEN 0.98 AND 1.02 THEN 'SUM_OUT_OF_RANGE' END, CASE WHEN lo <= 0 OR hi >= 1 THEN 'OUT_OF_BOUNDS' END, CASE WHEN off > 0 THEN 'RANK_MISMATCH' END, CASE WHEN lo = hi AND members > 1 THEN 'FLAT' END, CASE WHEN nf > 0 THEN 'FAIR_NOT_FINITE' END) AS codes FROM g""").replace("\n, f AS", ",\nf AS", 1)


def q32_forecast_validity(spark, d):
    f = field(spark, d).withColumn("won", (F.col("finish") == 1) & (F.col("card") % 9 != 0)).withColumn("x", F.when(F.col("card") % 11 == 0, F.col("p") * 2).otherwise(F.col("p")))
    return quality.forecast_validity(f, "card", "x", "won").select("card", r("total"), F.array_join("codes", ",").alias("codes"))


def q09_eligibility(spark, d):
    f = field(spark, d).withColumn("a", F.when(F.col("member") % 17 != 0, F.col("price"))).withColumn("b", F.when(F.col("member") % 19 != 0, F.col("qty")))
    f = f.withColumn("codes", quality.missing_by_row(["a", "b"]))
    return quality.eligibility(f, "card", "codes").select("card", "eligible", F.array_join("blockers", ",").alias("blockers"))


def q13_lineage(spark, d):
    f = field(spark, d).withColumn("speed", F.when(F.col("member") % 13 != 0, F.col("price"))).withColumn("source", F.concat(F.lit("feed_"), F.col("surface"))).withColumn("known", F.when(F.col("member") % 7 != 0, F.col("ship")))
    return quality.lineage_rows(f, ["card", "member"], ["speed", "qty"], "source", "known").groupBy("feature", "source", "status").agg(F.count("*").alias("n"))


Q13 = with_sql(FIELD, "SELECT feature, 'feed_' || surface AS source, CASE WHEN v IS NULL THEN 'MISSING' WHEN member % 7 = 0 THEN 'UNPROVEN' ELSE 'OBSERVED' END AS status, count(*) AS n FROM (SELECT surface, member, 'speed' AS feature, CASE WHEN member % 13 <> 0 THEN price END AS v FROM field UNION ALL SELECT surface, member, 'qty', qty FROM field) GROUP BY 1, 2, 3")


def q22_revised(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    new = c.where("c_custkey % 10 <> 1").withColumn("c_acctbal", F.when(F.col("c_custkey") % 6 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return quality.revised(c.where("c_custkey % 10 <> 2"), new, ["c_custkey"], ["c_acctbal", "c_mktsegment"]).select("c_custkey", "change", F.array_join("columns", ",").alias("columns"))


def q24_inferred_scratch(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("card"), F.col("l_partkey").alias("member"), "l_linestatus", "l_tax")
    m = l.select("card", "member").distinct()
    return quality.inferred_scratches(m, l.where("l_tax >= 0.01"), "card", "member").select("card", "member", "inferred_scratch")


Q24 = """WITH m AS (SELECT l_orderkey AS card, l_partkey AS member, bool_or(l_tax >= 0.01) AS seen FROM lineitem GROUP BY 1, 2), x AS (SELECT *, count(*) FILTER (NOT seen) OVER w AS gone, count(*) FILTER (seen) OVER w AS done FROM m WINDOW w AS (PARTITION BY card))
SELECT card, member, NOT seen AND done > 0 AND gone <= 2 AND gone < done AS inferred_scratch FROM x"""


def q27_collapsed(spark, d):
    f = field(spark, d).withColumn("x", F.when(F.col("card") % 3 == 0, F.col("m")).otherwise(F.col("p")))
    return quality.collapsed(f, "card", "x", "m").select("card", r("max_move"), "collapsed")


def p10_eligibility_reasons(spark, d):
    l = dated(spark, d)
    e = rules.market_eligibility(F.when(F.col("member") % 6 == 0, "morning_line").otherwise("tote"), F.when(F.col("member") % 5 != 0, F.col("ship").cast("timestamp")), F.when(F.col("card") % 4 != 0, F.date_add("day", 60).cast("timestamp")))
    return l.select(e.alias("e")).groupBy("e.reason", "e.eligible").agg(F.count("*").alias("n"))


P10 = with_sql(DATED, "SELECT reason, reason = 'OK' AS eligible, count(*) AS n FROM (SELECT CASE WHEN member % 6 = 0 THEN 'PRIOR_NOT_LIVE' WHEN member % 5 = 0 THEN 'NO_CAPTURE_TIME' WHEN card % 4 = 0 THEN 'NO_POST_TIME' WHEN ship >= day + 60 THEN 'AT_OR_AFTER_POST' ELSE 'OK' END AS reason FROM dated) GROUP BY reason")


def p11_as_of_class(spark, d):
    l = dated(spark, d)
    k = rules.as_of_class(F.when(F.col("member") % 9 != 0, F.col("ship").cast("timestamp")), F.date_add("day", 60), F.when(F.col("card") % 2 == 0, F.date_add("day", 50).cast("timestamp")))
    return l.groupBy(k.alias("as_of")).agg(F.count("*").alias("n"))


P11 = with_sql(DATED, "SELECT CASE WHEN member % 9 = 0 THEN 'UNPROVEN_NO_TIME' WHEN card % 2 = 0 AND ship < day + 50 THEN 'PROVEN_BEFORE_POST' WHEN card % 2 = 0 THEN 'AFTER_POST' WHEN ship < day + 60 THEN 'PROVEN_EARLIER_DAY' ELSE 'UNPROVEN_SAME_DAY' END AS as_of, count(*) AS n FROM dated GROUP BY 1")


def p18_contain(spark, d):
    f = field(spark, d).withColumn("tag", rules.value_tag(F.round(F.col("p") - F.col("m"), 9)))
    return rules.contain(f, F.col("n") >= 4, ["tag", "decimal"], F.lit("FIELD_TOO_SMALL")).groupBy("tag", "withheld").agg(F.count("*").alias("n"), F.count("decimal").alias("prices"))


P18 = with_sql(FIELD, "SELECT CASE WHEN n >= 4 THEN CASE WHEN round(p - m, 9) >= 0.02 THEN 'bet' WHEN round(p - m, 9) <= -0.02 THEN 'underlay' ELSE 'neutral' END END AS tag, CASE WHEN n < 4 THEN 'FIELD_TOO_SMALL' END AS withheld, count(*) AS n, count(*) FILTER (n >= 4) AS prices FROM (SELECT * FROM field) GROUP BY 1, 2")

QUERIES = {
    "q01_source_checks": (q01_source_checks, Q01),
    "q06_run_state": (q06_run_state, Q06),
    "q07_degenerate": (q07_degenerate, with_sql(FIELD, "SELECT card, concat_ws(',', CASE WHEN count(DISTINCT surface) <= 1 THEN 'surface' END, 'flat', CASE WHEN count(DISTINCT jockey) <= 1 THEN 'jockey' END) AS degenerate FROM field GROUP BY 1 HAVING count(*) > 1")),
    "q09_eligibility": (q09_eligibility, with_sql(FIELD, "SELECT card, bool_and(member % 17 <> 0 AND member % 19 <> 0) AS eligible, concat_ws(',', CASE WHEN bool_or(member % 17 = 0) THEN 'a' END, CASE WHEN bool_or(member % 19 = 0) THEN 'b' END) AS blockers FROM field GROUP BY 1")),
    "q13_lineage": (q13_lineage, Q13),
    "q20_log_integrity": (q20_log_integrity, Q20),
    "q22_revised": (q22_revised, "SELECT c_custkey, CASE WHEN c_custkey % 10 = 2 THEN 'NEW' WHEN c_custkey % 10 = 1 THEN 'GONE' WHEN c_custkey % 6 = 0 THEN 'REVISED' ELSE 'SAME' END AS change, CASE WHEN c_custkey % 10 IN (1, 2) THEN NULL WHEN c_custkey % 6 = 0 THEN 'c_acctbal' ELSE '' END AS columns FROM customer"),
    "q24_inferred_scratch": (q24_inferred_scratch, Q24),
    "q27_collapsed": (q27_collapsed, with_sql(FIELD, "SELECT card, round(max(abs(CASE WHEN card % 3 = 0 THEN m ELSE p END - m)), 6) AS max_move, max(abs(CASE WHEN card % 3 = 0 THEN m ELSE p END - m)) < 0.0025 AS collapsed FROM field GROUP BY 1")),
    "q32_forecast_validity": (q32_forecast_validity, with_sql(FIELD, "SELECT card, round(sum(x), 6) AS total, concat_ws(',', CASE WHEN abs(sum(x) - 1) > 1e-6 THEN 'SUM_NOT_ONE' END, CASE WHEN card % 9 = 0 THEN 'NO_SINGLE_WINNER' END) AS codes FROM (SELECT card, CASE WHEN card % 11 = 0 THEN p * 2 ELSE p END AS x FROM field) GROUP BY 1")),
    "p10_eligibility_reasons": (p10_eligibility_reasons, P10),
    "p11_as_of_class": (p11_as_of_class, P11),
    "p18_contain": (p18_contain, P18),
}
