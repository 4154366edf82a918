"""Queries that join: as of a time, complete captures, passes, tolerances, cohorts, reconciliation, matching, sets, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortcast.functions.text import ascii_key, squash_key
from cohortcast.operators import joins, sets
from cohortcast.queries.frames import DATED, FIELD, dated, field, parts_of, table, with_sql
from cohortcast.sources import readers, sinks

r = lambda c, k=6: F.round(c, k).alias(c)


def _runs(spark, d):
    e = table(spark, d, "events")
    return e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("outcome_id"), F.col("ts").alias("post")), e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("run_id"), "value")


def j08_as_of(spark, d):
    post, runs = _runs(spark, d)
    return joins.as_of(post, runs, ["user_id"], "post", "ts", ["run_id", "value"], "run_id", bucket_days=1).select("outcome_id", "run_id", r("value"), "as_of_ts")


def j09_as_of_lag(spark, d):
    post, runs = _runs(spark, d)
    return joins.as_of(post, runs, ["user_id"], "post", "ts", ["run_id"], "run_id", strict=False, lag="30 minutes", max_age="1 day", bucket_days=1).select("outcome_id", "run_id", "as_of_ts")


AS_OF = """WITH e AS (SELECT * FROM events), b AS (SELECT o.event_id AS outcome_id, v.event_id AS run_id, v.value, v.ts, row_number() OVER (PARTITION BY o.event_id ORDER BY v.ts DESC, v.event_id DESC) AS k
FROM e o JOIN e v ON v.user_id = o.user_id AND v.event_type = 'view' AND {on} WHERE o.event_type = 'purchase')
SELECT o.event_id AS outcome_id, {cols} FROM e o LEFT JOIN b ON b.outcome_id = o.event_id AND k = 1 WHERE o.event_type = 'purchase'"""
J08 = AS_OF.format(on="v.ts < o.ts", cols="run_id, round(b.value, 6) AS value, b.ts AS as_of_ts")
J09 = AS_OF.format(on="v.ts <= o.ts - INTERVAL 30 MINUTE", cols="CASE WHEN b.ts >= o.ts - INTERVAL 1 DAY THEN run_id END AS run_id, CASE WHEN b.ts >= o.ts - INTERVAL 1 DAY THEN b.ts END AS as_of_ts")


def j10_complete_capture(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("card"), F.col("l_partkey").alias("member"), F.col("l_returnflag").alias("provider"), F.to_date("l_shipdate").alias("ts"), F.col("l_quantity").alias("price"))
    expected = lines.where("provider = 'N'").select("card", "member")
    return joins.complete_capture(lines, expected, "card", "member", ["provider"], "ts", "price", parts_of(spark, 2 * lines.count())).select("card", "member", "provider", "ts")


J10 = """WITH l AS (SELECT l_orderkey AS card, l_partkey AS member, l_returnflag AS provider, CAST(l_shipdate AS DATE) AS ts, l_quantity AS price FROM lineitem),
x AS (SELECT DISTINCT card, member FROM l WHERE provider = 'N'), want AS (SELECT card, count(*) AS w FROM x GROUP BY 1),
b AS (SELECT l.card, l.ts, l.provider, count(*) AS n, count(DISTINCT l.member) AS k, count(x.member) AS h, bool_and(price > 1) AS ok FROM l LEFT JOIN x ON x.card = l.card AND x.member = l.member GROUP BY 1, 2, 3),
c AS (SELECT b.*, rank() OVER (PARTITION BY card ORDER BY ts DESC) AS rk FROM b JOIN want USING (card) WHERE n = w AND k = w AND h = w AND ok),
t AS (SELECT *, count(*) OVER (PARTITION BY card) AS ties FROM c WHERE rk = 1)
SELECT l.card, l.member, l.provider, l.ts FROM l JOIN t ON t.card = l.card AND t.ts = l.ts AND t.provider = l.provider WHERE ties = 1"""


def j07_two_pass(spark, d):
    left = field(spark, d).select("card", "member", "surface")
    right = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("card"), F.col("l_partkey").alias("member"), F.col("l_returnflag").alias("surface"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supp")).where("line <= 3")
    return joins.two_pass(left, right.withColumn("o", F.struct("line", "supp")), ["card", "member", "surface"], ["card", "surface"], "o", ["supp"]).select("card", "member", "match_type", F.col("supp").isNotNull().alias("found"))


J07 = with_sql(FIELD, """SELECT card, member, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_linenumber <= 3 AND l_orderkey = card AND l_partkey = member AND l_returnflag = surface) THEN 'full'
WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_linenumber <= 3 AND l_orderkey = card AND l_returnflag = surface) THEN 'partial' ELSE 'none' END AS match_type,
EXISTS (SELECT 1 FROM lineitem WHERE l_linenumber <= 3 AND l_orderkey = card AND l_returnflag = surface) AS found FROM field""")


def j13_within_days(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"))
    h = o.select("o_custkey", F.col("id").alias("past_id"), F.col("day").alias("past_day"))
    return joins.within_days(o, h, "o_custkey", "day", "past_day", 60).groupBy("id").agg(F.count("*").alias("n"), F.max("past_day").alias("latest"))


def j14_near_value(spark, d):
    p = table(spark, d, "part")
    a = p.select("p_brand", F.col("p_partkey").alias("a"), F.col("p_retailprice").alias("x"))
    b = p.select("p_brand", F.col("p_partkey").alias("b"), F.col("p_retailprice").alias("y"))
    return joins.near_value(a, b, ["p_brand"], "x", "y", 5.0).select("a", "b", "p_brand")


def j15_cohort(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", F.col("o_orderkey").alias("id"), "o_orderdate", "o_totalprice")
    c = joins.cohort_stats(o, o, ["o_orderpriority"], "o_orderdate", "o_orderdate", "o_totalprice")
    return c.select("id", "cohort_n", F.round(F.col("cohort_mean") + 1e-6, 1).alias("cohort_mean"), r("cohort_sd", 1))


J15 = """SELECT a.o_orderkey AS id, nullif(count(b.o_orderkey), 0) AS cohort_n, CASE WHEN count(b.o_orderkey) >= 5 THEN round(avg(b.o_totalprice) + 1e-6, 1) END AS cohort_mean, CASE WHEN count(b.o_orderkey) >= 5 THEN round(stddev_pop(b.o_totalprice), 1) END AS cohort_sd
FROM orders a LEFT JOIN orders b ON a.o_orderpriority = b.o_orderpriority AND date_diff('day', CAST(b.o_orderdate AS DATE), CAST(a.o_orderdate AS DATE)) BETWEEN 1 AND 90 GROUP BY 1"""


def j17_reconcile(spark, d):
    l = table(spark, d, "lineitem")
    side = lambda c: l.where(c).groupBy(F.col("l_orderkey").alias("card"), F.col("l_partkey").alias("member")).agg(F.max("l_linestatus").alias("flag"), F.max("l_linenumber").alias("line"))
    return joins.reconcile(side("l_linenumber <= 4"), side("l_linenumber >= 2"), ["card", "member"], ["flag", "line"]).select("card", "member", F.array_join("codes", ",").alias("codes"), "status")


J17 = """WITH a AS (SELECT l_orderkey AS card, l_partkey AS member, max(l_linestatus) AS flag, max(l_linenumber) AS line FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2),
b AS (SELECT l_orderkey AS card, l_partkey AS member, max(l_linestatus) AS flag, max(l_linenumber) AS line FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1, 2),
c AS (SELECT card, member, concat_ws(',', CASE WHEN a.flag IS NULL THEN 'MISSING_LEFT' END, CASE WHEN b.flag IS NULL THEN 'MISSING_RIGHT' END, CASE WHEN a.flag IS NOT NULL AND b.flag IS NOT NULL AND a.flag <> b.flag THEN 'DIFFERS_FLAG' END,
CASE WHEN a.flag IS NOT NULL AND b.flag IS NOT NULL AND a.line <> b.line THEN 'DIFFERS_LINE' END) AS codes FROM a FULL JOIN b USING (card, member)) SELECT *, CASE WHEN codes = '' THEN 'MATCHED' ELSE 'REVIEW' END AS status FROM c"""


def j20_best_match(spark, d):
    n = table(spark, d, "nation")
    a = n.select("n_regionkey", F.regexp_replace(F.lower("n_name"), "a", "e").alias("typed"))
    return joins.best_match(a, n, "n_regionkey", "typed", "n_name", "n_nationkey").select("n_regionkey", "typed", "match_id", "match_type", r("match_score"))


J20 = """WITH a AS (SELECT n_regionkey, replace(lower(n_name), 'a', 'e') AS typed, regexp_replace(upper(replace(lower(n_name), 'a', 'e')), '[^A-Z0-9]', '', 'g') AS k FROM nation), b AS (SELECT n_regionkey, n_nationkey AS id, regexp_replace(upper(n_name), '[^A-Z0-9]', '', 'g') AS k FROM nation),
x AS (SELECT a.*, e.id AS eid FROM a LEFT JOIN (SELECT n_regionkey, k, min(id) AS id FROM b GROUP BY 1, 2 HAVING count(*) = 1) e ON e.n_regionkey = a.n_regionkey AND e.k = a.k),
s AS (SELECT x.n_regionkey, x.k, b.id, 1 - levenshtein(x.k, b.k) / greatest(length(x.k), length(b.k)) AS sim FROM x JOIN b ON b.n_regionkey = x.n_regionkey WHERE x.eid IS NULL),
t AS (SELECT n_regionkey, k, min(id) AS fid, count(DISTINCT id) AS c, max(sim) AS sim FROM (SELECT *, max(sim) OVER (PARTITION BY n_regionkey, k) AS best FROM s WHERE sim >= 0.72) WHERE sim = best GROUP BY 1, 2)
SELECT x.n_regionkey, typed, CASE WHEN eid IS NOT NULL THEN eid WHEN c = 1 THEN fid END AS match_id, CASE WHEN eid IS NOT NULL THEN 'exact' WHEN c = 1 THEN 'fuzzy' WHEN c > 1 THEN 'ambiguous' ELSE 'none' END AS match_type, round(CASE WHEN eid IS NOT NULL THEN 1 ELSE sim END, 6) AS match_score FROM x LEFT JOIN t ON t.n_regionkey = x.n_regionkey AND t.k = x.k"""


def j23_ladder(spark, d):
    s = table(spark, d, "supplier")
    names = s.select("s_suppkey", F.concat(F.lower("s_name"), F.lit(" (usa)")).alias("name"))
    return joins.resolve_ladder(names, "name", s, "s_name", "s_suppkey", [lambda c: c, ascii_key, squash_key]).select("s_suppkey", "code", "resolution")


def j24_gap_fill(spark, d):
    c = table(spark, d, "customer")
    a = c.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("bal"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("seg"))
    b = c.where("c_custkey % 2 = 0").select("c_custkey", F.col("c_acctbal").alias("bal"), F.lit("OTHER").alias("seg"))
    return joins.gap_fill(a, b, ["c_custkey"], ["bal", "seg"])


J24 = """WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS bal, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS seg, c_custkey % 2 = 0 AS two, c_acctbal FROM customer)
SELECT c_custkey, coalesce(bal, CASE WHEN two THEN c_acctbal END) AS bal, coalesce(seg, CASE WHEN two THEN 'OTHER' END) AS seg, CASE WHEN bal IS NOT NULL THEN 'primary' WHEN two THEN 'secondary' END AS bal_source, CASE WHEN seg IS NOT NULL THEN 'primary' WHEN two THEN 'secondary' END AS seg_source FROM a"""


def j01_star(spark, d):
    f = dated(spark, d)
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("owner"), "c_mktsegment", "c_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return f.join(c, "owner").join(n, "c_nationkey", "left").groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("members"), F.count_distinct("card").alias("cards"))


def j02_latest(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"), F.max("o_orderdate").alias("latest"))


def j04_semi_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("kind", F.lit("with")).unionByName(c.join(o, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("kind", F.lit("without")))


def u02_member_difference(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("card"), F.col("l_partkey").alias("member"), "l_linenumber")
    x = sets.member_difference(l.where("l_linenumber <= 3"), l.where("l_linenumber >= 3"), "card", "member")
    return x.select("card", F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected"), "equal")


U02 = """WITH l AS (SELECT l_orderkey AS card, l_partkey AS member, l_linenumber AS k FROM lineitem), c AS (SELECT card, member, bool_or(k <= 3) AS e, bool_or(k >= 3) AS o FROM l GROUP BY 1, 2)
SELECT card, coalesce(string_agg(member::VARCHAR, ',' ORDER BY member) FILTER (e AND NOT o), '') AS missing, coalesce(string_agg(member::VARCHAR, ',' ORDER BY member) FILTER (o AND NOT e), '') AS unexpected, bool_and(e = o) AS equal FROM c GROUP BY 1"""


def u06_number_gaps(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("card"), F.col("l_linenumber").cast("int").alias("k"))
    return sets.number_gaps(l, "card", "k").select("card", "n", F.array_join("gaps", ",").alias("gaps"))


def u01_union(spark, d):
    a = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return sets.stacked(a, b)


def s13_versions(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    now = c.where("c_custkey % 4 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 == 0, F.lit(0.0)).otherwise(F.col("c_acctbal")))
    return sinks.versioned(now, c, ["c_custkey"], ["c_name", "c_acctbal"]).groupBy("status").agg(F.count("*").alias("n"))


def s14_replace(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    w = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")
    return sinks.replaced(*w, ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderdate")


def s14_ignore(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return sinks.new_rows(l.where("l_orderkey % 60 = 0"), l.where("l_partkey % 2 = 0"), ["l_partkey"]).select("l_partkey")


def s15_fill(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    old = c.where("c_custkey % 4 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")))
    return sinks.filled(old, c.withColumn("c_mktsegment", F.lit("NEW")), ["c_custkey"])


def s21_resolve(spark, d):
    s = table(spark, d, "supplier")
    known = s.where("s_suppkey % 2 = 0").select(F.when(F.col("s_suppkey") % 4 == 0, F.col("s_suppkey")).alias("src"), F.upper("s_name").alias("name"), F.col("s_suppkey").alias("entity"))
    out = sinks.resolved_entities(s.select(F.col("s_suppkey").alias("src"), F.lower("s_name").alias("name")), known, "src", "name", "entity")
    return out.select("src", F.when(~F.col("is_new"), F.col("entity")).alias("entity"), "is_new")


def s11_priority(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), "l_returnflag")
    return readers.prioritised([l.where(f"l_returnflag = '{f}'") for f in "RAN"], "part", "supp")


S11 = """WITH l AS (SELECT l_partkey AS part, l_suppkey AS supp, CAST(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS INT) AS pr FROM lineitem), t AS (SELECT *, min(pr) OVER (PARTITION BY part) AS f FROM l)
SELECT part, CASE WHEN count(DISTINCT supp) = 1 THEN min(supp) END AS supp, f AS priority, count(DISTINCT supp) > 1 AS ambiguous FROM t WHERE pr = f GROUP BY part, f"""


def s01_split_bad(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    good, bad = readers.split_bad(e, {"no_value": F.col("value").isNull(), "bad_key": F.col("k") % 7 == 0, "error_event": F.col("event_type") == "error"})
    return bad.groupBy("reason").agg(F.count("*").alias("n")).unionByName(good.groupBy().agg(F.count("*").alias("n")).withColumn("reason", F.lit("OK")))


def s08_sections(spark, d):
    x = readers.sections(table(spark, d, "documents").select("doc_id", "text"), "text", r"[A-Z][^\n]{0,40}\.\n")
    return x.select("doc_id", "section", "header", F.length("body").alias("body_chars"))


QUERIES = {
    "j01_star": (j01_star, with_sql(DATED, "SELECT n_name, c_mktsegment, count(*) AS members, count(DISTINCT card) AS cards FROM dated JOIN customer ON c_custkey = owner LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2")),
    "j02_latest": (j02_latest, "SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, max(o_orderdate) AS latest FROM orders GROUP BY 1"),
    "j04_semi_anti": (j04_semi_anti, "SELECT c_mktsegment, count(*) AS n, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'with' ELSE 'without' END AS kind FROM customer GROUP BY 1, 3"),
    "j07_two_pass": (j07_two_pass, J07),
    "j08_as_of": (j08_as_of, J08),
    "j09_as_of_lag": (j09_as_of_lag, J09),
    "j10_complete_capture": (j10_complete_capture, J10),
    "j13_within_days": (j13_within_days, "SELECT a.o_orderkey AS id, count(*) AS n, max(CAST(b.o_orderdate AS DATE)) AS latest FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND date_diff('day', CAST(b.o_orderdate AS DATE), CAST(a.o_orderdate AS DATE)) BETWEEN 1 AND 60 GROUP BY 1"),
    "j14_near_value": (j14_near_value, "SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_brand FROM part a JOIN part b ON a.p_brand = b.p_brand AND abs(a.p_retailprice - b.p_retailprice) <= 5"),
    "j15_cohort": (j15_cohort, J15),
    "j17_reconcile": (j17_reconcile, J17),
    "j20_best_match": (j20_best_match, J20),
    "j23_ladder": (j23_ladder, "SELECT s_suppkey, s_suppkey AS code, 'LEVEL_1' AS resolution FROM supplier"),
    "j24_gap_fill": (j24_gap_fill, J24),
    "u01_union": (u01_union, "SELECT c_name AS name, c_acctbal AS balance, NULL::BIGINT AS nation FROM customer UNION ALL SELECT s_name, NULL, s_nationkey FROM supplier"),
    "u02_member_difference": (u02_member_difference, U02),
    "u06_number_gaps": (u06_number_gaps, "SELECT card, n, array_to_string(list_filter(range(1, n + 1), lambda v: NOT list_contains(s, v)), ',') AS gaps FROM (SELECT l_orderkey AS card, count(*) AS n, list(DISTINCT l_linenumber) AS s FROM lineitem GROUP BY 1)"),
    "s01_split_bad": (s01_split_bad, "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN value IS NULL THEN 'no_value' WHEN coalesce(try_cast(json_extract_string(props, '$.k') AS INT) % 7 = 0, true) THEN 'bad_key' WHEN event_type = 'error' THEN 'error_event' ELSE 'OK' END AS reason FROM events) GROUP BY 1"),
    "s08_sections": (s08_sections, None),
    "s11_priority": (s11_priority, S11),
    "s13_versions": (s13_versions, "SELECT CASE WHEN c_custkey % 4 = 0 THEN 'INSERTED' WHEN c_custkey % 3 = 0 AND c_acctbal <> 0 THEN 'SUPERSEDED' ELSE 'UNCHANGED' END AS status, count(*) AS n FROM customer GROUP BY 1"),
    "s14_ignore": (s14_ignore, "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey % 2 = 0 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 60 = 0)"),
    "s14_replace": (s14_replace, "SELECT o_custkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1"),
    "s15_fill": (s15_fill, "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 3 = 0 THEN c_mktsegment ELSE 'NEW' END AS c_mktsegment FROM customer"),
    "s21_resolve": (s21_resolve, "SELECT s_suppkey AS src, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS entity, s_suppkey % 2 = 1 AS is_new FROM supplier"),
}
