"""Queries over records: overlays, batches, pairing, coverage, registries, segment roll-ups, simple features."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortcast.operators import features, records, rules, windows
from cohortcast.operators.aggregates import rate
from cohortcast.queries.frames import DATED, FIELD, dated, field, table, with_sql

r = lambda c, k=6: F.round(c, k).alias(c)


def j11_latest_batch(spark, d):
    e = table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts")).withColumn("slot", F.col("event_id") % 3)
    return records.latest_batch(e, "user_id", "hour", "slot").select("user_id", "hour", "slot", "event_id")


J11 = """WITH e AS (SELECT *, date_trunc('hour', ts) AS hour, event_id % 3 AS slot FROM events), l AS (SELECT *, max(hour) OVER (PARTITION BY user_id) AS t FROM e), c AS (SELECT *, count(*) OVER (PARTITION BY user_id, slot) AS c FROM l WHERE hour = t),
w AS (SELECT *, max(c) OVER (PARTITION BY user_id) AS worst FROM c) SELECT user_id, hour, slot, event_id FROM w WHERE worst = 1"""


def j12_overlay(spark, d):
    f = field(spark, d)
    live = f.where("member % 12 <> 0").select("card", "member", F.round("m", 9).alias("p"))
    return records.overlay_if_complete(f.select("card", "member", F.round("p", 9).alias("p")), live, "card", "member", "p").select("card", "member", r("p"), "is_live")


J12 = with_sql(FIELD, "SELECT card, member, round(CASE WHEN bool_and(member % 12 <> 0) OVER w THEN round(m, 9) ELSE round(p, 9) END, 6) AS p, bool_and(member % 12 <> 0) OVER w AS is_live FROM field WINDOW w AS (PARTITION BY card)")


def j21_pairing(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust"))
    a = o.where("key % 3 <> 0")
    b = o.where("key % 4 <> 0").withColumn("key", F.when(F.col("key") % 5 == 0, -F.col("key")).otherwise(F.col("key")))
    return records.pair_keys(a, b.unionByName(b.where("key % 50 = 1")), "key", ["cust"]).groupBy("status").agg(F.count("*").alias("n"))


J21 = """WITH a AS (SELECT o_orderkey AS key, o_custkey AS cust FROM orders WHERE o_orderkey % 3 <> 0), b0 AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN -o_orderkey ELSE o_orderkey END AS key, o_custkey AS cust FROM orders WHERE o_orderkey % 4 <> 0),
b AS (SELECT key, cust, count(*) AS nb FROM (FROM b0 UNION ALL FROM b0 WHERE key % 50 = 1) GROUP BY 1, 2), f AS (SELECT key, cust, a.key IS NOT NULL AS c, nb FROM a FULL JOIN b USING (key, cust)),
w AS (SELECT *, count(*) FILTER (c) OVER v AS nc, count(nb) OVER v AS nr FROM f WINDOW v AS (PARTITION BY cust))
SELECT CASE WHEN nb > 1 THEN 'AMBIGUOUS' WHEN c AND nb IS NOT NULL THEN 'PAIRED' WHEN nb IS NULL THEN CASE WHEN nr > 0 THEN 'KEY_MISMATCH' ELSE 'CARD_ONLY' END ELSE CASE WHEN nc > 0 THEN 'KEY_MISMATCH' ELSE 'RESULT_ONLY' END END AS status, count(*) AS n FROM w GROUP BY 1"""


def j25_source_priority(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("a"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 1).alias("b"))
    value, label = records.first_known([("entry", F.col("a")), ("provider", F.col("b")), ("derived", F.when(F.col("c_custkey") % 5 == 0, F.lit(0.0)))])
    return c.select("c_custkey", value.alias("value"), label.alias("source"))


def s23_candidates(spark, d):
    f = field(spark, d).withColumn("speed", F.when(F.col("member") % 5 != 0, F.col("post"))).withColumn("style", F.when(F.col("member") % 3 != 0, F.col("surface")))
    return records.unpivot_status(f, ["card", "member"], ["speed", "style"])


def s28_made_before(spark, d):
    e = table(spark, d, "events")
    posts = e.where("event_type = 'purchase' AND user_id % 7 <> 0").groupBy("user_id").agg(F.min("ts").alias("post"))
    return records.made_before(e.where("event_type = 'click'").select("user_id", "event_id", "ts"), posts, "user_id", "ts", "post").groupBy("reason", "accepted").agg(F.count("*").alias("n"))


S28 = "SELECT CASE WHEN post IS NULL THEN 'NO_POST_TIME' WHEN ts >= post THEN 'AT_OR_AFTER_POST' ELSE 'OK' END AS reason, CASE WHEN post IS NULL OR ts >= post THEN false ELSE true END AS accepted, count(*) AS n FROM events LEFT JOIN (SELECT user_id, min(ts) AS post FROM events WHERE event_type = 'purchase' AND user_id % 7 <> 0 GROUP BY 1) USING (user_id) WHERE event_type = 'click' GROUP BY 1, 2"


def a21_coverage(spark, d):
    f = dated(spark, d)
    return records.coverage(f, "class", {"as_of": F.col("ship") < F.date_add("day", 60), "outcome": F.col("card") % 13 != 0, "price": F.col("decimal") > 1})


def a28_dependencies(spark, d):
    return records.dependency_counts({"orders": table(spark, d, "orders").select(F.col("o_custkey").alias("key")), "events": table(spark, d, "events").select(F.col("user_id").alias("key")), "suppliers": table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"))}, "key")


def w19_folds(spark, d):
    f = dated(spark, d).select("card", "day")
    return records.contiguous_folds(f, "card", "day").groupBy("fold").agg(F.count_distinct("card").alias("cards"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


W19 = with_sql(DATED, ", g AS (SELECT day, count(DISTINCT card) AS g FROM dated GROUP BY 1), b AS (SELECT day, coalesce(sum(g) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(g) OVER () AS total FROM g) SELECT CAST(floor(before * 3 / total) AS INT) AS fold, count(DISTINCT card) AS cards, min(day) AS first_day, max(day) AS last_day FROM dated JOIN b USING (day) GROUP BY 1").replace("\n, g AS", ",\ng AS", 1)


def a25_person_stats(spark, d):
    f = dated(spark, d).withColumn("rider", F.col("jockey") % 20).withColumn("trainer", F.col("owner") % 30)
    return records.sectioned_rates(f, [["rider"], ["trainer"], ["rider", "trainer"]], ["rider", "trainer"], F.col("finish") == 1)


def a03_segments(spark, d):
    f = dated(spark, d).where("post = 1").withColumn("bucket", rules.field_size_bucket(F.col("n")))
    return f.groupBy("surface", "class", "bucket").agg(F.count("*").alias("cards"), F.round(rate(F.col("finish") == 1), 6).alias("win_rate"), F.round(F.avg("finish"), 6).alias("avg_finish"), F.round(F.avg(F.when(F.col("member") % 9 == 0, (F.col("finish") == 1).cast("double"))), 6).alias("scratched_pick_rate"))


A03 = with_sql(DATED, "SELECT surface, class, CASE WHEN n <= 6 THEN 'small' WHEN n <= 9 THEN 'medium' WHEN n <= 12 THEN 'large' ELSE 'full' END AS bucket, count(*) AS cards, round(avg((finish = 1)::INT), 6) AS win_rate, round(avg(finish), 6) AS avg_finish, round(avg(CASE WHEN member % 9 = 0 THEN (finish = 1)::INT END), 6) AS scratched_pick_rate FROM dated WHERE post = 1 GROUP BY 1, 2, 3")


def a10_member_metrics(spark, d):
    f = windows.probability_rank(field(spark, d), "card", "p", "post")
    q = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("p")))
    won = (F.col("finish") == 1).cast("double")
    return f.groupBy("surface").agg(F.count("*").alias("n"), F.round(F.avg(-(won * F.log(q) + (1 - won) * F.log(1 - q))), 5).alias("log_loss"), F.round(F.avg(F.pow(F.col("p") - won, 2)), 5).alias("brier"), F.count_if((F.col("finish") == 1) & (F.col("model_rank") == 1)).alias("top1"), F.count_if((F.col("finish") == 1) & (F.col("model_rank") <= 3)).alias("top3"), F.round(F.avg(F.when(F.col("finish") == 1, F.col("model_rank"))), 5).alias("winner_rank"))


A10 = with_sql(FIELD, "SELECT surface, count(*) AS n, round(avg(-CASE WHEN finish = 1 THEN ln(q) ELSE ln(1 - q) END), 5) AS log_loss, round(avg((p - (finish = 1)::INT) ** 2), 5) AS brier, count(*) FILTER (finish = 1 AND mr = 1) AS top1, count(*) FILTER (finish = 1 AND mr <= 3) AS top3, round(avg(CASE WHEN finish = 1 THEN mr END), 5) AS winner_rank FROM (SELECT *, greatest(1e-9, least(1 - 1e-9, p)) AS q, row_number() OVER (PARTITION BY card ORDER BY p DESC, post) AS mr FROM field) GROUP BY 1")


def a16_baselines(spark, d):
    """Net of backing every member, and of backing the shortest price, at the same prices."""
    f = dated(spark, d)
    win = F.when(F.col("finish") == 1, F.col("decimal") - 1).otherwise(-1.0)
    short = f.groupBy("class", "card").agg(F.min_by(win, F.struct(F.round("decimal", 9), "member")).alias("x")).groupBy("class").agg(F.round(F.sum("x"), 3).alias("shortest"), F.count("*").alias("cards"))
    return f.groupBy("class").agg(F.round(F.sum(win), 3).alias("every")).join(short, "class")


A16 = with_sql(DATED, ", w AS (SELECT *, CASE WHEN finish = 1 THEN decimal - 1 ELSE -1 END AS x, row_number() OVER (PARTITION BY card ORDER BY round(decimal, 9), member) AS k FROM dated) SELECT class, round(sum(x), 3) AS every, round(sum(CASE WHEN k = 1 THEN x END), 3) AS shortest, count(*) FILTER (k = 1) AS cards FROM w GROUP BY 1").replace("\n, w AS", ",\nw AS", 1)


def a36_run_summary(spark, d):
    f = field(spark, d).withColumn("edge", F.round(F.col("p") - F.col("m"), 9)).withColumn("tag", rules.value_tag(F.col("edge")))
    return f.groupBy("surface").agg(F.count_if(F.col("tag") == "bet").alias("bets"), F.count_if(F.col("tag") == "underlay").alias("underlays"), F.round(F.avg(F.abs("edge")), 6).alias("mean_abs_edge"), F.round(F.max("edge"), 6).alias("max_edge"), F.round(F.min("edge"), 6).alias("min_edge"))


def w01_last_five(spark, d):
    o = table(spark, d, "orders")
    last = windows.latest_k(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5)
    return last.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 1).alias("mean_price"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"))


def x06_beaten(spark, d):
    f = dated(spark, d)
    return f.select("card", "member", F.round(features.beaten_share(F.col("finish"), F.col("n")), 6).alias("beaten"), F.round(features.form_cycle(F.col("p"), F.col("finish")), 6).alias("form"))


X06 = with_sql(DATED, "SELECT card, member, round(CASE WHEN n >= 2 THEN 1 - (finish - 1) / (n - 1) END, 6) AS beaten, round(0.6 * p + 0.4 * (1 - greatest(0, least(1, (finish - 1) / 10))), 6) AS form FROM dated")


def x12_override(spark, d):
    f = field(spark, d)
    parts = [F.when(F.col("member") % k != 0, c) for k, c in ((2, F.col("p")), (3, F.col("m")), (5, F.col("post") / F.col("n")), (7, F.col("price") / 100000), (11, F.col("qty") / 50))]
    return f.select("card", "member", F.round(features.weighted_known(parts, features.OVERRIDE_WEIGHTS), 12).alias("composite"))


X12 = with_sql(FIELD, ", v AS (SELECT card, member, [CASE WHEN member % 2 <> 0 THEN p END, CASE WHEN member % 3 <> 0 THEN m END, CASE WHEN member % 5 <> 0 THEN post / n END, CASE WHEN member % 7 <> 0 THEN price / 100000 END, CASE WHEN member % 11 <> 0 THEN qty / 50 END] AS x FROM field), w AS (SELECT *, [0.35, 0.2, 0.2, 0.15, 0.1]::DOUBLE[] AS k FROM v), s AS (SELECT card, member, list_sum([CASE WHEN x[i] IS NOT NULL THEN k[i] END FOR i IN [1, 2, 3, 4, 5]]) AS t, list_sum([x[i] * k[i] FOR i IN [1, 2, 3, 4, 5]]) AS y FROM w) SELECT card, member, round(y / t, 12) AS composite FROM s").replace("\n, v AS", ",\nv AS", 1)


def p17_review(spark, d):
    """Latest graded cards of one surface and class, by optional filters."""
    f = dated(spark, d).where("surface = 'A' AND class = '1-URGENT' AND n BETWEEN 3 AND 8 AND finish = 1")
    return f.select("card", "day", "member", r("p")).orderBy(F.desc("day"), F.desc("card")).limit(50)


def e10_outcome_view(spark, d):
    l = table(spark, d, "labels")
    t = table(spark, d, "documents").select("doc_id", "lang", "source")
    return t.join(l, "doc_id", "left").groupBy("lang", "source").agg(F.count("*").alias("documents"), F.count("quality").alias("labelled"), F.round(F.avg("quality"), 6).alias("quality"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


QUERIES = {
    "j11_latest_batch": (j11_latest_batch, J11),
    "j12_overlay": (j12_overlay, J12),
    "j21_pairing": (j21_pairing, J21),
    "j25_source_priority": (j25_source_priority, "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 WHEN c_custkey % 5 = 0 THEN 0 END AS value, CASE WHEN c_custkey % 2 = 0 THEN 'entry' WHEN c_custkey % 3 = 0 THEN 'provider' WHEN c_custkey % 5 = 0 THEN 'derived' END AS source FROM customer"),
    "s23_candidates": (s23_candidates, with_sql(FIELD, "SELECT card, member, name, value, CASE WHEN value IS NULL THEN 'MISSING' ELSE 'OBSERVED' END AS status FROM (SELECT card, member, 'speed' AS name, CASE WHEN member % 5 <> 0 THEN post::VARCHAR END AS value FROM field UNION ALL SELECT card, member, 'style', CASE WHEN member % 3 <> 0 THEN surface END FROM field)")),
    "s28_made_before": (s28_made_before, S28),
    "a03_segments": (a03_segments, A03),
    "a10_member_metrics": (a10_member_metrics, A10),
    "a16_baselines": (a16_baselines, A16),
    "a21_coverage": (a21_coverage, with_sql(DATED, "SELECT class, count(*) AS rows, round(avg((ship < day + 60)::INT), 6) AS as_of, round(avg((card % 13 <> 0)::INT), 6) AS outcome, round(avg((decimal > 1)::INT), 6) AS price FROM dated GROUP BY 1")),
    "a25_person_stats": (a25_person_stats, with_sql(DATED, "SELECT rider, trainer, count(*) AS n, count(*) FILTER (finish = 1) AS hits, round(count(*) FILTER (finish = 1) / count(*), 6) AS rate, count(*) < 5 AS sparse FROM (SELECT *, jockey % 20 AS rider, owner % 30 AS trainer FROM dated) GROUP BY GROUPING SETS ((rider), (trainer), (rider, trainer))")),
    "a28_dependencies": (a28_dependencies, "SELECT key, count(*) FILTER (t = 'o') AS orders, count(*) FILTER (t = 'e') AS events, count(*) FILTER (t = 's') AS suppliers FROM (SELECT o_custkey AS key, 'o' AS t FROM orders UNION ALL SELECT user_id, 'e' FROM events UNION ALL SELECT s_suppkey, 's' FROM supplier) GROUP BY 1"),
    "a36_run_summary": (a36_run_summary, with_sql(FIELD, "SELECT surface, count(*) FILTER (e >= 0.02) AS bets, count(*) FILTER (e <= -0.02) AS underlays, round(avg(abs(e)), 6) AS mean_abs_edge, round(max(e), 6) AS max_edge, round(min(e), 6) AS min_edge FROM (SELECT surface, round(p - m, 9) AS e FROM field) GROUP BY 1")),
    "w01_last_five": (w01_last_five, "SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 1) AS mean_price, count(*) FILTER (o_orderstatus = 'F') AS filled FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 5 GROUP BY 1"),
    "w19_folds": (w19_folds, W19),
    "x06_beaten": (x06_beaten, X06),
    "x12_override": (x12_override, X12),
    "p17_review": (p17_review, with_sql(DATED, "SELECT card, day, member, round(p, 6) AS p FROM dated WHERE surface = 'A' AND class = '1-URGENT' AND n BETWEEN 3 AND 8 AND finish = 1 ORDER BY day DESC, card DESC LIMIT 50")),
    "e10_outcome_view": (e10_outcome_view, "SELECT lang, source, count(*) AS documents, count(quality) AS labelled, round(avg(quality), 6) AS quality, CAST(sum(coalesce(toxic, 0)) AS BIGINT) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2"),
}
