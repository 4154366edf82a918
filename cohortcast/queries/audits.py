"""Queries that audit cards and sources, settle legs and evaluate runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortcast.operators import audits as a
from cohortcast.queries.frames import DATED, FIELD, dated, field, parts_of, table, with_sql
from cohortcast.queries.members import STYLED, _then, styled

r = lambda c, k=6: F.round(c, k).alias(c)


def a08_quantile_bins(spark, d):
    return a.quantile_reliability(field(spark, d).withColumn("won", F.col("finish") == 1), "p", "won")


A08 = _then(FIELD, "q AS (SELECT p, (finish = 1)::INT AS won FROM field), e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM q), b AS (SELECT p, won, len(list_filter(e, lambda x: x < p)) AS bin FROM q, e), s AS (SELECT bin, count(*) AS n, avg(p) AS mp, avg(won) AS sh FROM b GROUP BY 1)", "SELECT bin, n, round(mp, 6) AS mean_p, round(sh, 6) AS share, round(abs(mp - sh), 6) AS gap FROM s")


def _names(spark, d):
    """Entries: customers of a nation by name; records: the same names in other spellings, some of them of nobody."""
    c = table(spark, d, "customer")
    entries = c.select("c_nationkey", F.when(F.col("c_custkey") % 10 == 0, F.lit("Twin One")).otherwise(F.col("c_name")).alias("name"), "c_custkey")
    k = F.col("c_custkey")
    spelled = F.when(k % 7 == 0, F.regexp_replace("name", "[^A-Za-z0-9]", "")).when(k % 5 == 1, F.concat("name", F.lit(" x"))).when(k % 3 == 0, F.upper("name")).otherwise(F.col("name"))
    return entries, entries.select("c_nationkey", spelled.alias("name"), F.col("c_custkey").alias("record"))


def _laddered(spark, d):
    entries, records = _names(spark, d)
    return entries, a.identity_ladder(records, entries, "c_nationkey", "name", F.lower(F.regexp_replace("name", "[^A-Za-z0-9]", "")), "c_custkey")


LADDER = """e AS (SELECT c_nationkey, CASE WHEN c_custkey % 10 = 0 THEN 'Twin One' ELSE c_name END AS name, c_custkey FROM customer),
rec AS (SELECT c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN regexp_replace(name, '[^A-Za-z0-9]', '', 'g') WHEN c_custkey % 5 = 1 THEN name || ' x' WHEN c_custkey % 3 = 0 THEN upper(name) ELSE name END AS name, c_custkey AS record FROM e),
x AS (SELECT c_nationkey, lower(name) AS k, count(*) AS n, min(c_custkey) AS id FROM e GROUP BY 1, 2),
y AS (SELECT c_nationkey, lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS k, count(*) AS n, min(c_custkey) AS id FROM e GROUP BY 1, 2),
l AS (SELECT rec.c_nationkey, record, coalesce(x.n, 0) AS xn, coalesce(y.n, 0) AS yn, CASE WHEN xn = 1 THEN x.id WHEN xn = 0 AND yn = 1 THEN y.id END AS c_custkey,
  CASE WHEN xn = 1 THEN 'EXACT_MATCH' WHEN xn > 1 THEN 'AMBIGUOUS' WHEN yn = 1 THEN 'NORMALIZED_EXACT_MATCH' WHEN yn > 1 THEN 'AMBIGUOUS' ELSE 'UNMATCHED' END AS status
  FROM rec LEFT JOIN x ON x.c_nationkey = rec.c_nationkey AND x.k = lower(rec.name) LEFT JOIN y ON y.c_nationkey = rec.c_nationkey AND y.k = lower(regexp_replace(rec.name, '[^A-Za-z0-9]', '', 'g')))"""


def j19_identity(spark, d):
    return _laddered(spark, d)[1].select("record", "c_custkey", "status", "n_candidates")


def q29_second_source(spark, d):
    entries, got = _laddered(spark, d)
    return a.second_source_errors(got, entries, "c_nationkey", "c_custkey").withColumn("errors", F.array_join("errors", ","))


Q29 = _then(LADDER, "g AS (SELECT c_nationkey, count(*) AS records, count(*) FILTER (status = 'AMBIGUOUS') AS am, count(*) FILTER (status = 'UNMATCHED') AS un, count(c_custkey) > count(DISTINCT c_custkey) AS twice FROM l GROUP BY 1)", "SELECT c_nationkey, records, concat_ws(',', CASE WHEN records <> (SELECT count(*) FROM e WHERE e.c_nationkey = g.c_nationkey) THEN 'COUNT_MISMATCH' END, CASE WHEN twice THEN 'SEVERAL_TO_ONE' END, CASE WHEN am > 0 THEN 'AMBIGUOUS' END, CASE WHEN un > 0 THEN 'UNMATCHED' END) AS errors FROM g")


def j30_preview(spark, d):
    """Lines as results of cards that are orders with a stated member list; nothing is written."""
    lines = table(spark, d, "lineitem")
    members = lines.where("l_orderkey % 17 <> 0 and l_linenumber <> 3").select(F.col("l_orderkey").alias("card"), F.col("l_partkey").alias("member"))
    results = lines.select(F.col("l_orderkey").alias("card"), F.col("l_partkey").alias("member"))
    again = lines.where("l_partkey % 11 = 0").select(F.col("l_orderkey").alias("card"), F.col("l_partkey").alias("member"))
    found = a.match_preview(results.unionByName(again), members, "card", "member", parts_of(spark, 2 * lines.count()))
    cards = found.groupBy("status", "card").agg(F.count("*").alias("members"), F.sum("rows").alias("rows"))  # stays in its card's part
    return cards.groupBy("status").agg(F.sum("members").alias("members"), F.sum("rows").alias("rows"), F.count("*").alias("cards"))


J30 = """WITH m AS (SELECT DISTINCT l_orderkey AS card, l_partkey AS member FROM lineitem WHERE l_orderkey % 17 <> 0 AND l_linenumber <> 3), res AS (SELECT l_orderkey AS card, l_partkey AS member FROM lineitem UNION ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey % 11 = 0),
t AS (SELECT card, member, count(*) AS n FROM res GROUP BY 1, 2), s AS (SELECT *, CASE WHEN card NOT IN (SELECT card FROM m) THEN 'RACE_MISSING' WHEN (card, member) NOT IN (SELECT (card, member) FROM m) THEN 'UNMATCHED' WHEN n > 1 THEN 'DUPLICATE' ELSE 'MATCHED' END AS status FROM t)
SELECT status, count(*) AS members, CAST(sum(n) AS BIGINT) AS rows, count(DISTINCT card) AS cards FROM s GROUP BY 1"""


def j31_context(spark, d):
    """Each customer with its latest view and latest purchase; one aggregate of the events serves both."""
    e = table(spark, d, "events")
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.struct("ts", "event_id")))
    latest = e.groupBy(F.col("user_id").alias("c_custkey")).agg(last("view").alias("v"), last("purchase").alias("b"))
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(latest, "c_custkey", "left").select("c_custkey", "c_mktsegment", F.col("v.event_id").alias("view_id"), F.col("b.event_id").alias("buy_id"))


def q04_self_checks(spark, d):
    """By card: a winner row, programs unique, payoff of the winner against its price, purse by place against its total."""
    f = field(spark, d).withColumns({"odds": F.round("decimal", 2) - 1, "program": F.when(F.col("card") % 6 == 0, F.col("post") % 2).otherwise(F.col("post"))})
    paid = f.withColumn("payoff", F.when(F.col("card") % 9 != 0, 2 * (F.col("odds") + 1) + F.when(F.col("card") % 5 == 0, 0.1).otherwise(0.0)))
    won = lambda c: F.max(F.when(F.col("finish") == 1, F.col(c)))
    g = paid.groupBy("card").agg(F.count("*").alias("n"), F.count_distinct("program").alias("programs"), won("payoff").alias("payoff"), won("odds").alias("odds"), F.sum(F.col("price").cast("decimal(18,2)")).cast("double").alias("listed"))
    g = g.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("card"), F.col("o_totalprice").alias("total")), "card", "left")
    rules = [("DUPLICATE_PROGRAM", F.col("programs") < F.col("n")), ("NO_WIN_PAYOFF", F.col("payoff").isNull()), ("PAYOFF_DISAGREES", F.abs(F.col("payoff") / 2 - 1 - F.col("odds")) > 0.011), ("PURSE_DISAGREES", F.abs(F.col("listed") - F.col("total")) > 0.5 * F.col("total"))]
    return g.select("card", F.array_join(a.broken(rules), ",").alias("problems"))


Q04 = _then(FIELD, "s AS (SELECT *, round(decimal, 2) - 1 AS odds, CASE WHEN card % 6 = 0 THEN post % 2 ELSE post END AS program FROM field), t AS (SELECT *, CASE WHEN card % 9 <> 0 THEN 2 * (odds + 1) + CASE WHEN card % 5 = 0 THEN 0.1 ELSE 0 END END AS payoff FROM s), g AS (SELECT card, count(*) AS n, count(DISTINCT program) AS programs, max(payoff) FILTER (finish = 1) AS payoff, max(odds) FILTER (finish = 1) AS odds, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS listed FROM t GROUP BY 1)", "SELECT card, concat_ws(',', CASE WHEN programs < n THEN 'DUPLICATE_PROGRAM' END, CASE WHEN payoff IS NULL THEN 'NO_WIN_PAYOFF' END, CASE WHEN abs(payoff / 2 - 1 - odds) > 0.011 THEN 'PAYOFF_DISAGREES' END, CASE WHEN abs(listed - o_totalprice) > 0.5 * o_totalprice THEN 'PURSE_DISAGREES' END) AS problems FROM g LEFT JOIN orders ON o_orderkey = card")


def q10_eligibility(spark, d):
    """Training rows by reason of exclusion; a row counts for each of its reasons."""
    f = styled(spark, d)
    rules = [("NO_STYLE", F.col("style").isNull()), ("NO_WORKS", F.col("works").isNull()), ("FEW_STARTS", F.col("starts") < 2), ("SMALL_FIELD", F.col("n") < 3)]
    reasons = f.select("card", F.explode(F.when(F.size(a.broken(rules)) == 0, F.array(F.lit("ELIGIBLE"))).otherwise(a.broken(rules))).alias("reason"))
    return reasons.groupBy("reason").agg(F.count("*").alias("rows"), F.count_distinct("card").alias("cards"))


Q10 = _then(STYLED, "x AS (SELECT card, unnest(CASE WHEN len(b) = 0 THEN ['ELIGIBLE'] ELSE b END) AS reason FROM (SELECT card, list_filter([CASE WHEN style IS NULL THEN 'NO_STYLE' END, CASE WHEN works IS NULL THEN 'NO_WORKS' END, CASE WHEN starts < 2 THEN 'FEW_STARTS' END, CASE WHEN n < 3 THEN 'SMALL_FIELD' END], lambda v: v IS NOT NULL) AS b FROM styled))", "SELECT reason, count(*) AS rows, count(DISTINCT card) AS cards FROM x GROUP BY 1")


def q12_attested(spark, d):
    """Artifacts attested strictly before every event that uses them, and how many events that promotes."""
    f = dated(spark, d).withColumn("attested", F.date_add(F.lit("1995-01-01").cast("date"), (F.col("jockey") % 3).cast("int") * -1200))
    g = f.groupBy("jockey").agg(F.bool_and(F.col("attested") < F.col("day")).alias("accepted"), F.count("*").alias("linked"))
    return g.withColumn("promoted", F.when(F.col("accepted"), F.col("linked")).otherwise(0))


def q17_missing(spark, d):
    """By field of evidence: pairs that have it and pairs that lack it."""
    items = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).isNull().alias("no")) for c in ("style", "works", "gate", "layoff", "rate")])
    return styled(spark, d).select("card", F.explode(items).alias("i")).select("card", "i.*").groupBy("card", "item").agg(F.count_if("no").alias("missing"), (F.count_if("no") == 0).alias("complete"))


def q19_completeness(spark, d):
    """Share of a contract's fields that are there, by surface and overall (null)."""
    have = sum((F.col(c).isNotNull().cast("int") for c in ("style", "works", "gate", "layoff")), F.lit(0))
    return styled(spark, d).withColumn("have", have).rollup("surface").agg(F.count("*").alias("rows"), F.round(F.sum("have") / (4 * F.count("*")), 6).alias("complete"), F.count_if(F.col("have") == 4).alias("whole"))


def q33_validity(spark, d):
    status = F.when(F.col("member") % 8 == 0, "placeholder").when(F.col("member") % 8 == 1, F.lit(None)).otherwise("observed")
    source = F.when(F.col("jockey") % 6 == 0, " Seeded ").when(F.col("jockey") % 6 == 1, "hearsay").otherwise("Chart")
    reason = a.feature_validity(status, source, F.col("post") - 1, F.col("ship"), F.col("day") + F.expr("interval 60 days"), ["UNKNOWN", "PLACEHOLDER", "UNAVAILABLE"], ["seeded", "default"], ["chart", "feed"])
    return dated(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


Q33 = with_sql(DATED, "SELECT CASE WHEN member % 8 IN (0, 1) THEN 'ACTIVE_FEATURE_PLACEHOLDER_OR_UNAVAILABLE' WHEN jockey % 6 = 0 THEN 'ACTIVE_FEATURE_SEEDED_OR_DEFAULTED' WHEN jockey % 6 = 1 THEN 'ACTIVE_FEATURE_UNKNOWN_OR_UNSUPPORTED_SOURCE' WHEN post <= 1 THEN 'ACTIVE_FEATURE_NO_EVIDENCE' WHEN ship >= day + INTERVAL 60 DAY THEN 'ACTIVE_FEATURE_AS_OF_INVALID' ELSE '' END AS reason, count(*) AS n FROM dated GROUP BY 1")

_KINDS = ["WIN", "PLACE", "SHOW", "EXACTA", "TRIFECTA", "SUPERFECTA", "OTHER"]


def f13_stakes(spark, d):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("l_partkey") % 7 + 1).cast("int"))
    raw = F.floor((F.round(F.col("l_extendedprice") * 100).cast("long") + 2500) / 5000) / 100  # from cents: a half goes up, whatever the quotient's last bits are
    stake = a.rounded_stake(raw, kind)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"), stake.alias("stake"), F.when(stake > 0, F.concat(F.lit("$"), F.format_string("%.2f", stake))).otherwise("PASS").alias("advice"))


_STEP = "CASE l_partkey % 7 WHEN 3 THEN 1.0 WHEN 4 THEN 0.5 WHEN 5 THEN 0.1 WHEN 6 THEN 1.0 ELSE 2.0 END::DOUBLE"
F13 = f"WITH a AS (SELECT *, {_KINDS}[l_partkey % 7 + 1] AS kind, (CAST(round(l_extendedprice * 100) AS BIGINT) + 2500) // 5000 / 100::DOUBLE AS raw, {_STEP} AS step FROM lineitem), b AS (SELECT *, CASE WHEN raw >= step THEN round(floor(raw / step + 1e-9) * step, 2) ELSE 0.0 END AS stake FROM a) SELECT l_orderkey, l_linenumber, kind, stake, CASE WHEN stake > 0 THEN '$' || printf('%.2f', stake) ELSE 'PASS' END AS advice FROM b"


def f15_lineage(spark, d):
    """Lineage as JSON and back: one row for each feature's status, UNKNOWN where the text lacks it."""
    status = lambda c: F.when(F.col(c).isNotNull(), "observed")
    text = F.to_json(F.struct(*[status(c).alias(c) for c in ("style", "works", "gate")]))
    read = styled(spark, d).select("card", F.from_json(text, "map<string,string>").alias("m"))
    rows = read.select("card", F.explode(F.array(*map(F.lit, ("style", "works", "gate", "sire")))).alias("feature"), "m")
    return rows.groupBy("feature", F.coalesce(F.col("m")[F.col("feature")], F.lit("UNKNOWN")).alias("status")).agg(F.count("*").alias("n"))


def x18_observed_style(spark, d):
    code = F.when(F.col("card") % 4 != 0, F.element_at(F.array(*map(F.lit, ("E", "e/p ", "P", "S"))), (F.col("member") % 4 + 1).cast("int"))).when(F.col("post") > 1, "E")
    f = styled(spark, d).withColumns({"code": code, "captured": F.col("card") % 3, "start": F.lit(2)})
    return a.whole_group_override(f, "card", "style", "code", "captured", "start").select("card", "member", "observed", "style")


def x16_scratches(spark, d):
    """By member: scratch rate from three rows on, and publicness of its prices shrunk to 0.10, older ones weighing less."""
    h = dated(spark, d)
    days = F.greatest(F.datediff(F.lit("1999-01-01").cast("date"), "day"), F.lit(0))
    w = F.exp(-0.01 * days)
    g = h.groupBy("member").agg(F.count("*").alias("n"), F.count_if(F.col("qty") < 10).alias("out"), F.sum(w).alias("w"), F.sum(w * F.col("m")).alias("wm"), F.count_if(F.col("jockey") % 2 == 0).alias("first_source"))
    return g.select("member", "n", F.when(F.col("n") >= 3, "adequate").otherwise("low").alias("confidence"), F.when(F.col("n") >= 3, F.round(F.col("out") / F.col("n"), 4)).alias("scratch_rate"), F.round((F.col("wm") + 0.3) / (F.col("w") + 3.0) + 1e-9, 4).alias("publicness"), "first_source")


X16 = _then(DATED, "h AS (SELECT *, exp(-0.01 * greatest(date_diff('day', day, DATE '1999-01-01'), 0)) AS w FROM dated)", "SELECT member, count(*) AS n, CASE WHEN count(*) >= 3 THEN 'adequate' ELSE 'low' END AS confidence, CASE WHEN count(*) >= 3 THEN round(count(*) FILTER (qty < 10) / count(*), 4) END AS scratch_rate, round((sum(w * m) + 0.3) / (sum(w) + 3) + 1e-9, 4) AS publicness, count(*) FILTER (jockey % 2 = 0) AS first_source FROM h GROUP BY 1")


def e14_legs(spark, d):
    """Legs of the three likeliest members of a card (to win, to place, to show), by type: how many hit, and their mean chance."""
    w = Window.partitionBy("card").orderBy(F.round("p", 9).desc(), "member")
    f = field(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 3")
    kind = F.element_at(F.array(*map(F.lit, a.NEEDS)), F.col("k"))
    legs = f.select(kind.alias("kind"), r("p", 9), a.leg_status(kind, F.when(F.col("member") % 10 != 0, F.col("finish"))).alias("status"))
    g = legs.where("status <> 'VOID'").groupBy("kind").agg(F.count("*").alias("legs"), F.count_if(F.col("status") == "HIT").alias("hits"), F.sum(F.col("p").cast("decimal(18,9)")).cast("double").alias("p"))
    return g.select("kind", "legs", "hits", F.round(F.col("hits") / F.col("legs"), 6).alias("hit_rate"), F.round(F.col("p") / F.col("legs"), 6).alias("mean_p"))


E14 = _then(FIELD, "k AS (SELECT *, row_number() OVER (PARTITION BY card ORDER BY round(p, 9) DESC, member) AS k FROM field QUALIFY k <= 3), s AS (SELECT ['WIN', 'PLACE', 'SHOW'][k] AS kind, CAST(round(p, 9) AS DECIMAL(18,9)) AS p, (finish <= k)::INT AS hit FROM k WHERE member % 10 <> 0)", "SELECT kind, count(*) AS legs, CAST(sum(hit) AS BIGINT) AS hits, round(sum(hit) / count(*), 6) AS hit_rate, round(CAST(sum(p) AS DOUBLE) / count(*), 6) AS mean_p FROM s GROUP BY 1")


def e06_run(spark, d):
    """A run by card: the effective pick and the favourite, whether they won, how many of the first three were among the three likeliest."""
    f, w = field(spark, d).withColumn("out", F.col("member") % 10 == 0), Window.partitionBy("card")
    f = f.withColumns({"k": F.row_number().over(w.orderBy("out", F.round("p", 9).desc(), "member")), "v": F.row_number().over(w.orderBy("out", F.round("decimal", 6), "post"))}).where("not out")
    first = lambda c, x: F.max(F.when(F.col(c) == 1, F.col(x)))
    g = f.groupBy("card").agg(first("k", "member").alias("pick"), first("k", "finish").cast("long").alias("pick_finish"), first("v", "member").alias("favourite"), first("v", "finish").cast("long").alias("favourite_finish"), F.count_if((F.col("k") <= 3) & (F.col("finish") <= 3)).alias("top3_hits"))
    return g.withColumn("pick_won", F.col("pick_finish") == 1).withColumn("agrees", F.col("pick") == F.col("favourite"))


E06 = _then(FIELD, "k AS (SELECT *, row_number() OVER (PARTITION BY card ORDER BY member % 10 = 0, round(p, 9) DESC, member) AS k, row_number() OVER (PARTITION BY card ORDER BY member % 10 = 0, round(decimal, 6), post) AS v FROM field), g AS (SELECT card, max(member) FILTER (k = 1) AS pick, max(finish) FILTER (k = 1) AS pick_finish, max(member) FILTER (v = 1) AS favourite, max(finish) FILTER (v = 1) AS favourite_finish, count(*) FILTER (k <= 3 AND finish <= 3) AS top3_hits FROM k WHERE member % 10 <> 0 GROUP BY 1)", "SELECT *, pick_finish = 1 AS pick_won, pick = favourite AS agrees FROM g")


def e18_index(spark, d):
    """Cards that aren't hidden, with their state: scored, latest run, results."""
    runs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").cast("date").alias("latest_run"), F.count_if(F.col("l_returnflag") == "R").alias("res"))
    o = table(spark, d, "orders").where("o_orderpriority not like '5%'")
    return o.join(runs, "o_orderkey", "left").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.col("latest_run").isNotNull().cast("int").alias("has_run"), "latest_run", (F.coalesce("res", F.lit(0)) > 0).cast("int").alias("has_results"))


QUERIES = {
    "a08_quantile_bins": (a08_quantile_bins, A08),
    "j19_identity": (j19_identity, with_sql(LADDER, "SELECT record, c_custkey, status, CASE WHEN xn > 0 THEN xn ELSE yn END AS n_candidates FROM l")),
    "q29_second_source": (q29_second_source, Q29),
    "j30_preview": (j30_preview, J30),
    "j31_context": (j31_context, "SELECT c_custkey, any_value(c_mktsegment) AS c_mktsegment, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'view') AS view_id, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'purchase') AS buy_id FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1"),
    "q04_self_checks": (q04_self_checks, Q04),
    "q10_eligibility": (q10_eligibility, Q10),
    "q12_attested": (q12_attested, with_sql(DATED, "SELECT jockey, bool_and(DATE '1995-01-01' - CAST(jockey % 3 * 1200 AS INTEGER) < day) AS accepted, count(*) AS linked, CASE WHEN accepted THEN count(*) ELSE 0 END AS promoted FROM dated GROUP BY 1")),
    "q17_missing": (q17_missing, _then(STYLED, "i AS (" + " UNION ALL ".join(f"SELECT card, '{c}' AS item, {c} IS NULL AS no FROM styled" for c in ("style", "works", "gate", "layoff", "rate")) + ")", "SELECT card, item, count(*) FILTER (no) AS missing, count(*) FILTER (no) = 0 AS complete FROM i GROUP BY 1, 2")),
    "q19_completeness": (q19_completeness, _then(STYLED, "h AS (SELECT surface, (style IS NOT NULL)::INT + (works IS NOT NULL)::INT + (gate IS NOT NULL)::INT + (layoff IS NOT NULL)::INT AS have FROM styled)", "SELECT surface, count(*) AS rows, round(sum(have) / (4 * count(*)), 6) AS complete, count(*) FILTER (have = 4) AS whole FROM h GROUP BY ROLLUP (surface)")),
    "q33_validity": (q33_validity, Q33),
    "f13_stakes": (f13_stakes, F13),
    "f15_lineage": (f15_lineage, _then(STYLED, "x AS (SELECT unnest(['style', 'works', 'gate', 'sire']) AS feature, unnest([style IS NOT NULL, works IS NOT NULL, gate IS NOT NULL, false]) AS has FROM styled)", "SELECT feature, CASE WHEN has THEN 'observed' ELSE 'UNKNOWN' END AS status, count(*) AS n FROM x GROUP BY 1, 2")),
    "x18_observed_style": (x18_observed_style, with_sql(STYLED, "SELECT card, member, card % 4 <> 0 AND card % 3 < 2 AS observed, CASE WHEN card % 4 <> 0 AND card % 3 < 2 THEN ['front', 'presser', 'stalker', 'closer'][member % 4 + 1] ELSE style END AS style FROM styled")),
    "x16_scratches": (x16_scratches, X16),
    "e14_legs": (e14_legs, E14),
    "e06_run": (e06_run, E06),
    "e18_index": (e18_index, "SELECT o_orderkey, CAST(any_value(o_orderdate) AS DATE) AS day, (count(l_orderkey) > 0)::INT AS has_run, CAST(max(l_shipdate) AS DATE) AS latest_run, (count(*) FILTER (l_returnflag = 'R') > 0)::INT AS has_results FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority NOT LIKE '5%' GROUP BY 1"),
}
