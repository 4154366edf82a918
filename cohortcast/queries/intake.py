"""Queries of intake: odds feeds, outcome logs, stewards' orders, board permissions, model choice and agreement of views."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortcast.operators import intake as k
from cohortcast.queries.frames import FIELD, field, table
from cohortcast.queries.members import _then
from cohortcast.sources.sinks import new_rows

#: Books whose prices are taken.
BOOKS = ["fanduel", "draftkings", "twinspires", "churchill", "betmgm", "betonline", "caesars", "manual", "morningline"]
MODES = [*k.CONTRACT, "SOMETHING_ELSE"]


def _nth(values: list, n):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (n % len(values) + 1).cast("int"))


def _sql(values: list, n: str) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][{n} % {len(values)} + 1]"


def s03_odds_feed(spark, d):
    """Members as rows of a feed in mixed dialects, some of them of no entry or an unknown book."""
    f = field(spark, d).withColumns({"q": F.col("qty").cast("long")})
    feed = f.select("card", F.when(F.col("q") % 9 == 0, F.lit(99)).otherwise(F.col("post")).alias("post"), "member", _nth(["FanDuel ", "nobody", None, "", "betmgm"], F.col("member")).alias("book"), _nth(["4.5", "x", None, ""], F.col("q")).alias("decimal_odds"), _nth(["+450", "-200", "n/a", None, None], F.col("q")).alias("american_odds"), _nth(["7/2", "even", None], F.col("q")).alias("morning_line"))
    return k.scanned_prices(feed, f, ["card", "post"], BOOKS).select("card", "post", "member", "book", F.round("price", 6).alias("price"), "odds_type", "skipped")


S03 = _then(FIELD, f"""q AS (SELECT *, CAST(qty AS BIGINT) AS q FROM field),
x AS (SELECT card, CASE WHEN q % 9 = 0 THEN 99 ELSE post END AS post, member, {_sql(['fanduel', 'nobody', 'manual', 'manual', 'betmgm'], 'member')} AS book, CASE WHEN q % 4 = 0 THEN 4.5 END AS dec, CASE q % 5 WHEN 0 THEN 5.5 WHEN 1 THEN 1.5 END AS am, CASE q % 3 WHEN 0 THEN 4.5 WHEN 1 THEN 2.0 END AS ml FROM q)""", "SELECT card, post, member, book, CAST(coalesce(dec, am, ml) AS DOUBLE) AS price, CASE WHEN coalesce(dec, am) IS NOT NULL THEN 'live_tote' WHEN ml IS NOT NULL THEN 'morning_line' END AS odds_type, CASE WHEN book = 'nobody' THEN 'book' WHEN coalesce(dec, am, ml) IS NULL THEN 'odds' WHEN post = 99 THEN 'entry' END AS skipped FROM x")


def s05_outcome_log(spark, d):
    """Lines as rows of a log, matched to cards by customer and month; cards are orders."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("track"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    texts = k.log_fields(_nth(["1", " 12 ", "scr", "2.5", None, ""], F.col("q")), _nth(["✓", "no", None], F.col("q")), _nth(["7.0f", "8.5F ", "8", None], F.col("q")), _nth(["ON", "off", None, " ", "yes"], F.col("q")))
    log = lines.join(o, "o_orderkey").select(F.col("o_orderkey").alias("source"), "l_linenumber", "track", F.when(F.col("q") % 10 == 0, "1900-01").otherwise(F.col("month")).alias("month"), *[c.alias(n) for n, c in texts.items()])
    return k.matched_cards(log, o.withColumnRenamed("o_orderkey", "card"), ["track", "month"], "card").drop("track", "month")


S05 = f"""WITH o AS (SELECT o_orderkey, o_custkey AS track, strftime(o_orderdate, '%Y-%m') AS month FROM orders), c AS (SELECT track, month, count(*) AS n, min(o_orderkey) AS card FROM o GROUP BY 1, 2),
l AS (SELECT o_orderkey AS source, l_linenumber, track, CAST(l_quantity AS BIGINT) AS q, CASE WHEN CAST(l_quantity AS BIGINT) % 10 = 0 THEN '1900-01' ELSE month END AS month FROM lineitem JOIN o ON l_orderkey = o_orderkey)
SELECT source, l_linenumber, CASE q % 6 WHEN 0 THEN 1 WHEN 1 THEN 12 END AS place, q % 6 = 2 AS scratched, q % 3 = 0 AS marked, CAST(CASE q % 4 WHEN 0 THEN 7.0 WHEN 1 THEN 8.5 END AS DOUBLE) AS furlongs, q % 5 IN (0, 4) AS on, CASE WHEN n = 1 THEN c.card END AS card, CASE WHEN n = 1 THEN 'MATCHED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'UNMATCHED' END AS status FROM l LEFT JOIN c USING (track, month)"""
S05 = S05.replace("AS on,", 'AS "on",')


def q05_stewards(spark, d):
    """A third of the cards: the winner goes to third; a sixth: then the second as run goes first. Ties by card."""
    f = field(spark, d).select("card", "member", F.col("finish").cast("int").alias("finish"))
    move = lambda nth, rows, to: f.where(rows).select("card", F.lit(nth).alias("nth"), "member", F.lit(to).alias("to"))
    moves = move(1, "card % 3 = 0 AND finish = 1", 3).unionByName(move(2, "card % 6 = 0 AND finish = 2", 1)).unionByName(move(3, "card % 12 = 0 AND finish = 4", 1))
    ties = f.where("card % 5 = 0 AND finish = 4").select("card", "member", F.lit(3).alias("place"))
    return k.official_order(f, moves, ties, "card", "member", "finish")


def _step(at: str, who: str, to: int) -> str:
    """The place after a move of the member at `who` to `to`, as SQL over the places before it."""
    end = f"least({to}, n)"
    return f"CASE WHEN {who} IS NULL THEN {at} WHEN {at} = {who} THEN {end} WHEN {who} < {end} AND {at} > {who} AND {at} <= {end} THEN {at} - 1 WHEN {who} > {end} AND {at} >= {end} AND {at} < {who} THEN {at} + 1 ELSE {at} END"


Q05 = _then(FIELD, f"""a AS (SELECT card, member, finish, n, CASE WHEN card % 3 = 0 THEN 1 END AS w1 FROM field),
b AS (SELECT *, {_step('finish', 'w1', 3)} AS p1 FROM a), b2 AS (SELECT *, CASE WHEN card % 6 = 0 THEN max(CASE WHEN finish = 2 THEN p1 END) OVER (PARTITION BY card) END AS w2 FROM b),
c AS (SELECT *, {_step('p1', 'w2', 1)} AS p2 FROM b2), c2 AS (SELECT *, CASE WHEN card % 12 = 0 THEN max(CASE WHEN finish = 4 THEN p2 END) OVER (PARTITION BY card) END AS w3 FROM c),
e AS (SELECT *, {_step('p2', 'w3', 1)} AS p3 FROM c2)""", "SELECT card, member, CAST(finish AS INTEGER) AS finish, CAST(CASE WHEN card % 5 = 0 AND finish = 4 THEN 3 ELSE p3 END AS INTEGER) AS place, (card % 3 = 0 AND finish = 1) OR (card % 6 = 0 AND finish = 2) OR (card % 12 = 0 AND finish = 4) AS moved FROM e")


def p23_contract(spark, d):
    c = F.col("o_orderkey")
    mode = k.effective_mode(_nth(MODES, c), F.when(c % 8 != 1, c % 8 == 0), c % 9 != 0)
    o = table(spark, d, "orders").select("o_orderkey", mode.alias("mode"), (c % 2 == 0).alias("live"))
    return o.select("o_orderkey", "mode", *[p.alias(n) for n, p in k.permissions(F.col("mode"), F.col("live")).items()])


P23 = f"WITH a AS (SELECT o_orderkey, {_sql(MODES, 'o_orderkey')} AS m, o_orderkey % 2 = 0 AS live FROM orders), x AS (SELECT o_orderkey, live, CASE WHEN m LIKE 'MODEL_READY%' AND (o_orderkey % 8 < 2 OR o_orderkey % 9 = 0) THEN 'MARKET_ANCHORED_NOT_ACTIONABLE' ELSE m END AS mode FROM a) SELECT o_orderkey, mode, mode LIKE 'MODEL_READY%' AS model, mode LIKE 'MODEL_READY%' OR mode LIKE 'MARKET%' AS reference, mode LIKE 'MODEL_READY%' AND live AS live_market, mode = 'MODEL_READY' AND live AS fair_odds, mode = 'MODEL_READY' AND live AS edge, mode = 'MODEL_READY' AND live AS tags, mode = 'MODEL_READY' AND live AS stakes, mode LIKE 'MODEL_READY%' AS scoring FROM x"


def l11_model_choice(spark, d):
    """Customers ask for their segment's model; orders are models, one priority's being the pooled ones."""
    models = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.when(F.col("o_custkey") % 3 == 0, "pooled").when(F.col("o_custkey") % 3 == 1, "BUILDING").otherwise("MACHINERY").alias("segment"), F.date_format("o_orderdate", "yyyyMMdd").alias("version"))
    return k.chosen_models(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), models, "segment", "version")


L11 = "WITH m AS (SELECT CASE o_custkey % 3 WHEN 0 THEN 'pooled' WHEN 1 THEN 'BUILDING' ELSE 'MACHINERY' END AS s, max(strftime(o_orderdate, '%Y%m%d')) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT c_custkey, c_mktsegment AS segment, CASE WHEN m.v IS NOT NULL THEN m.s WHEN g.v IS NOT NULL THEN 'pooled' END AS model_segment, coalesce(m.v, g.v) AS model_version FROM customer LEFT JOIN m ON m.s = c_mktsegment LEFT JOIN m AS g ON g.s = 'pooled'"


def q14_views(spark, d):
    """Two views of each line, the second without some lines and with other flags, statuses and nulls."""
    one = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.when(F.col("l_linenumber") > 2, F.col("l_suppkey")).alias("evidence"))
    n = F.col("l_orderkey") + F.col("l_linenumber")
    other = one.where(n % 13 != 0).select("l_orderkey", "l_linenumber", F.when(n % 5 == 0, "X").otherwise(F.col("l_returnflag")).alias("l_returnflag"), "l_linestatus", F.when(n % 7 != 0, F.col("evidence")).alias("evidence"))
    # A line number can repeat in an order: only lines told by both are compared.
    once = lambda df: df.groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_returnflag", "l_linestatus", "evidence")])
    return k.view_mismatches(once(one), once(other), ["l_orderkey", "l_linenumber"], ["l_returnflag", "l_linestatus", "evidence"]).withColumn("fields", F.array_join("fields", ","))


Q14 = "WITH a AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS f, min(l_linestatus) AS s, min(CASE WHEN l_linenumber > 2 THEN l_suppkey END) AS e, l_orderkey + l_linenumber AS n FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN n % 5 = 0 AND f <> 'X' THEN 'l_returnflag' END, CASE WHEN n % 7 = 0 AND e IS NOT NULL THEN 'evidence' END) AS fields FROM a WHERE n % 13 <> 0 AND ((n % 5 = 0 AND f <> 'X') OR (n % 7 = 0 AND e IS NOT NULL))"

def s22_fuzzy_names(spark, d):
    """History rows come under typed names: some lack their last character, some have a wrong one. All customers are one block."""
    from cohortcast.operators.joins import best_match

    c = table(spark, d, "customer").select(F.lit(1).alias("block"), "c_custkey", "c_name")
    typed = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.substring("c_name", 1, 12), F.lit("x"), F.expr("substring(c_name, 14)"))).when(F.col("c_custkey") % 3 == 1, F.expr("substring(c_name, 1, length(c_name) - 1)")).otherwise(F.lower("c_name"))
    got = best_match(c.select("block", F.col("c_custkey").alias("row"), typed.alias("typed")), c, "block", "typed", "c_name", "c_custkey")
    return got.select("row", "match_id", "match_type", F.round("match_score", 6).alias("match_score"))


S22F = """WITH c AS (SELECT c_custkey, regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') AS k, regexp_replace(upper(CASE c_custkey % 3 WHEN 0 THEN substr(c_name, 1, 12) || 'x' || substr(c_name, 14) WHEN 1 THEN substr(c_name, 1, length(c_name) - 1) ELSE c_name END), '[^A-Z0-9]', '', 'g') AS t FROM customer),
e AS (SELECT k, min(c_custkey) AS id FROM c GROUP BY 1 HAVING count(*) = 1), x AS (SELECT c.c_custkey AS row, t, e.id FROM c LEFT JOIN e ON e.k = c.t),
s AS (SELECT x.t, b.c_custkey AS id, 1 - levenshtein(x.t, b.k) / greatest(length(x.t), length(b.k)) AS sim FROM (SELECT DISTINCT t FROM x WHERE id IS NULL) x, c b),
f AS (SELECT t, min(id) AS fid, count(DISTINCT id) AS n, max(sim) AS sim FROM (SELECT *, max(sim) OVER (PARTITION BY t) AS best FROM s WHERE sim >= 0.72) WHERE sim = best GROUP BY 1)
SELECT row, CASE WHEN id IS NOT NULL THEN id WHEN n = 1 THEN fid END AS match_id, CASE WHEN id IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'fuzzy' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS match_type, round(CASE WHEN id IS NOT NULL THEN 1 ELSE sim END, 6) AS match_score FROM x LEFT JOIN f USING (t)"""


def j30_names(spark, d):
    """A preview of results by name: suppliers are members of their nation, and every fourth result has a wrong digit; what would match how, by nation."""
    from cohortcast.operators.joins import best_match

    m = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name")
    typed = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.expr("substring(s_name, 1, length(s_name) - 1)"), F.lit("z"))).when(F.col("s_suppkey") % 4 == 1, F.reverse("s_name")).otherwise(F.upper("s_name"))
    got = best_match(m.select("s_nationkey", typed.alias("typed")), m, "s_nationkey", "typed", "s_name", "s_suppkey")
    return got.groupBy("s_nationkey", "match_type").agg(F.count("*").alias("results"), F.count("match_id").alias("matched"))


J30N = """WITH c AS (SELECT s_nationkey AS b, s_suppkey AS i, regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g') AS k, regexp_replace(upper(CASE s_suppkey % 4 WHEN 0 THEN substr(s_name, 1, length(s_name) - 1) || 'z' WHEN 1 THEN reverse(s_name) ELSE s_name END), '[^A-Z0-9]', '', 'g') AS t FROM supplier),
e AS (SELECT b, k, min(i) AS id FROM c GROUP BY 1, 2 HAVING count(*) = 1), x AS (SELECT c.b, t, e.id FROM c LEFT JOIN e ON e.b = c.b AND e.k = c.t),
s AS (SELECT x.b, x.t, c.i, 1 - levenshtein(x.t, c.k) / greatest(length(x.t), length(c.k)) AS sim FROM (SELECT DISTINCT b, t FROM x WHERE id IS NULL) x JOIN c ON c.b = x.b),
f AS (SELECT b, t, min(i) AS fid, count(DISTINCT i) AS n FROM (SELECT *, max(sim) OVER (PARTITION BY b, t) AS best FROM s WHERE sim >= 0.72) WHERE sim = best GROUP BY 1, 2)
SELECT x.b AS s_nationkey, CASE WHEN id IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'fuzzy' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS match_type, count(*) AS results, count(CASE WHEN id IS NOT NULL THEN id WHEN n = 1 THEN fid END) AS matched FROM x LEFT JOIN f ON f.b = x.b AND f.t = x.t GROUP BY 1, 2"""


def s22_history(spark, d):
    """Customers' orders as history rows by name; some names are of nobody, a segment isn't on the card, older orders are stored."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), "c_mktsegment")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("date").alias("day"))
    parsed = o.join(c, "c_custkey").select(F.when(F.col("o_orderkey") % 9 == 0, F.concat("name", F.lit("x"))).when(F.col("o_orderkey") % 2 == 0, F.upper("name")).otherwise(F.col("name")).alias("name"), "day", "o_orderkey")
    got = k.history_status(parsed, c, c.where("c_mktsegment <> 'BUILDING'"), o.where("o_orderkey % 4 = 0"), "name", "c_custkey", "day")
    return got.select("o_orderkey", "c_custkey", "day", "status")


S22 = """WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN c_custkey END AS id, c_mktsegment AS seg, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS name FROM orders JOIN customer ON o_custkey = c_custkey),
h AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 4 = 0),
s AS (SELECT p.*, CASE WHEN id IS NULL THEN 'UNMATCHED' WHEN seg = 'BUILDING' THEN 'NOT_ON_CARD' WHEN h.day IS NOT NULL THEN 'DUPLICATE' END AS status FROM p LEFT JOIN h ON h.o_custkey = id AND h.day = p.day)
SELECT o_orderkey, id AS c_custkey, day, coalesce(status, CASE WHEN row_number() OVER (PARTITION BY id, day, status ORDER BY name, o_orderkey) = 1 THEN 'INSERTED' ELSE 'DUPLICATE' END) AS status FROM s"""


def l09_registry(spark, d):
    """Models by customer and priority: stored are odd orders' newest, arriving the even ones' prices. Ids of new keys are shown as null."""
    o = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority")
    even = F.col("o_orderkey") % 2 == 0
    both = o.agg(F.max(F.when(~even, F.col("o_orderkey"))).alias("model_id"), F.max(F.when(~even, F.col("o_totalprice"))).alias("old"), F.max(F.when(even, F.col("o_totalprice"))).alias("new"))
    stored = both.where("model_id IS NOT NULL").select("o_custkey", "o_orderpriority", "model_id", F.col("old").alias("metric"))
    arriving = both.where("new IS NOT NULL").select("o_custkey", "o_orderpriority", F.col("new").alias("metric"))
    return k.upserted(stored, arriving, ["o_custkey", "o_orderpriority"], "model_id").withColumn("model_id", F.when(F.col("action") != "inserted", F.col("model_id")))


L09 = "WITH b AS (SELECT o_custkey, o_orderpriority, max(o_orderkey) FILTER (o_orderkey % 2 = 1) AS model_id, max(o_totalprice) FILTER (o_orderkey % 2 = 1) AS old, max(o_totalprice) FILTER (o_orderkey % 2 = 0) AS new FROM orders GROUP BY 1, 2) SELECT o_custkey, o_orderpriority, model_id, coalesce(new, old) AS metric, CASE WHEN new IS NULL THEN 'kept' WHEN model_id IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM b"


def q15_providers(spark, d):
    """Orders as keys; the second provider lacks some, differs in some, and is late or undated in some."""
    n = F.col("o_orderkey")
    o = table(spark, d, "orders").withColumn("cutoff", F.lit(5))
    one = o.select("o_orderkey", "cutoff", F.when(n % 3 != 0, n % 10).alias("as_of"), F.when(n % 4 != 0, F.col("o_orderpriority")).alias("class"), F.when(n % 5 != 0, F.col("o_orderstatus")).alias("style"))
    two = o.where(n % 7 != 0).select("o_orderkey", (n % 6).alias("as_of"), F.when(n % 2 == 0, F.col("o_orderpriority")).alias("class"), F.when(n % 11 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("style"))
    return k.provider_coverage(one, two, "o_orderkey", ["class", "style"], "as_of", "cutoff")


Q15 = """WITH o AS (SELECT o_orderkey AS n, o_orderpriority AS p, o_orderstatus AS s, coalesce(n % 3 <> 0 AND n % 10 < 5, false) AS ok1, n % 7 <> 0 AND n % 6 < 5 AS ok2, n % 7 <> 0 AS there FROM orders),
c AS (SELECT 'class' AS feature, CASE WHEN n % 4 <> 0 THEN p END AS a, CASE WHEN there AND n % 2 = 0 THEN p END AS b, ok1, ok2 FROM o UNION ALL SELECT 'style', CASE WHEN n % 5 <> 0 THEN s END, CASE WHEN there THEN CASE WHEN n % 11 = 0 THEN 'Z' ELSE s END END, ok1, ok2 FROM o)
SELECT feature, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS "both", count(*) FILTER (a <> b) AS conflicts, count(*) FILTER (a IS NOT NULL AND b IS NULL) AS only_first, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS only_second, count(*) FILTER (a IS NULL AND b IS NULL) AS neither, count(*) FILTER (coalesce(a, b) IS NOT NULL AND NOT ((a IS NOT NULL AND ok1) OR (b IS NOT NULL AND ok2))) AS unproven FROM c GROUP BY 1"""

def s04_new_groups(spark, d):
    """Orders as a feed of groups by customer and month; the fulfilled ones' groups are known."""
    o = table(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderstatus")
    return k.created_groups(o, o.where("o_orderstatus = 'F'"), ["o_custkey", "month"])


S04 = "SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, NOT bool_or(o_orderstatus = 'F') AS created FROM orders GROUP BY 1, 2"


def s18_prediction_log(spark, d):
    """What a log takes of all lines by day, where those of small numbers are logged: an entry of a card once."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day"))
    return new_rows(lines.where("l_linenumber < 4"), lines, ["l_orderkey", "l_partkey", "day"]).groupBy("day").agg(F.count("*").alias("appended"))


S18 = "WITH l AS (SELECT l_orderkey, l_partkey, CAST(l_shipdate AS DATE) AS day, min(l_linenumber) AS least FROM lineitem GROUP BY 1, 2, 3) SELECT day, count(*) AS appended FROM l WHERE least >= 4 GROUP BY 1"

QUERIES = {
    "s03_odds_feed": (s03_odds_feed, S03),
    "s05_outcome_log": (s05_outcome_log, S05),
    "q05_stewards": (q05_stewards, Q05),
    "p23_contract": (p23_contract, P23),
    "l11_model_choice": (l11_model_choice, L11),
    "q14_views": (q14_views, Q14),
    "s22_history": (s22_history, S22),
    "s22_fuzzy_names": (s22_fuzzy_names, S22F),
    "j30_names": (j30_names, J30N),
    "l09_registry": (l09_registry, L09),
    "q15_providers": (q15_providers, Q15),
    "s04_new_groups": (s04_new_groups, S04),
    "s18_prediction_log": (s18_prediction_log, S18),
}
