"""Queries of gates and contracts: chaos, promotion, contracts by family, outcomes, edits, appends, lookups, styles and surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortcast.operators import gates as g
from cohortcast.operators import members as m
from cohortcast.queries.frames import DATED, FIELD, dated, field, parts_of, table, with_sql
from cohortcast.queries.members import STYLED, _case, _then, styled
from cohortcast.sources.sinks import without

COMMENTS = ["Set pace, led clear", "Pressed, vied inside", "tracked; well  placed", "rallied, ran on late", "chased pace then chased", None, "no factor", "Quick lead, dueled", "gained belatedly", "settled close, pulled"]
GROUNDS = ["on turf", "on Dirt", "muddy", "Tapeta", "all-weather turf", "unknown"]
SIRES = [*g.SIRE_ROUTE, " Tapit ", "nobody", None]
FAMILIES = ["BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD"]


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _listed(values: list) -> str:
    return "[" + ", ".join(map(_quoted, values)) + "]"


def _nth(values: list, k):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (k % len(values) + 1).cast("int"))


def x02_form(spark, d):
    c = F.col
    placed = m.rate(F.least(c("starts"), c("wins") + 1), c("starts"))
    return styled(spark, d).select("card", "member", g.finish_energy(c("style"), c("finish")).alias("finish_energy"), g.form_cycle(placed, c("finish")).alias("form_cycle"))


X02 = _then(STYLED, "x AS (SELECT *, CASE WHEN starts > 0 THEN round(least(starts, wins + 1) / starts, 4) END AS placed FROM styled)", f"SELECT card, member, round(0.5 * (1 - {_case('style', m.EARLY)}) + 0.5 * greatest(0, least(1, 1 - (finish - 1) / 19)), 4) AS finish_energy, round(0.6 * placed + 0.4 * greatest(0, least(1, 1 - (finish - 1) / 10)), 4) AS form_cycle FROM x")


def x09_sire(spark, d):
    return field(spark, d).select("card", "member", g.sire_route(_nth(SIRES, F.col("member"))).alias("sire_route"))


X09 = _then(FIELD, f"x AS (SELECT card, member, lower(trim({_listed(SIRES)}[member % {len(SIRES)} + 1])) AS sire FROM field)", "SELECT card, member, CAST(CASE sire " + " ".join(f"WHEN {_quoted(k)} THEN {v}" for k, v in g.SIRE_ROUTE.items()) + f" ELSE {g.OTHER_SIRE} END AS DOUBLE) AS sire_route FROM x")


def f09_styles(spark, d):
    said = table(spark, d, "lineitem").select(F.col("l_partkey").alias("member"), _nth(COMMENTS, F.col("l_quantity").cast("long")).alias("comment"))
    return g.comment_styles(said, "member", "comment")


F09 = (
    f"WITH c AS (SELECT l_partkey AS member, {_listed(COMMENTS)}[CAST(l_quantity AS BIGINT) % {len(COMMENTS)} + 1] AS comment FROM lineitem), s AS (SELECT member, "
    + ", ".join(f"CAST(sum(coalesce(len(regexp_extract_all(comment, {_quoted(terms)})), 0)) AS BIGINT) AS {s}" for s, terms in g.STYLE_TERMS.items())
    + " FROM c GROUP BY 1), b AS (SELECT *, greatest(front, presser, stalker, closer) AS terms FROM s) SELECT member, CASE WHEN terms = 0 THEN NULL WHEN front = terms THEN 'front' WHEN presser = terms THEN 'presser' WHEN stalker = terms THEN 'stalker' ELSE 'closer' END AS style, terms FROM b"
)


def f20_surface(spark, d):
    return table(spark, d, "part").select("p_partkey", g.surface_of(F.concat_ws(" ", "p_name", _nth(GROUNDS, F.col("p_size")))).alias("surface"))


F20 = f"WITH x AS (SELECT p_partkey, lower(p_name || ' ' || {_listed(GROUNDS)}[p_size % {len(GROUNDS)} + 1]) AS t FROM part) SELECT p_partkey, CASE WHEN t LIKE '%turf%' THEN 'turf' WHEN t LIKE '%dirt%' OR t LIKE '%mud%' THEN 'dirt' WHEN t LIKE '%tapeta%' OR t LIKE '%polytrack%' OR t LIKE '%synthetic%' OR t LIKE '%all weather%' OR t LIKE '%all-weather%' THEN 'all_weather' END AS surface FROM x"


def p21_inventory(spark, d):
    return g.availability(styled(spark, d), "surface", {c: F.col(c).isNotNull() for c in ("style", "works", "gate", "layoff", "post")} | {"sire": F.lit(False)})


P21 = _then(STYLED, "x AS (SELECT surface, unnest(['style', 'works', 'gate', 'layoff', 'post', 'sire']) AS field, unnest([style IS NOT NULL, works IS NOT NULL, gate IS NOT NULL, layoff IS NOT NULL, post IS NOT NULL, false]) AS has FROM styled)", "SELECT surface, field, CASE WHEN bool_and(has) THEN 'Available' WHEN bool_or(has) THEN 'Partial' ELSE 'Missing' END AS class, CAST(floor(100 * count(*) FILTER (has) / count(*) + 0.5) AS BIGINT) AS percent FROM x GROUP BY 1, 2")


def m09_chaos(spark, d):
    c = F.col
    f = styled(spark, d).withColumns({"market": 1 / c("decimal"), "furlongs": 6.0 + c("card") % 5})
    out = g.chaos(f, "card", "member", "p", "market", "style", "furlongs", F.round(4 * c("decimal"), 2), c("rate"), c("layoff"), F.when(c("jockey") % 4 == 0, "underlay"))
    return out.select("card", "member", "entropy", "intensity", "active", "eligible", "boost", "tier", "adjusted_p")


M09 = _then(STYLED, """a AS (SELECT card, member, p, style, 6 + card % 5 AS fur, round(4 * decimal, 2) AS price, coalesce(rate, 0) AS career, coalesce(layoff, 0) AS lay, jockey % 4 = 0 AS under, (1 / decimal) / sum(1 / decimal) OVER (PARTITION BY card) AS q, n FROM styled),
b AS (SELECT *, CASE WHEN n <= 1 THEN 0.0 ELSE greatest(0.0, least(1.0, -sum(q * log2(q)) OVER w / log2(n))) END AS h, count(*) FILTER (style = 'front') OVER w AS fr, stddev_pop(q) OVER w AS sd, max(q) OVER w AS mq FROM a WINDOW w AS (PARTITION BY card)),
c AS (SELECT *, h >= 0.72 AS active, round(h + 1e-9, 4) AS entropy, round(greatest(0.0, least(1.0, h + 0.3 * (fr = 0 OR fr >= CASE WHEN fur < 8.5 THEN 3 ELSE 4 END)::INT + 0.2 * (sd < 0.04 AND n >= 8)::INT + 0.2 * (1 - mq))) + 1e-9, 4) AS intensity FROM b),
e AS (SELECT *, active AND price >= 15 AND career > 0 AND NOT under AND lay <= 45 AS eligible, CASE WHEN active AND price >= 15 AND career > 0 AND NOT under AND lay <= 45 THEN exp(1 / least(price, 1000)) END AS x FROM c),
f AS (SELECT *, coalesce(round(intensity * round(x / sum(x) OVER (PARTITION BY card) + 1e-9, 4) * 0.06 + 1e-9, 5), 0) AS boost, row_number() OVER (PARTITION BY card ORDER BY p DESC, member DESC) AS nth FROM e),
g AS (SELECT *, sum(boost) OVER (PARTITION BY card) AS total, sum(p) FILTER (nth <= 3) OVER (PARTITION BY card) AS top FROM f),
h AS (SELECT *, boost + CASE WHEN nth <= 3 THEN greatest(0.001, p - total * p / top) ELSE p END AS rawp FROM g)""", "SELECT card, member, entropy, intensity, active, eligible, boost, CASE WHEN boost <= 0 THEN 'NONE' WHEN boost < 0.005 THEN 'LOW' WHEN boost < 0.015 THEN 'MEDIUM' ELSE 'HIGH' END AS tier, round(CASE WHEN total > 0 THEN rawp / sum(rawp) OVER (PARTITION BY card) ELSE p END, 6) AS adjusted_p FROM h")


def l08_dispatch(spark, d):
    """Families are classes of cards; odd owners' ones are split further, so that some are too thin."""
    c = F.col
    f = dated(spark, d).withColumns({"family": F.when(c("owner") % 2 == 0, c("class")).otherwise(F.concat_ws(" ", "class", (c("owner") % 50).cast("string"))), "won": (c("finish") == 1).cast("double")})
    miss = lambda p: F.avg(F.pow(F.col(p) - F.col("won"), F.lit(2)))
    log = lambda p: F.avg(F.when(c("won") == 1, -F.log(p)))
    big = lambda p: F.avg(F.when(c("n") >= 5, F.pow(F.col(p) - F.col("won"), F.lit(2))))
    by = f.groupBy("family").agg(F.count_if(c("finish") == 1).alias("completed"), F.count("*").alias("starters"), F.size(F.collect_set(F.date_format("day", "yyyy-MM"))).alias("folds"), (F.count_if(c("jockey") % 7 != 0) / F.count("*")).alias("coverage"), F.bool_and(c("n") >= 1).alias("groups_ok"), F.bool_and(c("owner") % 50 != 7).alias("no_leak"), g.gain(miss("p"), miss("m")).alias("brier_gain"), g.gain(log("p"), log("m")).alias("log_gain"), (F.abs(F.avg("m") - F.avg("won")) <= 0.05).alias("calibrated"), F.coalesce(g.gain(big("p"), big("m")) >= -0.02, F.lit(True)).alias("sizes_ok"))
    judged = g.promotion(by.withColumns({"labels_ok": F.lit(True), "registered": ~c("family").startswith("5"), "family_ok": ~c("family").startswith("4")}))
    return judged.select("family", "completed", "starters", F.col("folds").cast("long").alias("folds"), F.round("coverage", 6).alias("coverage"), "mode", F.array_join("reasons", ",").alias("reasons"))


L08 = _then(DATED, """f AS (SELECT *, CASE WHEN owner % 2 = 0 THEN class ELSE class || ' ' || owner % 50 END AS family, (finish = 1)::INT AS won FROM dated),
s AS (SELECT family, count(*) FILTER (finish = 1) AS completed, count(*) AS starters, count(DISTINCT strftime(day, '%Y-%m')) AS folds, count(*) FILTER (jockey % 7 <> 0) / count(*) AS coverage, bool_and(owner % 50 <> 7) AS no_leak, avg((p - won) ** 2) AS b, avg((m - won) ** 2) AS k, avg(-ln(p)) FILTER (won = 1) AS lb, avg(-ln(m)) FILTER (won = 1) AS lk, avg((p - won) ** 2) FILTER (n >= 5) AS gb, avg((m - won) ** 2) FILTER (n >= 5) AS gk, abs(avg(m) - avg(won)) <= 0.05 AS cal FROM f GROUP BY 1),
e AS (SELECT *, concat_ws(',', CASE WHEN completed < 500 THEN 'insufficient_completed_races' END, CASE WHEN starters < 4000 THEN 'insufficient_labeled_starters' END, CASE WHEN coverage < 0.8 THEN 'insufficient_feature_coverage' END, CASE WHEN folds < 12 THEN 'insufficient_rolling_folds' END, CASE WHEN NOT no_leak THEN 'leakage_check_failed' END) AS early FROM s),
w AS (SELECT *, CASE WHEN early <> '' THEN early ELSE concat_ws(',', CASE WHEN NOT coalesce(b > 0 AND lb > 0 AND (b - k) / b >= 0.02 AND (lb - lk) / lb >= 0.01, false) THEN 'oof_baseline_not_beaten' END, CASE WHEN NOT cal THEN 'calibration_failed' END, CASE WHEN coalesce((gb - gk) / gb < -0.02, false) THEN 'field_size_regression' END, CASE WHEN family LIKE '5%' THEN 'artifact_registration_incomplete' END, CASE WHEN family LIKE '4%' THEN 'artifact_family_mismatch' END) END AS why FROM e),
o AS (SELECT *, CASE WHEN why = '' THEN 'promoted' WHEN completed >= 20 AND starters >= 100 AND coverage >= 0.5 AND no_leak THEN 'shadow' ELSE 'baseline' END AS mode FROM w)""", "SELECT family, completed, starters, folds, round(coverage, 6) AS coverage, mode, CASE mode WHEN 'promoted' THEN 'promoted' WHEN 'shadow' THEN why || ',shadow_only' ELSE why END AS reasons FROM o")


def a38_contracts(spark, d):
    """Orders as registered models of their customers' segments; fulfilled ones ran, but for one segment."""
    models = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", "o_orderdate", "o_orderstatus")
    runs = models.where("o_orderstatus = 'F' AND c_mktsegment <> 'MACHINERY'")
    return g.contracts(models, runs, "c_mktsegment", "o_orderkey", "o_orderdate", {"FURNITURE": "BUILDING"}, FAMILIES)


A38 = f"WITH x AS (SELECT o_orderkey, CASE c_mktsegment WHEN 'FURNITURE' THEN 'BUILDING' ELSE c_mktsegment END AS c_mktsegment, o_orderstatus = 'F' AND c_mktsegment <> 'MACHINERY' AS from_run, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey), k AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY from_run DESC, CASE WHEN from_run THEN o_orderdate END DESC, o_orderkey DESC) AS nth FROM x WHERE c_mktsegment IN {tuple(FAMILIES)}) SELECT c_mktsegment, o_orderkey, from_run FROM k WHERE nth = 1"


def e17_populate(spark, d):
    f = field(spark, d).where("member % 13 <> 0").select("card", "member", F.col("finish").cast("long").alias("finish"))
    had = f.where("card % 4 IN (1, 2)").withColumn("finish", F.when((F.col("card") % 4 == 2) & (F.col("member") % 5 == 0), F.col("finish") + 1).otherwise(F.col("finish")))
    return g.outcome_status(f, had, f.where("card % 7 <> 0"), "card", "member", "finish")


E17 = _then(FIELD, "x AS (SELECT card, count(*) AS n, bool_or(member % 5 = 0) AS five FROM field WHERE member % 13 <> 0 GROUP BY 1), s AS (SELECT card, n, CASE WHEN card % 7 = 0 THEN 'NOT_MATCHED' WHEN card % 4 NOT IN (1, 2) THEN 'POPULATED' WHEN card % 4 = 2 AND five THEN 'EXISTING_DIFFERS' ELSE 'UNCHANGED' END AS status FROM x)", "SELECT card, status, CASE WHEN status = 'POPULATED' THEN n ELSE 0 END AS populated FROM s")


def s27_patch(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    k = F.col("o_orderkey")
    patch = o.where(k % 5 == 0).select("o_orderkey", F.when(k % 10 == 0, "9-NEW").alias("o_orderpriority"), F.when(k % 15 == 0, 0.0).alias("o_totalprice"))
    return g.patched(o, patch, ["o_orderkey"])


def s24_append(spark, d):
    blocks = table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("kind"), "l_linenumber", F.sha2(F.concat_ws("|", "l_partkey", F.col("l_quantity").cast("long")), 256).alias("sha"))
    return g.appended(blocks.where("l_linenumber < 4"), blocks, ["l_orderkey", "kind", "sha"]).groupBy("kind", "status").agg(F.count("*").alias("rows"))


S24 = "WITH b AS (SELECT l_orderkey, l_returnflag AS kind, l_linenumber, sha256(l_partkey || '|' || CAST(l_quantity AS BIGINT)) AS sha FROM lineitem), h AS (SELECT DISTINCT l_orderkey, kind, sha, true AS had FROM b WHERE l_linenumber < 4) SELECT kind, CASE WHEN had THEN 'unchanged' ELSE 'new' END AS status, count(*) AS rows FROM b LEFT JOIN h USING (l_orderkey, kind, sha) GROUP BY 1, 2"


def s19_scoped_delete(spark, d):
    """Lines left by status after the lines of partly filled orders are deleted."""
    scope = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return without(table(spark, d, "lineitem").select("l_orderkey", "l_linestatus"), scope, ["l_orderkey"]).groupBy("l_linestatus").agg(F.count("*").alias("rows"))


def s26_template(spark, d):
    """The active members of each card with blank prices, as a form to fill."""
    blank = lambda name: F.lit(None).cast("string").alias(name)
    return field(spark, d).where("member % 13 <> 0").select("card", "post", "member", blank("odds_decimal"), blank("odds_american"), blank("book"))


def j22_find_card(spark, d):
    """Cards by track, day and number; asked by a track's name, by its code, or by no known one."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")), "c_nationkey")  # a nation table has a fixed bound
    k, code = F.col("o_orderkey"), F.concat(F.lit("T"), F.col("c_nationkey").cast("string"))
    cards = o.select(code.alias("code"), F.col("o_orderdate").cast("date").alias("day"), (k % 12).alias("number"), k.alias("card"))
    raw = F.when(k % 3 == 0, F.concat(F.lit(" "), F.lower("n_name"), F.lit(" "))).when(k % 3 == 1, F.lower(code)).otherwise("nowhere")
    asked = o.select("o_orderkey", raw.alias("raw"), F.col("o_orderdate").cast("date").alias("day"), F.when(k % 11 == 0, F.lit(99)).otherwise(k % 12).cast("long").alias("number"))
    aliases = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("code"))
    return g.found_card(asked, cards, aliases, ["code", "day", "number"], "card").select("o_orderkey", "card")


J22 = "WITH o AS (SELECT o_orderkey AS k, 'T' || c_nationkey AS code, CAST(o_orderdate AS DATE) AS day FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), c AS (SELECT code, day, k % 12 AS number, min(k) AS card FROM o GROUP BY 1, 2, 3) SELECT k AS o_orderkey, card FROM o LEFT JOIN c ON c.code = o.code AND c.day = o.day AND number = k % 12 AND k % 3 < 2 AND k % 11 <> 0"

def q16_manifests(spark, d):
    """Each order's manifest as JSON, with faults by its number: times without zone or after the post, counts, states, unreadable texts."""
    from cohortcast.operators.manifests import judge_manifests

    k = F.col("o_orderkey")
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    text = lambda x: F.lit(x)
    fields = {
        "artifact_path_or_uri": F.concat(text("/raw/"), k), "sha256": F.sha2(k.cast("string").cast("binary"), 256), "source_provider": text("p"), "parser_version": text("1"),
        "source_as_of_timestamp": F.when(k % 11 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 11 == 1, at).otherwise(F.concat(at, text("+00:00"))), "source_as_of_tier": F.when(k % 3 == 0, "OPERATOR_ATTESTED").otherwise("PROVEN"),
        "source_as_of_provenance": F.when(k % 5 == 0, "FILENAME_DERIVED").otherwise("PUBLISHER_TIMESTAMP"), "target_track_code": text("CD"), "target_race_date": F.date_format("o_orderdate", "yyyy-MM-dd"), "target_race_number": F.lit(1),
        "target_scheduled_post_timestamp": F.concat(F.date_format(F.expr("CAST(o_orderdate AS timestamp_ntz) + make_dt_interval(0, CAST(o_orderkey % 7 - 1 AS int))"), "yyyy-MM-dd'T'HH:mm:ss"), text("Z")), "target_surface": text("dirt"), "target_distance_furlongs": F.lit(6.5),
        "expected_active_starter_count": (k % 13).cast("int"), "observed_active_starter_count": (k % 13).cast("int") + (k % 17 == 0).cast("int"), "identity_reconciliation_status": F.when(k % 19 == 0, "INCOMPLETE").otherwise("COMPLETE"),
        "field_completeness_status": text("COMPLETE"), "feature_vector_status": text("COMPLETE"), "raw_artifact_retained": k % 23 != 0, "pre_race_fields_only": F.lit(True),
        "outcome_reference": F.struct(text("x").alias("path_or_uri"), F.sha2(text("x"), 256).alias("sha256"), text("p").alias("source_provider"), text("1").alias("parser_version")), "outcome_provenance_status": text("PROVEN"),
    }
    json = F.when(k % 29 == 0, "{").otherwise(F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()])))
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    orders = orders.repartition(parts_of(spark, orders.count()) or spark.sparkContext.defaultParallelism, "o_orderkey")  # judging a text costs much more than its row's shuffle, and a file's splits are few and uneven
    got = judge_manifests(orders.select("o_orderkey", json.alias("manifest")), "manifest")
    return got.select("o_orderkey", F.array_join("codes", ";").alias("codes"), "passed")


Q16 = """WITH c AS (SELECT o_orderkey, o_orderkey AS k, o_orderkey % 29 = 0 AS bad, o_orderkey % 11 = 0 OR o_orderkey % 11 = 1 OR o_orderkey % 13 < 2 AS broken FROM orders),
j AS (SELECT o_orderkey, CASE WHEN bad THEN 'MANIFEST_JSON_UNREADABLE' ELSE concat_ws(';', CASE WHEN broken THEN 'MANIFEST_SCHEMA_INVALID' END, CASE WHEN k % 11 = 0 THEN 'SOURCE_AS_OF_TIMESTAMP_DATE_ONLY' WHEN k % 11 = 1 THEN 'SOURCE_AS_OF_TIMESTAMP_INVALID_OR_TIMEZONE_MISSING' WHEN k % 7 < 2 THEN 'SOURCE_AS_OF_NOT_STRICTLY_BEFORE_TARGET_POST' END,
  CASE WHEN k % 5 = 0 AND k % 3 > 0 THEN 'FILENAME_DERIVED_CANNOT_CLAIM_PROVEN' END, CASE WHEN k % 13 < 2 THEN 'ACTIVE_STARTER_COUNT_INSUFFICIENT' END, CASE WHEN k % 19 = 0 THEN 'IDENTITY_RECONCILIATION_INCOMPLETE' END, CASE WHEN k % 17 = 0 THEN 'PARTIAL_STARTER_FIELD' END, CASE WHEN k % 23 = 0 THEN 'RAW_ARTIFACT_NOT_RETAINED' END) END AS codes FROM c)
SELECT o_orderkey, codes, codes = '' AS passed FROM j"""


QUERIES = {
    "q16_manifests": (q16_manifests, Q16),
    "x02_form": (x02_form, X02),
    "x09_sire": (x09_sire, X09),
    "f09_styles": (f09_styles, F09),
    "f20_surface": (f20_surface, F20),
    "p21_inventory": (p21_inventory, P21),
    "m09_chaos": (m09_chaos, M09),
    "l08_dispatch": (l08_dispatch, L08),
    "a38_contracts": (a38_contracts, A38),
    "e17_populate": (e17_populate, E17),
    "s27_patch": (s27_patch, "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '9-NEW' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey % 15 = 0 THEN 0 ELSE o_totalprice END AS o_totalprice, (o_orderkey % 10 = 0 AND o_orderpriority <> '9-NEW')::INT + (o_orderkey % 15 = 0 AND o_totalprice <> 0)::INT AS n_changed FROM orders"),
    "s24_append": (s24_append, S24),
    "s19_scoped_delete": (s19_scoped_delete, "SELECT l_linestatus, count(*) AS rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1"),
    "s26_template": (s26_template, with_sql(FIELD, "SELECT card, post, member, CAST(NULL AS VARCHAR) AS odds_decimal, CAST(NULL AS VARCHAR) AS odds_american, CAST(NULL AS VARCHAR) AS book FROM field WHERE member % 13 <> 0")),
    "j22_find_card": (j22_find_card, J22),
}
