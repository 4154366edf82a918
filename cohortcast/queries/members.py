"""Queries over members and their fields: career measures, readiness, fits, publicness, race shape, confidence, market edges, rules and selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortcast.operators import members as m
from cohortcast.operators.joins import harville
from cohortcast.queries.frames import DATED, FIELD, dated, field, table, with_sql

r = lambda c, k=6: F.round(c, k).alias(c)
STYLES = list(m.EARLY)


def _then(frame: str, ctes: str, body: str) -> str:
    return f"WITH {frame.strip()},\n{ctes}\n{body}"


def _case(x: str, values: dict, other: str = "NULL") -> str:
    return f"CASE {x} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in values.items()) + f" ELSE {other} END"


def styled(spark, d):
    """The field with a running style (null for some), works, gate, layoff, starts, wins and a career rate."""
    f = field(spark, d)
    style = F.when(F.col("card") % 9 == 0, F.lit(None)).when(F.col("member") % 7 == 0, F.lit(None)).otherwise(F.element_at(F.array(*map(F.lit, STYLES)), (F.col("jockey") % 4 + 1).cast("int")))
    return f.withColumns({"style": style, "works": F.when(F.col("member") % 11 != 0, F.col("member") % 9), "gate": F.when(F.col("jockey") % 5 != 0, F.col("jockey") % 7), "layoff": F.when(F.col("member") % 13 != 0, F.col("jockey") % 100), "starts": F.col("member") % 5, "wins": F.least(F.col("member") % 5, F.col("jockey") % 3), "career": F.col("member") % 19, "rate": F.when(F.col("member") % 6 != 0, (F.col("member") % 6) / 20)})


STYLED = FIELD + """,
styled AS (SELECT *, CASE WHEN card % 9 = 0 OR member % 7 = 0 THEN NULL ELSE ['front', 'presser', 'stalker', 'closer'][jockey % 4 + 1] END AS style, CASE WHEN member % 11 <> 0 THEN member % 9 END AS works, CASE WHEN jockey % 5 <> 0 THEN jockey % 7 END AS gate,
  CASE WHEN member % 13 <> 0 THEN jockey % 100 END AS layoff, member % 5 AS starts, least(member % 5, jockey % 3) AS wins, member % 19 AS career, CASE WHEN member % 6 <> 0 THEN (member % 6) / 20 END AS rate FROM field)"""


def x04_career_rates(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("starts"), *[F.count(F.when(F.col("o_orderstatus") == s, 1)).alias(k) for s, k in (("F", "wins"), ("O", "seconds"), ("P", "thirds"))])
    return o.select("o_custkey", m.rate(F.col("wins"), F.col("starts")).alias("win_rate"), m.rate(F.col("wins") + F.col("seconds") + F.col("thirds"), F.col("starts")).alias("placed_rate"))


def x07_readiness(spark, d):
    c = F.col
    return styled(spark, d).select("card", "member", m.work_readiness(c("works"), c("gate")).alias("readiness"), m.intent(c("works"), c("layoff")).alias("intent"), F.round(m.clamp(c("gate") / 5.0), 4).alias("gate"), m.traffic(c("style"), c("rate")).alias("traffic"))


X07 = with_sql(STYLED, f"SELECT card, member, round(0.6 * least(1, works / 6.0) + 0.4 * least(1, gate / 5.0), 4) AS readiness, round(0.5 * least(1, works / 6.0) + 0.5 * CASE WHEN layoff IS NOT NULL THEN greatest(0, least(1, 1 - greatest(0, layoff - 14.0) / 56.0)) END, 4) AS intent, CASE WHEN gate IS NOT NULL THEN round(least(1, gate / 5.0), 4) END AS gate, round(0.5 * {_case('style', m.EARLY)} + 0.5 * coalesce(rate, 0.5), 4) AS traffic FROM styled".replace("0.6 * least(1, works / 6.0)", "0.6 * CASE WHEN works IS NOT NULL THEN least(1, works / 6.0) END").replace("0.5 * least(1, works / 6.0)", "0.5 * CASE WHEN works IS NOT NULL THEN least(1, works / 6.0) END").replace("0.4 * least(1, gate / 5.0)", "0.4 * CASE WHEN gate IS NOT NULL THEN least(1, gate / 5.0) END"))


def x08_fits(spark, d):
    c = F.col
    return styled(spark, d).select("card", "member", m.surface_fit(c("starts"), c("wins")).alias("surface_fit"), m.distance_fit(c("starts"), c("wins"), c("rate")).alias("distance_fit"))


def x10_publicness(spark, d):
    return m.publicness(styled(spark, d).withColumn("odds", F.round("decimal", 2)), "card", F.col("odds"), F.col("rate")).select("card", "member", "implied_p", "publicness", "underlay")


def x11_race_shape(spark, d):
    return m.race_shape(styled(spark, d), "card", "style").select("card", "member", "pressure", "band", "collapse", "lone_speed", "shape_fit", "shape_state")


_FIT = " ".join(f"WHEN style = '{s}' THEN {_case('band', row)}" for s, row in m.SHAPE_FIT.items())
X11 = _then(STYLED, f"""a AS (SELECT *, round(avg({_case('style', m.PRESSURE)}) OVER w + 1e-9, 4) AS pressure, count(style) OVER w AS classified, count(*) FILTER (style = 'front') OVER w AS fronts, count(*) FILTER (style = 'presser') OVER w AS pressers, count(*) OVER w AS active FROM styled WINDOW w AS (PARTITION BY card)),
b AS (SELECT *, CASE WHEN pressure < 0.40 THEN 'low' WHEN pressure < 0.65 THEN 'moderate' WHEN pressure IS NOT NULL THEN 'high' END AS band FROM a), c AS (SELECT *, CASE {_FIT} END AS fit FROM b),
e AS (SELECT *, len(list_distinct(list(fit) OVER (PARTITION BY card))) AS kinds FROM c),
g AS (SELECT *, CASE WHEN classified / active < 0.40 OR kinds <= 1 THEN 'UNAVAILABLE' WHEN classified / active >= 0.70 THEN 'READY' ELSE 'PARTIAL' END AS shape_state FROM e)""", "SELECT card, member, pressure, band, CASE WHEN classified > 0 THEN round((fronts + 0.5 * pressers) / classified + 1e-9, 4) END AS collapse, coalesce((style = 'front' AND fronts = 1)::INT, 0) AS lone_speed, CASE WHEN shape_state <> 'UNAVAILABLE' THEN fit END AS shape_fit, shape_state FROM g")

#: Weights of a composite: groups, their weights, and the weights of their features. A parameter of the queries.
WEIGHTS = [("form", 0.5, "qty", 0.7), ("form", 0.5, "price", 0.3), ("draw", 0.2, "post", 1.0), ("value", 0.3, "price", 0.4), ("value", 0.3, "m", 0.6)]


def m02_composite(spark, d):
    """Each feature as its share of the field's range, weighed within its group and by the group."""
    f, w = field(spark, d), Window.partitionBy("card")
    unit = lambda c: F.when(F.max(c).over(w) > F.min(c).over(w), (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w))).otherwise(0.5)
    return f.select("card", "member", m.rounded(sum((gw * fw * unit(c) for _, gw, c, fw in WEIGHTS), F.lit(0.0)), 6).alias("composite"))


_UNIT = "CASE WHEN max({c}) OVER w > min({c}) OVER w THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE 0.5 END"
M02 = with_sql(FIELD, "SELECT card, member, round(" + " + ".join(f"{gw}::DOUBLE * {fw}::DOUBLE * ({_UNIT.format(c=c)})" for _, gw, c, fw in WEIGHTS) + " + 1e-9, 6) AS composite FROM field WINDOW w AS (PARTITION BY card)")


def a39_importances(spark, d):
    """Effective weight of each feature over its groups, as shares, of the members that have the feature."""
    weights = spark.createDataFrame(WEIGHTS, "grp string, gw double, feature string, fw double")
    total = weights.groupBy("feature").agg(F.sum(F.col("gw") * F.col("fw")).alias("w"), F.sort_array(F.collect_set("grp")).alias("groups"))
    total = total.crossJoin(F.broadcast(total.agg(F.sum("w").alias("all"))))  # five rows and one
    long = field(spark, d).select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in ("qty", "price", "post", "m")])).alias("v")).select("v.*").groupBy("feature").agg(F.count("x").alias("members"))
    return long.join(F.broadcast(total), "feature").select("feature", F.array_join("groups", ",").alias("groups"), F.round(F.col("w") / F.col("all"), 4).alias("importance"), "members")


def m07_evidence_confidence(spark, d):
    c = F.col
    f = styled(spark, d).withColumns({"p": F.round("p", 9), "m": F.round("m", 9)})
    return m.evidence_confidence(f, "card", "p", "m", c("starts"), c("career"), c("works").isNull(), c("gate").isNotNull(), "member", c("card") % 9 == 0).select("card", "member", "confidence_score", "confidence")


M07 = _then(STYLED, """q AS (SELECT * REPLACE (round(p, 9) AS p, round(m, 9) AS m) FROM styled), k AS (SELECT *, row_number() OVER (PARTITION BY card ORDER BY p DESC, member) AS kp, row_number() OVER (PARTITION BY card ORDER BY m DESC, member) AS km FROM q),
s AS (SELECT card, member, 0.5 * CASE starts WHEN 0 THEN 0 WHEN 1 THEN 0.4 WHEN 2 THEN 0.7 WHEN 3 THEN 0.85 ELSE 1 END + 0.25 * least(career / 15.0, 1) + 0.25 * (works IS NOT NULL)::INT AS a, 0.5 * greatest(0, least(1, (n - 4) / 8.0)) + 0.5 * count(gate) OVER w / n AS b,
  0.45 * greatest(0, 1 + sum(p * ln(greatest(p, 1e-9))) OVER w / CASE WHEN n > 1 THEN ln(n) ELSE 1 END) + 0.35 * least((max(p) OVER w - coalesce(max(p) FILTER (kp = 2) OVER w, 0)) / 0.1, 1) + 0.2 * max((kp = 1 AND km = 1)::INT) OVER w AS c FROM k WINDOW w AS (PARTITION BY card))""",
  "SELECT card, member, round(x + 1e-9, 3) AS confidence_score, CASE WHEN x < 0.45 THEN 'LOW' WHEN x < 0.70 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM (SELECT *, greatest(0, 0.35 * round(a + 1e-9, 4) + 0.25 * round(b + 1e-9, 4) + 0.3 * round(c + 1e-9, 4) + 0.1 * 0.5 - CASE WHEN card % 9 = 0 THEN 0.05 ELSE 0 END) AS x FROM s)")


def m10_edges(spark, d):
    f = m.market_edges(field(spark, d).withColumn("decimal", F.round("decimal", 6)), "card", "p", "decimal")
    low = F.col("member") % 4 == 0
    blocked = low & (F.col("tag") == "bet")
    return f.select("card", "member", r("market_p"), "edge", "fair_odds", F.when(blocked, "neutral").otherwise(F.col("tag")).alias("tag"), F.coalesce(blocked, F.lit(False)).cast("int").alias("blocked"))


M10 = _then(FIELD, "a AS (SELECT card, member, p, round(decimal, 6) AS d FROM field), b AS (SELECT *, CASE WHEN min((coalesce(d > 1, false))::INT) OVER (PARTITION BY card) = 1 THEN 1 / d / sum(1 / d) OVER (PARTITION BY card) END AS q FROM a), e AS (SELECT *, round(round(p, 9) - round(q, 9), 4) AS edge FROM b), t AS (SELECT *, CASE WHEN edge >= 0.02 THEN 'bet' WHEN edge <= -0.02 THEN 'underlay' WHEN edge IS NOT NULL THEN 'neutral' END AS tag FROM e)", "SELECT card, member, round(q, 6) AS market_p, edge, round(1 / greatest(round(p, 9), 1e-9) - 1, 2) AS fair_odds, CASE WHEN member % 4 = 0 AND tag = 'bet' THEN 'neutral' ELSE tag END AS tag, coalesce(member % 4 = 0 AND tag = 'bet', false)::INT AS blocked FROM t")


def m12_market_only(spark, d):
    valid = F.when(F.round("decimal", 6) > 1, 1 / F.round("decimal", 6))
    return field(spark, d).select("card", "member", F.round(valid / F.sum(valid).over(Window.partitionBy("card")), 6).alias("p_market"))


def m06_place_show(spark, d):
    got = harville(field(spark, d).where("n >= 2"), "card", "member", "p")
    w = Window.partitionBy("card")
    return got.select("card", "member", F.round(F.least(F.col("place"), F.lit(1.0)), 5).alias("place"), F.when(F.count("*").over(w) == 2, 1.0).otherwise(F.round(F.least(F.col("show"), F.lit(1.0)), 5)).alias("show"))


M06 = _then(FIELD, """f AS (SELECT card, member, p, n FROM field WHERE n >= 2),
two AS (SELECT x.card, x.member, sum(y.p * x.p / (1 - y.p)) AS s FROM f x JOIN f y ON x.card = y.card AND x.member <> y.member GROUP BY 1, 2),
three AS (SELECT x.card, x.member, sum(y.p * z.p / (1 - y.p) * x.p / (1 - y.p - z.p)) AS s FROM f x JOIN f y ON x.card = y.card AND x.member <> y.member JOIN f z ON x.card = z.card AND z.member NOT IN (x.member, y.member) GROUP BY 1, 2)""", "SELECT f.card, f.member, round(least(1, p + two.s), 5) AS place, CASE WHEN n = 2 THEN 1 ELSE round(least(1, p + two.s + coalesce(three.s, 0)), 5) END AS show FROM f JOIN two USING (card, member) LEFT JOIN three USING (card, member)")


def k01_board(spark, d):
    w = Window.partitionBy("card").orderBy(F.round("p", 9).desc(), "member")
    return field(spark, d).select("card", "member", F.row_number().over(w).alias("place"), r("p")).orderBy("card", "place")


def k06_donors(spark, d):
    w = Window.partitionBy("card").orderBy(F.round("p", 9).desc(), "member")
    f = field(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 3")
    return f.groupBy("card").agg(F.count("*").alias("donors"), F.sum(F.round("p", 9).cast("decimal(18,9)")).cast("double").alias("given"))


def k07_unmatched_sample(spark, d):
    """The first ten customers without an event: the limit is the feature."""
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(table(spark, d, "events").select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_anti").distinct().orderBy("c_custkey").limit(10)


def u04_pick_hits(spark, d):
    w = Window.partitionBy("card").orderBy(F.round("p", 9).desc(), "member")
    f = field(spark, d).withColumn("k", F.row_number().over(w))
    return f.groupBy("card").agg(F.count(F.when((F.col("k") <= 3) & (F.col("finish") <= 3), 1)).alias("hits"))


def u05_distinct_meta(spark, d):
    return table(spark, d, "documents").select("lang", "source").dropDuplicates()


def j03_size_default(spark, d):
    """A card's stated size, or else the number of its members, counted once for all cards."""
    sizes = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.countDistinct("l_partkey").alias("members"))
    stated = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 12 + 4)
    return table(spark, d, "orders").join(sizes, "o_orderkey", "left").select("o_orderkey", F.coalesce(stated, "members", F.lit(0)).alias("size"))


def j28_training_rows(spark, d):
    f, o = dated(spark, d), table(spark, d, "supplier").select(F.col("s_suppkey").alias("jockey"), "s_nationkey")
    return f.join(o, "jockey").groupBy("s_nationkey").agg(F.count("*").alias("rows"), F.countDistinct("card").alias("cards"), F.count(F.when(F.col("finish") == 1, 1)).alias("won"))


def j29_members_of(spark, d):
    wanted = table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("member"))
    return field(spark, d).join(wanted, "member", "left_semi").select("card", "member", r("p"))


def a02_pick_pivot(spark, d):
    """The first pick, and the first of those that still run."""
    f = field(spark, d).withColumn("out", F.col("member") % 10 == 0)
    w = Window.partitionBy("card")
    f = f.withColumn("k", F.row_number().over(w.orderBy(F.round("p", 9).desc(), "member"))).withColumn("e", F.row_number().over(w.orderBy("out", F.round("p", 9).desc(), "member")))
    return f.groupBy("card").agg(F.max(F.when(F.col("k") == 1, F.col("member"))).alias("original"), F.max(F.when((F.col("e") == 1) & ~F.col("out"), F.col("member"))).alias("effective"), F.max(F.when((F.col("k") == 1) & F.col("out"), 1).otherwise(0)).alias("original_out"))


def a14_track_record(spark, d):
    """By surface, of the newest version of each card (odd and even ships): bets, hits, and whether there are 30."""
    f = dated(spark, d).withColumn("version", F.when(F.col("class") < "3", 1).otherwise(2))
    newest = f.agg(F.max("version").alias("version"))
    return f.join(F.broadcast(newest), "version", "left_semi").where("round(p, 9) >= 0.3").groupBy("surface").agg(F.count("*").alias("bets"), F.count(F.when(F.col("finish") == 1, 1)).alias("hits"), (F.count("*") >= 30).alias("enough"))


def a17_drawdown(spark, d):
    """The deepest fall of a running balance of each month of orders, each month in one order; months bound the window."""
    o = table(spark, d, "orders").withColumn("month", F.date_trunc("month", "o_orderdate").cast("date"))
    w = Window.partitionBy("month").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    o = o.withColumn("balance", F.sum(F.when(F.col("o_orderstatus") == "F", 2).otherwise(-1)).over(w))
    o = o.withColumn("peak", F.greatest(F.max("balance").over(w), F.lit(0)))
    return o.groupBy("month").agg(F.max(F.col("peak") - F.col("balance")).alias("fall"))


def a22_evidence(spark, d):
    """By feature: how many members have evidence, and of which provider."""
    f = styled(spark, d)
    rows = f.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.when(F.col(c).isNull(), "missing").when(F.col("member") % 2 == 0, "first").otherwise("second").alias("provider")) for n, c in (("works", "works"), ("gate", "gate"), ("style", "style"))])).alias("x")).select("x.*")
    return rows.groupBy("feature").agg(F.count("*").alias("rows"), *[F.count(F.when(F.col("provider") == k, 1)).alias(k) for k in ("first", "second", "missing")])


def a23_exclusions(spark, d):
    f = field(spark, d).groupBy("card").agg(F.count("*").alias("n"), F.count(F.when(F.col("finish") == 1, 1)).alias("winners"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("card"), "o_orderstatus")
    reason = F.when(F.col("n") < 3, "FIELD_TOO_SMALL").when(F.col("o_orderstatus").isNull(), "NO_RESULT").when(F.col("o_orderstatus") == "P", "NOT_OFFICIAL").otherwise("ELIGIBLE")
    return f.join(o, "card", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("cards"))


def a24_classes(spark, d):
    f = dated(spark, d)
    kind = F.when(F.col("ship") < F.col("day") + F.expr("interval 30 days"), "PROVEN").when(F.col("ship") < F.col("day") + F.expr("interval 90 days"), "LATE").otherwise("UNPROVEN")
    return f.withColumn("kind", kind).groupBy("surface").pivot("kind", ["PROVEN", "LATE", "UNPROVEN"]).agg(F.count(F.lit(1))).na.fill(0)


def a40_card_counts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("card"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("card")).agg(F.count("*").alias("rows"), F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("results"), F.max("l_shipdate").cast("date").alias("last"))
    return o.join(lines, "card", "left").select("card", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("results", F.lit(0)).alias("results"), "last")


def f05_post_utc(spark, d):
    """Local times with the zone of a small table, as UTC."""
    zones = spark.createDataFrame([("click", "America/New_York"), ("view", "America/Los_Angeles"), ("purchase", "America/Chicago")], "event_type string, zone string")
    e = table(spark, d, "events").join(F.broadcast(zones), "event_type", "left")
    return e.select("event_id", F.to_utc_timestamp("ts", F.coalesce("zone", F.lit("UTC"))).alias("utc"))


def f07_casts(spark, d):
    """Tolerant numbers and flags from text: what isn't one is null."""
    t = F.concat(F.when(F.col("event_id") % 3 == 0, "x").otherwise(""), F.round("value", 2).cast("decimal(18,2)").cast("string"))
    return table(spark, d, "events").select("event_id", t.try_cast("double").alias("number"), F.when(F.col("event_type").isin("click", "view"), True).when(F.col("event_type") == "error", False).alias("flag"))


def f08_row_ids(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.substring(F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"), 256), 1, 16).alias("row_id"))


def f10_class_rank(spark, d):
    label = F.when(F.col("p_partkey") % 13 == 0, "Open").otherwise(F.concat(F.element_at(F.array(*[F.lit(k) for k in (" g1", "Alw 5", "m cl", "Stakes ", "Msw", "clm", "aoc", "str", "moc", "soc", "G 3", "g2")]), (F.col("p_partkey") % 12 + 1).cast("int")), F.lit(" race")))
    return table(spark, d, "part").select("p_partkey", m.class_rank(label).alias("rank"))


_LABELS = "[' g1', 'Alw 5', 'm cl', 'Stakes ', 'Msw', 'clm', 'aoc', 'str', 'moc', 'soc', 'G 3', 'g2']"


def f11_finish_share(spark, d):
    return field(spark, d).select("card", "member", F.round(m.finish_share(F.col("finish"), F.col("n") - F.when(F.col("member") % 9 == 0, 1).otherwise(0), F.col("member") % 8 == 0), 6).alias("share"))


def f16_scaled(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(m.scaled(F.col("c_acctbal"), 0.0, 5000.0), 6).alias("scaled"), m.rate(F.col("c_acctbal"), F.col("c_custkey") % 4, 6).alias("rate"))


def f17_codes(spark, d):
    tags = {"click": 2, "view": 1, "error": 0}
    return table(spark, d, "events").groupBy(m.looked_up(F.lower(F.trim("event_type")), tags, -1).alias("code")).agg(F.count("*").alias("n"))


def f18_fraction(spark, d):
    """A decimal price in eighths as a reduced fraction to one."""
    eighths = F.round(F.col("l_quantity")).cast("long") + 1
    part = F.when(eighths % 8 == 0, 8).when(eighths % 4 == 0, 4).when(eighths % 2 == 0, 2).otherwise(1)
    return table(spark, d, "lineitem").groupBy((eighths / part).cast("long").alias("num"), (F.lit(8) / part).cast("long").alias("den")).agg(F.count("*").alias("n"))


def p09_context(spark, d):
    f = dated(spark, d).groupBy("card").agg(F.first("n").alias("n"), F.first("class").alias("class"), F.sum("qty").alias("qty"))
    return f.select("card", ((F.col("n") >= 5) & (F.col("class") == "1-URGENT") & (F.col("qty") >= 100)).alias("special"))


def p20_no_history(spark, d):
    """No history at all, a history that is empty, or one."""
    h = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("done"))
    return table(spark, d, "customer").join(h, "c_custkey", "left").groupBy(F.when(F.col("n").isNull(), "unknown").when(F.col("done") == 0, "none").otherwise("some").alias("history")).agg(F.count("*").alias("n"))


def p24_modes(spark, d):
    """Known modes as they are; unknown ones take the safe default."""
    mode = F.lower(F.trim(F.col("event_type")))
    return table(spark, d, "events").groupBy(F.when(mode.isin("click", "view"), mode).otherwise("off").alias("mode")).agg(F.count("*").alias("n"))


def w03_firsts(spark, d):
    """First live pick, favourite by price (the earlier post at a tie), and how many share the lowest price."""
    f, w = field(spark, d).withColumn("out", F.col("member") % 10 == 0), Window.partitionBy("card")
    f = f.withColumns({"k": F.row_number().over(w.orderBy("out", F.round("p", 9).desc(), "member")), "v": F.row_number().over(w.orderBy("out", F.round("decimal", 6), "post")), "s": F.rank().over(w.orderBy("out", F.round("decimal", 6)))})
    live = lambda c: F.max(F.when((F.col(c) == 1) & ~F.col("out"), F.col("member")))
    return f.groupBy("card").agg(live("k").alias("pick"), live("v").alias("favourite"), F.count(F.when((F.col("s") == 1) & ~F.col("out"), 1)).alias("shared"))


def e09_flags(spark, d):
    f = dated(spark, d).where("post = 1").groupBy("surface", "class").agg(F.count("*").alias("n"), F.round(F.avg((F.col("finish") == 1).cast("double")), 6).alias("rate"))
    return f.withColumn("flag", F.when(F.col("n") < 5, "low_sample").when(F.col("rate") >= 0.30, "strong").when(F.col("rate") <= 0.12, "weak").otherwise("none"))


def l01_observations(spark, d):
    """Members with a label: those of cards with a winner, without those that are out; the latest forecast of each."""
    f = dated(spark, d).where("member % 10 <> 0")
    w = Window.partitionBy("card")
    return f.withColumn("live", F.count("*").over(w)).withColumn("done", F.max(F.when(F.col("finish") == 1, 1).otherwise(0)).over(w)).where("done = 1 and live >= 2").select("card", "member", "day", r("p"), (F.col("finish") == 1).cast("int").alias("won"), "live")


def q02_stored_checks(spark, d):
    """By card: gaps among posts, overround out of its range, members without a part."""
    f = field(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("member"), F.lit(1).alias("known")), "member", "left")
    g = f.groupBy("card").agg(F.count("*").alias("n"), F.max("post").alias("last"), F.round(F.sum(1 / F.round("decimal", 6)), 4).alias("book"), F.count(F.when(F.col("known").isNull(), 1)).alias("orphans"))
    return g.select("card", (F.col("last") != F.col("n")).alias("gaps"), (~F.col("book").between(1.0, 1.5)).alias("book_off"), "orphans")


def q08_row_contract(spark, d):
    """Which required values a member lacks, and cards that this blocks."""
    lacks = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in ("gate", "layoff", "style", "works")])), ",")
    return styled(spark, d).groupBy(lacks.alias("lacks")).agg(F.count("*").alias("members"), F.countDistinct("card").alias("cards"))


def q18_required(spark, d):
    s = styled(spark, d).groupBy("card").agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in ("gate", "style", "works")])
    return s.select("card", F.round((F.col("gate") + F.col("style") + F.col("works")) / (3 * F.col("n")), 6).alias("complete"), (F.col("style") == F.col("n")).alias("ready"))


QUERIES = {
    "x04_career_rates": (x04_career_rates, "SELECT o_custkey, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS win_rate, round(count(*) FILTER (o_orderstatus IN ('F', 'O', 'P')) / count(*), 4) AS placed_rate FROM orders GROUP BY 1"),
    "x07_readiness": (x07_readiness, X07),
    "x08_fits": (x08_fits, with_sql(STYLED, "SELECT card, member, CASE WHEN starts >= 2 THEN round(wins / starts, 4) WHEN starts = 1 THEN round(0.5 * wins, 4) END AS surface_fit, round(CASE WHEN starts >= 1 THEN 0.55 * wins / starts ELSE 0 END + 0.45 * rate, 4) AS distance_fit FROM styled")),
    "x10_publicness": (x10_publicness, _then(STYLED, "a AS (SELECT card, member, rate, round(1 / (round(decimal, 2) + 1), 6) AS implied_p FROM styled), b AS (SELECT *, CASE WHEN rate > 0 THEN round(implied_p / rate + 1e-9, 4) END AS publicness FROM a), c AS (SELECT *, avg(publicness) OVER (PARTITION BY card) AS mean, stddev_samp(publicness) OVER (PARTITION BY card) AS sd FROM b)", "SELECT card, member, implied_p, publicness, round(coalesce(CASE WHEN sd > 0 AND publicness IS NOT NULL THEN round(greatest(0, least(1, (publicness - mean) / sd / 3 + 0.5)) + 1e-9, 4) END, 0.5), 4) AS underlay FROM c")),
    "x11_race_shape": (x11_race_shape, X11),
    "m02_composite": (m02_composite, M02),
    "a39_importances": (a39_importances, _then(FIELD, "w(grp, gw, feature, fw) AS (VALUES " + ", ".join(f"('{g}', {a}::DOUBLE, '{c}', {b}::DOUBLE)" for g, a, c, b in WEIGHTS) + "), t AS (SELECT feature, sum(gw * fw) AS w, string_agg(DISTINCT grp, ',' ORDER BY grp) AS groups FROM w GROUP BY 1)", "SELECT feature, groups, round(w / (SELECT sum(w) FROM t), 4) AS importance, (SELECT count(*) FROM field) AS members FROM t")),
    "m07_evidence_confidence": (m07_evidence_confidence, M07),
    "m10_edges": (m10_edges, M10),
    "m12_market_only": (m12_market_only, with_sql(FIELD, "SELECT card, member, round(v / sum(v) OVER (PARTITION BY card), 6) AS p_market FROM (SELECT card, member, CASE WHEN round(decimal, 6) > 1 THEN 1 / round(decimal, 6) END AS v FROM field)")),
    "m06_place_show": (m06_place_show, M06),
    "k01_board": (k01_board, with_sql(FIELD, "SELECT card, member, row_number() OVER (PARTITION BY card ORDER BY round(p, 9) DESC, member) AS place, round(p, 6) AS p FROM field ORDER BY card, place")),
    "k06_donors": (k06_donors, with_sql(FIELD, "SELECT card, count(*) AS donors, CAST(sum(CAST(round(p, 9) AS DECIMAL(18,9))) AS DOUBLE) AS given FROM (SELECT card, p FROM field QUALIFY row_number() OVER (PARTITION BY card ORDER BY round(p, 9) DESC, member) <= 3) GROUP BY 1")),
    "k07_unmatched_sample": (k07_unmatched_sample, "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events) ORDER BY c_custkey LIMIT 10"),
    "u04_pick_hits": (u04_pick_hits, with_sql(FIELD, "SELECT card, count(*) FILTER (k <= 3 AND finish <= 3) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY card ORDER BY round(p, 9) DESC, member) AS k FROM field) GROUP BY 1")),
    "u05_distinct_meta": (u05_distinct_meta, "SELECT DISTINCT lang, source FROM documents"),
    "j03_size_default": (j03_size_default, "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 12 + 4 END, (SELECT nullif(count(DISTINCT l_partkey), 0) FROM lineitem WHERE l_orderkey = o_orderkey), 0) AS size FROM orders"),
    "j28_training_rows": (j28_training_rows, with_sql(DATED, "SELECT s_nationkey, count(*) AS rows, count(DISTINCT card) AS cards, count(*) FILTER (finish = 1) AS won FROM dated JOIN supplier ON s_suppkey = jockey GROUP BY 1")),
    "j29_members_of": (j29_members_of, with_sql(FIELD, "SELECT card, member, round(p, 6) AS p FROM field WHERE member IN (SELECT p_partkey FROM part WHERE p_size = 7)")),
    "a02_pick_pivot": (a02_pick_pivot, with_sql(FIELD, "SELECT card, max(member) FILTER (k = 1) AS original, max(member) FILTER (e = 1 AND member % 10 <> 0) AS effective, max((k = 1 AND member % 10 = 0)::INT) AS original_out FROM (SELECT *, row_number() OVER (PARTITION BY card ORDER BY round(p, 9) DESC, member) AS k, row_number() OVER (PARTITION BY card ORDER BY member % 10 = 0, round(p, 9) DESC, member) AS e FROM field) GROUP BY 1")),
    "a14_track_record": (a14_track_record, _then(DATED, "v AS (SELECT *, CASE WHEN class < '3' THEN 1 ELSE 2 END AS version FROM dated)", "SELECT surface, count(*) AS bets, count(*) FILTER (finish = 1) AS hits, count(*) >= 30 AS enough FROM v WHERE version = (SELECT max(version) FROM v) AND round(p, 9) >= 0.3 GROUP BY 1")),
    "a17_drawdown": (a17_drawdown, "WITH b AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderdate, o_orderkey, sum(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE -1 END) OVER (PARTITION BY date_trunc('month', o_orderdate) ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS balance FROM orders), p AS (SELECT *, greatest(0, max(balance) OVER (PARTITION BY month ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)) AS peak FROM b) SELECT month, CAST(max(peak - balance) AS BIGINT) AS fall FROM p GROUP BY 1"),
    "a22_evidence": (a22_evidence, _then(STYLED, "x AS (SELECT 'works' AS feature, works IS NULL AS no, member FROM styled UNION ALL SELECT 'gate', gate IS NULL, member FROM styled UNION ALL SELECT 'style', style IS NULL, member FROM styled)", "SELECT feature, count(*) AS rows, count(*) FILTER (NOT no AND member % 2 = 0) AS first, count(*) FILTER (NOT no AND member % 2 = 1) AS second, count(*) FILTER (no) AS missing FROM x GROUP BY 1")),
    "a23_exclusions": (a23_exclusions, with_sql(FIELD, "SELECT CASE WHEN n < 3 THEN 'FIELD_TOO_SMALL' WHEN o_orderstatus IS NULL THEN 'NO_RESULT' WHEN o_orderstatus = 'P' THEN 'NOT_OFFICIAL' ELSE 'ELIGIBLE' END AS reason, count(*) AS cards FROM (SELECT card, count(*) AS n FROM field GROUP BY 1) LEFT JOIN orders ON o_orderkey = card GROUP BY 1")),
    "a24_classes": (a24_classes, with_sql(DATED, "SELECT surface, count(*) FILTER (ship < day + INTERVAL 30 DAY) AS PROVEN, count(*) FILTER (ship >= day + INTERVAL 30 DAY AND ship < day + INTERVAL 90 DAY) AS LATE, count(*) FILTER (ship >= day + INTERVAL 90 DAY) AS UNPROVEN FROM dated GROUP BY 1")),
    "a40_card_counts": (a40_card_counts, "SELECT o_orderkey AS card, count(l_orderkey) AS rows, count(*) FILTER (l_linestatus = 'F') AS results, CAST(max(l_shipdate) AS DATE) AS last FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"),
    "f05_post_utc": (f05_post_utc, None),
    "f07_casts": (f07_casts, "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(CAST(round(value, 2) AS DECIMAL(18,2)) AS DOUBLE) END AS number, CASE WHEN event_type IN ('click', 'view') THEN true WHEN event_type = 'error' THEN false END AS flag FROM events"),
    "f08_row_ids": (f08_row_ids, "SELECT o_orderkey, substr(sha256(concat_ws('|', o_orderkey::VARCHAR, o_orderstatus, o_orderpriority)), 1, 16) AS row_id FROM orders"),
    "f10_class_rank": (f10_class_rank, "WITH t AS (SELECT p_partkey, upper(replace(CASE WHEN p_partkey % 13 = 0 THEN 'Open' ELSE " + _LABELS + "[p_partkey % 12 + 1] || ' race' END, ' ', '')) AS t FROM part) SELECT p_partkey, CASE " + " ".join(f"WHEN contains(t, '{k}') THEN {v}" for k, v in m.CLASS_RANKS.items()) + " END AS rank FROM t"),
    "f11_finish_share": (f11_finish_share, _then(FIELD, "s AS (SELECT *, n - (member % 9 = 0)::INT AS size FROM field)", "SELECT card, member, CASE WHEN member % 8 <> 0 AND size >= 2 AND finish BETWEEN 1 AND size THEN round(1 - (finish - 1) / (size - 1), 6) END AS share FROM s")),
    "f16_scaled": (f16_scaled, "SELECT c_custkey, round(greatest(0, least(1, c_acctbal / 5000)), 6) AS scaled, CASE WHEN c_custkey % 4 > 0 THEN round(c_acctbal / (c_custkey % 4), 6) END AS rate FROM customer"),
    "f17_codes": (f17_codes, "SELECT CASE lower(trim(event_type)) WHEN 'click' THEN 2 WHEN 'view' THEN 1 WHEN 'error' THEN 0 ELSE -1 END AS code, count(*) AS n FROM events GROUP BY 1"),
    "f18_fraction": (f18_fraction, "WITH e AS (SELECT CAST(round(l_quantity) AS BIGINT) + 1 AS e FROM lineitem) SELECT e // gcd(e, 8) AS num, 8 // gcd(e, 8) AS den, count(*) AS n FROM e GROUP BY 1, 2"),
    "p09_context": (p09_context, with_sql(DATED, "SELECT card, any_value(n) >= 5 AND any_value(class) = '1-URGENT' AND sum(qty) >= 100 AS special FROM dated GROUP BY 1")),
    "p20_no_history": (p20_no_history, "WITH h AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1) SELECT CASE WHEN done IS NULL THEN 'unknown' WHEN done = 0 THEN 'none' ELSE 'some' END AS history, count(*) AS n FROM customer LEFT JOIN h ON o_custkey = c_custkey GROUP BY 1"),
    "p24_modes": (p24_modes, "SELECT CASE WHEN lower(trim(event_type)) IN ('click', 'view') THEN lower(trim(event_type)) ELSE 'off' END AS mode, count(*) AS n FROM events GROUP BY 1"),
    "w03_firsts": (w03_firsts, with_sql(FIELD, "SELECT card, max(member) FILTER (k = 1 AND NOT o) AS pick, max(member) FILTER (v = 1 AND NOT o) AS favourite, count(*) FILTER (s = 1 AND NOT o) AS shared FROM (SELECT *, member % 10 = 0 AS o, row_number() OVER (PARTITION BY card ORDER BY member % 10 = 0, round(p, 9) DESC, member) AS k, row_number() OVER (PARTITION BY card ORDER BY member % 10 = 0, round(decimal, 6), post) AS v, rank() OVER (PARTITION BY card ORDER BY member % 10 = 0, round(decimal, 6)) AS s FROM field) GROUP BY 1")),
    "e09_flags": (e09_flags, with_sql(DATED, "SELECT *, CASE WHEN n < 5 THEN 'low_sample' WHEN rate >= 0.30 THEN 'strong' WHEN rate <= 0.12 THEN 'weak' ELSE 'none' END AS flag FROM (SELECT surface, class, count(*) AS n, round(avg((finish = 1)::INT), 6) AS rate FROM dated WHERE post = 1 GROUP BY 1, 2)")),
    "l01_observations": (l01_observations, with_sql(DATED, "SELECT card, member, day, round(p, 6) AS p, (finish = 1)::INT AS won, live FROM (SELECT *, count(*) OVER (PARTITION BY card) AS live, max((finish = 1)::INT) OVER (PARTITION BY card) AS done FROM dated WHERE member % 10 <> 0) WHERE done = 1 AND live >= 2")),
    "q02_stored_checks": (q02_stored_checks, with_sql(FIELD, "SELECT card, max(post) <> count(*) AS gaps, NOT round(sum(1 / round(decimal, 6)), 4) BETWEEN 1.0 AND 1.5 AS book_off, count(*) FILTER (p_partkey IS NULL) AS orphans FROM field LEFT JOIN part ON p_partkey = member GROUP BY 1")),
    "q08_row_contract": (q08_row_contract, with_sql(STYLED, "SELECT concat_ws(',', CASE WHEN gate IS NULL THEN 'gate' END, CASE WHEN layoff IS NULL THEN 'layoff' END, CASE WHEN style IS NULL THEN 'style' END, CASE WHEN works IS NULL THEN 'works' END) AS lacks, count(*) AS members, count(DISTINCT card) AS cards FROM styled GROUP BY 1")),
    "q18_required": (q18_required, with_sql(STYLED, "SELECT card, round((count(gate) + count(style) + count(works)) / (3 * count(*)), 6) AS complete, count(style) = count(*) AS ready FROM styled GROUP BY 1")),
}
