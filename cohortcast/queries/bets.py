"""Queries of scoring, picks, paper trading and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortcast.operators import backtest, features, rules, scoring
from cohortcast.queries.frames import DATED, FIELD, dated, field, once, table, with_sql

r = lambda c, k=6: F.round(c, k).alias(c)


def m01_signal(spark, d):
    return scoring.weighted_signal(field(spark, d), "card", {"price": 0.6, "qty": 0.3, "post": 0.1}).select("card", "member", r("signal"))


_NORM = "CASE WHEN max({c}) OVER w > min({c}) OVER w THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE 0.5 END"
_SIGNAL = f"0.6 * ({_NORM.format(c='price')}) + 0.3 * ({_NORM.format(c='qty')}) + 0.1 * ({_NORM.format(c='post')})"


def m03_probabilities(spark, d):
    return scoring.probabilities(field(spark, d), "card", {"price": 0.6, "qty": 0.3, "post": 0.1}, 8.0, "q").select("card", "member", r("q"))


M03 = with_sql(FIELD, f", s AS (SELECT card, member, {_SIGNAL} AS s FROM field WINDOW w AS (PARTITION BY card)), e AS (SELECT card, member, exp(8 * (s - max(s) OVER (PARTITION BY card))) AS e FROM s) SELECT card, member, round(e / sum(e) OVER (PARTITION BY card), 6) AS q FROM e").replace("\n, s AS", ",\ns AS", 1)


def m05_place_show(spark, d):
    place, show = scoring.place_show(F.col("p"), F.col("n"))
    return field(spark, d).select("card", "member", F.round(place, 6).alias("place"), F.round(show, 6).alias("show"))


def m10_market(spark, d):
    f = scoring.market(field(spark, d).withColumn("price_now", F.round("decimal", 6)), "card", "price_now")
    return f.select("card", "member", r("overround"), r("market_p"))


M10 = with_sql(FIELD, "SELECT card, member, CASE WHEN ok THEN round(s, 6) END AS overround, CASE WHEN ok THEN round(1 / d / s, 6) END AS market_p FROM (SELECT card, member, round(decimal, 6) AS d, bool_and(round(decimal, 6) > 1) OVER w AS ok, sum(1 / round(decimal, 6)) OVER w AS s FROM field WINDOW w AS (PARTITION BY card))")


def m07_confidence(spark, d):
    f = field(spark, d).withColumn("cov", (F.col("member") % 10) / 10).withColumn("agree", 1 - F.abs(F.col("p") - F.col("m")))
    return scoring.confidence(f, "card", "p", "cov", "agree").select("card", "member", r("confidence_score"), F.col("confidence").alias("level"), F.array_join("confidence_reasons", ",").alias("reasons"))


M07 = with_sql(FIELD, """, x AS (SELECT card, member, least(1, (max(p) OVER w - coalesce(list(p ORDER BY p DESC) OVER w[2], 0)) / 0.25) AS lead, (member % 10) / 10 AS cov, 1 - abs(p - m) AS ag, 1 - least(1, n / 20) AS ev FROM field WINDOW w AS (PARTITION BY card)),
s AS (SELECT *, 0.35 * lead + 0.25 * cov + 0.3 * ag + 0.1 * ev AS sc FROM x)
SELECT card, member, round(sc, 6) AS confidence_score, CASE WHEN sc >= 0.7 THEN 'HIGH' WHEN sc >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS level,
array_to_string(list_filter([CASE WHEN lead < 0.25 THEN 'NO_CLEAR_LEADER' END, CASE WHEN cov < 0.5 THEN 'THIN_EVIDENCE' END, CASE WHEN ag < 0.5 THEN 'MARKET_DISAGREES' END, CASE WHEN ev < 0.4 THEN 'LARGE_FIELD' END], lambda v: v IS NOT NULL)[1:3], ',') AS reasons FROM s""".replace("list(p ORDER BY p DESC) OVER w[2]", "(list(p ORDER BY p DESC) OVER w)[2]")).replace("\n, x AS", ",\nx AS", 1)


def m08_lift_longshots(spark, d):
    f = field(spark, d).withColumn("flagged", F.col("member") % 4 == 0)
    return scoring.lift_longshots(f, "card", "p", "flagged").select("card", "member", r("patched_p"))


M08 = with_sql(FIELD, """, c AS (SELECT card, member, p, member % 4 = 0 AS fl, quantile_cont(p, 0.7) OVER (PARTITION BY card) AS cut FROM field),
g AS (SELECT *, p >= cut AND NOT fl AS donor, fl AND p < cut AS taker, sum(CASE WHEN p >= cut AND NOT fl THEN p ELSE 0 END) OVER (PARTITION BY card) AS gave, sum(CASE WHEN fl AND p < cut THEN p ELSE 0 END) OVER (PARTITION BY card) AS got FROM c),
x AS (SELECT *, CASE WHEN got > 0 AND gave > 0 THEN 0.05 ELSE 0 END AS mv FROM g),
y AS (SELECT card, member, CASE WHEN donor THEN p - mv * p WHEN taker THEN greatest(0.035, p + mv * gave * p / got) ELSE p END AS v FROM x) SELECT card, member, round(v / sum(v) OVER (PARTITION BY card), 6) AS patched_p FROM y""").replace("\n, c AS", ",\nc AS", 1)


def m08_dark_horses(spark, d):
    """Scores follow numbers of the member; the index of chaos is the card's."""
    c = F.col
    f = field(spark, d)
    score = lambda k: ((c("member") * k + c("post")) % 11).cast("double")
    f = f.withColumns({"index": 0.55 + (c("card") % 10) * 0.05, "development": score(3), "energy": score(5), "pace": score(7), "distance": score(2), "publicness": score(9), "late_z": F.when(c("member") % 6 > 0, ((c("member") % 7) - 3) / 2.0), "rail_closer": c("post") == 1, "tactical_inner": c("member") % 5 == 0, "tactical_outer": c("member") % 8 == 0})
    out = scoring.dark_horses(f, "card", "index")
    return out.select("card", "member", "dark_horse", r("upside"), r("p_multiplied"), r("p_floored"), "beneficiary", r("p_patched"), "dark_tier")


M08D = with_sql(FIELD, """, s AS (SELECT card, member, p AS b, 0.55::DOUBLE + (card % 10) * 0.05::DOUBLE AS ix, (member * 3 + post) % 11 AS dev, (member * 5 + post) % 11 AS en, (member * 7 + post) % 11 AS pa, (member * 2 + post) % 11 AS di, (member * 9 + post) % 11 AS pu, CASE WHEN member % 6 > 0 THEN (member % 7 - 3) / 2 END AS z, post = 1 AS rc, member % 5 = 0 AS ti, member % 8 = 0 AS tu FROM field),
a AS (SELECT *, ix >= 0.7::DOUBLE AS act, b BETWEEN 0.015 AND 0.12 AND pu <= 7 AND (dev >= 7 OR en >= 7) AND (pa >= 6 OR di >= 6) AS dark, (dev + en) / 20 AS up, quantile_cont(b, 0.7) OVER (PARTITION BY card) AS cut FROM s),
m AS (SELECT *, CASE WHEN act THEN b * (CASE WHEN rc THEN 0.9 ELSE 1 END) * (CASE WHEN ti THEN 0.95 ELSE 1 END) * (CASE WHEN tu THEN 1.05 ELSE 1 END) ELSE b END AS pm FROM a),
fl AS (SELECT *, CASE WHEN act AND dark AND up >= 0.7 AND coalesce(z, -9) >= 0.7 AND pa >= 7 THEN greatest(pm, 0.035) ELSE pm END AS pf, dark AND up >= 0.5 AND coalesce(z, -9) >= 0 AND pa >= 6 AS ben FROM m),
g AS (SELECT *, CASE WHEN NOT dark AND NOT tu AND (rc OR ti OR (up <= 0.4 AND b >= cut)) THEN b ELSE 0 END AS gv, CASE WHEN ben THEN up * greatest(coalesce(z, -9), 0.1) ELSE 0 END AS tk FROM fl),
h AS (SELECT *, sum(gv) OVER (PARTITION BY card) AS gs, sum(tk) OVER (PARTITION BY card) AS ts FROM g),
v AS (SELECT *, CASE WHEN act AND gs > 0 AND ts > 0 THEN least(least(0.1, greatest(0.05, 0.05 + 0.05 * (ix - 0.7) / 0.3)), 0.6 * gs) ELSE 0 END AS mv FROM h),
x AS (SELECT *, pf - CASE WHEN gs > 0 THEN gv / gs * mv ELSE 0 END + CASE WHEN ts > 0 THEN tk / ts * mv ELSE 0 END AS raw FROM v)
SELECT card, member, dark AS dark_horse, round(up, 6) AS upside, round(pm, 6) AS p_multiplied, round(pf, 6) AS p_floored, ben AS beneficiary, round(raw / sum(raw) OVER (PARTITION BY card), 6) AS p_patched, CASE WHEN NOT dark THEN 'none' WHEN up >= 0.7 THEN 'strong' ELSE 'light' END AS dark_tier FROM x""").replace("\n, s AS", ",\ns AS", 1)


def m13_picks(spark, d):
    f = field(spark, d)
    return scoring.picks(f, "card", "member", {"WIN": ("p", "m", 0.08, 0.04)}, 3, 2).select("card", "member", "bet", r("ours"), r("lead"), "nth", "long_shot", r("break_even"))


M13 = with_sql(FIELD, "SELECT card, member, 'WIN' AS bet, round(p, 6) AS ours, round(p - m, 6) AS lead, nth, p >= 2 * m AS long_shot, round(1 / p, 6) AS break_even FROM (SELECT *, CAST(row_number() OVER (PARTITION BY card ORDER BY round(p - m, 9) DESC, member) AS INT) AS nth FROM field WHERE n >= 3 AND p >= 0.08 AND p - m >= 0.04) WHERE nth <= 2")


def m14_stakes(spark, d):
    return scoring.stakes(field(spark, d), "p", "decimal", 1000.0).select("card", "member", r("stake", 2), "action")


M14 = with_sql(FIELD, "SELECT card, member, round(st, 2) AS stake, CASE WHEN st >= 2 THEN 'BET' ELSE 'PASS' END AS action FROM (SELECT card, member, coalesce(floor(1000 * least(0.05, 0.25 * greatest((p * decimal - 1) / (decimal - 1), 0)) / 2 + 1e-9) * 2, 0)::DOUBLE AS st FROM field)")


def _bets(spark, d, f=None):
    return backtest.decide(dated(spark, d) if f is None else f, "card", "member", "p", "decimal", "edge_v1")


DECIDED = DATED + """,
priced AS (SELECT *, min(CASE WHEN decimal > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY card) = 1 AS ok, sum(CASE WHEN decimal > 1 THEN 1 / decimal END) OVER (PARTITION BY card) AS tot FROM dated),
good AS (SELECT *, p - 1 / decimal / tot AS edge, p * decimal - 1 AS ev FROM priced WHERE ok),
bets AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY card ORDER BY round(ev, 9) DESC, member) AS k FROM good WHERE edge >= 0.02 AND ev >= 0.05) WHERE k = 1)"""


def e11_decide(spark, d):
    return _bets(spark, d).select("policy", "card", "member", r("edge"), r("ev"), "decision_id")


def _members(spark, d):
    """What bets, outcomes, classes and closing prices read of the dated field, worked out once."""
    return once(dated(spark, d).select("card", "member", "p", "decimal", "finish", "class", "day"), "members")


def _settled(spark, d, f=None):
    f = _members(spark, d) if f is None else f
    outcomes = f.select("card", "member", F.when((F.col("card") % 13 != 0) & (F.col("member") % 29 != 0), F.col("finish")).alias("finish"), (F.col("member") % 31 == 0).alias("scratched"))
    classes = f.select("card", "class").distinct()
    return backtest.settle(_bets(spark, d, f).join(classes, "card"), outcomes, "card", "member", F.lit(2.0))


SETTLED = DECIDED + """,
oc AS (SELECT card, member, CASE WHEN card % 13 <> 0 AND member % 29 <> 0 THEN finish END AS fin, member % 31 = 0 AS scr FROM dated),
per AS (SELECT card, count(fin) AS done, count(*) FILTER (fin = 1) AS firsts FROM oc GROUP BY 1),
st AS (SELECT b.*, CASE WHEN scr THEN 'REFUNDED_SCRATCH' WHEN done = 0 THEN 'HELD_NO_RESULT' WHEN fin IS NULL THEN 'HELD_MEMBER_MISSING' WHEN fin = 1 AND firsts > 1 THEN 'VOID_DEAD_HEAT' WHEN fin = 1 THEN 'WON' ELSE 'LOST' END AS status FROM bets b JOIN oc ON oc.card = b.card AND oc.member = b.member JOIN per ON per.card = b.card),
settled AS (SELECT *, CASE WHEN status = 'WON' THEN 2 * (decimal - 1) WHEN status = 'LOST' THEN -2 ELSE 0 END AS net FROM st)"""


def e12_settle(spark, d):
    return _settled(spark, d).select("card", "member", "status", r("net"))


def e13_report(spark, d):
    return backtest.report(_settled(spark, d), ["policy", "class"], F.lit(2.0)).select("policy", "class", "bets", "wins", "turnover", r("net", 4), r("expected_wins", 4), r("roi", 5), r("z", 4))


E13 = with_sql(SETTLED, "SELECT 'edge_v1' AS policy, class, count(*) FILTER (l) AS bets, count(*) FILTER (status = 'WON') AS wins, sum(CASE WHEN l THEN 2.0::DOUBLE ELSE 0 END) AS turnover, round(sum(net), 4) AS net, round(sum(CASE WHEN l THEN p END), 4) AS expected_wins, round(sum(net) / sum(CASE WHEN l THEN 2 ELSE 0 END), 5) AS roi, round((count(*) FILTER (status = 'WON') - sum(CASE WHEN l THEN p END)) / sqrt(sum(CASE WHEN l THEN p * (1 - p) END)), 4) AS z FROM (SELECT *, status IN ('WON', 'LOST') AS l FROM settled) GROUP BY class")


def _priced(spark, d):
    """Settled bets with the card's day and the value of their price against the last one, which follows the members' share of price."""
    f = _members(spark, d)
    closing = f.select("card", "member", "day", (1 / (F.col("p") * 1.18)).alias("closing"))
    return _settled(spark, d, f).join(closing, ["card", "member"]).withColumn("clv", backtest.closing_line_value(F.col("decimal"), F.col("closing")))


def a15_performance(spark, d):
    b = _priced(spark, d)
    whole = backtest.performance(b, ["policy", "class"], F.lit(2.0)).join(backtest.max_drawdown(b.where("status IN ('WON', 'LOST')"), ["policy", "class"], "day", ["card", "member"]), ["policy", "class"], "left")
    return whole.select("policy", "class", "bets", "refunded", "staked", "wins", *[r(c, 4) for c in ("returned", "profit", "roi", "hit_rate", "expected_hit_rate", "expected_wins", "wins_z", "mean_decimal", "mean_clv", "positive_clv", "max_drawdown")], "needed")


A15 = with_sql(SETTLED, """, pr AS (SELECT s.*, f.day, decimal_ * f.p * 1.18 - 1 AS clv, status IN ('WON', 'LOST') AS l FROM (SELECT *, decimal AS decimal_ FROM settled) s JOIN dated f ON f.card = s.card AND f.member = s.member),
run AS (SELECT class, bal, greatest(0, max(bal) OVER (PARTITION BY class ORDER BY day, card, member ROWS UNBOUNDED PRECEDING)) AS peak FROM (SELECT *, sum(net) OVER (PARTITION BY class ORDER BY day, card, member ROWS UNBOUNDED PRECEDING) AS bal FROM pr WHERE l)),
dd AS (SELECT class, max(peak - bal) AS dd FROM run GROUP BY 1),
g AS (SELECT class, count(*) FILTER (l) AS bets, count(*) FILTER (status = 'REFUNDED_SCRATCH') AS refunded, coalesce(sum(2.0::DOUBLE) FILTER (l), 0) AS staked, coalesce(sum(net) FILTER (l), 0) AS profit, avg((status = 'WON')::INT) FILTER (l) AS hr, avg(p) FILTER (l) AS ehr, count(*) FILTER (status = 'WON') AS wins, sum(p) FILTER (l) AS ew, sum(p * (1 - p)) FILTER (l) AS v, avg(decimal) FILTER (l) AS md, avg(clv) FILTER (l) AS mc, avg((clv > 0)::INT) FILTER (l) AS pc, stddev_samp(net / 2) FILTER (l) AS sd FROM pr GROUP BY 1)
SELECT 'edge_v1' AS policy, class, bets, refunded, staked, wins, round(staked + profit, 4) AS returned, round(profit, 4) AS profit, round(profit / nullif(staked, 0), 4) AS roi, round(hr, 4) AS hit_rate, round(ehr, 4) AS expected_hit_rate, round(ew, 4) AS expected_wins, round((wins - ew) / sqrt(nullif(v, 0)), 4) AS wins_z, round(md, 4) AS mean_decimal, round(mc, 4) AS mean_clv, round(pc, 4) AS positive_clv, round(dd, 4) AS max_drawdown, CASE WHEN sd > 0 THEN CAST(ceil((1.96 * sd / 0.05) ** 2) AS BIGINT) END AS needed FROM g LEFT JOIN dd USING (class)""").replace("\n, pr AS", ",\npr AS", 1)


def a15_verdicts(spark, d):
    """Returns and closing-line values by class with intervals from 2,000 resamples of bets."""
    return backtest.verdicts(_priced(spark, d), ["policy", "class"], "decision_id", F.lit(2.0))


def x14_history_form(spark, d):
    f = dated(spark, d)
    h = f.select("jockey", F.col("day").alias("past"), features.beaten_share(F.col("finish"), F.col("n")).alias("score"))
    t = f.where("finish = 1").select("card", "jockey", "day")
    return features.history_form(t, h, ["jockey"], "day", "past", "score", "jockey").select("card", "jockey", r("form"), "starts", "days_off")


X14 = with_sql(DATED, """, h AS (SELECT jockey, day, CASE WHEN n >= 2 THEN 1 - (finish - 1) / (n - 1) END AS s FROM dated), t AS (SELECT card, jockey, day FROM dated WHERE finish = 1),
hd AS (SELECT jockey, day, count(s) AS n, sum(s) AS s FROM h WHERE s IS NOT NULL GROUP BY 1, 2),
g AS (SELECT t.card, t.jockey, sum(exp(-0.01 * date_diff('day', hd.day, t.day)) * hd.s) / sum(exp(-0.01 * date_diff('day', hd.day, t.day)) * hd.n) AS raw, sum(hd.n) AS starts, sum(CASE WHEN date_diff('day', hd.day, t.day) <= 180 THEN hd.n ELSE 0 END) AS recent, min(date_diff('day', hd.day, t.day)) AS days_off FROM t LEFT JOIN hd ON hd.jockey = t.jockey AND hd.day < t.day GROUP BY 1, 2)
SELECT card, jockey, round(least(1, coalesce(recent, 0) / 5) * coalesce(raw, 0.5) + (1 - least(1, coalesce(recent, 0) / 5)) * 0.5, 6) AS form, CAST(coalesce(starts, 0) AS BIGINT) AS starts, CAST(days_off AS INT) AS days_off FROM g""").replace("\n, h AS", ",\nh AS", 1)


def x03_layoff(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    from pyspark.sql import Window

    gap = F.datediff("day", F.lag("day").over(Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")))
    return o.select("o_orderkey", gap.alias("days_off")).select("o_orderkey", "days_off", features.layoff_rate(F.col("days_off")).alias("rate"))


X03 = "SELECT o_orderkey, g AS days_off, CAST(CASE WHEN g IS NULL THEN NULL WHEN g < 14 THEN 0.18 WHEN g < 28 THEN 0.21 WHEN g < 56 THEN 0.23 WHEN g < 120 THEN 0.17 ELSE 0.12 END AS DOUBLE) AS rate FROM (SELECT o_orderkey, CAST(date_diff('day', lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey), CAST(o_orderdate AS DATE)) AS INT) AS g FROM orders)"


def e01_graded(spark, d):
    f = dated(spark, d).withColumn("done", F.col("card") % 13 != 0)
    reason = F.when(F.col("n") < 3, "FIELD_TOO_SMALL").when(~F.col("done"), "NO_OFFICIAL_WINNER").when(F.col("card") % 17 == 0, "NO_SCORE_RUN").otherwise("GRADED")
    return f.groupBy(reason.alias("reason")).agg(F.count_distinct("card").alias("cards"), F.count("*").alias("members"))


def e05_review(spark, d):
    f = field(spark, d).withColumn("scratched", F.col("surface") == "R")
    pick = lambda x: F.min_by("member", F.struct((~x).cast("int").alias("o"), F.round(-F.col("p"), 12).alias("p"), "member"))
    g = f.groupBy("card").agg(pick(F.lit(True)).alias("original_pick"), F.when(F.bool_or(~F.col("scratched")), pick(~F.col("scratched"))).alias("effective_pick"), F.min_by("member", "finish").alias("winner"))
    return g.withColumn("original_hit", F.col("original_pick") == F.col("winner")).withColumn("effective_hit", F.col("effective_pick") == F.col("winner")).withColumn("status", rules.workflow_status(F.lit(True), F.col("winner").isNotNull()))


E05 = with_sql(FIELD, """, g AS (SELECT card, arg_min(member, (-round(p, 12), member)) AS original_pick, arg_min(member, (-round(p, 12), member)) FILTER (surface <> 'R') AS effective_pick, arg_min(member, finish) AS winner FROM field GROUP BY 1)
SELECT *, original_pick = winner AS original_hit, effective_pick = winner AS effective_hit, 'calibrated' AS status FROM g""").replace("\n, g AS", ",\ng AS", 1)


def e15_newest_version(spark, d):
    e = table(spark, d, "events").withColumn("version", F.concat(F.lit("v"), (F.col("event_id") % 4).cast("string")))
    newest = e.groupBy("event_type").agg(F.max_by("version", F.struct("ts", "event_id")).alias("version"))
    return e.join(newest, ["event_type", "version"], "left_semi").groupBy("event_type", "version").agg(F.count("*").alias("n"))


def walk_forward(spark, d):
    """Chronological folds by date, each scored by a rate learned before it, with an embargo."""
    from cohortcast.operators.windows import date_blocks

    f = date_blocks(dated(spark, d).select("card", "member", "day", "post", "finish", "n"), "day", 4)
    starts = f.groupBy("block").agg(F.min("day").alias("start")).where("block > 0").withColumnRenamed("block", "fold")
    sums = f.groupBy("day", F.least("post", F.lit(8)).alias("post")).agg(F.count_if(F.col("finish") == 1).alias("wins"), F.count("*").alias("seen"))
    rates = starts.join(sums, F.col("day") < F.date_sub("start", 7)).groupBy("fold", "post").agg((F.sum("wins") / F.sum("seen")).alias("rate"))
    test = f.where("block > 0").withColumn("fold", F.col("block")).withColumn("post", F.least("post", F.lit(8)))
    scored = test.join(rates, ["fold", "post"]).withColumn("won", (F.col("finish") == 1).cast("double"))
    return scored.groupBy("fold").agg(F.count("*").alias("members"), F.round(F.avg(F.pow(F.col("rate") - F.col("won"), 2)), 6).alias("brier"))


WALK = with_sql(DATED, """, b AS (SELECT d.*, CAST(floor(k * 4 / c) AS INT) AS block FROM dated d JOIN (SELECT day, row_number() OVER (ORDER BY day) - 1 AS k, count(*) OVER () AS c FROM (SELECT DISTINCT day FROM dated)) x USING (day)),
s AS (SELECT block AS fold, min(day) AS start FROM b WHERE block > 0 GROUP BY 1),
rt AS (SELECT fold, least(post, 8) AS post, count(*) FILTER (finish = 1) / count(*) AS rate FROM s JOIN b ON b.day < start - 7 GROUP BY 1, 2)
SELECT block AS fold, count(*) AS members, round(avg((rate - (finish = 1)::INT) ** 2), 6) AS brier FROM b JOIN rt ON rt.fold = b.block AND rt.post = least(b.post, 8) WHERE block > 0 GROUP BY 1""").replace("\n, b AS", ",\nb AS", 1)

QUERIES = {
    "m01_signal": (m01_signal, with_sql(FIELD, f"SELECT card, member, round({_SIGNAL}, 6) AS signal FROM field WINDOW w AS (PARTITION BY card)")),
    "m03_probabilities": (m03_probabilities, M03),
    "m05_place_show": (m05_place_show, with_sql(FIELD, "SELECT card, member, round(least(1, 0.45 * p + 0.55 / n), 6) AS place, round(least(1, 0.35 * p + 0.65 / n), 6) AS show FROM field")),
    "m07_confidence": (m07_confidence, M07),
    "m08_lift_longshots": (m08_lift_longshots, M08),
    "m08_dark_horses": (m08_dark_horses, M08D),
    "m10_market": (m10_market, M10),
    "m13_picks": (m13_picks, M13),
    "m14_stakes": (m14_stakes, M14),
    "e01_graded": (e01_graded, with_sql(DATED, "SELECT CASE WHEN n < 3 THEN 'FIELD_TOO_SMALL' WHEN card % 13 = 0 THEN 'NO_OFFICIAL_WINNER' WHEN card % 17 = 0 THEN 'NO_SCORE_RUN' ELSE 'GRADED' END AS reason, count(DISTINCT card) AS cards, count(*) AS members FROM dated GROUP BY 1")),
    "e05_review": (e05_review, E05),
    "e11_decide": (e11_decide, with_sql(DECIDED, "SELECT 'edge_v1' AS policy, card, member, round(edge, 6) AS edge, round(ev, 6) AS ev, sha256('edge_v1|' || card || '|' || member) AS decision_id FROM bets")),
    "e12_settle": (e12_settle, with_sql(SETTLED, "SELECT card, member, status, round(net, 6) AS net FROM settled")),
    "e13_report": (e13_report, E13),
    "a15_performance": (a15_performance, A15),
    "a15_verdicts": (a15_verdicts, None),
    "e15_newest_version": (e15_newest_version, "WITH e AS (SELECT *, 'v' || (event_id % 4) AS version FROM events), n AS (SELECT event_type, arg_max(version, (ts, event_id)) AS version FROM e GROUP BY 1) SELECT event_type, version, count(*) AS n FROM e JOIN n USING (event_type, version) GROUP BY 1, 2"),
    "walk_forward": (walk_forward, WALK),
    "x03_layoff": (x03_layoff, X03),
    "x14_history_form": (x14_history_form, X14),
}
