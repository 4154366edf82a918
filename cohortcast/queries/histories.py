"""Queries of entities' histories: works, starts, speed figures. An entity is a supplier; its starts are members of cards, its works are dated by shipping."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortcast.operators import histories
from cohortcast.queries.frames import DATED, dated, once, parts_of, with_sql


#: Beyond every member's key, so that card * ID + member is one row's alone.
ID = 10_000_000_000


def _then(frame, parts, body):
    return with_sql(frame + ",\n" + parts, body)


def _starts(spark, d, *names):
    """These columns of the dated field, worked out once: targets and each kind of sum read them."""
    return once(dated(spark, d).select(*names), "starts")


def _works(f):
    """Every seventh work has no time, every fifth no rank; some ranks are beyond the field."""
    c = F.col
    return f.select("jockey", c("ship").alias("date"), (c("post") % 4 + 4).cast("double").alias("distance"), F.when(c("member") % 7 > 0, 50 + c("qty")).alias("seconds"), c("class").alias("location"), "surface", F.when(c("member") % 5 > 0, c("finish")).alias("rank"), F.when(c("member") % 11 > 0, c("n")).otherwise(1).alias("of"), (c("card") * 1000000 + c("member")).alias("tie"))


WORKS = """w AS (SELECT jockey, ship AS date, CAST(post % 4 + 4 AS DOUBLE) AS distance, CASE WHEN member % 7 > 0 THEN 50 + qty END AS seconds, class AS location, surface, CASE WHEN member % 5 > 0 THEN finish END AS rank, CASE WHEN member % 11 > 0 THEN n ELSE 1 END AS of_, card * 1000000 + member AS tie FROM dated),
t AS (SELECT card, jockey, day FROM dated WHERE finish = 1),
rk AS (SELECT card, avg(1 - rank / of_) AS rp, count(*) AS rn FROM (SELECT t.card, w.rank, w.of_, row_number() OVER (PARTITION BY t.card ORDER BY w.date DESC, w.tie DESC) AS k FROM t JOIN w ON w.jockey = t.jockey AND w.date < t.day WHERE w.rank IS NOT NULL AND w.rank <= w.of_) WHERE k <= 5 GROUP BY 1),
v AS (SELECT t.card, t.day, w.*, date_diff('day', w.date, t.day) AS ago, row_number() OVER (PARTITION BY t.card ORDER BY w.date DESC, w.tie DESC) AS k FROM t JOIN w ON w.jockey = t.jockey AND w.date < t.day AND w.seconds IS NOT NULL WHERE date_diff('day', w.date, t.day) <= 60),
s AS (SELECT card, count(*) AS n60, count(*) FILTER (ago <= 30) AS n30, min(ago) AS ago, avg(distance) FILTER (k > 1) AS earlier, min(rank) FILTER (rank > 0) AS best FROM v GROUP BY 1),
la AS (SELECT * FROM v WHERE k = 1),
p AS (SELECT la.card, count(*) AS pn, avg(w.seconds) AS pm, stddev_pop(w.seconds) AS ps FROM la JOIN w ON w.location = la.location AND w.surface = la.surface AND w.distance = la.distance AND w.seconds IS NOT NULL AND w.date < la.day AND date_diff('day', w.date, la.day) <= 90 GROUP BY 1),
z AS (SELECT t.card, rp, coalesce(rn, 0) AS rn, coalesce(n30, 0) AS n30, coalesce(n60, 0) AS n60, s.ago, earlier, best, la.distance, la.rank, CASE WHEN pn >= 5 AND ps > 1e-6 THEN (la.seconds - pm) / ps END AS z FROM t LEFT JOIN rk USING (card) LEFT JOIN s USING (card) LEFT JOIN la ON la.card = t.card LEFT JOIN p ON p.card = t.card),
y AS (SELECT *, least(1, n60 / 3) AS cover, 0.35 * exp(-ago / 30) + 0.30 * least(1, n30 / 3) + 0.20 * CASE WHEN n60 < 2 THEN 0.5 WHEN distance >= earlier - 1e-9 THEN 0.65 ELSE 0.35 END + 0.05 * coalesce(1 / (1 + exp(z)), 0.5) AS part,
  0.10 * CASE WHEN rank > 0 THEN least(1, 1 / rank) ELSE 0.5 END AS last_rank, 0.10 * CASE WHEN best > 0 THEN least(1, 1 / best) ELSE 0.5 END AS best_rank FROM z)"""


def x17_workouts(spark, d):
    """What the supplier's works say before the day of a card that it won; the last work's rank counts."""
    f = _starts(spark, d, "card", "member", "jockey", "ship", "post", "qty", "class", "surface", "finish", "n", "day")
    out = histories.work_overlay(f.where("finish = 1").select("card", "jockey", "day"), _works(f), "jockey", "day")
    return out.select("card", "rank_n", "count_30", "days_since_work", "normalized", "rank_percentile", F.col("readiness_v2").alias("readiness"))


X17 = _then(DATED, WORKS, "SELECT card, rn AS rank_n, CAST(n30 AS INT) AS count_30, CAST(ago AS INT) AS days_since_work, z IS NOT NULL AS normalized, round(rp, 4) AS rank_percentile, round(CASE WHEN n60 > 0 THEN cover * (part + last_rank) + (1 - cover) * 0.5 END, 4) AS readiness FROM y")


def x19_velocity(spark, d):
    """The same with the best rank of 60 days, and the time of the last work against its peers."""
    f = _starts(spark, d, "card", "member", "jockey", "ship", "post", "qty", "class", "surface", "finish", "n", "day")
    out = histories.work_overlay(f.where("finish = 1").select("card", "jockey", "day"), _works(f), "jockey", "day", rank_of="best")
    return out.select("card", "count_30", "velocity_z", F.col("readiness_v2").alias("readiness"))


X19V = _then(DATED, WORKS, "SELECT card, CAST(n30 AS INT) AS count_30, round(z, 4) AS velocity_z, round(CASE WHEN n60 > 0 THEN cover * (part + best_rank) + (1 - cover) * 0.5 END, 4) AS readiness FROM y")


def x19_standalone(spark, d):
    f = _starts(spark, d, "card", "member", "jockey", "day", "surface", "finish", "n", "m")
    c = F.col
    starts = f.select("jockey", c("day").alias("date"), "surface", (c("n") >= 5).alias("route"), "finish", c("n").alias("field"), (c("member") % 13 == 0).alias("scratched"), F.when(c("member") % 3 > 0, c("m")).alias("implied"))
    target = f.where("finish = 1").select("card", "jockey", "day", c("surface").alias("today"), (c("n") >= 5).alias("long"))
    out = histories.start_features(target, starts, "jockey", "day", "today", "long", parts_of(spark, f.count()))
    return out.select("card", "days_since_start", "starts_90", "finish_share", "fit_n", "fit_share", "publicness", "attempts", "scratch_rate", "starts", "wins", "places", "shows", "excluded")


X19 = _then(DATED, """s AS (SELECT jockey, day AS date, surface, n >= 5 AS route, finish, n, member % 13 <> 0 AS live, CASE WHEN member % 3 > 0 THEN m END AS q, CASE WHEN member % 13 <> 0 AND n >= 2 THEN 1 - (finish - 1) / (n - 1) END AS sh FROM dated),
t AS (SELECT card, jockey, day, surface AS today, n >= 5 AS long_ FROM dated WHERE finish = 1),
j AS (SELECT t.card, t.today, t.long_, s.*, date_diff('day', date, day) AS ago FROM t LEFT JOIN s ON s.jockey = t.jockey AND s.date < t.day),
e AS (SELECT t.card, count(*) AS excluded FROM t JOIN s ON s.jockey = t.jockey AND s.date = t.day GROUP BY 1),
g AS (SELECT card, min(ago) FILTER (live) AS off, count(*) FILTER (live AND ago <= 90) AS s90, sum(exp(-0.01 * ago) * sh) AS p, sum(exp(-0.01 * ago)) FILTER (sh IS NOT NULL) AS w, count(sh) FILTER (ago <= 180) AS us, count(*) FILTER (live AND surface = today AND route = long_) AS fn,
  sum(exp(-0.01 * ago) * sh) FILTER (surface = today AND route = long_) AS fp, sum(exp(-0.01 * ago)) FILTER (sh IS NOT NULL AND surface = today AND route = long_) AS fw, sum(exp(-0.01 * ago) * q) FILTER (live) AS qq, sum(exp(-0.01 * ago)) FILTER (live AND q IS NOT NULL) AS qw,
  count(jockey) AS att, count(*) FILTER (live) AS st, count(*) FILTER (live AND finish = 1) AS wi, count(*) FILTER (live AND finish = 2) AS pl, count(*) FILTER (live AND finish = 3) AS so FROM j GROUP BY 1)""",
    "SELECT card, CAST(off AS INT) AS days_since_start, s90 AS starts_90, round(least(1, us / 5) * coalesce(p / w, 0.5) + (1 - least(1, us / 5)) * 0.5, 4) AS finish_share, fn AS fit_n, round((coalesce(fp, 0) + 1) / (coalesce(fw, 0) + 2), 4) AS fit_share, round((coalesce(qq, 0) + 0.3) / (coalesce(qw, 0) + 3), 4) AS publicness, att AS attempts, CASE WHEN att >= 3 THEN round(1 - st / att, 4) END AS scratch_rate, st AS starts, wi AS wins, pl AS places, so AS shows, coalesce(excluded, 0) AS excluded FROM g LEFT JOIN e USING (card)")


def x20_speed_figures(spark, d):
    """Members of some cards have figures of their own; suppliers of others have results; the rest are derived from places. id: card * 10^10 + member, one row's alone."""
    f = dated(spark, d)
    c = F.col
    id_ = (c("card") * ID + c("member")).alias("id")
    members = f.select(id_, "jockey", F.when(c("card") % 7 == 0, c("qty")).alias("last"), F.when(c("card") % 7 == 0, c("qty") + 3).alias("best"), F.when(c("card") % 14 == 0, c("qty") + 1).alias("avg"))
    results = f.where("jockey % 3 = 0").select("jockey", c("day").alias("time"), id_.alias("tie"), F.when(c("member") % 4 > 0, c("qty")).alias("figure"), (c("member") % 9 == 0).alias("scratched"))
    starts = f.where("card % 5 > 0").select(id_, F.explode(F.sequence(F.lit(1), c("n"))).alias("nth"), c("finish"), c("n").alias("field"))
    return histories.speed_figures(members, results, starts, "id", "jockey").select("id", *[F.round(x, 4).alias(x) for x in ("speed_last", "speed_best", "speed_avg")], "source")


X20 = _then(DATED, f"""m AS (SELECT card * {ID} + member AS id, jockey, n, finish, card, CASE WHEN card % 7 = 0 THEN qty END AS l, CASE WHEN card % 7 = 0 THEN qty + 3 END AS b, CASE WHEN card % 14 = 0 THEN qty + 1 END AS a FROM dated),
r5 AS (SELECT * FROM (SELECT jockey, qty AS x, row_number() OVER (PARTITION BY jockey ORDER BY day DESC, card * {ID} + member DESC) AS k FROM dated WHERE jockey % 3 = 0 AND member % 4 > 0 AND member % 9 > 0 AND qty <> 0) WHERE k <= 5),
r AS (SELECT jockey, max(CASE WHEN k = 1 THEN x END) AS l, max(x) AS b, round(avg(x), 1) AS a FROM r5 GROUP BY 1),
e AS (SELECT id, CASE WHEN card % 5 > 0 AND n >= 2 THEN 60 + 60 * (1 - (finish - 1) / (n - 1)) END AS x FROM m)""",
    "SELECT m.id, round(CASE WHEN m.l IS NOT NULL THEN m.l WHEN r.l IS NOT NULL THEN r.l ELSE x END, 4) AS speed_last, round(CASE WHEN m.l IS NOT NULL THEN m.b WHEN r.l IS NOT NULL THEN r.b ELSE x END, 4) AS speed_best, round(CASE WHEN m.l IS NOT NULL THEN m.a WHEN r.l IS NOT NULL THEN r.a ELSE round(x, 1) END, 4) AS speed_avg, CASE WHEN m.l IS NOT NULL THEN 'entries' WHEN r.l IS NOT NULL THEN 'results' WHEN x IS NOT NULL THEN 'derived' ELSE 'none' END AS source FROM m LEFT JOIN r USING (jockey) JOIN e USING (id)")

QUERIES = {
    "x17_workouts": (x17_workouts, X17),
    "x19_velocity": (x19_velocity, X19V),
    "x19_standalone": (x19_standalone, X19),
    "x20_speed_figures": (x20_speed_figures, X20),
}
