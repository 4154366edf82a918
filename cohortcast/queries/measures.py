"""Queries that aggregate: rates, breakdowns, reliability, scores, intervals, entropy, audits, normalisers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortcast.functions import odds, text
from cohortcast.operators import aggregates as agg
from cohortcast.queries.frames import DATED, FIELD, dated, field, table, with_sql

r = lambda c, k=6: F.round(c, k).alias(c)


def a01_pair_stats(spark, d):
    return agg.pair_stats(dated(spark, d), ["jockey", "surface"], "finish")


def a04_breakdowns(spark, d):
    f = dated(spark, d).where("finish = 1")
    return agg.breakdowns(f, ["surface", "class", "n"], {"cards": F.count("*"), "hit_rate": F.round(F.avg((F.col("post") == 1).cast("double")), 6), "mean_p": F.round(F.avg("p"), 6)})


A04 = with_sql(DATED, "SELECT CASE WHEN grouping(surface) = 0 THEN 'surface' WHEN grouping(class) = 0 THEN 'class' ELSE 'n' END AS dimension, coalesce(surface, class, n::VARCHAR) AS value, count(*) AS cards, round(avg((post = 1)::INT), 6) AS hit_rate, round(avg(p), 6) AS mean_p FROM dated WHERE finish = 1 GROUP BY GROUPING SETS ((surface), (class), (n))")
EDGES = [0.0, 0.05, 0.10, 0.20, 0.30, 0.50, 0.75, 1.0]


def _long(f):
    both = F.array(F.struct(F.lit("price").alias("forecast"), F.round("p", 12).alias("p")), F.struct(F.lit("market").alias("forecast"), F.round("m", 12).alias("p")), F.struct(F.lit("uniform").alias("forecast"), F.round(1 / F.col("n"), 12).alias("p")))
    return f.select("card", "member", "n", (F.col("finish") == 1).alias("won"), F.explode(both).alias("_b")).select("card", "member", "n", "won", "_b.*")


LONG = FIELD + """,
long AS (SELECT card, member, n, finish = 1 AS won, 'price' AS forecast, round(p, 12) AS p FROM field UNION ALL SELECT card, member, n, finish = 1, 'market', round(m, 12) FROM field UNION ALL SELECT card, member, n, finish = 1, 'uniform', round(1 / n, 12) FROM field)"""
SCORES = LONG + """,
ranked AS (SELECT *, rank() OVER (PARTITION BY forecast, card ORDER BY p DESC) + (count(*) OVER (PARTITION BY forecast, card, p) - 1) / 2 AS ar, count(*) OVER (PARTITION BY forecast, card, p) AS tied, max(p) OVER (PARTITION BY forecast, card) AS best FROM long),
scores AS (SELECT forecast, card, max(CASE WHEN won THEN -ln(greatest(p, 1e-6)) END) AS log_loss, sum((p - won::INT) * (p - won::INT)) AS brier, max(CASE WHEN won THEN ar END) AS winner_rank, sum(CASE WHEN won AND p >= best - 1e-12 THEN 1 / tied ELSE 0 END) AS top1, count(*) AS field_size FROM ranked GROUP BY 1, 2)"""


def a06_reliability(spark, d):
    return agg.reliability(_long(field(spark, d)), ["forecast"], "p", "won", EDGES).select("forecast", "bin", "n", r("mean_p"), r("observed"))


A06 = with_sql(LONG, f", b AS (SELECT *, CAST({' + '.join(f'(p >= {e})::INT' for e in EDGES[1:-1])} AS INT) AS bin FROM long), f AS (SELECT DISTINCT forecast, unnest(range(0, {len(EDGES) - 1}))::INT AS bin FROM long), g AS (SELECT forecast, bin, count(*) AS n, avg(p) AS mean_p, avg(won::INT) AS observed FROM b GROUP BY 1, 2) SELECT f.forecast, f.bin, coalesce(n, 0) AS n, round(mean_p, 6) AS mean_p, round(observed, 6) AS observed FROM f LEFT JOIN g ON f.forecast = g.forecast AND f.bin = g.bin").replace("\n, b AS", ",\nb AS", 1)


def a06_calibration_error(spark, d):
    bins = agg.reliability(_long(field(spark, d)), ["forecast"], "p", "won", EDGES)
    return agg.calibration_error(bins, ["forecast"]).select("forecast", r("ece"), r("max_gap"))


def e02_group_scores(spark, d):
    return agg.group_scores(_long(field(spark, d)), "card", "forecast", "p", "won").select("card", "forecast", r("log_loss"), F.round("brier", 9).alias("brier"), r("winner_rank"), r("top1"), "field_size")


def a09_summary(spark, d):
    s = agg.summary(agg.group_scores(_long(field(spark, d)), "card", "forecast", "p", "won"), "forecast")
    return s.select("forecast", "groups", *[r(c, 5) for c in s.columns if c.startswith("mean_")])


def _dated_scores(spark, d):
    f = dated(spark, d)
    cards = f.groupBy("card").agg(F.min("day").alias("day"), F.min("class").alias("family"), F.when(F.max("n") < 3, "small").when(F.max("n") < 6, "medium").otherwise("large").alias("size"), F.min("surface").alias("ground"))
    return agg.group_scores(_long(f), "card", "forecast", "p", "won").join(cards, "card")


def e03_evaluation(spark, d):
    """The market's forecasts against those by price: all cards, by family, by size of the field and by ground."""
    cube = agg.evaluation_cube(_dated_scores(spark, d), "card", "forecast", ["family", "size", "ground"], "market", "price")
    return cube.select("dimension", "value", "groups", "paired", "thin", *[r(c, 5) for c in cube.columns if c.startswith(("candidate", "reference", "delta"))])


CARDS = "cards AS (SELECT card, min(day) AS day, min(class) AS family, CASE WHEN max(n) < 3 THEN 'small' WHEN max(n) < 6 THEN 'medium' ELSE 'large' END AS size, min(surface) AS ground FROM (SELECT f.*, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS class FROM field f JOIN orders ON o_orderkey = card) GROUP BY 1)"
_MEANS = ", ".join(f"round(avg(CASE WHEN ok THEN {s}.{c} END), 5) AS {n}_{c}" for n, s in (("candidate", "a"), ("reference", "b")) for c in ("log_loss", "brier", "top1", "winner_rank"))
E03 = with_sql(SCORES + ",\n" + CARDS, f""", k AS (SELECT cards.*, a, b, a.log_loss IS NOT NULL AND b.log_loss IS NOT NULL AS ok FROM cards JOIN scores a ON a.card = cards.card AND a.forecast = 'market' JOIN scores b ON b.card = cards.card AND b.forecast = 'price')
SELECT CASE WHEN grouping(family) = 0 THEN 'family' WHEN grouping(size) = 0 THEN 'size' WHEN grouping(ground) = 0 THEN 'ground' ELSE 'all' END AS dimension, coalesce(family, size, ground) AS value, count(*) AS groups, count(*) FILTER (ok) AS paired, count(*) FILTER (ok) < 10 AS thin, {_MEANS},
  round(avg(CASE WHEN ok THEN a.log_loss END) - avg(CASE WHEN ok THEN b.log_loss END), 5) AS delta_log_loss FROM k GROUP BY GROUPING SETS ((), (family), (size), (ground))""").replace("\n, k AS", ",\nk AS", 1)


def e03_running(spark, d):
    return agg.running_loss(_dated_scores(spark, d), "card", "forecast", "day", ["market", "price"]).select("day", "groups", r("market", 5), r("price", 5))


E03R = with_sql(SCORES + ",\n" + CARDS, ", w AS (SELECT day, count(*) AS n, sum(a.log_loss) AS a, sum(b.log_loss) AS b FROM cards JOIN scores a ON a.card = cards.card AND a.forecast = 'market' JOIN scores b ON b.card = cards.card AND b.forecast = 'price' WHERE a.log_loss IS NOT NULL AND b.log_loss IS NOT NULL GROUP BY 1) SELECT day, CAST(sum(n) OVER o AS BIGINT) AS groups, round(sum(a) OVER o / sum(n) OVER o, 5) AS market, round(sum(b) OVER o / sum(n) OVER o, 5) AS price FROM w WINDOW o AS (ORDER BY day)").replace("\n, w AS", ",\nw AS", 1)


def a11_paired(spark, d):
    s = agg.group_scores(_long(field(spark, d)), "card", "forecast", "p", "won")
    return agg.paired(s, "card", "forecast", "market", "price").select("n", r("mean_diff"), r("sd"), r("brier_diff"), "needed")


A11 = with_sql(SCORES, "SELECT n, round(md, 6) AS mean_diff, round(sd, 6) AS sd, round(bd, 6) AS brier_diff, CAST(ceil((1.96 * sd / (0.01 * rf)) ** 2) AS BIGINT) AS needed FROM (SELECT count(*) AS n, avg(a.log_loss - b.log_loss) AS md, stddev_samp(a.log_loss - b.log_loss) AS sd, avg(a.brier - b.brier) AS bd, avg(b.log_loss) AS rf FROM scores a JOIN scores b ON a.card = b.card AND a.forecast = 'market' AND b.forecast = 'price')")


def a11_verdict(spark, d):
    """Differences of two forecasts with intervals from 2,000 resamples of cards."""
    s = agg.group_scores(_long(field(spark, d)), "card", "forecast", "p", "won")
    return agg.paired_verdict(s, "card", "forecast", "market", "price")


def a12_bootstrap(spark, d):
    """How often the first post wins, by surface, with intervals from 2,000 resamples of cards."""
    f = field(spark, d).where("finish = 1").withColumn("hit", (F.col("post") == 1).cast("double"))
    return agg.bootstrap(f, ["surface"], "card", "hit")


def a13_wilson(spark, d):
    f = dated(spark, d).groupBy("class").agg(F.count_if((F.col("finish") == 1) & (F.col("post") == 1)).alias("hits"), F.count_distinct("card").alias("n"))
    lo, hi = agg.wilson(F.col("hits"), F.col("n"))
    return f.select("class", "hits", "n", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


A13 = with_sql(DATED, ", c AS (SELECT class, count(*) FILTER (finish = 1 AND post = 1) AS hits, count(DISTINCT card) AS n FROM dated GROUP BY 1), w AS (SELECT *, hits / n AS q, 1.96 * 1.96 AS zz FROM c) SELECT class, hits, n, round((q + zz / (2 * n) - 1.96 * sqrt(q * (1 - q) / n + zz / (4 * n * n))) / (1 + zz / n), 6) AS lo, round((q + zz / (2 * n) + 1.96 * sqrt(q * (1 - q) / n + zz / (4 * n * n))) / (1 + zz / n), 6) AS hi FROM w").replace("\n, c AS", ",\nc AS", 1)


def a20_null_audit(spark, d):
    e = table(spark, d, "events").withColumn("big", F.when(F.col("value") > 50, F.col("value")))
    return agg.null_audit(e, ["event_id", "ts", "user_id", "event_type", "value", "big"]).select("column_name", r("null_rate"))


A20 = " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(({e} IS NULL)::INT), 6) AS null_rate FROM events" for c, e in [*((c, c) for c in ("event_id", "ts", "user_id", "event_type", "value")), ("big", "CASE WHEN value > 50 THEN value END")])


def a30_decayed(spark, d):
    o = table(spark, d, "orders").withColumn("age", F.datediff(F.lit("2000-01-01"), F.to_date("o_orderdate")))
    return agg.decayed_mean(o, ["o_custkey"], "o_totalprice", "age").select("o_custkey", r("decayed_mean", 3), "n")


def a31_shrunk(spark, d):
    f = agg.pair_stats(field(spark, d), ["jockey"], "finish")
    return f.select("jockey", F.round(agg.shrunk(F.col("wins"), F.col("starts"), 2, 0.5), 6).alias("rate"), F.round(agg.blended(F.col("itm_rate"), F.col("starts"), 500), 6).alias("blended"))


def a33_entropy(spark, d):
    e = agg.entropy_measures(field(spark, d), "card", "p", "m")
    return e.select("card", r("entropy"), r("kl"), r("js"), r("normal_entropy"))


A33 = with_sql(FIELD, "SELECT card, round(-sum(p * ln(p)), 6) AS entropy, round(sum(p * ln(p / greatest(m, 1e-12))), 6) AS kl, round(sum(p * ln(p / ((p + m) / 2))) / 2 + sum(m * ln(m / ((p + m) / 2))) / 2, 6) AS js, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) END, 6) AS normal_entropy FROM field GROUP BY 1")


def a33_kendall(spark, d):
    return agg.kendall_tau(field(spark, d).withColumn("x", F.round("p", 12)).withColumn("y", F.round("m", 12)), "card", "member", "x", "y").select("card", r("tau"))


A33K = with_sql(FIELD, ", f AS (SELECT card, member, round(p, 12) AS x, round(m, 12) AS y FROM field), t AS (SELECT a.card, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, sum((a.x <> b.x)::INT) AS u, sum((a.y <> b.y)::INT) AS v FROM f a JOIN f b ON a.card = b.card AND a.member < b.member GROUP BY 1) SELECT DISTINCT f.card, round(CASE WHEN u > 0 AND v > 0 THEN s / sqrt(u::DOUBLE * v) END, 6) AS tau FROM f LEFT JOIN t USING (card)").replace("\n, f AS", ",\nf AS", 1)


def a35_grid(spark, d):
    grid = [0.25 + 3.75 * k / 199 for k in range(200)]
    return agg.grid_temperature(field(spark, d), "card", "p", "m", grid).select("card", r("scale", 2), r("mse", 5))


def a37_worst_status(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("s"))
    return agg.worst_status(l, ["l_orderkey"], "s", ["RF", "AF", "NF", "NO", "AO", "RO"])


def a19_distinct(spark, d):
    return dated(spark, d).groupBy("class").agg(F.count_distinct("card").alias("cards"), F.count_distinct("day").alias("days"), F.count_distinct("owner").alias("owners"))


def a05_slices(spark, d):
    e = table(spark, d, "events").withColumn("band", F.when(F.col("value") < 20, "low").when(F.col("value") < 60, "mid"))
    return e.groupBy("event_type", "band").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))


def a27_progress(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("have"), F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("span"), F.max(F.to_date("o_orderdate")).alias("today"))
    need = 5000
    return o.select("o_orderpriority", "have", F.round(7 * F.col("have") / F.col("span"), 4).alias("per_week"), F.when(F.col("have") >= need, F.col("today")).otherwise(F.date_add("today", F.ceil((need - F.col("have")) / (F.col("have") / F.col("span"))).cast("int"))).alias("projected"))


A27 = "SELECT o_orderpriority, h AS have, round(7 * h / s, 4) AS per_week, CASE WHEN h >= 5000 THEN t ELSE t + CAST(ceil((5000 - h) / (h / s)) AS INT) END AS projected FROM (SELECT o_orderpriority, count(*) AS h, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS s, CAST(max(o_orderdate) AS DATE) AS t FROM orders GROUP BY 1)"


def f01_odds_text(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), "l_partkey")
    k = F.col("l_partkey") % 5
    raw = F.when(k == 0, F.concat(F.col("q").cast("string"), F.lit("/"), (F.col("l_linenumber") + 1).cast("string"))).when(k == 1, F.concat(F.lit("+"), (F.col("q") * 10 + 100).cast("string"))).when(k == 2, F.concat(F.lit("-"), (F.col("q") * 5 + 100).cast("string"))).when(k == 3, F.concat((F.col("q") + 1).cast("string"), F.lit(".5"))).otherwise("n/a")
    dec = odds.text_to_decimal(F.col("raw"))
    return l.withColumn("raw", raw).groupBy("raw").agg(F.count("*").alias("rows")).select("raw", "rows", F.round(dec, 6).alias("decimal"), F.round(odds.implied(dec), 6).alias("implied"))


F01 = """WITH l AS (SELECT CAST(l_quantity AS INT) AS q, l_linenumber AS k, l_partkey % 5 AS c FROM lineitem), x AS (SELECT CASE c WHEN 0 THEN q || '/' || (k + 1) WHEN 1 THEN '+' || (q * 10 + 100) WHEN 2 THEN '-' || (q * 5 + 100) WHEN 3 THEN (q + 1) || '.5' ELSE 'n/a' END AS raw,
CASE c WHEN 0 THEN 1 + q / (k + 1) WHEN 1 THEN 1 + (q * 10 + 100) / 100 WHEN 2 THEN 1 + 100 / (q * 5 + 100) WHEN 3 THEN q + 1.5 END AS d FROM l) SELECT raw, count(*) AS rows, round(CAST(any_value(d) AS DOUBLE), 6) AS decimal, round(1 / CAST(any_value(d) AS DOUBLE), 6) AS implied FROM x GROUP BY raw"""


#: Spellings of distances, and their furlongs.
SPELLINGS = [("Six Furlongs", 6.0), ("Five And One Half Furlongs", 5.5), ("One And One Sixteenth Miles", 8.5), ("One Mile And Seventy Yards", 8.3182), ("About Seven Furlongs", 7.0), ("Three Hundred Yards", None), ("Two Hundreds", None), ("Three Hundredths", None), ("Four Miles Two", None), ("One Mile", 8.0), ("Seven Eighths", None), ("One And Three Quarters Miles", 14.0), ("Forty Five Yards", 0.2045), ("Half Mile", None), ("Zero Furlongs", None), ("Two Miles And One Eighth Mile", 17.0)]


def f21_spelled(spark, d):
    """Parts' names with a spelled distance behind them; each distinct text is read once."""
    from cohortcast.functions.text import spelled_furlongs
    from cohortcast.operators.joins import by_distinct

    texts = F.element_at(F.array(*[F.lit(t) for t, _ in SPELLINGS]), (F.col("p_size") % len(SPELLINGS) + 1).cast("int"))
    p = table(spark, d, "part").select("p_partkey", texts.alias("spelled"))
    return by_distinct(p, "spelled", "furlongs", spelled_furlongs)


F21 = "SELECT p_partkey, t AS spelled, f AS furlongs FROM part JOIN (VALUES " + ", ".join(f"({k}, '{t}', {'NULL' if f is None else f}::DOUBLE)" for k, (t, f) in enumerate(SPELLINGS)) + f") v(k, t, f) ON k = p_size % {len(SPELLINGS)}"


def f19_zones(spark, d):
    """Customers' states and hours from Pacific time, and the zones that both agree on."""
    from cohortcast.functions.text import zone

    states = F.element_at(F.array(*map(F.lit, ZONE_STATES)), (F.col("c_custkey") % len(ZONE_STATES) + 1).cast("int"))
    c = table(spark, d, "customer").select(states.alias("state"), (F.col("c_custkey") % 4).alias("hours"))
    return c.groupBy("state", "hours", zone(F.col("state"), F.col("hours")).alias("zone")).agg(F.count("*").alias("customers"))


ZONE_STATES = ["NY", "CA", "KY", "TX", "AZ", "OR", "IN", "CO", "HI"]
_AGREED = "('NY', 3, 'America/New_York'), ('CA', 0, 'America/Los_Angeles'), ('KY', 3, 'America/New_York'), ('KY', 2, 'America/Chicago'), ('TX', 2, 'America/Chicago'), ('TX', 1, 'America/Denver'), ('AZ', 1, 'America/Phoenix'), ('OR', 0, 'America/Los_Angeles'), ('OR', 1, 'America/Boise'), ('IN', 3, 'America/Indiana/Indianapolis'), ('IN', 2, 'America/Chicago'), ('CO', 1, 'America/Denver')"
F19 = f"WITH c AS (SELECT list_extract({ZONE_STATES}, CAST(c_custkey % {len(ZONE_STATES)} + 1 AS BIGINT)) AS state, c_custkey % 4 AS hours FROM customer) SELECT c.state, c.hours, z AS zone, count(*) AS customers FROM c LEFT JOIN (VALUES {_AGREED}) v(s, h, z) ON s = c.state AND h = c.hours GROUP BY 1, 2, 3"


def f02_distance_text(spark, d):
    k = F.col("l_partkey") % 4
    q = F.col("l_quantity").cast("int").cast("string")
    raw = F.when(k == 0, F.concat(q, F.lit("f"))).when(k == 1, F.concat(q, F.lit(" 1/2 furlongs"))).when(k == 2, F.concat(q, F.lit(" 1/16 miles"))).otherwise(F.concat(q, F.lit("0 yards")))
    return table(spark, d, "lineitem").select(raw.alias("raw")).groupBy("raw").agg(F.count("*").alias("rows")).select("raw", "rows", F.round(text.furlongs(F.col("raw")), 6).alias("furlongs"))


F02 = """WITH x AS (SELECT CAST(l_quantity AS INT) AS q, l_partkey % 4 AS k FROM lineitem) SELECT CASE k WHEN 0 THEN q || 'f' WHEN 1 THEN q || ' 1/2 furlongs' WHEN 2 THEN q || ' 1/16 miles' ELSE q || '0 yards' END AS raw, count(*) AS rows,
round(any_value(CAST(CASE k WHEN 0 THEN q WHEN 1 THEN q + 0.5 WHEN 2 THEN 8 * (q + 0.0625) ELSE q * 10 / 220 END AS DOUBLE)), 6) AS furlongs FROM x GROUP BY 1"""


def f06_name_keys(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" (USA)")).alias("name"))
    return p.select("p_partkey", text.ascii_key(F.col("name")).alias("key"), text.squash_key(F.col("name")).alias("squash"))


QUERIES = {
    "a01_pair_stats": (a01_pair_stats, with_sql(DATED, "SELECT jockey, surface, count(*) AS starts, count(*) FILTER (finish = 1) AS wins, count(*) FILTER (finish <= 3) AS itm, round(count(*) FILTER (finish = 1) / count(*), 4) AS win_rate, round(count(*) FILTER (finish <= 3) / count(*), 4) AS itm_rate FROM dated GROUP BY 1, 2")),
    "a04_breakdowns": (a04_breakdowns, A04),
    "a05_slices": (a05_slices, "SELECT event_type, CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'mid' END AS band, count(*) AS n, round(avg(value), 4) AS mean_value FROM events GROUP BY 1, 2"),
    "a06_reliability": (a06_reliability, A06),
    "a06_calibration_error": (a06_calibration_error, with_sql(LONG, f"SELECT forecast, round(sum(abs(mp - ob) * n) / sum(n), 6) AS ece, round(max(abs(mp - ob)), 6) AS max_gap FROM (SELECT forecast, {' + '.join(f'(p >= {e})::INT' for e in EDGES[1:-1])} AS bin, count(*) AS n, avg(p) AS mp, avg(won::INT) AS ob FROM long GROUP BY 1, 2) GROUP BY 1")),
    "e02_group_scores": (e02_group_scores, with_sql(SCORES, "SELECT card, forecast, round(log_loss, 6) AS log_loss, round(brier, 9) AS brier, round(winner_rank, 6) AS winner_rank, round(top1, 6) AS top1, field_size FROM scores")),
    "a09_summary": (a09_summary, with_sql(SCORES, "SELECT forecast, count(*) AS groups, round(avg(log_loss), 5) AS mean_log_loss, round(avg(brier), 5) AS mean_brier, round(avg(winner_rank), 5) AS mean_winner_rank, round(avg(top1), 5) AS mean_top1 FROM scores GROUP BY 1")),
    "a11_paired": (a11_paired, A11),
    "a11_verdict": (a11_verdict, None),
    "e03_evaluation": (e03_evaluation, E03),
    "e03_running": (e03_running, E03R),
    "a12_bootstrap": (a12_bootstrap, None),
    "a13_wilson": (a13_wilson, A13),
    "a19_distinct": (a19_distinct, with_sql(DATED, "SELECT class, count(DISTINCT card) AS cards, count(DISTINCT day) AS days, count(DISTINCT owner) AS owners FROM dated GROUP BY 1")),
    "a20_null_audit": (a20_null_audit, A20),
    "a27_progress": (a27_progress, A27),
    "a30_decayed": (a30_decayed, "SELECT o_custkey, round(sum(w * o_totalprice) / sum(w), 3) AS decayed_mean, count(*) AS n FROM (SELECT *, exp(-0.01 * date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01')) AS w FROM orders) GROUP BY 1"),
    "a31_shrunk": (a31_shrunk, with_sql(FIELD, "SELECT jockey, round((w + 1.0::DOUBLE) / (s + 2), 6) AS rate, round(least(1, s / 500) * i + (1 - least(1, s / 500)) * 0.5, 6) AS blended FROM (SELECT jockey, count(*) AS s, count(*) FILTER (finish = 1) AS w, round(count(*) FILTER (finish <= 3) / count(*), 4) AS i FROM field GROUP BY 1)")),
    "a33_entropy": (a33_entropy, A33),
    "a33_kendall": (a33_kendall, A33K),
    "a35_grid": (a35_grid, None),
    "a37_worst_status": (a37_worst_status, "SELECT l_orderkey, arg_min(l_returnflag || l_linestatus, CASE l_returnflag || l_linestatus WHEN 'RF' THEN 1 WHEN 'AF' THEN 2 WHEN 'NF' THEN 3 WHEN 'NO' THEN 4 WHEN 'AO' THEN 5 WHEN 'RO' THEN 6 END) AS worst FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem) GROUP BY 1"),
    "f01_odds_text": (f01_odds_text, F01),
    "f02_distance_text": (f02_distance_text, F02),
    "f19_zones": (f19_zones, F19),
    "f21_spelled": (f21_spelled, F21),
    "f06_name_keys": (f06_name_keys, "SELECT p_partkey, trim(regexp_replace(upper(p_name), '[^A-Z0-9]+', ' ', 'g')) AS key, regexp_replace(upper(p_name), '[^A-Z0-9]+', '', 'g') AS squash FROM part"),
}
