"""Joins: as of a time, within a tolerance, in passes, and reconciling two sources."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, ts: str, take: list[str], tie: str, strict: bool = True, lag: str | None = None, max_age: str | None = None, bucket_days: float | None = None) -> DataFrame:
    """left with the columns `take` of the last right row before `at` (less `lag`; `strict`: not at it), null if none.

    Right rows and left rows are put in one order by key, and a running last value is taken, so that no pair of rows is formed,
    however many a key has. Of equal times the largest `tie` counts. Rows older than `max_age` before `at` are refused. Intervals are like "30 minutes".
    One shuffle by the keys; with `bucket_days` the order is by key and span of days, and each span's last row is carried to the next ones by a
    window over spans, one row each: a key with a large share of all rows is then no task of its own.
    """
    limit = F.col(at) - F.expr(f"interval {lag}") if lag else F.col(at)
    payload = F.struct(F.col(ts).alias("_ts"), *take)
    sides = left.select(*keys, limit.alias("_t"), F.lit(1 if strict else 3).alias("_o"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.struct(*left.columns).alias("_left"), F.lit(None).alias("_right"))
    rows = right.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("_t"), F.lit(2).alias("_o"), F.col(tie).alias("_tie"), F.lit(None).alias("_left"), payload.alias("_right"))
    both = sides.unionByName(rows)
    if bucket_days:
        both = both.withColumn("_span", F.floor(F.unix_micros(F.col("_t").cast("timestamp")) / F.lit(round(bucket_days * 86_400_000_000))))
    parts = [*keys, "_span"] if bucket_days else keys
    w = Window.partitionBy(*parts).orderBy("_t", "_o", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_right", ignorenulls=True).over(w)).where("_left IS NOT NULL")
    if bucket_days:
        ends = both.groupBy(*parts).agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.struct("_t", "_tie"))).alias("_end"))
        past = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*[F.col(c).alias(f"_key_{c}") for c in parts], F.last("_end", ignorenulls=True).over(past).alias("_before"))
        same = [found[c].eqNullSafe(carried[f"_key_{c}"]) for c in parts]
        found = found.join(carried, same, "left").withColumn("_last", F.coalesce("_last", "_before"))
    if max_age:
        found = found.withColumn("_last", F.when(F.col("_last._ts") >= F.col(f"_left.{at}") - F.expr(f"interval {max_age}"), F.col("_last")))
    return found.select("_left.*", *[F.col(f"_last.{c}").alias(c) for c in take], F.col("_last._ts").alias(f"as_of_{ts}"))


def complete_capture(captures: DataFrame, expected: DataFrame, group: str, member: str, batch: list[str], ts: str, price: str, parts: int | None = None) -> DataFrame:
    """Of each group the latest batch that quotes every expected member once, each at a price above 1.

    Two such batches of one time are a tie: the group gets none. Quotes and expected members are shuffled once, by group (into `parts`, if given); all else is windows within a group.
    """
    c, quotes = F.col, captures.withColumn("_quote", F.lit(True))
    both = quotes.unionByName(expected.select(group, member), allowMissingColumns=True).where(c(group).isNotNull())
    both = both.repartition(parts, group) if parts else both
    fact = c("_quote").isNotNull()
    by, once = Window.partitionBy(group), Window.partitionBy(group, member)
    known = both.withColumn("_known", F.max(~fact & c(member).isNotNull()).over(once)).withColumn("_want", F.size(F.collect_set(F.when(~fact, c(member))).over(by))).where(fact)
    of = Window.partitionBy(group, ts, *batch)
    sums = known.withColumns({"_n": F.count("*").over(of), "_distinct": F.size(F.collect_set(member).over(of)), "_hit": F.count_if("_known").over(of), "_ok": F.min(F.coalesce((c(price) > 1).cast("int"), F.lit(0))).over(of)})
    whole = sums.where("_want > 0 AND _n = _want AND _distinct = _want AND _hit = _want AND _ok = 1")
    best = whole.withColumn("_rank", F.rank().over(by.orderBy(F.desc(ts)))).where("_rank = 1").withColumn("_batches", F.size(F.collect_set(F.struct(*batch)).over(by)))
    known_batch = [c(x).isNotNull() for x in (ts, *batch)]
    return best.where("_batches = 1").where(functools.reduce(lambda a, b: a & b, known_batch)).select(*captures.columns)


def two_pass(left: DataFrame, right: DataFrame, full: list[str], partial: list[str], order: str, take: list[str]) -> DataFrame:
    """left with `take` of right by the full key, else by the partial one; the first right row of a key counts.
    match_type: full, partial or none. Rows of left with a null in a key don't match by it."""
    first = lambda keys: right.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_k = 1").select(*keys, F.struct(*take).alias("_p"))
    a = left.join(first(full).withColumnRenamed("_p", "_full"), full, "left")
    b = a.join(first(partial).withColumnRenamed("_p", "_part"), partial, "left")
    return b.select(*left.columns, *[F.coalesce(F.col("_full"), F.col("_part"))[c].alias(c) for c in take], F.when(F.col("_full").isNotNull(), "full").when(F.col("_part").isNotNull(), "partial").otherwise("none").alias("match_type"))


def within_days(target: DataFrame, history: DataFrame, key: str, at: str, date: str, days: int) -> DataFrame:
    """Pairs of a target and its entity's history of up to `days` before it, never on its day.

    The range is cut into buckets of `days`, each history row in its own and the next, so the join has an
    equality on (entity, bucket) and a hot entity is spread over its buckets.
    """
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / days)
    h = history.withColumn("_b", F.explode(F.array(bucket(F.col(date)), bucket(F.col(date)) + 1)))
    gap = F.datediff(F.col(at), F.col(date))
    return target.withColumn("_b", bucket(F.col(at))).join(h, [key, "_b"]).where((gap > 0) & (gap <= days)).drop("_b")


def near_value(a: DataFrame, b: DataFrame, keys: list[str], x: str, y: str, tolerance: float, pairs_of_a_part: int = 5_000_000) -> DataFrame:
    """Pairs of equal keys whose x and y differ by at most the tolerance; b's columns must not clash but for the keys.

    Cells of the tolerance's width are an equality. They are counted first: a cell with more than `pairs_of_a_part` candidates has its rows of a dealt to several parts, each with the
    cell's rows of b, and the parts are shuffled to as many tasks as their pairs need, since small tables can have many pairs.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance)
    by = [*keys, "_c"]
    left, wide = a.withColumn("_c", cell(x)), b.withColumn("_c", F.explode(F.array(*[cell(y) + k for k in (-1, 0, 1)])))
    cells = left.groupBy(*by).agg(F.count("*").alias("_na")).join(wide.groupBy(*by).agg(F.count("*").alias("_nb")), by)
    parts = cells.select(*by, F.ceil(F.col("_na") * F.col("_nb") / pairs_of_a_part).cast("int").alias("_parts"), (F.col("_na") * F.col("_nb")).alias("_pairs"))
    total = parts.agg(F.sum("_pairs")).first()[0] or 0
    tasks = max(a.sparkSession.sparkContext.defaultParallelism, math.ceil(total / (4 * pairs_of_a_part)))
    parts = parts.drop("_pairs")
    dealt = left.join(parts, by).withColumn("_part", F.pmod(F.xxhash64(*a.columns), F.col("_parts")).cast("int")).drop("_parts")
    met = wide.join(parts, by).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    pairs = dealt.repartition(tasks, *by, "_part").join(met.repartition(tasks, *by, "_part").hint("merge"), [*by, "_part"])
    return pairs.where(F.abs(F.col(x) - F.col(y)) <= tolerance).drop("_c", "_part")


def cohort_stats(df: DataFrame, target: DataFrame, keys: list[str], at: str, date: str, x: str, days: int = 90, least: int = 5) -> DataFrame:
    """target with mean and population deviation of x among rows of the same keys up to `days` before, null if fewer than `least`.

    Sums are taken by day first, so each key's window is over its days, one row each, however large the cohort.
    """
    number = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01"))
    day = df.groupBy(*keys, number(date).alias("_d")).agg(F.count(x).alias("_n"), F.sum(x).alias("_s"), F.sum(F.col(x) * F.col(x)).alias("_q"))
    asked = target.select(*keys, number(at).alias("_d")).distinct().select(*keys, "_d", F.lit(0).cast("long").alias("_n"), F.lit(None).cast("double").alias("_s"), F.lit(None).cast("double").alias("_q"))
    days_of = day.unionByName(asked).groupBy(*keys, "_d").agg(*[F.sum(c).alias(c) for c in ("_n", "_s", "_q")])
    before = Window.partitionBy(*keys).orderBy("_d").rangeBetween(-days, -1)
    sums = days_of.select(*keys, "_d", F.sum("_n").over(before).alias("_c"), F.sum("_s").over(before).alias("_a"), F.sum("_q").over(before).alias("_b"))
    enough, mean = F.col("_c") >= least, F.col("_a") / F.col("_c")
    stats = sums.where("_c > 0").select(*keys, "_d", F.col("_c").alias("cohort_n"), F.when(enough, mean).alias("cohort_mean"), F.when(enough, F.sqrt(F.greatest(F.col("_b") / F.col("_c") - mean * mean, F.lit(0.0)))).alias("cohort_sd"))
    return target.withColumn("_d", number(at)).join(stats, [*keys, "_d"], "left").drop("_d")


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """A row for each key of either side, with codes: MISSING_LEFT, MISSING_RIGHT, or DIFFERS_<column> (nulls differ from values)."""
    x = a.select(*keys, F.struct(*compare).alias("_a"))
    y = b.select(*keys, F.struct(*compare).alias("_b"))
    both = x.join(y, keys, "full_outer")
    there = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    codes = [F.when(F.col("_a").isNull(), "MISSING_LEFT"), F.when(F.col("_b").isNull(), "MISSING_RIGHT"), *[F.when(there & ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), f"DIFFERS_{c.upper()}") for c in compare]]
    return both.select(*keys, F.array_compact(F.array(*codes)).alias("codes")).withColumn("status", F.when(F.size("codes") == 0, "MATCHED").otherwise("REVIEW"))


def gap_fill(primary: DataFrame, secondary: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """primary with nulls in these columns filled from secondary, and for each column where its value is from."""
    s = secondary.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in columns])
    out = primary.join(s, keys, "left")
    for c in columns:
        out = out.withColumn(f"{c}_source", F.when(F.col(c).isNotNull(), "primary").when(F.col(f"_s_{c}").isNotNull(), "secondary")).withColumn(c, F.coalesce(c, f"_s_{c}"))
    return out.drop(*[f"_s_{c}" for c in columns])


def best_match(a: DataFrame, b: DataFrame, block: str, name_a: str, name_b: str, id_b: str, cutoff: float = 0.72) -> DataFrame:
    """Each row of a with the most similar name of b in its block: exact keys first, else similarity of at least the cutoff.
    Equal bests are ambiguous and give none. Blocks may be of any size: names meet through an index of their rarest letter pairs (`fuzzy.nearest_names`), and no join is broadcast."""
    from cohortcast.functions.text import squash_key
    from cohortcast.operators.fuzzy import nearest_names

    exact = b.groupBy(block, squash_key(F.col(name_b)).alias("_key")).agg(F.min(id_b).alias("_id"), F.count("*").alias("_n"))
    x = a.withColumn("_key", squash_key(F.col(name_a))).join(exact.where("_n = 1").hint("merge"), [block, "_key"], "left")
    names = b.select(block, squash_key(F.col(name_b)).alias("_name"), F.col(id_b).alias("_cid"))
    near = nearest_names(x.where("_id IS NULL").select(block, F.col("_key").alias("_name")), names.select(block, "_name"), block, "_name", cutoff)
    top = near.join(names.withColumnRenamed("_name", "match").hint("merge"), [block, "match"]).groupBy(block, F.col("_name").alias("_key")).agg(F.min("_cid").alias("_fid"), F.count_distinct("_cid").alias("_c"), F.max("similarity").alias("_s"))
    out = x.join(top.hint("merge"), [block, "_key"], "left").withColumn("_s", F.when(F.col("_id").isNull(), F.col("_s"))).withColumn("_c", F.when(F.col("_id").isNull(), F.col("_c")))
    how = F.when(F.col("_id").isNotNull(), "exact").when(F.col("_c") == 1, "fuzzy").when(F.col("_c") > 1, "ambiguous").otherwise("none")
    return out.select(*a.columns, F.coalesce("_id", F.when(F.col("_c") == 1, F.col("_fid"))).alias("match_id"), how.alias("match_type"), F.when(F.col("_id").isNotNull(), 1.0).otherwise(F.col("_s")).alias("match_score"))


def resolve_ladder(names: DataFrame, name: str, registry: DataFrame, reg_name: str, code: str, levels: list) -> DataFrame:
    """names with the code of the first level of keys (functions of a name column) at which exactly one code fits; a level with more is ambiguous."""
    out = names
    for k, level in enumerate(levels):
        keyed = registry.groupBy(level(F.col(reg_name)).alias("_key")).agg(F.min(code).alias(f"_c{k}"), F.count_distinct(code).alias(f"_n{k}"))
        out = out.withColumn("_key", level(F.col(name))).join(keyed, "_key", "left").drop("_key")
    found, status = F.lit(None), F.lit("UNMATCHED")
    for k in reversed(range(len(levels))):
        found = F.when(F.col(f"_n{k}") == 1, F.col(f"_c{k}")).when(F.col(f"_n{k}") > 1, None).otherwise(found)
        status = F.when(F.col(f"_n{k}") == 1, f"LEVEL_{k}").when(F.col(f"_n{k}") > 1, "AMBIGUOUS").otherwise(status)
    return out.select(*names.columns, found.alias("code"), status.alias("resolution"))


def with_grid(df: DataFrame, values: list[float], name: str) -> DataFrame:
    """Each row with each value of a short fixed grid (a parameter, not data)."""
    return df.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def harville(df: DataFrame, group: str, member: str, p: str) -> DataFrame:
    """Chances to come in the first two and the first three, from win chances, as arrays within each group.

    A field's members are gathered in an array: fields are small (a card), and must be for this to make sense.
    """
    field = df.groupBy(group).agg(F.collect_list(F.struct(F.col(member).alias("m"), F.col(p).cast("double").alias("p"))).alias("f"))

    def chances(f, x):
        rest = F.filter(f, lambda y: y["m"] != x["m"])
        second = F.aggregate(rest, F.lit(0.0), lambda a, y: a + F.when(y["p"] < 1, y["p"] * x["p"] / (1 - y["p"])).otherwise(0.0))
        third = F.aggregate(
            rest,
            F.lit(0.0),
            lambda a, y: a + F.aggregate(F.filter(rest, lambda z: z["m"] != y["m"]), F.lit(0.0), lambda b, z: b + F.when((1 - y["p"] - z["p"] > 1e-12) & (y["p"] < 1), y["p"] * z["p"] / (1 - y["p"]) * x["p"] / (1 - y["p"] - z["p"])).otherwise(0.0)),
        )
        place = F.when(F.size(f) <= 2, 1.0).otherwise(F.least(x["p"] + second, F.lit(1.0)))
        show = F.when(F.size(f) <= 3, 1.0).otherwise(F.least(x["p"] + second + third, F.lit(1.0)))
        return F.struct(x["m"].alias(member), x["p"].alias("win"), place.alias("place"), show.alias("show"))

    return field.select(group, F.inline(F.transform("f", lambda x: chances(F.col("f"), x))))


def by_distinct(df: DataFrame, column: str, out: str, value) -> DataFrame:
    """df with `out`, value(column) worked out once for each distinct value: for what is dear to read and often repeated. Nulls get value(null)."""
    known = df.select(column).where(F.col(column).isNotNull()).distinct().select(F.col(column).alias("_key"), value(F.col(column)).alias(out))
    there = df.join(known, F.col(column) == F.col("_key"), "left").drop("_key")
    return there.withColumn(out, F.when(F.col(column).isNull(), value(F.lit(None).cast("string"))).otherwise(F.col(out)))
