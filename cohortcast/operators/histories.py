"""Features of entities' histories, strictly before the day of the target: sums over spans, decayed sums, the last few rows, peers.

Histories are summed by entity and day, or carried along as the state of their last rows; a target looks up the state before
its day. No target meets the rows of its history, so a long history costs what it is long, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortcast.operators.joins import as_of, cohort_stats


def day_number(c) -> Column:
    return F.datediff(F.to_date(c), F.lit("1970-01-01"))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def running_sums(
    target: DataFrame, history: DataFrame, keys: list[str], at: str, date: str, sums: dict[str, Column], decayed: dict[str, Column] | None = None, spans: tuple[int, ...] = (), rate: float = 0.01, seen: Column | None = None, own: tuple[str, ...] = (), parts: int | None = None
) -> DataFrame:
    """target with sums over the rows of equal keys before its day: <name>, and <name>_<days> over the last so many days; for `decayed`, <name> with weights exp(-rate * age).
    days_off: days since the last row (of those that are `seen`). For names in `own`, <name>_own is the sum of the day itself. Nothing before: 0, days_off null. Null values count as 0;
    targets with a null day or key get 0.

    Targets go with the history in one shuffle by key (into so many parts), are carried by their day's row and come out of it again: no join, and days without a target end there.
    """
    decayed = decayed or {}
    named = {**sums, **decayed}
    asked = target.select(*keys, day_number(at).alias("_d"), F.lit(None).cast("int").alias("_seen"), *[F.lit(0.0).alias(f"_{n}") for n in named], F.struct(*target.columns).alias("_target"))
    some = F.lit(True) if seen is None else seen
    told = history.select(*keys, day_number(date).alias("_d"), F.when(some, 1).alias("_seen"), *[F.coalesce(x.cast("double"), F.lit(0.0)).alias(f"_{n}") for n, x in named.items()], F.lit(None).cast(asked.schema["_target"].dataType).alias("_target"))
    for k in keys:
        told = told.where(F.col(k).isNotNull())
    both = told.where("_d IS NOT NULL").unionByName(asked)
    both = both.repartition(parts, *keys) if parts else both.repartition(*keys)
    days = both.groupBy(*keys, "_d").agg(F.max("_seen").alias("_seen"), *[F.sum(f"_{n}").alias(f"_{n}") for n in named], F.collect_list("_target").alias("_targets"))
    order = Window.partitionBy(*keys).orderBy("_d")
    before = order.rangeBetween(Window.unboundedPreceding, -1)
    grown, age = F.exp(rate * F.col("_d")), F.exp(-rate * F.col("_d"))
    out = {n: F.sum(f"_{n}").over(before) for n in sums} | {f"{n}_{s}": F.sum(f"_{n}").over(order.rangeBetween(-s, -1)) for n in sums for s in spans} | {n: age * F.sum(grown * F.col(f"_{n}")).over(before) for n in decayed} | {f"{n}_own": F.col(f"_{n}") for n in own}
    last = F.max(F.when(F.col("_seen") == 1, F.col("_d"))).over(before)
    known = days.select("_targets", *[F.coalesce(x, F.lit(0.0)).alias(n) for n, x in out.items()], (F.col("_d") - last).alias("days_off"))
    return known.select(F.explode("_targets").alias("_target"), *out, "days_off").select("_target.*", *out, "days_off")


def last_rows_mean(target: DataFrame, history: DataFrame, keys: list[str], at: str, date: str, tie: str, x: str, k: int = 5, out: str = "last_mean") -> DataFrame:
    """target with the mean of x over the last k rows before its day that have it (of one day those of greater `tie`), and <out>_n, how many there are."""
    w = Window.partitionBy(*keys).orderBy(date, tie).rowsBetween(1 - k, 0)
    states = history.where(F.col(x).isNotNull()).select(*keys, date, tie, F.avg(x).over(w).alias(out), F.count(x).over(w).alias(f"{out}_n"))
    return as_of(target, states, keys, at, date, [out, f"{out}_n"], tie).drop(f"as_of_{date}").withColumn(f"{out}_n", F.coalesce(f"{out}_n", F.lit(0)))


def work_overlay(target: DataFrame, works: DataFrame, entity: str, at: str, rank_of: str = "last", peer_days: int = 90, least_peers: int = 5) -> DataFrame:
    """target with what its entity's works before its day say.

    works: entity, date, distance, seconds, location, surface, rank, of (how many were ranked), tie (unique). Works without distance or time
    count for rank_percentile only, which takes the last five with 0 <= rank <= of.
    Added: rank_percentile and rank_n; count_30; coverage (works of 60 days, three are whole); days_since_work; readiness_v2, from recency, cadence, progress in
    distance, rank (of the last work, or the best of 60 days) and time, blended to 0.5 by coverage; velocity_z: the last work's time against works of all
    entities at its place, surface and distance (two decimals) in the 90 days before the target, if there are five that differ; normalized.
    """
    c = F.col
    ranked = works.where("rank IS NOT NULL AND of > 0 AND rank >= 0 AND rank <= of").withColumn("_share", 1 - c("rank") / c("of"))
    timed = works.where("seconds IS NOT NULL AND distance IS NOT NULL").withColumn("_km", F.round("distance", 2))
    out = last_rows_mean(target, ranked, [entity], at, "date", "tie", "_share", 5, "rank_percentile").withColumnRenamed("rank_percentile_n", "rank_n")
    out = running_sums(out, timed, [entity], at, "date", {"_works": F.lit(1), "_far": c("distance")}, spans=(30, 60)).withColumnRenamed("days_off", "days_since_work")
    takes = ["_km", "distance", "seconds", "location", "surface", "rank"]
    out = as_of(out, timed.select(entity, "date", "tie", F.struct(*takes).alias("_last")), [entity], at, "date", ["_last"], "tie").drop("as_of_date")
    out = out.withColumn("_last", F.when(c("days_since_work") <= 60, c("_last")))
    best = timed.where("rank > 0").groupBy(entity, "date").agg(F.min("rank").alias("_rank"))
    peers = timed.select(c("location").alias("_place"), c("surface").alias("_ground"), c("_km").alias("_length"), "date", "seconds").where("_place IS NOT NULL")
    out = out.withColumns({"_place": c("_last.location"), "_ground": c("_last.surface"), "_length": c("_last._km")})
    out = cohort_stats(peers, out, ["_place", "_ground", "_length"], at, "date", "seconds", days=peer_days, least=least_peers)
    if rank_of == "best":
        asked = out.select(entity, c(at).alias("date")).distinct().withColumn("_rank", F.lit(None).cast(best.schema["_rank"].dataType))
        w = Window.partitionBy(entity).orderBy(day_number("date")).rangeBetween(-60, -1)
        days = best.unionByName(asked).groupBy(entity, "date").agg(F.min("_rank").alias("_rank")).select(entity, c("date").alias(at), F.min("_rank").over(w).alias("_chosen"))
        out = out.join(days, [entity, at], "left")
    else:
        out = out.withColumn("_chosen", c("_last.rank"))
    n, z = c("_works_60"), (c("_last.seconds") - c("cohort_mean")) / c("cohort_sd")
    velocity = F.when(c("_last").isNotNull() & (c("cohort_sd") > 1e-6), z)
    earlier = (c("_far_60") - c("_last.distance")) / (n - 1)
    progress = F.when(n >= 2, F.when(c("_last.distance") >= earlier - 1e-9, 0.65).otherwise(0.35)).otherwise(0.5)
    rank = F.when(c("_chosen") > 0, F.least(F.lit(1.0), 1 / c("_chosen"))).otherwise(0.5)
    time = F.coalesce(1 / (1 + F.exp(velocity)), F.lit(0.5))
    seen = 0.35 * F.exp(-c("days_since_work") / 30) + 0.30 * clamp(c("_works_30") / 3) + 0.20 * progress + 0.10 * rank + 0.05 * time
    cover = clamp(n / 3)
    ready = F.when(n > 0, clamp(cover * seen + (1 - cover) * 0.5))
    out = out.withColumns({"count_30": c("_works_30").cast("int"), "coverage": F.round(cover, 4), "velocity_z": F.round(velocity, 4), "normalized": velocity.isNotNull(), "readiness_v2": F.round(ready, 4), "rank_percentile": F.round(clamp(c("rank_percentile")), 4)})
    return out.withColumn("days_since_work", F.when(n > 0, c("days_since_work"))).select(*target.columns, "rank_percentile", "rank_n", "count_30", "coverage", "days_since_work", "readiness_v2", "velocity_z", "normalized")


def start_features(target: DataFrame, starts: DataFrame, entity: str, at: str, surface: str, route: str, parts: int | None = None) -> DataFrame:
    """target with what its entity's starts before its day say; target has today's surface and route (long distance or not).

    starts: entity, date, surface, route, finish, field, scratched, implied (chance by its price). Added: days_since_start, starts_90, finish_share (decayed share of rivals
    beaten, blended to 0.5 by coverage) and coverage, fit_n, fit_share (the same under today's conditions, shrunk to 0.5 by two), publicness (decayed chance, shrunk
    to 0.10 by three), attempts, scratch_rate (from three attempts on), career starts, wins, places, shows, and excluded (rows of the entity on the target's day).
    Each of the two shuffles, by entity and by entity and conditions, has so many parts.
    """
    from cohortcast.operators.features import beaten_share

    c = F.col
    live = ~F.coalesce(c("scratched"), F.lit(False))
    share = F.when(live, beaten_share(c("finish"), c("field")))
    one = lambda x: F.when(x, 1.0)
    recent = starts.withColumn("_share", share)
    known = c("_share").isNotNull()
    sums = {"_attempts": F.lit(1), "_starts": one(live), "_wins": one(live & (c("finish") == 1)), "_places": one(live & (c("finish") == 2)), "_shows": one(live & (c("finish") == 3)), "_usable": one(known)}
    odds = live & c("implied").isNotNull()
    weights = {"_p": c("_share"), "_w": one(known), "_q": F.when(odds, c("implied")), "_v": one(odds)}
    fit = recent.where(live).withColumnsRenamed({"surface": surface, "route": route})
    out = running_sums(target, fit, [entity, surface, route], at, "date", {"_fit": F.lit(1)}, {"_fp": c("_share"), "_fw": one(known)}, parts=parts).drop("days_off")
    out = running_sums(out, recent, [entity], at, "date", sums, weights, spans=(90, 180), seen=live, own=("_attempts",), parts=parts).withColumnRenamed("days_off", "days_since_start")
    cover = F.least(F.lit(1.0), c("_usable_180") / 5)
    seen = F.when(c("_w") > 0, c("_p") / c("_w")).otherwise(0.5)
    whole = lambda x: c(x).cast("long")
    return out.select(
        *target.columns, "days_since_start", whole("_starts_90").alias("starts_90"), F.round(cover * seen + (1 - cover) * 0.5, 4).alias("finish_share"), F.round(cover, 4).alias("coverage"), whole("_fit").alias("fit_n"), F.round((c("_fp") + 1.0) / (c("_fw") + 2), 4).alias("fit_share"),
        F.round((c("_q") + 0.3) / (c("_v") + 3), 4).alias("publicness"), whole("_attempts").alias("attempts"), F.when(c("_attempts") >= 3, F.round(1 - c("_starts") / c("_attempts"), 4)).alias("scratch_rate"),
        whole("_starts").alias("starts"), whole("_wins").alias("wins"), whole("_places").alias("places"), whole("_shows").alias("shows"), whole("_attempts_own").alias("excluded"),
    )


def speed_figures(members: DataFrame, results: DataFrame, starts: DataFrame, member: str, entity: str) -> DataFrame:
    """members with speed_last, speed_best, speed_avg and their source: the member's own figures, else the entity's last five result figures (by time, then tie),
    else 60 + 60 * share of rivals beaten in the member's last five starts (by nth); null and "none" if nothing is known. The last two are means of one digit.

    members: member, entity, last, best, avg. results: entity, time, tie, figure, scratched. starts: member, nth, finish, field.
    """
    from cohortcast.operators.features import beaten_share

    five = lambda w: (F.row_number().over(w) <= 5)
    kept = results.where(~F.coalesce("scratched", F.lit(False)) & (F.coalesce("figure", F.lit(0)) != 0)).withColumn("_five", five(Window.partitionBy(entity).orderBy(F.desc("time"), F.desc("tie")))).where("_five")
    by_entity = kept.groupBy(entity).agg(F.struct(F.max_by("figure", F.struct("time", "tie")).cast("double").alias("last"), F.max("figure").cast("double").alias("best"), F.round(F.avg("figure"), 1).alias("avg")).alias("_results"))
    score = 60 + 60 * beaten_share(F.col("finish"), F.col("field"))
    scored = starts.withColumn("_five", five(Window.partitionBy(member).orderBy("nth"))).where("_five").withColumn("_x", score).where("_x IS NOT NULL")
    by_member = scored.groupBy(member).agg(F.struct(F.min_by("_x", "nth").alias("last"), F.max("_x").alias("best"), F.round(F.avg("_x"), 1).alias("avg")).alias("_derived"))
    own = F.when(F.coalesce("last", "best", "avg").isNotNull(), F.struct(F.col("last").cast("double").alias("last"), F.col("best").cast("double").alias("best"), F.col("avg").cast("double").alias("avg")))
    out = members.join(by_entity, entity, "left").join(by_member, member, "left").withColumn("_own", own).withColumn("_x", F.coalesce("_own", "_results", "_derived"))
    source = F.when(F.col("_own").isNotNull(), "entries").when(F.col("_results").isNotNull(), "results").when(F.col("_derived").isNotNull(), "derived").otherwise("none")
    return out.select(member, entity, F.col("_x.last").alias("speed_last"), F.col("_x.best").alias("speed_best"), F.col("_x.avg").alias("speed_avg"), source.alias("source"))
