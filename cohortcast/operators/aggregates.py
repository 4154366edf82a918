"""Aggregates: rates, reliability, forecast scores, intervals, entropy measures and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(flag: Column) -> Column:
    """Share of rows where the flag holds; null flags count as not."""
    return F.avg(F.coalesce(flag.cast("double"), F.lit(0.0)))


def pair_stats(df: DataFrame, keys: list[str], finish: str) -> DataFrame:
    """starts, wins, in-the-money count and rates by keys."""
    f = F.col(finish)
    out = df.groupBy(*keys).agg(F.count("*").alias("starts"), F.count_if(f == 1).alias("wins"), F.count_if(f <= 3).alias("itm"))
    return out.withColumn("win_rate", F.round(F.col("wins") / F.col("starts"), 4)).withColumn("itm_rate", F.round(F.col("itm") / F.col("starts"), 4))


def breakdowns(df: DataFrame, dims: list[str], measures: dict[str, Column]) -> DataFrame:
    """The measures over each one-key grouping, in one pass: dimension, value (text), measures."""
    names = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for d in dims:
        names = F.when(F.grouping(d) == 0, d).otherwise(names)
        value = F.when(F.grouping(d) == 0, F.col(d).cast("string")).otherwise(value)
    return df.groupingSets([[d] for d in dims], *dims).agg(names.alias("dimension"), value.alias("value"), *[m.alias(k) for k, m in measures.items()]).drop(*dims)


def reliability(df: DataFrame, by: list[str], p: str, won: str, edges: list[float]) -> DataFrame:
    """For each bin [edge, next): members, mean probability, observed share. Empty bins are kept, with 0 members."""
    inner = edges[1:-1]
    bin_of = sum((F.when(F.col(p) >= e, 1).otherwise(0) for e in inner), F.lit(0))
    binned = df.withColumn("bin", bin_of).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(won).cast("double")).alias("observed"))
    frame = df.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 2))))
    return frame.join(binned, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_error(bins: DataFrame, by: list[str]) -> DataFrame:
    """Expected and greatest gap between mean probability and observed share."""
    gap = F.abs(F.col("mean_p") - F.col("observed"))
    return bins.where("n > 0").groupBy(*by).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("max_gap"))


def group_scores(df: DataFrame, group: str, forecast: str, p: str, won: str, floor: float = 1e-6) -> DataFrame:
    """A row for each (forecast, group): log loss of the winner, Brier, the winner's tie-averaged rank, split top-1 credit."""
    from cohortcast.operators.windows import average_rank

    ranked = average_rank(df, [forecast, group], p)
    tied = F.count("*").over(Window.partitionBy(forecast, group, F.round(p, 12)))
    top = F.when(F.col(p) >= F.max(p).over(Window.partitionBy(forecast, group)) - 1e-12, 1.0 / tied).otherwise(0.0)
    w = F.col(won).cast("double")
    return ranked.withColumn("_top", top).groupBy(forecast, group).agg(
        F.max(F.when(w == 1, -F.log(F.greatest(F.col(p), F.lit(floor))))).alias("log_loss"),
        F.sum((F.col(p) - w) * (F.col(p) - w)).alias("brier"),
        F.max(F.when(w == 1, F.col("avg_rank"))).alias("winner_rank"),
        F.sum(F.when(w == 1, F.col("_top")).otherwise(0.0)).alias("top1"),
        F.count("*").alias("field_size"),
    )


def summary(scores: DataFrame, forecast: str) -> DataFrame:
    """Means over groups for each forecast."""
    return scores.groupBy(forecast).agg(F.count("*").alias("groups"), *[F.avg(c).alias(f"mean_{c}") for c in ("log_loss", "brier", "winner_rank", "top1")])


#: Groups without which no verdict is given.
LEAST_GROUPS = 30


def paired(scores: DataFrame, group: str, forecast: str, a: str, b: str, gain: float = 0.01) -> DataFrame:
    """One row: differences a - b over groups that both have (negative: a is better), without resampling.

    n, mean_diff and sd of log loss, brier_diff, and needed: groups without which a gain of this share of b's log loss isn't seen (null if sd is 0 or n is 2 or less).
    """
    return _differences(scores, group, forecast, a, b).agg(F.count("*").alias("n"), F.avg("loss").alias("mean_diff"), F.coalesce(F.stddev_samp("loss"), F.lit(0.0)).alias("sd"), F.avg("brier").alias("brier_diff"), F.avg("reference").alias("_r")).withColumn(
        "needed", F.when((F.col("n") > 2) & (F.col("sd") > 0) & (F.col("_r") > 0), F.ceil(F.pow(1.96 * F.col("sd") / (gain * F.col("_r")), 2)))
    ).drop("_r")


def _differences(scores: DataFrame, group: str, forecast: str, a: str, b: str) -> DataFrame:
    x, y = (scores.where(F.col(forecast) == f).select(group, F.struct("log_loss", "brier").alias(n)) for f, n in ((a, "_a"), (b, "_b")))
    both = x.join(y, group).where("_a.log_loss IS NOT NULL AND _b.log_loss IS NOT NULL")
    return both.select(group, F.expr("_a.log_loss - _b.log_loss AS loss"), F.expr("_a.brier - _b.brier AS brier"), F.expr("_b.log_loss AS reference"))


def paired_verdict(scores: DataFrame, group: str, forecast: str, a: str, b: str, reps: int = 2000, seed: int = 7) -> DataFrame:
    """One row: n, and the differences of log loss and Brier score (a - b) with bootstrap intervals over groups, and the verdict that the interval of log loss allows."""
    from cohortcast.operators.resample import intervals

    out = intervals(_differences(scores, group, forecast, a, b), [], group, {"loss": ("loss", None), "brier": ("brier", None)}, reps, seed)
    verdict = F.when(F.col("n") < LEAST_GROUPS, "INSUFFICIENT_DATA").when(F.col("loss_hi") < 0, "BETTER_THAN_REFERENCE").when(F.col("loss_lo") > 0, "WORSE_THAN_REFERENCE").otherwise("NOT_DISTINGUISHABLE")
    return out.withColumn("verdict", verdict)


#: Groups under which a segment is called thin.
THIN = 10


def evaluation_cube(scores: DataFrame, group: str, forecast: str, dims: list[str], candidate: str, reference: str) -> DataFrame:
    """The whole and each value of each dimension, in one pass: dimension ("all" for the whole), value (text), groups, paired groups, mean log loss, Brier, top-1 and winner's rank of both
    forecasts over paired groups, their difference in log loss, and whether the segment is thin. scores: `group_scores` with the group's dims."""
    names = ["log_loss", "brier", "top1", "winner_rank"]
    of = lambda f, c: F.max(F.when(F.col(forecast) == f, F.col(c)))
    wide = scores.groupBy(group, *dims).agg(*[of(f, c).alias(f"{side}_{c}") for side, f in (("candidate", candidate), ("reference", reference)) for c in names])
    both = F.col("candidate_log_loss").isNotNull() & F.col("reference_log_loss").isNotNull()
    means = [F.avg(F.when(both, F.col(f"{side}_{c}"))).alias(f"{side}_{c}") for side in ("candidate", "reference") for c in names]
    dimension, value = F.lit("all"), F.lit(None).cast("string")
    for d in dims:
        dimension, value = F.when(F.grouping(d) == 0, d).otherwise(dimension), F.when(F.grouping(d) == 0, F.col(d).cast("string")).otherwise(value)
    out = wide.groupingSets([[], *[[d] for d in dims]], *dims).agg(dimension.alias("dimension"), value.alias("value"), F.count("*").alias("groups"), F.count_if(both).alias("paired"), *means)
    return out.drop(*dims).withColumn("delta_log_loss", F.col("candidate_log_loss") - F.col("reference_log_loss")).withColumn("thin", F.col("paired") < THIN)


def running_loss(scores: DataFrame, group: str, forecast: str, day: str, names: list[str]) -> DataFrame:
    """A row for each day: groups so far that have all the forecasts, and each forecast's mean log loss over them. A window goes over days, not over groups."""
    wide = scores.groupBy(group, day).agg(*[F.max(F.when(F.col(forecast) == f, F.col("log_loss"))).alias(f) for f in names])
    days = wide.where(" AND ".join(f"`{f}` IS NOT NULL" for f in names)).groupBy(day).agg(F.count("*").alias("_n"), *[F.sum(f).alias(f) for f in names])
    so_far = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return days.select(day, F.sum("_n").over(so_far).alias("groups"), *[(F.sum(f).over(so_far) / F.sum("_n").over(so_far)).alias(f) for f in names])


def bootstrap(df: DataFrame, by: list[str], key: str, num: str, den: Column | None = None, reps: int = 2000, seed: int = 7) -> DataFrame:
    """estimate, lo and hi: percentile interval of sum(num) / sum(den) (a mean, by default) over resampled groups. df has a row for each group, told by key."""
    from cohortcast.operators.resample import intervals

    rows = df.select(*by, key, F.col(num).alias("_num"), (den if den is not None else F.lit(1.0)).alias("_den"))
    out = intervals(rows, by, key, {"estimate": ("_num", "_den")}, reps, seed)
    return out.select(*by, "estimate", F.col("estimate_lo").alias("lo"), F.col("estimate_hi").alias("hi"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of a share."""
    p = hits / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, (mid - half) / (1 + z * z / n)), F.when(n > 0, (mid + half) / (1 + z * z / n))


def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name and the share of nulls, in one pass."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns))).alias("column_name", "null_rate"))


def decayed_mean(df: DataFrame, by: list[str], x: str, age_days: str, rate_a_day: float = 0.01) -> DataFrame:
    """Mean of x with weights exp(-rate * age)."""
    w = F.when(F.col(x).isNotNull(), F.exp(-rate_a_day * F.col(age_days)))
    return df.groupBy(*by).agg((F.sum(w * F.col(x)) / F.sum(w)).alias("decayed_mean"), F.count(x).alias("n"))


def shrunk(hits: Column, n: Column, weight: float, prior: float) -> Column:
    return (hits + weight * prior) / (n + weight)


def blended(x: Column, n: Column, enough: float, neutral: float = 0.5) -> Column:
    """x as far as n covers `enough`, the neutral value for the rest."""
    c = F.least(F.lit(1.0), n / enough)
    return c * F.coalesce(x, F.lit(neutral)) + (1 - c) * neutral


def entropy_measures(df: DataFrame, group: str, p: str, q: str) -> DataFrame:
    """A row for each group: entropy of p, that over the log of the field size, KL(p, q) and the Jensen-Shannon divergence."""
    plogp = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    m = (F.col(p) + F.col(q)) / 2
    out = df.groupBy(group).agg((-F.sum(plogp(F.col(p), F.lit(1.0)))).alias("entropy"), F.sum(plogp(F.col(p), F.greatest(F.col(q), F.lit(1e-12)))).alias("kl"), (F.sum(plogp(F.col(p), m)) / 2 + F.sum(plogp(F.col(q), m)) / 2).alias("js"), F.count("*").alias("n"))
    return out.withColumn("normal_entropy", F.when(F.col("n") > 1, F.col("entropy") / F.log("n")))


def kendall_tau(df: DataFrame, group: str, member: str, a: str, b: str) -> DataFrame:
    """Tau-b of two orders within each group. Groups are cards; a card's members meet in pairs, in an array, not by a join."""
    pairs = F.aggregate(
        F.sequence(F.lit(0), F.size("f") - 1),
        F.struct(F.lit(0).alias("s"), F.lit(0).alias("x"), F.lit(0).alias("y")),
        lambda acc, i: F.aggregate(
            F.slice("f", i + 2, F.size("f")),
            acc,
            lambda t, o: F.struct(
                (t["s"] + (F.signum(F.get("f", i)["a"] - o["a"]) * F.signum(F.get("f", i)["b"] - o["b"])).cast("int")).alias("s"),
                (t["x"] + (F.get("f", i)["a"] != o["a"]).cast("int")).alias("x"),
                (t["y"] + (F.get("f", i)["b"] != o["b"]).cast("int")).alias("y"),
            ),
        ),
    )
    field = df.groupBy(group).agg(F.collect_list(F.struct(F.col(a).alias("a"), F.col(b).alias("b"))).alias("f"))
    t = field.select(group, pairs.alias("t"))
    return t.select(group, F.when((F.col("t.x") > 0) & (F.col("t.y") > 0), F.col("t.s") / F.sqrt(F.col("t.x").cast("double") * F.col("t.y"))).alias("tau"))


def worst_status(df: DataFrame, by: list[str], status: str, order: list[str]) -> DataFrame:
    """Of each key the status that comes first in `order` (unknown ones last)."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(status)), F.lit(0))
    place = F.when(place == 0, len(order) + 1).otherwise(place)
    return df.groupBy(*by).agg(F.min_by(status, place).alias("worst"))


def _temperatures(grid: list[float], least_js: float, default: float):
    """For mapInArrow: (group, array of (x, q)) to (group, scale, mse); a batch's groups are tried together, one scale at a time."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            size = np.diff(b.column(1).offsets.to_numpy())
            flat = b.column(1).flatten()
            x, q = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            some = size > 0
            n = size[some]
            at = np.cumsum(n) - n
            scale, mse = np.full(len(n), default), np.full(len(n), np.inf)
            if len(n):
                total = lambda v: np.add.reduceat(v, at)
                each = lambda v: np.repeat(v, n)
                clipped = lambda v: (c := np.maximum(v, 1e-12)) / each(total(c))
                x, r = x - each(np.maximum.reduceat(x, at)), clipped(q)
                for t in grid:
                    e = np.exp(x * t)
                    p = e / each(total(e))
                    c = clipped(p)
                    js = total(c * np.log(2 * c / (c + r)) + r * np.log(2 * r / (c + r))) / 2
                    now = total((p - q) ** 2) / n
                    better = (js >= least_js) & (now < mse)
                    scale[better], mse[better] = t, now[better]
            scales, errors = np.full(len(size), default), np.full(len(size), np.inf)
            scales[some], errors[some] = scale, mse
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scales), pa.array(errors, mask=~np.isfinite(errors))], ["group", "scale", "mse"])

    return run


def grid_temperature(df: DataFrame, group: str, x: str, target: str, grid: list[float], least_js: float = 0.001, default: float = 1.0) -> DataFrame:
    """A row for each group: the softmax scale of the grid with the least squared error to target probabilities, the first of equal ones.

    A scale whose chances lie within `least_js` (Jensen-Shannon divergence) of the target doesn't count; the default where none does.
    Members without x or target take no part. A group's members are gathered once, in an array, which the grid then
    goes over: fields are small (a card), and neither rows nor shuffles grow with the grid.
    """
    members = F.when(F.col(x).isNotNull() & F.col(target).isNotNull(), F.struct(F.col(x).cast("double").alias("x"), F.col(target).cast("double").alias("q")))
    field = df.groupBy(F.col(group).alias("group")).agg(F.array_sort(F.collect_list(members)).alias("f"))
    out = field.mapInArrow(_temperatures([float(t) for t in grid], least_js, float(default)), f"group {field.schema['group'].dataType.simpleString()}, scale double, mse double")
    return out.withColumnRenamed("group", group)
