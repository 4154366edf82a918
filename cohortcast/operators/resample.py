"""Bootstrap intervals over groups, from mergeable sums.

Each group has a Poisson(1) weight in each resample, drawn from a hash of its key, so that tasks agree on the weights, sums
from different tasks add up, and a rerun gives the same intervals. A task keeps one array of `reps` weighted sums for each
measure and stratum and adds its groups to it as it reads; what is shuffled is a row for each stratum, resample and task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The cumulative Poisson(1) distribution.
CUTS = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 14)]))
ROWS, STRATA = 512, 256


def weights(keys: np.ndarray, reps: int) -> np.ndarray:
    """Poisson(1) weights of groups with these 64-bit hashes: a row for each group, a column for each resample."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] + np.arange(1, reps + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.searchsorted(CUTS, (x >> np.uint64(11)) * 2.0**-53, side="right").astype(np.float64)


def group_key(key: str, seed: int) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed))


def replicates(df: DataFrame, by: list[str], key: str, measures: list[str], reps: int = 2000, seed: int = 7) -> DataFrame:
    """(by, rep, and each measure's weighted sum): the resampled totals of each stratum. df has a row for each group; null measures count as 0."""
    head = df.select(*by, group_key(key, seed).alias("_key"), *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in measures])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in head.schema.fields[: len(by)])

    def add(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            strata = list(zip(*(batch.column(k).to_pylist() for k in range(len(by))))) if by else [()] * len(batch)
            keys = batch.column(len(by)).to_numpy().view(np.uint64)
            x = np.stack([batch.column(len(by) + 1 + k).to_numpy() for k in range(len(measures))], axis=1) if len(batch) else np.empty((0, len(measures)))
            number = {s: k for k, s in enumerate(dict.fromkeys(strata))}
            of = np.fromiter((number[s] for s in strata), np.int64, len(strata))
            for s, k in number.items():
                mine = np.flatnonzero(of == k)
                for lo in range(0, len(mine), ROWS):
                    at = mine[lo : lo + ROWS]
                    held[s] = held.get(s, 0) + x[at].T @ weights(keys[at], reps)
                if len(held) >= STRATA:
                    yield from told(held)
                    held = {}
        yield from told(held)

    def told(held):
        for s, sums in held.items():
            columns = [pa.array([v] * reps, kind) for v, kind in zip(s, types)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(reps, dtype=np.int32)), *map(pa.array, sums)], names=names)

    from pyspark.sql.pandas.types import to_arrow_schema

    names, types = [*by, "rep", *measures], list(to_arrow_schema(head.select(*by).schema).types)
    schema = ", ".join(filter(None, [kinds, "rep int", *[f"`{m}` double" for m in measures]]))
    return head.mapInArrow(add, schema).groupBy(*by, "rep").agg(*[F.sum(m).alias(m) for m in measures])


def intervals(df: DataFrame, by: list[str], key: str, ratios: dict[str, tuple[str, str | None]], reps: int = 2000, seed: int = 7, alpha: float = 0.05) -> DataFrame:
    """A row for each stratum: n, and for each name of `ratios` its estimate sum(num) / sum(den) (den None: the number of groups), <name>_lo and <name>_hi.

    Percentiles are of the resamples whose denominator isn't 0. df has a row for each group.
    """
    one = df.withColumn("_one", F.lit(1.0))
    measures = list(dict.fromkeys(c for num, den in ratios.values() for c in (num, den or "_one")))
    sums = replicates(one, by, key, measures, reps, seed)
    ratio = lambda num, den: F.when(F.col(den or "_one") != 0, F.col(num) / F.col(den or "_one"))
    ends = sums.groupBy(*by).agg(*[F.percentile(ratio(num, den), F.lit(q)).alias(f"{name}_{end}") for name, (num, den) in ratios.items() for q, end in ((alpha / 2, "lo"), (1 - alpha / 2, "hi"))])
    total = {name: F.sum(F.coalesce(F.col(num).cast("double"), F.lit(0.0))) / F.nullif(F.sum(F.coalesce(F.col(den or "_one").cast("double"), F.lit(0.0))), F.lit(0.0)) for name, (num, den) in ratios.items()}
    point = one.groupBy(*by).agg(F.count("*").alias("n"), *[e.alias(name) for name, e in total.items()])
    if not by:
        return point.join(ends)  # one row each
    on = [point[c].eqNullSafe(ends[c]) for c in by]
    return point.join(ends, on).select(*[point[c] for c in by], "n", *[c for name in ratios for c in (name, f"{name}_lo", f"{name}_hi")])
