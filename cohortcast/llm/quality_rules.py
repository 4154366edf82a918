"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Each text gives a vector of transformed statistics. Per (language, source) the minimum covariance
determinant estimate is sought by concentration steps: the share `alpha` of vectors with the least Mahalanobis
distance is found (by percentile sketches, which all tasks merge), their mean and covariance are taken (by sums,
which all tasks merge), and again until the determinant falls no more. Three starts are followed: medians and
quartiles, mean and covariance, and the correlation of hyperbolic tangents; the least determinant wins.
Covariances get the consistency factor of that share and a floor per statistic, well under its range, so that a
statistic which most texts have at zero can't make the estimate singular. A text is rejected beyond the
chi-square quantile `quantile`.

Small groups, by definition: a (language, source) of fewer than `least` vectors is judged by the estimate of its
language's such groups together; where those too have fewer, by that of all languages' together; and where
even these have fewer than `fewest` vectors, by none: then the fixed limits alone decide.

Estimates are a row a group and start; distances are plain columns, so no vector leaves its task, whatever
share one source has. Everything is DataFrame functions.

Null, empty and blank texts have no words and fail the fixed limits. Null languages and sources are a
group of their own. Repeated rows count as often as they occur. Empty tables give empty results. Columns of
docs keep their values, whatever their names, but for those that have the name of a result: these are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import BLANKS, let, packed, unpacked, words
from .graphs import join_groups, ready, settled

#: Transformed statistics, and the least standard deviation that each is given.
FLOORS = {"x_words": 0.8, "x_length": 0.1, "x_symbols": 0.1, "x_lines": 0.15, "x_repeats": 0.15}


def _gamma_share(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def chi2_share(x: float, p: int) -> float:
    return _gamma_share(p / 2, x / 2)


def chi2_quantile(q: float, p: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_share(mid, p) < q else (lo, mid)
    return (lo + hi) / 2


def repeated_words(w: Column) -> Column:
    """Words in runs of three that occur twice or more in the array w.

    Each run is a 64-bit number: hash bits above, place below, so that a plain sort brings equal runs
    together; a run counts where a neighbour has the same hash bits.
    """
    n = F.size(w)
    bits = F.length(F.bin(n.cast("long")))

    def runs(v):
        low = F.call_function("shiftleft", F.lit(1).cast("long"), v["bits"]) - F.lit(1).cast("long")
        return let(
            F.struct(v["w"].alias("w"), v["bits"].alias("bits"), low.alias("low"), F.bitwise_not(low).alias("high")),
            lambda u: F.sort_array(
                F.transform(
                    F.when(F.size(u["w"]) >= 3, F.sequence(F.lit(0), F.size(u["w"]) - 3)).otherwise(F.array().cast("array<int>")),
                    lambda i: F.xxhash64(F.get(u["w"], i), F.get(u["w"], i + 1), F.get(u["w"], i + 2)).bitwiseAND(u["high"]).bitwiseOR(i.cast("long")),
                )
            ),
        )

    def places(v):
        same = lambda x, y, v: x.bitwiseXOR(y) <= v["low"]
        between = lambda x, y, v: F.coalesce((x.bitwiseXOR(y) >= 0) & same(x, y, v), F.lit(False))
        kept = F.filter(v["s"], lambda x, i: between(F.get(v["s"], i - 1), x, v) | between(F.get(v["s"], i + 1), x, v))
        return F.sort_array(F.transform(kept, lambda x: x.bitwiseAND(v["low"])))

    def covered(p):
        step = F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n"), x.alias("last")))
        return step["n"]

    low = lambda v: F.call_function("shiftleft", F.lit(1).cast("long"), v["bits"]) - F.lit(1).cast("long")
    return let(
        F.struct(w.alias("w"), bits.alias("bits")),
        lambda v: let(F.struct(runs(v).alias("s"), low(v).alias("low")), lambda u: let(places(u), covered)),
    )


def text_statistics(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word)."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    long = lambda c: c.cast("long")
    counts = let(words(t), lambda w: F.struct(long(F.size(w)).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(long(F.size(x)).alias("n_lines"), long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    return F.struct(
        counts.alias("counts"),
        by_line.alias("lines"),
        long(F.length(F.translate(t, BLANKS, ""))).alias("word_chars"),
        long(F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).alias("n_symbols"),
    )


def _vector() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "x_words": F.log(n),
        "x_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "x_symbols": F.sqrt(F.col("n_symbols") / n),
        "x_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "x_repeats": F.sqrt(F.col("n_repeat_words") / n),
    }


def _factored(cov: dict[tuple[int, int], Column], p: int) -> Column:
    """A struct of w_i_j, the inverse of the Cholesky factor of cov ((i, j) for j <= i), and logdet. For tables of a row a group."""

    def column(j: int, low: list, diag: list):
        if j == p:
            return row(0, low, diag, [])
        d = F.sqrt(F.greatest(cov[j, j] - sum((x * x for x in low[j]), F.lit(0.0)), F.lit(1e-12)))

        def rest(d):
            if j == p - 1:
                return column(p, low, [*diag, d])
            below = F.struct(*[((cov[i, j] - sum((low[i][k] * low[j][k] for k in range(j)), F.lit(0.0))) / d).alias(f"l{i}") for i in range(j + 1, p)])
            return let(below, lambda s: column(j + 1, [[*x, s[f"l{i}"]] if i > j else x for i, x in enumerate(low)], [*diag, d]))

        return let(d, rest)

    def row(i: int, low: list, diag: list, w: list):
        if i == p:
            return F.struct(*[x.alias(f"w_{i}_{j}") for i, xs in enumerate(w) for j, x in enumerate(xs)], (2 * sum((F.log(d) for d in diag), F.lit(0.0))).alias("logdet"))
        own = [(-sum((low[i][k] * w[k][j] for k in range(j, i)), F.lit(0.0)) / diag[i]) for j in range(i)] + [1 / diag[i]]
        return let(F.struct(*[x.alias(f"w{j}") for j, x in enumerate(own)]), lambda s: row(i + 1, low, diag, [*w, [s[f"w{j}"] for j in range(i + 1)]]))

    return column(0, [[] for _ in range(p)], [])


def distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance of a row's statistics, which also has the columns m_i and w_i_j of an estimate."""
    parts = [sum((F.col(f"w_{i}_{j}") * (F.col(names[j]) - F.col(f"m_{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(len(names))]
    return sum((x * x for x in parts), F.lit(0.0))


def robust_estimates(vectors: DataFrame, names: list[str], floors: list[float], group: str, alpha: float, attach, rounds: int = 50, least_gain: float = 1e-4) -> DataFrame:
    """A row for each group: m_i and c_i_j, the robust mean and covariance, w_i_j and logdet.

    attach(rows, table): rows joined with a table of rows for each group. rounds: of concentration steps, at most;
    they end where no determinant's logarithm falls by `least_gain` or more.
    """
    p = len(names)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    factor = alpha / chi2_share(chi2_quantile(alpha, p), p + 2)

    def estimate(sums: DataFrame, scale: float, *others: str) -> DataFrame:
        """Estimates of a table with m_i and s_i_j."""
        made = sums.select(group, "start", *others, *[f"m_{i}" for i in range(p)], *[(F.col(f"s_{i}_{j}") * scale + (floors[i] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i, j in pairs])
        return settled(made.withColumn("f", _factored({(i, j): F.col(f"c_{i}_{j}") for i, j in pairs}, p)).select(*made.columns, "f.*"))

    quart = vectors.groupBy(group).agg(*[F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10_000)).alias(f"q_{i}") for i, c in enumerate(names)], *[F.avg(c).alias(f"a_{i}") for i, c in enumerate(names)], *[F.covar_pop(names[i], names[j]).alias(f"s_{i}_{j}") for i, j in pairs])
    quart = settled(quart.select("*", *[F.col(f"q_{i}")[1].alias(f"m_{i}") for i in range(p)], *[((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349).alias(f"d_{i}") for i in range(p)]))
    spread = lambda i: F.sqrt(F.col(f"d_{i}") * F.col(f"d_{i}") + floors[i] ** 2)
    bent = attach(vectors, quart).select(group, *[F.tanh((F.col(c) - F.col(f"m_{i}")) / spread(i)).alias(f"t_{i}") for i, c in enumerate(names)])
    bent = bent.groupBy(group).agg(*[F.covar_pop(f"t_{i}", f"t_{j}").alias(f"b_{i}_{j}") for i, j in pairs]).join(quart.drop(*[f"s_{i}_{j}" for i, j in pairs]), group)
    scaled = lambda i, j: F.col(f"b_{i}_{j}") / F.sqrt(F.greatest(F.col(f"b_{i}_{i}") * F.col(f"b_{j}_{j}"), F.lit(1e-12))) * F.col(f"d_{i}") * F.col(f"d_{j}")
    start = lambda k, table, means, s: estimate(table.select(group, F.lit(k).alias("start"), F.lit(math.inf).alias("was"), *[F.col(m).alias(f"m_{i}") for i, m in enumerate(means)], *[s(i, j).alias(f"s_{i}_{j}") for i, j in pairs]), 1.0)
    starts = [
        start(0, quart, [f"m_{i}" for i in range(p)], lambda i, j: F.col(f"d_{i}") * F.col(f"d_{i}") if i == j else F.lit(0.0)),
        start(1, quart, [f"a_{i}" for i in range(p)], lambda i, j: F.col(f"s_{i}_{j}")),
        start(2, bent, [f"m_{i}" for i in range(p)], scaled),
    ]
    active = starts[0].unionByName(starts[1]).unionByName(starts[2]).withColumn("logdet", F.lit(math.inf))
    done = []
    for _ in range(rounds):
        far = attach(vectors, active).select(group, "start", "logdet", *names, distance(names).alias("d2"))
        near = far.groupBy(group, "start").agg(F.percentile_approx("d2", F.lit(alpha), F.lit(10_000)).alias("limit"))
        inside = attach(far.withColumnRenamed("start", "_start"), near).where((F.col("start") == F.col("_start")) & (F.col("d2") <= F.col("limit")))
        sums = inside.groupBy(group, "start").agg(F.min("logdet").alias("was"), *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(names)], *[F.covar_pop(names[i], names[j]).alias(f"s_{i}_{j}") for i, j in pairs])
        stepped = estimate(sums, factor, "was")
        falls = F.col("logdet") < F.col("was") - least_gain
        done.append(stepped.where(~falls))
        active = stepped.where(falls)
        if active.isEmpty():
            break
    for more in [active, *done[:-1]]:
        done[-1] = done[-1].unionAll(more)
    rows = done[-1].groupBy(group).agg(F.min(F.struct("logdet", "start", *[f"m_{i}" for i in range(p)], *[f"{k}_{i}_{j}" for k in "cw" for i, j in pairs])).alias("best"))
    return settled(rows.select(group, "best.*").drop("start"))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None, alpha: float = 0.75, quantile: float = 0.999, least: int = 200, fewest: int = 20, broadcast_groups: int = 50_000) -> DataFrame:
    """The rows of docs, with the columns `keep` (all, if not given) and n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, distance2 and kept.

    Columns of docs with such names are replaced. distance2 is null where base_failed, or where there
    is no estimate; such texts pass that part. Statistics are taken once, and checkpointed with the
    columns to keep. Tables of a row a group are broadcast up to `broadcast_groups` groups; beyond, only large groups are.
    """
    ready(docs.sparkSession)
    names, floors = list(FLOORS), list(FLOORS.values())
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", "kept"]
    others = [c for c in (docs.columns if keep is None else keep) if c not in made]
    label = lambda *cols: F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]))
    s = docs.select(packed(others).alias("docs"), label(lang_col, source_col).alias("own"), label(lang_col).alias("lang"), text_statistics(F.col(text_col)).alias("s"))
    s = s.select("docs", "own", "lang", "s.counts.*", "s.lines.*", "s.word_chars", "s.n_symbols").withColumns(_vector())
    s = s.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).checkpoint()
    sizes = s.where(~F.col("base_failed")).groupBy("own", "lang").agg(F.count("*").alias("n")).withColumn("pool", F.when(F.col("n") >= least, F.col("own")).otherwise(F.col("lang")))
    pools = sizes.groupBy("pool").agg(F.sum("n").alias("total")).select("pool", F.when(F.col("total") >= least, F.col("pool")).otherwise(F.lit("[]")).alias("grp"))
    named = settled(sizes.join(pools, "pool").select("own", "grp", "n"))
    enough = named.groupBy("grp").agg(F.sum("n").alias("total")).where(F.col("total") >= fewest)
    named = settled(named.join(enough.select("grp"), "grp", "left_semi"))
    few = named.count() <= broadcast_groups

    def attach(rows, table):
        if few:
            return rows.join(F.broadcast(table), "grp")
        return join_groups(rows, table.join(enough, "grp"), ["grp"], "total").drop("total")

    owned = F.broadcast(named.drop("n")) if few else named.drop("n")
    vectors = s.where(~F.col("base_failed")).select("own", *names)
    vectors = (vectors.join(owned, "own") if few else join_groups(vectors, named, ["own"], "n")).select("grp", *names)
    fitted = robust_estimates(settled(vectors), names, floors, "grp", alpha, attach)
    by_own = named.join(fitted, "grp").drop("grp")
    out = s.join(F.broadcast(by_own.drop("n")), "own", "left") if few else join_groups(s, by_own, ["own"], "n", "left")
    limit = chi2_quantile(quantile, len(names))
    out = out.withColumn("distance2", F.when(~F.col("base_failed"), distance(names)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= limit)).select(*unpacked("docs", others), *made)
