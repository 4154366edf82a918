"""How filters overlap: what each of them removes in every order, what it would find removed already, and which labels it costs.

One table of failing ids is stored for each filter. A prefix of an order matters only as the set of filters that ran, so
there are 2**k prefixes of k filters: the survivors of a set are the base ids left-anti joined with the failing ids of
each of its filters, and what every other filter removes next is the table of failures left-semi joined with those
survivors. All these tables are stored by id, dealt alike and sorted, so that the joins merge without shuffling or sorting; only
counts by part, set and filter are shuffled. Orders are put together from those counts, k x 2**k numbers a part.

Texts are read once; what is kept of a row is a number, its part, its flags and the SHA-256 of its text. Null text is empty.
Rows are told by number, so repeated rows and ids are judged one by one; a null id is smaller and greater than none and has no
labels. A document with several labels counts as good (toxic) if one of them says so. Other columns aren't read; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import join_groups, placed, ready
from .text import batches

UPPER, ODD, CHUNK = bytes(range(65, 91)), b"#$%&*|", 1 << 22
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_counts(text: bytes) -> tuple[int, int]:
    """Words and distinct words; bytes.split knows the six blanks of the word pattern. Long texts go in parts cut at blanks."""
    if len(text) <= CHUNK:
        words = text.split()
        return len(words), len(set(words))
    n, known, at = 0, set(), 0
    while at < len(text):
        found = _BLANK.search(text, at + CHUNK)
        words = text[at : (to := found.start() if found else len(text))].split()
        n, at = n + len(words), to
        known.update(words)
    return n, len(known)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part (null: empty), n_words, n_distinct, n_upper (A to Z), n_chars (code points), odd (holds one of #$%&*|) and digest (SHA-256) of each text."""

    def look(rows):
        for batch in rows:
            for lo, hi in batches(batch.column(2)):
                own = batch.slice(lo, hi - lo)
                texts = [t or b"" for t in own.column(2).cast(pa.binary()).to_pylist()]
                counts = [word_counts(t) for t in texts]
                columns = [[n for n, _ in counts], [d for _, d in counts], [len(t) - len(t.translate(None, UPPER)) for t in texts]]
                points = pc.fill_null(pc.utf8_length(own.column(2)), 0).cast(pa.int64())
                odd = pa.array([len(t.translate(None, ODD)) != len(t) for t in texts], pa.bool_())
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *(pa.array(c, pa.int64()) for c in columns), points, odd, pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], names=names)

    names = ["id", "part", "n_words", "n_distinct", "n_upper", "n_chars", "odd", "digest"]
    wanted = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    kind = wanted.schema["id"].dataType.simpleString()
    return wanted.select("id", "part", "text").mapInArrow(look, f"id {kind}, part string, n_words long, n_distinct long, n_upper long, n_chars long, odd boolean, digest binary")


def later_copies(rows: DataFrame) -> DataFrame:
    """`row` of the rows whose digest a smaller id has too."""
    groups = rows.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("copies")).where("copies > 1").checkpoint()
    return join_groups(rows.select("row", "id", "digest"), groups, ["digest"], "copies").where("id > least").select("row")


class Failures:
    """The stored tables: ids of all rows, ids that fail each filter, and failures with what they are counted by. All are dealt alike by id and sorted."""

    def __init__(self, rows: DataFrame, filters: list[str], per_part: int = 500_000):
        kept = rows.checkpoint()
        parts = max(rows.sparkSession.sparkContext.defaultParallelism, 1 + kept.count() // per_part)
        base = placed(kept.repartition(parts, "row").sortWithinPartitions("row"))
        named = F.array_compact(F.array(F.lit(""), *[F.when(F.col(f), F.lit(f)) for f in filters]))
        self.ids = base.select("row")
        self.failing = [placed(base.where(F.col(f)).select("row")) for f in filters]
        self.failures = placed(base.select("row", "part", "good", "toxic", F.explode(named).alias("filter")).sortWithinPartitions("row"))

    def survivors(self, prefix: int) -> DataFrame:
        """Ids that no filter of the prefix removes."""
        ran = [ids for k, ids in enumerate(self.failing) if prefix >> k & 1]
        return reduce(lambda left, ids: left.join(ids.hint("merge"), "row", "left_anti"), ran, self.ids)

    def counts(self, prefixes) -> DataFrame:
        """(part, prefix, filter, n, n_good, n_toxic): what each filter removes of a prefix's survivors; filter "": the survivors themselves."""
        found = [self.failures.join(self.survivors(p).hint("merge"), "row", "left_semi").select("part", "good", "toxic", "filter", F.lit(p).alias("prefix")) for p in prefixes]
        return reduce(DataFrame.unionAll, found).groupBy("part", "prefix", "filter").agg(F.count("*").alias("n"), F.count_if("good").alias("n_good"), F.count_if("toxic").alias("n_toxic"))


def overlaps(rows: DataFrame, filters: list[str], at_once: int = 8) -> DataFrame:
    """part, prefix (number with a bit for each filter that ran), filter (empty: the survivors), n, n_good, n_toxic.

    rows: row (a unique long), part, good, toxic, and for each filter a Boolean column of its name that tells whether the row fails.
    Prefixes are counted `at_once` in a job, so that a task reports the metrics of a few joins only; each job's counts are stored.
    """
    tables, last = Failures(rows, filters), 1 << len(filters)
    return reduce(DataFrame.unionAll, [tables.counts(range(lo, min(lo + at_once, last))).checkpoint() for lo in range(0, last, at_once)])


def audit(rows: DataFrame, filters: list[str]) -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. rows: as for `overlaps`.

    shapley is what the step's filter removes, summed over all orders at whatever step: its Shapley value times the number of orders."""
    bit = {f: 1 << k for k, f in enumerate(filters)}
    everything = sum(bit.values())
    key = F.concat_ws("/", "prefix", "filter")
    by_part = overlaps(rows, filters).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(key, F.struct("n", "n_good", "n_toxic")))).alias("counts"))

    def count(prefix, name, field="n") -> Column:
        at = F.concat_ws("/", prefix.cast("string"), name)
        return F.coalesce(F.try_element_at("counts", at)[field], F.lit(0).cast("long"))

    steps = [(order, k + 1, f, sum(bit[x] for x in order[:k])) for order in permutations(filters) for k, f in enumerate(order)]
    names = "array<struct<filter_order:array<string>,step:int,filter:string,before:int>>"
    with_steps = by_part.withColumn("s", F.explode(F.from_json(F.lit(_json(steps)), names))).select("part", "counts", "s.*")
    own = F.element_at(F.create_map(*[F.lit(x) for f in filters for x in (f, bit[f])]), F.col("filter"))
    judged = with_steps.withColumn("own", own).select(
        "part", F.concat_ws("", "filter_order").alias("filter_order"), "step", "filter",
        count(F.col("before") + F.col("own"), F.lit("")).alias("kept"),
        count(F.col("before"), F.col("filter")).alias("removed"),
        (count(F.lit(0), F.col("filter")) - count(F.col("before"), F.col("filter"))).alias("redundant"),
        count(F.lit(everything) - F.col("own"), F.col("filter")).alias("unique_fails"),
        count(F.col("before"), F.col("filter"), "n_good").alias("good_lost"),
        count(F.col("before"), F.col("filter"), "n_toxic").alias("toxic_lost"),
    )
    total = judged.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return judged.join(total, ["part", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _json(steps) -> str:
    import json

    return json.dumps([{"filter_order": list(o), "step": k, "filter": f, "before": b} for o, k, f, b in steps])


#: The filters of `audit_texts`: conditions on the columns of `measure`. E is by the whole table.
CONDITIONS = {"A": "n_words < 100", "B": "100 * n_distinct < 80 * n_words", "C": "100 * n_upper > 10 * n_chars", "D": "odd"}


def audit_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`audit` of five filters on texts by language: too few words (A), words that repeat (B), capitals (C), odd symbols (D), copies of a smaller id's text (E)."""
    ready(docs.sparkSession)
    rows = measure(docs).withColumn("row", F.monotonically_increasing_id()).checkpoint()
    copies = later_copies(rows).select("row", F.lit(True).alias("E"))
    said = labels.groupBy(F.col("doc_id").alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    flagged = rows.select("row", "id", "part", *[F.expr(c).alias(f) for f, c in CONDITIONS.items()]).join(said, "id", "left").join(copies, "row", "left")
    wrong = F.lit(False)
    return audit(flagged.select("row", "part", *CONDITIONS, F.coalesce("E", wrong).alias("E"), F.coalesce("good", wrong).alias("good"), F.coalesce("toxic", wrong).alias("toxic")), [*CONDITIONS, "E"])
