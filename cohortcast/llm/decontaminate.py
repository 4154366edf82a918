"""Benchmark decontamination: test n-grams in a broadcast hash set, probed by every window of every text.

Words are runs of letters, digits and characters beyond ASCII, with A-Z lower-cased. The windows of the
benchmark (n consecutive words of an item; a shorter item is one window) are keyed by a hash of their
first, middle and last words; each place of each text probes that set by a broadcast join, so no text
is shuffled; a hit is verified by comparing all its words. The set's size is checked: beyond
`max_windows` it is dealt to blocks, and all texts are scanned for each block in turn.

Hits are few rows of numbers, grouped by 128 bits of hashes of the row. Null texts and items have no words.
Equal rows get equal results, one for each row. Empty tables give empty results, an empty benchmark no hits.
Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import ascii_lower, let, packed, row_key, unpacked
from .graphs import few, ready

#: The characters that part words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _key(w: Column, p: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), F.get(w, p), F.get(w, p + size // 2), F.get(w, p + (size - 1)))


def benchmark_windows(benchmark: DataFrame, n: int, item_col: str, text_col: str) -> DataFrame:
    """size, key, gram (words of a distinct window) and items that have it."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), normal_words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))))
    grams = items.select("item", F.least(F.size("w"), F.lit(n)).alias("size"), "w", at.alias("p")).select("item", "size", F.slice("w", F.col("p") + 1, F.col("size")).alias("gram"))
    grams = grams.groupBy("size", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))
    first, middle, last = F.get("gram", F.lit(0)), F.get("gram", (F.col("size") / 2).cast("int")), F.get("gram", F.col("size") - 1)
    return grams.withColumn("key", F.xxhash64(F.col("size").cast("int"), first, middle, last))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", share: int = 20, max_windows: int = 500_000) -> DataFrame:
    """id, _row (a hash of id and text), n_words, n_hit, items (sorted), spans (word places [from, to)) and contaminated.

    contaminated: at least one word is hit, and share * n_hit >= n_words.
    """
    ready(docs.sparkSession)
    windows = benchmark_windows(benchmark, n, item_col, bench_text_col).checkpoint()
    facts = windows.groupBy("size").count().collect()  # at most n rows
    blocks = -(-sum(r["count"] for r in facts) // max_windows)
    texts = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("_row"), normal_words(F.col(text_col)).alias("w"))
    sizes = sorted(r["size"] for r in facts)

    def places() -> DataFrame:
        """Each place of each text with the keys of all lengths that windows have, in one scan."""
        at = texts.where(F.size("w") >= sizes[0]).select("_row", "w", F.explode(F.sequence(F.lit(0), F.size("w") - sizes[0])).alias("p"))
        if len(sizes) == 1:
            return at.select("_row", "w", "p", F.lit(sizes[0]).alias("size"), _key(F.col("w"), F.col("p"), sizes[0]).alias("key"))
        keys = F.array(*[F.struct(F.lit(n).alias("size"), _key(F.col("w"), F.col("p"), n).alias("key")) for n in sizes])
        return at.select("_row", "w", "p", F.explode(keys).alias("k")).select("_row", "w", "p", "k.*").where(F.col("p") + F.col("size") <= F.size("w"))

    found = []
    for block in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).select("key", "gram", "items")
        hits = places().join(F.broadcast(part), "key").where(F.slice("w", F.col("p") + 1, F.col("size")) == F.col("gram"))
        found.append(hits.select("_row", "p", (F.col("p") + F.col("size")).alias("to"), "items"))
    base = texts.select("id", "_row", F.size("w").cast("long").alias("n_words"))
    if not found:
        return base.selectExpr("id", "_row", "n_words", "0L AS n_hit", "cast(array() AS array<string>) AS items", "cast(array() AS array<struct<from:int,to:int>>) AS spans", "false AS contaminated")
    rows = reduce(DataFrame.unionAll, found).groupBy("_row").agg(F.array_sort(F.collect_set(F.struct(F.col("p").alias("from"), "to"))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    # joined spans: a hit that begins beyond all before it begins a new one
    far = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1)["to"], F.lit(-1))
    joined = F.aggregate(
        "hit",
        F.expr("cast(array() AS array<struct<from:int,to:int>>)"),
        lambda acc, x: F.when(x["from"] > far(acc), F.concat(acc, F.array(x))).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["from"].alias("from"), F.greatest(far(acc), x["to"]).alias("to"))))),
    )
    rows = rows.select("_row", "items", joined.alias("spans"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["to"] - x["from"]))
    out = base.join(rows, "_row", "left").withColumn("n_hit", F.coalesce(hit, F.lit(0).cast("long")))
    return out.select("id", "_row", "n_words", "n_hit", F.coalesce("items", F.expr("cast(array() AS array<string>)")).alias("items"), F.coalesce("spans", F.expr("cast(array() AS array<struct<from:int,to:int>>)")).alias("spans"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the hit words cut out of their texts."""
    found = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    keyed = docs.select(packed(docs.columns).alias("_docs"), row_key(id_col, text_col).alias("_row"))
    if remove == "documents":
        return keyed.join(few(found.where("contaminated").select("_row").distinct()), "_row", "left_anti").select(*unpacked("_docs", docs.columns))
    spans = found.where("contaminated").select("_row", F.col("spans").alias("_spans")).dropDuplicates(["_row"])
    # words and the gaps around them: gap 0, word 0, gap 1, word 1, ..., taken from the text by their lengths
    inside = lambda i: F.exists("_spans", lambda s: (i >= s["from"]) & (i < s["to"]))
    text = F.col("_docs").getField(text_col)
    word = F.regexp_extract_all(text, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1)
    gap = F.split(text, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    cut = let(F.struct(word.alias("w"), gap.alias("g")), lambda v: F.array_join(F.transform(v["g"], lambda g, i: F.when(i == 0, g).when(inside(i - 1), F.lit("")).otherwise(F.concat(F.get(v["w"], i - 1), g))), ""))
    done = F.when(F.col("_spans").isNull(), text).otherwise(cut).alias(text_col)
    return keyed.join(spans, "_row", "left").select(*[done if c == text_col else x for c, x in zip(docs.columns, unpacked("_docs", docs.columns))])
