"""Token counts with a map-side two-tier lookup.

A first pass over all texts counts pre-tokens inside each task and keeps each task's most frequent
ones (`per_task`); their sums give a table of at most `table_size` frequent pre-tokens, which is
broadcast as a direct-mapped hash table of token lengths: its size is fixed, whatever the corpus. The
second pass looks pre-tokens up there; misses go through a cache in each Python worker and only then
to the tokenizer itself. No pre-token of the corpus is shuffled, and the table changes speed only.

Null is an empty text with no tokens. Repeated rows and ids are counted one by one; an empty table
gives an empty result; other columns are kept, and one that has the name of the result is replaced by it.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graphs import most_frequent
from .pretokens import PreTokens, split_special
from .text import U64, batches

_TOKENIZERS: dict = {}
CACHE = 500_000


class _Lengths:
    """Token lengths of pre-tokens in one Python worker: the tokenizer and what it has been asked."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t["content"] for t in json.loads(spec)["added_tokens"]]
        self.known: dict[int, int] = {}

    def of(self, tokens: PreTokens, at: np.ndarray) -> np.ndarray:
        """Lengths of the pre-tokens at these places."""
        keys, first, inverse = np.unique(tokens.hash[at], return_index=True, return_inverse=True)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        names = keys.tolist()
        new = [k for k, h in enumerate(names) if h not in known]
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            encoded = self.tokenizer.encode_batch([tokens.text(at[first[k]]) for k in part], add_special_tokens=False)
            known.update((names[k], len(e.ids)) for k, e in zip(part, encoded))
        return np.fromiter((known[h] for h in names), np.int64, len(names))[inverse]


def _lengths(spec: str) -> _Lengths:
    key = hash(spec)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = _Lengths(spec)
    return _TOKENIZERS[key]


def _texts(batch: pa.RecordBatch, column: int):
    col = batch.column(column)
    for lo, hi in batches(col):
        yield lo, hi, col.slice(lo, hi - lo).to_pylist()


def frequent_lengths(docs: DataFrame, spec, text_col: str, table_size: int, per_task: int) -> tuple[np.ndarray, np.ndarray]:
    """Direct-mapped table (keys, lengths) of the most frequent pre-tokens of all texts."""

    def top(rows):
        lengths, keys, counts, sizes = _lengths(spec.value), np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in rows:
            for _, _, texts in _texts(batch, 0):
                tokens = PreTokens(split_special(texts, lengths.specials)[0], spaced=True)
                if not len(tokens.hash):
                    continue
                k, first, c = np.unique(tokens.hash, return_index=True, return_counts=True)
                often = np.argsort(-c, kind="stable")[:per_task]
                k, c, s = k[often], c[often], lengths.of(tokens, first[often])
                keys, inverse = np.unique(np.concatenate((keys, k)), return_inverse=True)
                both, was = np.bincount(inverse, np.concatenate((counts, c))).astype(np.int64), np.concatenate((sizes, s))
                sizes = np.zeros(len(keys), np.int64)
                sizes[inverse] = was
                counts = both
                if len(keys) > 4 * per_task:
                    best = np.sort(np.argsort(-counts, kind="stable")[:per_task])
                    keys, counts, sizes = keys[best], counts[best], sizes[best]
        best = np.argsort(-counts, kind="stable")[:per_task]
        yield pa.RecordBatch.from_arrays([pa.array(keys[best].view(np.int64)), pa.array(counts[best]), pa.array(sizes[best])], names=["key", "n", "size"])

    found = docs.select(text_col).mapInArrow(top, "key long, n long, size long").groupBy("key").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    rows = most_frequent(found, "n", table_size).toPandas()  # at most table_size rows
    slots = 1 << (2 * max(table_size, 2) - 1).bit_length()
    keys, sizes = np.zeros(slots, U64), np.zeros(slots, np.uint16)
    rows = rows[rows["size"] < 65536].sort_values("n")  # the more frequent overwrite the others
    k = rows["key"].to_numpy(np.int64).view(U64)
    at = (k & U64(slots - 1)).astype(np.int64)
    keys[at], sizes[at] = k, rows["size"].to_numpy(np.uint16)
    return keys, sizes


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text", out_col: str = "n_tokens", table_size: int = 1 << 15, per_task: int = 1 << 14) -> DataFrame:
    """Adds out_col, the number of tokens of text_col. vocabulary: path of a tokenizers .json file on the driver."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    table = spark.sparkContext.broadcast(frequent_lengths(docs, spec, text_col, table_size, per_task))
    at = docs.columns.index(text_col)
    own = [k for k, c in enumerate(docs.columns) if c != out_col]
    kept = [docs.schema.fields[k] for k in own]
    titles = [*(f.name for f in kept), out_col]

    def count(rows):
        lengths, (keys, sizes) = _lengths(spec.value), table.value
        mask = U64(len(keys) - 1)
        for batch in rows:
            out = []
            for _, _, texts in _texts(batch, at):
                pieces, owner, special = split_special(texts, lengths.specials)
                tokens = PreTokens(pieces, spaced=True)
                slot = (tokens.hash & mask).astype(np.int64)
                size = sizes[slot].astype(np.int64)
                miss = np.flatnonzero(keys[slot] != tokens.hash)
                if len(miss):
                    size[miss] = lengths.of(tokens, miss)
                total = np.bincount(owner[tokens.doc], size, len(texts)).astype(np.int64)
                if special:
                    total += np.bincount(owner[[p for p, _ in special]], minlength=len(texts))
                out.append(total)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in own), pa.array(np.concatenate(out) if out else np.empty(0, np.int64))], names=titles)

    schema = T.StructType([*kept, T.StructField(out_col, T.LongType())])
    return docs.mapInArrow(count, schema)
