"""Exact substring deduplication by fixed-block anchors.

A reference block is `block` consecutive words at a multiple of `block` in its text, so that blocks
never overlap; with 2 * block - 1 <= window every window of `window` words holds a whole block of its
own text. All blocks are indexed; every rolling run of `block` words, in every text, probes the index.
A run that is a block and occurs twice or more is an anchor. Windows around anchors are extended to
maximal exact repeats: the earliest start of each window's word sequence is found, and the windows
that start later cover, joined, the words to remove.

Texts are dealt to buckets of about `bucket_bytes` by a hash. A bucket sends each distinct run once (pre-aggregation: a passage
that fills a third of the corpus costs a key per bucket), as 32 bits under a shard number; shards
answer with a bit per key. Such bits may hold false anchors, never miss one; windows are then compared
by 128 bits of hashes with their starts. Only distinct keys and bits move, besides one shuffle of the texts.

Null and short texts lose nothing. Null ids come after all others. Rows with the same id and text are
one start: neither makes the other a repeat. An empty table gives an empty result. Other columns are
dropped, so that no name can clash.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import U64, Words

LAST = np.iinfo(np.int64).max
PART = 4 << 20


def _column(table: pa.Table, name: str):
    return table.column(name).combine_chunks()


def _parts(texts: list[bytes]):
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= PART):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


class _Bucket:
    """One bucket's texts as word hashes, and its distinct keys in the order in which they are sent."""

    def __init__(self, table: pa.Table, window: int, block: int, shards: int):
        self.window, self.block, self.shards = window, block, shards
        ids = _column(table, "id")
        order = np.argsort(ids.fill_null(LAST).to_numpy(zero_copy_only=False), kind="stable")
        ids = ids.take(pa.array(order))
        self.ids = ids
        self.id = ids.fill_null(LAST).to_numpy(zero_copy_only=False)
        self.texts = [t or b"" for t in _column(table, "text").cast(pa.binary()).take(pa.array(order)).to_pylist()]
        keys, aligned, start, doc, at, wide, more, counts = [], [], [], [], [], [], [], []
        base = 0
        for lo, hi in _parts(self.texts):
            words = Words(self.texts[lo:hi])
            place = np.arange(len(words.start)) - words.first[words.doc]
            run, first = words.grams(block)
            keys.append(run), start.append(first + base), aligned.append(place[first] % block == 0)
            long, first = words.grams(window)
            more.append(words.grams(window, second=True)[0])
            wide.append(long), at.append(first + base), doc.append(np.stack((words.doc[first] + lo, place[first])))
            counts.append(words.count)
            base += len(words.start)
        self.n_words = base
        self.count = np.concatenate(counts) if counts else np.empty(0, np.int64)
        run = np.concatenate(keys) if keys else np.empty(0, U64)
        self.run_at = np.concatenate(start) if start else np.empty(0, np.int64)
        self.wide = np.concatenate(wide) if wide else np.empty(0, U64)
        self.more = np.concatenate(more) if more else np.empty(0, U64)
        self.wide_at = np.concatenate(at) if at else np.empty(0, np.int64)
        self.wide_doc, self.wide_place = np.concatenate(doc, axis=1) if doc else np.empty((2, 0), np.int64)
        key = (((run >> U64(32)) % U64(shards)) << U64(32)) | (run & U64(0xFFFFFFFF))
        self.key, self.inverse, self.times = np.unique(key, return_inverse=True, return_counts=True)
        self.is_block = np.bincount(self.inverse, np.concatenate(aligned) if aligned else None, len(self.key)) > 0

    def send_runs(self):
        """(shard, keys, flags) of the distinct runs."""
        edge = np.searchsorted(self.key >> U64(32), np.arange(self.shards + 1, dtype=U64))
        for shard in np.flatnonzero(np.diff(edge)):
            own = slice(edge[shard], edge[shard + 1])
            yield int(shard), self.key[own].astype(np.uint32).tobytes(), np.concatenate((np.packbits(self.is_block[own]), np.packbits(self.times[own] > 1))).tobytes()

    def _bits(self, shard_of: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
        out = np.zeros(len(shard_of), bool)
        edge = np.searchsorted(shard_of, np.arange(self.shards + 1))
        for shard, bits in answers.items():
            n = edge[shard + 1] - edge[shard]
            out[edge[shard] : edge[shard + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
        return out

    def candidates(self, answers: dict[int, bytes]) -> None:
        """Windows with an anchor, and the earliest of equal ones in this bucket."""
        anchor = self._bits((self.key >> U64(32)).astype(np.int64), answers)
        seen = np.zeros(self.n_words + 1, np.int64)
        seen[self.run_at[anchor[self.inverse]] + 1] = 1
        seen = np.cumsum(seen)
        near = seen[self.wide_at + self.window - self.block + 1] > seen[self.wide_at]
        self.c_hash, self.c_more, self.c_at = self.wide[near], self.more[near], self.wide_at[near]
        self.c_doc, self.c_place = self.wide_doc[near], self.wide_place[near]
        shard = self.c_hash % U64(self.shards)
        order = np.lexsort((self.c_more, self.c_hash, shard))  # stable, and the rows are in the order of (id, place)
        h, more = self.c_hash[order], self.c_more[order]
        new = np.append(True, (h[1:] != h[:-1]) | (more[1:] != more[:-1])) if len(h) else np.empty(0, bool)
        self.u_first = order[new]
        self.c_unique = np.empty(len(h), np.int64)
        self.c_unique[order] = np.cumsum(new) - 1
        self.u_shard = shard[self.u_first].astype(np.int64)

    def send_windows(self):
        edge = np.searchsorted(self.u_shard, np.arange(self.shards + 1))
        for shard in np.flatnonzero(np.diff(edge)):
            own = self.u_first[edge[shard] : edge[shard + 1]]
            yield int(shard), self.c_hash[own].tobytes(), self.c_more[own].tobytes(), self.id[self.c_doc[own]].tobytes(), self.c_place[own].astype(np.int32).tobytes()

    def removed(self, answers: dict[int, bytes]) -> np.ndarray:
        """A flag for each word of the bucket."""
        first = self._bits(self.u_shard, answers)
        lead = self.u_first[self.c_unique]
        earliest = first[self.c_unique] & (self.id[self.c_doc] == self.id[self.c_doc[lead]]) & (self.c_place == self.c_place[lead])
        repeat = self.c_at[~earliest]
        step = np.zeros(self.n_words + 1, np.int64)
        np.add.at(step, repeat, 1)
        np.add.at(step, repeat + self.window, -1)
        return np.cumsum(step[:-1]) > 0


def _answers(table: pa.Table, kind: int) -> dict[int, bytes]:
    rows = table.filter(pc.equal(table.column("kind"), kind))
    return dict(zip(rows.column("shard").to_pylist(), rows.column("bits").to_pylist()))


def _shared_runs(table):
    """Which keys of one shard are blocks and occur twice or more: a bit for each key of each bucket."""
    keys = [np.frombuffer(b, np.uint32) for b in table.column("keys").to_pylist()]
    size = np.array([len(k) for k in keys])
    flags = []
    for n, f in zip(size, table.column("flags").to_pylist()):
        bits, half = np.frombuffer(f, np.uint8), (n + 7) // 8
        flags.append(np.stack((np.unpackbits(bits[:half], count=n), np.unpackbits(bits[half:], count=n))))
    flags = np.concatenate(flags, axis=1).astype(bool)
    _, inverse, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    block = np.bincount(inverse, flags[0], len(times)) > 0
    twice = (times > 1) | (np.bincount(inverse, flags[1], len(times)) > 0)
    both = (block & twice)[inverse]
    bits = [np.packbits(x).tobytes() for x in np.split(both, np.cumsum(size)[:-1])]
    return pa.table({"bucket": table.column("bucket"), "shard": table.column("shard"), "kind": pa.array([0] * len(size), pa.int32()), "bits": pa.array(bits, pa.binary())})


def _first_windows(table):
    """Which windows of one shard start earliest: a bit for each window of each bucket."""
    col = lambda name, kind: [np.frombuffer(b, kind) for b in table.column(name).to_pylist()]
    keys, more, ids, places = col("keys", U64), np.concatenate(col("more", U64)), np.concatenate(col("ids", np.int64)), np.concatenate(col("places", np.int32))
    size, h = np.array([len(k) for k in keys]), np.concatenate(keys)
    order = np.lexsort((places, ids, more, h))
    new = np.append(True, (h[order[1:]] != h[order[:-1]]) | (more[order[1:]] != more[order[:-1]]))
    lead = order[new][np.cumsum(new) - 1]
    first = np.empty(len(h), bool)
    first[order] = (ids[order] == ids[lead]) & (places[order] == places[lead])
    bits = [np.packbits(x).tobytes() for x in np.split(first, np.cumsum(size)[:-1])]
    return pa.table({"bucket": table.column("bucket"), "shard": table.column("shard"), "kind": pa.array([1] * len(size), pa.int32()), "bits": pa.array(bits, pa.binary())})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, partitions: int | None = None, bucket_bytes: int = 48 << 20) -> DataFrame:
    """id_col, n_words, n_removed and kept: the words of each text that no repeated window covers, joined by spaces.

    partitions: of the shuffles (by default those of the session, or more where buckets of `bucket_bytes` need more);
    texts go to twice as many buckets, so that a task holds one bucket at a time, whatever the size of the input.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    n = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (2 * bucket_bytes)))
    block, shards = (window + 1) // 2, n
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("bucket", F.pmod(F.xxhash64("id", "text"), F.lit(2 * n)).cast("int"))
    made = lambda table: _Bucket(table, window, block, shards)
    answer = "bucket int, shard int, kind int, bits binary"

    def runs(key, table):
        rows = [(shard, key[0].as_py(), keys, flags) for shard, keys, flags in made(table).send_runs()]
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["shard", "bucket", "keys", "flags"])

    def windows(key, table, known):
        rows = []
        if len(table):
            bucket = made(table)
            bucket.candidates(_answers(known, 0))
            rows = [(shard, key[0].as_py(), *x) for shard, *x in bucket.send_windows()]
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, (pa.int32(), pa.int32(), *[pa.binary()] * 4))], names=["shard", "bucket", "keys", "more", "ids", "places"])

    def keep(key, table, known):
        names, kinds = ["id", "n_words", "n_removed", "kept"], (pa.int64(), pa.int64(), pa.int64(), pa.string())
        if not len(table):
            return pa.table([pa.array([], t) for t in kinds], names=names)
        bucket = made(table)
        bucket.candidates(_answers(known, 0))
        gone = bucket.removed(_answers(known, 1))
        end = np.cumsum(bucket.count)
        sums = np.append(0, np.cumsum(gone))
        lost = sums[end] - sums[end - bucket.count]
        kept = []
        for text, hi, size, out in zip(bucket.texts, end.tolist(), bucket.count.tolist(), lost.tolist()):
            words = text.split()
            kept.append(b" ".join(compress(words, (~gone[hi - size : hi]).tolist()) if out else words))
        return pa.table([bucket.ids, pa.array(bucket.count), pa.array(lost), pa.array(kept, pa.binary()).cast(pa.string())], names=names)

    by = lambda df, c: df.repartition(n, c).groupBy(c)
    by_bucket = by(texts, "bucket")
    shared = by(by_bucket.applyInArrow(runs, "shard int, bucket int, keys binary, flags binary"), "shard").applyInArrow(_shared_runs, answer)
    starts = by_bucket.cogroup(by(shared, "bucket")).applyInArrow(windows, "shard int, bucket int, keys binary, more binary, ids binary, places binary")
    first = by(starts, "shard").applyInArrow(_first_windows, answer)
    out = by_bucket.cogroup(by(shared.unionAll(first), "bucket")).applyInArrow(keep, "id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)
