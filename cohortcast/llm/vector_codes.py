"""Vector codes: each of `parts` equal parts of a vector becomes the index of its nearest codebook entry (product quantisation).

Codebooks are trained by member-resident Lloyd. The parts live in an RDD that is partitioned by owner, which is (position of
the part, entry, salt); an owner's partition keeps its members from round to round. In a round each partition compares its
resident members with the new codebook: those whose entry stays the same stay where they are, and only those that change
entry are shuffled to their new owners. Union keeps the partitioning, so that both meet without another shuffle. Owners
then sum their residents, and the sums of an entry's salts give its mean. The codebooks (`entries` x dimension numbers) are
all that the driver holds. An entry that attracts a third of all parts is spread over the salts, of which there are
enough for owners of at most about `per_owner` members.

An RDD is used because a DataFrame loses its partitioning behind Python code, and members would be shuffled in full.
Kept vectors are checkpointed with a row number first: what is recomputed after a lost executor starts from that table
(and, after half of the rounds, from a checkpoint of the members), and gives the same rows.

Components are numbers floor(scale * x). Vectors that are null or hold a null or non-finite component are dropped, and so
are empty ones and those whose length isn't the most frequent one that `parts` divides (of ties the greatest). Beyond
2**24 a component counts as that bound, so that sums stay exact. A codebook starts from the smallest ids: nulls last, of
equal ids the smaller vector by its bytes; with fewer rows than `entries` it is as small. Equal rows are coded one by one.
An empty table, or one without a whole vector, gives no rows. Input columns other than id, vector and label aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graphs import join_groups, ready

BOUND, CHUNK, HELD = 1 << 24, 1 << 16, 1 << 17


def whole_numbers(vectors: pa.Array, scale: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Of each kept vector its place, its whole numbers (little-endian 32-bit) and its length."""
    flat = pc.list_flatten(vectors).cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    x = np.where(np.isfinite(x), x, np.nan)
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size)
    bad = np.concatenate(([0], np.cumsum(np.isnan(x))))
    keep = np.flatnonzero((size > 0) & (bad[end] == bad[end - size]))
    q = np.clip(np.floor(np.nan_to_num(x) * scale), -BOUND, BOUND).astype("<i4")
    return keep, [q[end[k] - size[k] : end[k]].tobytes() for k in keep], size[keep]


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (of ties the lowest) and its squared distance, for each row of part."""
    index, distance = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
    for lo in range(0, len(part), CHUNK):
        x = part[lo : lo + CHUNK].astype(np.int64)
        d = np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)
        index[lo : lo + len(x)] = d.argmin(axis=1)
        distance[lo : lo + len(x)] = d.min(axis=1)
    return index, distance


class Place:
    """The partition of an owner. One object serves all shuffles: partitionings are equal if they are by the same function."""

    def __init__(self, partitions: int):
        self.partitions = partitions

    def __call__(self, owner: int) -> int:
        return owner % self.partitions


class Layout:
    """Owners and where they live. An owner is a whole number: (position * entries + entry) * salts + salt."""

    def __init__(self, entries: int, salts: int, partitions: int):
        self.entries, self.salts, self.partitions, self.place = entries, salts, partitions, Place(partitions)

    def owner(self, position, entry, row):
        return (position * self.entries + entry) * self.salts + (row + (row >> 33)) % self.salts


def blocks(owner: np.ndarray, row: np.ndarray, part: np.ndarray) -> list[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """Members by owner: (owner, (rows, parts)), parts as 16-bit numbers where they fit."""
    if not len(owner):
        return []
    order = np.argsort(owner, kind="stable")
    owner, row, part = owner[order], row[order], part[order]
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    small = -32768 <= part.min() and part.max() < 32768
    part = part.astype(np.int16 if small else np.int32)
    return [(int(owner[a]), (row[a:z].copy(), part[a:z].copy())) for a, z in zip(first, np.append(first[1:], len(owner)))]


def gathered(records) -> list[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """The blocks of each owner as one."""
    by: dict[int, list] = {}
    for owner, block in records:
        by.setdefault(owner, []).append(block)
    return [(owner, b[0] if len(b) == 1 else tuple(map(np.concatenate, zip(*b)))) for owner, b in by.items()]


def first_members(rows: DataFrame, codebooks: np.ndarray, layout: Layout):
    """Members of all rows under the first codebooks, shuffled to their owners."""
    parts, _, width = codebooks.shape

    def deal(batches):
        held = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= HELD:
                yield from dealt_out(held)
                held = []
        yield from dealt_out(held)

    def dealt_out(held):
        row = np.concatenate([b.column(0).to_numpy() for b in held] or [np.empty(0, np.int64)])
        q = np.frombuffer(b"".join(x for b in held for x in b.column(1).to_pylist()), "<i4").reshape(len(row), parts * width)
        for p, part in enumerate(np.split(q, parts, axis=1)):
            entry, _ = nearest(part, codebooks[p])
            made = blocks(layout.owner(p, entry, row), row, part)
            yield pa.RecordBatch.from_pydict({"owner": [o for o, _ in made], "rows": [b[0].tobytes() for _, b in made], "parts": [b[1].tobytes() for _, b in made], "small": [b[1].itemsize == 2 for _, b in made]}, schema)

    schema = pa.schema([("owner", pa.int64()), ("rows", pa.binary()), ("parts", pa.binary()), ("small", pa.bool_())])
    dealt = rows.select("row", "q").mapInArrow(deal, "owner long, rows binary, parts binary, small boolean").rdd
    return dealt.map(lambda r: (r.owner, (np.frombuffer(r.rows, np.int64), np.frombuffer(r.parts, np.int16 if r.small else np.int32).reshape(-1, width)))).partitionBy(layout.partitions, layout.place)


def reassigned(members, codebooks: np.ndarray, layout: Layout):
    """(owner, (moved, rows, parts)): members with their owner under new codebooks. They still lie where they were."""

    def look(records):
        for owner, (row, part) in gathered(records):
            position, old = divmod(owner // layout.salts, layout.entries)
            entry, _ = nearest(part, codebooks[position])
            for moved in (False, True):
                mine = np.flatnonzero((entry != old) == moved)
                for o, (r, v) in blocks(layout.owner(position, entry[mine], row[mine]), row[mine], part[mine]):
                    yield o, (moved, r, v)

    return members.mapPartitions(look, preservesPartitioning=True)


def settled_members(looked, layout: Layout):
    """Residents that stay, and movers that are shuffled to their new owners: partitioned by owner as before."""
    stay = looked.filter(lambda x: not x[1][0]).mapValues(lambda x: x[1:])
    move = looked.mapPartitions(lambda records: ((o, x[1:]) for o, x in records if x[0])).partitionBy(layout.partitions, layout.place)  # forgets where they lie, so that they are shuffled
    return stay.union(move)


def means(members, codebooks: np.ndarray, layout: Layout) -> np.ndarray:
    """Codebooks whose entries are the floors of their members' means; those without members stay. A row for each entry comes to the driver."""

    def sums(records):
        found: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        for owner, (_, part) in records:
            key = divmod(owner // layout.salts, layout.entries)
            n, total = found.get(key, (0, 0))
            found[key] = (n + len(part), total + part.sum(axis=0, dtype=np.int64))
        return found.items()

    out = codebooks.copy()
    tasks = max(1, min(layout.partitions, 16))
    for (position, entry), (n, total) in members.mapPartitions(sums).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), tasks).collect():
        out[position, entry] = total // n
    return out


def train(rows: DataFrame, codebooks: np.ndarray, layout: Layout, rounds: int):
    """The members under the codebooks before the last, and the last codebooks."""
    members, held = first_members(rows, codebooks, layout), None
    for k in range(rounds):
        if k:
            looked = reassigned(members, codebooks, layout).persist(StorageLevel.MEMORY_AND_DISK)
            if k == rounds // 2:
                looked.checkpoint()
            members = settled_members(looked, layout)
        last, codebooks = codebooks, means(members, codebooks, layout)
        if k:
            if held is not None:
                held.unpersist()
            held = looked
        if (last == codebooks).all():  # no later round changes anything
            break
    return members, codebooks


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, per_owner: int = 1 << 16) -> tuple[DataFrame, np.ndarray]:
    """A row for each kept vector, and the final codebooks (parts x entries x numbers of a part). At most 256 entries.

    A row: id_col, label_col, code (binary, a byte for each part), error (final squared distances summed over parts, long)
    and label_error (error summed over labels that are equal as strings, nulls together)."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    spark = vectors.sparkSession
    ready(spark)
    fields = {c: vectors.schema[c] for c in (id_col, label_col)}

    def numbers(batches):
        for batch in batches:
            keep, q, size = whole_numbers(batch.column(2), scale)
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(q, pa.binary()), pa.array(size)], names=["id", "label", "q", "size"])

    kind = T.StructType([T.StructField("id", fields[id_col].dataType), T.StructField("label", fields[label_col].dataType), T.StructField("q", T.BinaryType()), T.StructField("size", T.LongType())])
    clean = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).mapInArrow(numbers, kind)
    clean = clean.where(F.col("size") % parts == 0).withColumn("row", F.monotonically_increasing_id()).checkpoint()
    sizes = clean.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    size, n = (sizes["size"], sizes["count"]) if sizes else (parts, 0)
    rows = clean.where(F.col("size") == size)
    first = rows.select("id", "q").orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).collect()
    codebooks = np.array([np.frombuffer(r.q, "<i4") for r in first], np.int64).reshape(len(first), parts, size // parts).transpose(1, 0, 2)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-parts * n // 1_000_000))
    salts = max(-(-4 * partitions // (parts * max(len(first), 1))), -(-n // per_owner), 1)
    layout = Layout(max(len(first), 1), salts, partitions)

    def codes(records):
        for owner, (row, part) in records:
            position = owner // layout.salts // layout.entries
            entry, distance = nearest(part, codebooks[position])
            for lo in range(0, len(row), CHUNK):
                hi = lo + CHUNK
                yield position, row[lo:hi].tobytes(), entry[lo:hi].astype(np.uint8).tobytes(), distance[lo:hi].tobytes()

    def unpacked(batches):
        for batch in batches:
            for p, r, e, d in zip(*(c.to_pylist() for c in batch.columns)):
                row = np.frombuffer(r, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.full(len(row), p, np.int32)), pa.array(np.frombuffer(e, np.uint8).astype(np.int32)), pa.array(np.frombuffer(d, np.int64))], names=["row", "position", "entry", "distance"])

    if n:
        members, codebooks = train(rows, codebooks, layout, rounds)
        packed = spark.createDataFrame(members.mapPartitions(codes), "position int, rows binary, entries binary, distances binary", verifySchema=False)
        coded = packed.mapInArrow(unpacked, "row long, position int, entry int, distance long")
    else:
        coded = spark.createDataFrame([], "row long, position int, entry int, distance long")
    digit = [F.max(F.when(F.col("position") == p, F.lpad(F.hex("entry"), 2, "0"))) for p in range(parts)]
    code = coded.groupBy("row").agg(F.unhex(F.concat(*digit)).alias("code"), F.sum("distance").alias("error"))
    found = rows.select("row", "id", "label").join(code, "row").select("id", "label", F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("key"), "code", "error").checkpoint()
    groups = found.groupBy("none", "key").agg(F.sum("error").alias("label_error"), F.count("*").alias("members"))
    return join_groups(found, groups, ["none", "key"], "members").select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error"), codebooks


def books_digest(codebooks) -> str:
    """Lowercase hex SHA-256 of all entries' decimal components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in np.asarray(codebooks).ravel()).encode()).hexdigest()
