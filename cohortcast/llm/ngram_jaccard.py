"""Similarity join of texts by the Jaccard coefficient of their word shingles.

Texts with equal sets are one class. A set's keys are its first n - ceil(t * n) + l shingles in one
fixed order (frequent shingles last), so that two sets of Jaccard t or more share l keys (l = 1 + n / SHARED,
of the smaller set). A key is of use to a set if another set of a fitting size has it; sets with fewer
such keys than l have no links, which leaves out sets that share a few shingles by chance. Sets of a key
are parted where their sizes leave a gap; the least set of each part is its head, and all sets of
parts with one head are a group.

Signatures are compared first: each shingle flips the bit that it hashes to, so two signatures differ in at
most as many bits as shingles are in one set only, which bounds the overlap from above; what sizes and bits
allow is decided by the sorted shingle arrays. Round 1 compares each set with the heads of its groups, which
is linear in the rows, whatever the size of a group, and joins most near copies. What is left of a group goes
to tiles: the sets outside its largest component (probes) meet all sets of the group (targets) whose size band
is their own or the next. Bands are as wide as sizes of linked sets can differ, tiles take at most `tile` sets
a side, fewer of long ones. Tiles of signatures give clusters of what may be linked; tiles of clusters, dealt
in the same way, compare arrays. A tile returns pairs that connect what it finds connected, so results are
linear in the rows; no pair of different components is left out.

Frequent shingles are found by summaries with a proven error (`frequent_shingles`), so that every key that
isn't in their table has a bounded share of all rows. Keys of the table are grouped by aggregation and a
broadcast of at most `frequent` rows; the other keys go through a window. Groups, components and classes
with many rows are joined by broadcasts of bounded tables (graphs.join_groups) or in salted parts.

Equal sets are told by 128 bits of hashes. Within a pair, shingles are told by 64 bits: of two sets of n,
two different shingles are taken for one with a chance below n * n / 2**64.

Empty, blank and null texts have no shingles and no links: each is its own component. Equal rows are
one class. A null id never names a component unless it has no other. Other columns are dropped, so that
no name can clash. Empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import components, join_groups, most_frequent, ready, settled
from .text import U64, Words, batches, freeing, mix

LEAST_BITS = 512
SHARED = 16


def signature_bits(n: np.ndarray) -> np.ndarray:
    """Length of the signature of a set of n: a power of two, at least twice n, so that long texts don't fill it."""
    return np.maximum(LEAST_BITS, 2 ** np.ceil(np.log2(np.maximum(2 * n, 2))).astype(np.int64))


def signatures(size: np.ndarray, doc: np.ndarray, got: np.ndarray) -> list[bytes]:
    """Each set's signature: a shingle flips the bit that it hashes to. Halves can be laid upon each other (by xor)
    to get the signature of half the length."""
    bits = signature_bits(size)
    end = np.cumsum(bits)
    at = (end - bits)[doc] + (mix(got ^ U64(0x2545F491)) & (bits[doc] - 1).astype(U64)).astype(np.int64)
    odd = np.packbits((np.bincount(at, minlength=int(end[-1]) if len(end) else 0) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [odd[a // 8 : b // 8] for a, b in zip((end - bits).tolist(), end.tolist())]


def folded(words: np.ndarray, length: int) -> np.ndarray:
    """Signatures of 64-bit words in the last axis, halved until they have `length` words."""
    while words.shape[-1] > length:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def shingle_sets(texts: list[bytes | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each text's distinct shingles, in order. Texts of fewer words have one: all of them."""
    words = Words(texts, lower=True)
    doc, got = [], []
    for k in range(1, n + 1):
        h, at = words.grams(k)
        d = words.doc[at]
        if k < n:
            short = words.count[d] == k
            h, d = h[short], d[short]
        doc.append(d), got.append(h)
    doc, got = np.concatenate(doc), np.concatenate(got)
    order = np.lexsort((got, doc))
    doc, got = doc[order], got[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (got[1:] != got[:-1])) if len(doc) else np.empty(0, bool)
    return doc[new], got[new]


def _parts(batch, at):
    col = batch.column(at).cast(pa.binary())
    for lo, hi in batches(col):
        yield lo, hi, col.slice(lo, hi - lo).to_pylist()


def frequent_shingles(texts: DataFrame, n: int, frequent: int, counters: int = 1 << 14, least: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the frequent shingles, at most `frequent` of them.

    Each task keeps a summary of at most `counters` counts: when there are more, the next lower count is taken from
    all, and those without any left are forgotten. A count is too low by at most 1 / counters of all shingles, so
    whatever occurs more often than that, and `least` times, is counted, wherever it occurs.
    """

    def top(rows):
        keys, counts = np.empty(0, U64), np.empty(0, np.int64)
        for batch in rows:
            for _, _, part in _parts(batch, 0):
                k, c = np.unique(shingle_sets(part, n)[1], return_counts=True)
                keys, inverse = np.unique(np.concatenate((keys, k)), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate((counts, c)), len(keys)).astype(np.int64)
                if len(keys) > counters:
                    counts = counts - np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1]
                    keys, counts = keys[counts > 0], counts[counts > 0]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "c"])

    found = texts.select("text").mapInArrow(freeing(top), "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    rows = most_frequent(found, "c", frequent).toPandas()  # at most `frequent` rows
    keys, counts = rows["key"].to_numpy(np.int64).view(U64), rows["c"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def _nodes(doc: np.ndarray, got: np.ndarray, n_texts: int):
    """Size of each text's set, where it begins, and two hashes of the whole set."""
    size = np.bincount(doc, minlength=n_texts)
    first = np.cumsum(size) - size
    out = []
    with np.errstate(over="ignore"):
        for seed in (0x51ED270B, 0x7F4A7C15):
            sums = np.append(U64(0), np.cumsum(mix(got + U64(seed))))
            out.append(mix(sums[first + size] - sums[first] + size.astype(U64)))
    return size, first, *out


def describe(texts: DataFrame, n: int, percent: int, table) -> DataFrame:
    """id, row, n, node and check (hashes of the set; null if empty), keys (rare ones), often (keys of the frequent table) and bits."""

    def run(rows):
        known, counts = table.value
        for batch in rows:
            for lo, hi, part in _parts(batch, 2):
                doc, got = shingle_sets(part, n)
                size, first, node, check = _nodes(doc, got, hi - lo)
                weight = np.zeros(len(got), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, got), len(known) - 1)
                    weight = np.where(known[at] == got, counts[at], 0)
                order = np.lexsort((mix(got), weight, doc))
                place = np.arange(len(got)) - first[doc]
                keep = order[place < (size + (-percent * size // 100) + 1 + size // SHARED)[doc]]
                listed = []
                for chosen in (keep[weight[keep] == 0], keep[weight[keep] > 0]):
                    edge = np.searchsorted(doc[chosen], np.arange(hi - lo + 1))
                    listed.append(pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(got[chosen].view(np.int64))))
                hashes = [pa.array(h.view(np.int64), mask=size == 0) for h in (node, check)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(size), *hashes, *listed, pa.array(signatures(size, doc, got), pa.binary())], names=["id", "row", "n", "node", "check", "keys", "often", "bits"])

    return texts.mapInArrow(freeing(run), "id long, row long, n long, node long, check long, keys array<long>, often array<long>, bits binary")


def shingles_of(texts: DataFrame, nodes: DataFrame, n: int, twice: list[int], most_bits: int = 1 << 25) -> DataFrame:
    """(node, shingles) for nodes (node, row), read from the text of that row alone, whatever copies it has.

    A Bloom filter over (node, row), of about 16 bits each and at most `most_bits`, picks the texts map-side; a join
    settles the rest. twice: hashes that several sets have; their nodes are made of both hashes.
    """
    spark = texts.sparkSession
    count = nodes.count()
    size = min(most_bits, 1 << max(12, (16 * count - 1).bit_length() if count else 0))
    shifts = (0, 20, 39)
    at = nodes.select(F.expr("node ^ row").alias("x")).select(F.explode(F.array(*[F.expr(f"shiftrightunsigned(x, {s}) & {size - 1}") for s in shifts])).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("v")).toPandas()  # at most size / 64 rows
    out = np.zeros(size // 64, U64)
    out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).view(U64)
    held = spark.sparkContext.broadcast(out)

    def run(rows):
        bits, seen = held.value, set()
        for batch in rows:
            for lo, hi, part in _parts(batch, 2):
                doc, got = shingle_sets(part, n)
                many, first, node, check = _nodes(doc, got, hi - lo)
                node = np.where(np.isin(node.view(np.int64), twice), node ^ check, node)
                row = batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False).view(U64)
                x, may = node ^ row, many > 0
                for s in shifts:
                    at = (x >> U64(s)) & U64(size - 1)
                    may &= (bits[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) > 0
                for k in np.flatnonzero(may).tolist():  # equal rows of a task once
                    may[k] = (pair := (int(node[k]), int(row[k]))) not in seen
                    seen.add(pair)
                listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many[may])).astype(np.int32)), pa.array(got[may[doc]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node[may].view(np.int64)), pa.array(row[may].view(np.int64)), listed], names=["node", "row", "shingles"])

    found = texts.mapInArrow(freeing(run), "node long, row long, shingles array<long>")
    return found.join(nodes.select("node", "row"), ["node", "row"], "left_semi").dropDuplicates(["node", "row"]).drop("row")


def _allowed_pairs(percent: int):
    """For mapInArrow over pairs (a, b, n_a, n_b, bits_a, bits_b): those that sizes and signatures allow."""

    def run(rows):
        for batch in rows:
            differ = np.zeros(len(batch), np.int64)
            for k, (p, q) in enumerate(zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())):
                x, y = np.frombuffer(p, U64), np.frombuffer(q, U64)
                least = min(len(x), len(y))
                differ[k] = np.bitwise_count(folded(x, least) ^ folded(y, least)).sum()
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            total = n_a + n_b
            keep = pa.array((100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & ((100 + percent) * (total - differ) >= 2 * percent * total))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b", "salt")], names=["a", "b", "salt"])

    return run


def _with_both(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (a, b, salt) with the columns of held (by node) as x_a and x_b. Rows of b are copied for each of its salts."""
    side = lambda k: held.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in held.columns if c != "node"])
    heads = pairs.select("b", "salt").distinct().join(side("b"), "b")
    return pairs.join(side("a"), "a").join(heads, ["b", "salt"])


def near_heads(pairs: DataFrame, bits: DataFrame, percent: int, share: int = 256, most: int = 1 << 16) -> DataFrame:
    """(a, b, salt): those of the pairs (a: a set, b: a head) that sizes and signatures allow. A head of more than `share` pairs is salted."""
    counts = most_frequent(pairs.groupBy("b").agg(F.count("*").alias("c")).where(F.col("c") > share), "c", most)
    salted = pairs.join(F.broadcast(counts), "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.ceil(F.col("c") / share)), F.lit(0)).cast("int").alias("salt"))
    return _with_both(salted, bits).mapInArrow(freeing(_allowed_pairs(percent)), "a long, b long, salt int")


def linked_pairs(near: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b, salt) that reach the coefficient."""
    both = _with_both(near, arrays).withColumn("same", F.size(F.array_intersect("shingles_a", "shingles_b")))
    return both.where(100 * F.col("same") >= percent * (F.size("shingles_a") + F.size("shingles_b") - F.col("same"))).select("a", "b")


def _near(t: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (probe, target) of a tile that have different roots and that sizes and signatures allow, the nearest first."""
    probe, target = np.flatnonzero(t["probe"]), np.flatnonzero(~t["probe"])
    n, root = t["n"], t["root"]
    small, large = np.minimum.outer(n[probe], n[target]), np.maximum.outer(n[probe], n[target])
    i, j = np.nonzero((root[probe][:, None] != root[target][None, :]) & (100 * small >= percent * large))
    i, j = probe[i], target[j]
    length = np.fromiter(map(len, t["bits"]), np.int64, len(n)) // 8
    differ = np.zeros(len(i), np.int64)
    for p in np.unique(length[i]):
        for q in np.unique(length[j]):
            least = min(p, q)
            some = np.flatnonzero((length[i] == p) & (length[j] == q))
            step = max(1, (1 << 20) // least)
            for k in range(0, len(some), step):
                part = some[k : k + step]
                words = []
                for at, size in ((i[part], p), (j[part], q)):
                    own, inverse = np.unique(at, return_inverse=True)
                    words.append(folded(np.frombuffer(b"".join(t["bits"][own]), U64).reshape(len(own), size), least)[inverse])
                differ[part] = np.bitwise_count(words[0] ^ words[1]).sum(axis=1, dtype=np.int64)
    total = n[i] + n[j]
    keep = (100 + percent) * (total - differ) >= 2 * percent * total
    i, j = i[keep], j[keep]
    order = np.argsort((differ / np.maximum(total, 1))[keep], kind="stable")
    return i[order], j[order]


def near_forest(t: dict, percent: int):
    """Pairs of nodes that connect what the near pairs of a tile connect: a tree for each part."""
    i, j = _near(t, percent)
    if not len(i):
        return
    node = t["node"]
    ok = np.zeros((len(node), len(node)), bool)
    ok[i, j] = ok[j, i] = True
    new = np.ones(len(node), bool)
    for start in np.unique(i).tolist():
        if not new[start]:
            continue
        new[start] = False
        queue = [start]
        for x in queue:
            found = np.flatnonzero(ok[x] & new)
            new[found] = False
            queue.extend(found.tolist())
            for y in found:
                yield node[x], node[y]


def linked_roots(t: dict, percent: int):
    """Pairs of roots of a tile that sets link, enough to connect all that are linked."""
    names, group = np.unique(t["root"], return_inverse=True)
    label, sets = np.arange(len(names)), t["shingles"]
    i, j = _near(t, percent)
    while len(i):
        x, y = i[:1024], j[:1024]
        for a, b in zip(x, y):
            p, q = label[group[a]], label[group[b]]
            if p != q:
                small, large = sorted((sets[a], sets[b]), key=len)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                same = int((large[at] == small).sum())
                if 100 * same >= percent * (len(small) + len(large) - same):
                    label[label == max(p, q)] = min(p, q)
                    yield t["root"][a], t["root"][b]
        i, j = i[1024:], j[1024:]
        open_pairs = label[group[i]] != label[group[j]]
        i, j = i[open_pairs], j[open_pairs]


def _by_tile(judge, percent: int, exact: bool):
    """For mapInArrow over rows sorted by tile: the pairs (a, b) that `judge` finds in each tile. exact: with shingle arrays."""

    def columns(batch):
        out = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "probe", "node", "n", "root")}
        out["bits"] = np.fromiter(batch.column("bits").to_pylist(), object, len(batch))
        if exact:
            out["shingles"] = np.empty(len(batch), object)
            for k, s in enumerate(batch.column("shingles")):
                out["shingles"][k] = s.values.to_numpy().view(U64)
        return out

    def run(rows):
        left = None
        for batch in rows:
            for lo in range(0, len(batch), 512):
                now = columns(batch.slice(lo, 512))
                if left is not None:
                    now = {c: np.concatenate((left[c], now[c])) for c in now}
                edge = [0, *(np.flatnonzero(now["tile"][1:] != now["tile"][:-1]) + 1).tolist()]
                for a, b in zip(edge, edge[1:]):
                    yield from emit({c: v[a:b] for c, v in now.items()})
                left = {c: v[edge[-1] :] for c, v in now.items()}
        if left is not None:
            yield from emit(left)

    def emit(t):
        pairs = list(judge(t, percent))
        if pairs:
            a, b = np.array(pairs, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def tiles(rows: DataFrame, percent: int, tile: int) -> DataFrame:
    """(tile, probe, node, root) for rows (hub, node, n, root, probe): each probe meets each target of its hub whose band is its own or a next one."""
    width = math.log(100 / percent) * (1 + 1e-9)
    banded = settled(rows.withColumn("band", F.floor(F.log("n") / width).cast("int")))
    probes = banded.where("probe").select("hub", "node", "root", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    sizes = banded.groupBy("hub", "band").agg(F.count("*").alias("targets"))
    most = F.greatest(F.lit(16), F.least(F.lit(tile), F.floor((1 << 20) / F.exp(F.col("band") * width)))) if tile >= 16 else F.lit(tile)
    deal = sizes.join(probes.groupBy("hub", "band").agg(F.count("*").alias("probes")), ["hub", "band"])
    deal = settled(deal.select("hub", "band", "targets", "probes", F.ceil(F.col("targets") / most).cast("int").alias("high"), F.ceil(F.col("probes") / most).cast("int").alias("wide")))
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    named = lambda df, probe: df.select(F.xxhash64("hub", "band", "i", "j").alias("tile"), F.lit(probe).alias("probe"), "node", "root")
    targets = join_groups(banded.select("hub", "node", "root", "band"), deal, ["hub", "band"], "targets").select("hub", "node", "root", "band", own("high").alias("i"), each("wide").alias("j"))
    met = join_groups(probes, deal, ["hub", "band"], "probes").select("hub", "node", "root", "band", each("high").alias("i"), own("wide").alias("j"))
    return named(targets, False).unionAll(named(met, True))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, frequent: int = 1 << 16, tile: int = 128, rows: bool = False) -> DataFrame:
    """id_col, n_shingles and component_id, the smallest id that links of Jaccard percent / 100 or more reach.

    rows: adds row (xxhash64 of id_col and text_col) and first, whether the row is its component's first: of the
    rows of the smallest id, the one of the least hash. Equal rows are first together.
    """
    if not 10 <= percent <= 100:
        raise ValueError("percent: from 10 to 100")
    spark = docs.sparkSession
    ready(spark)
    id = F.col(id_col).cast("long")
    texts = docs.select(id.alias("id"), F.xxhash64(id, F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    table = spark.sparkContext.broadcast(frequent_shingles(texts, shingle, frequent))
    sets = describe(texts, shingle, percent, table).checkpoint()

    def by_node(sets):
        own = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
        return settled(sets.where("node is not null").groupBy("node").agg(F.min(own).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bits").alias("bits"), (F.min("check") < F.max("check")).alias("twice")))

    classes = by_node(sets)
    twice = [r["node"] for r in classes.where("twice").select("node").collect()]  # hashes that different sets share: next to none
    if twice:
        sets = sets.withColumn("node", F.when(F.col("node").isin(twice), F.col("node").bitwiseXOR(F.col("check"))).otherwise(F.col("node")))
        classes = by_node(sets)

    # keys that sets of fitting sizes share, and the sets that have enough of them
    by_size = Window.partitionBy("key").orderBy("n")
    fits = lambda x, y: F.coalesce(100 * x >= percent * y, F.lit(False))
    rare = sets.select("node", "n", F.explode("keys").alias("key")).repartition("key").distinct()
    rare = rare.withColumns({"below": F.lag("n").over(by_size), "above": F.lead("n").over(by_size)}).where(fits(F.col("below"), F.col("n")) | fits(F.col("n"), F.col("above")))
    often = sets.select("node", "n", F.explode("often").alias("key")).distinct()
    shared = often.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last")  # at most `frequent` rows
    kept = settled(rare.select("key", "node", "n", F.lit(False).alias("often")).unionAll(often.join(F.broadcast(shared.select("key")), "key").select("key", "node", "n", F.lit(True))))
    enough = kept.groupBy("node").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(F.col("c") > F.floor(F.ceil(F.col("n") * percent / 100 - 1e-6) / SHARED)).select("node")
    kept = settled(kept.join(enough, "node", "left_semi"))

    # parts of keys, their heads, and whether a part has more than its head and one set
    part = Window.partitionBy("key", "part")
    rare = kept.where("not often").withColumn("part", F.sum(F.when(fits(F.lag("n").over(by_size), F.col("n")), 0).otherwise(1)).over(by_size))
    rare = rare.select("node", F.min("node").over(part).alias("hub"), F.max("node").over(part).alias("last"), F.count("*").over(part).alias("c")).where("hub < last").select("hub", "node", "c")
    often = kept.where("often")
    heads = often.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("c")).where("hub < last").select("key", "hub", "c")  # at most `frequent` rows
    groups = settled(rare.unionAll(often.join(F.broadcast(heads), "key").select("hub", "node", "c")).groupBy("hub", "node").agg((F.max("c") > 2).alias("many")))
    bits = settled(classes.select("node", "n", "bits").join(groups.select("node").distinct(), "node", "left_semi"))
    place = classes.select("node", F.col("first.row").alias("row"))
    near = settled(near_heads(groups.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")), bits, percent))
    wanted = settled(near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(place, "node"))
    links = settled(linked_pairs(near, settled(shingles_of(texts, wanted, shingle, twice), 10_000), percent))
    roots = settled(components(links))

    def in_tiles(rows, judge, held):
        """What `judge` finds in tiles of the groups of rows (hub, node) that have different roots."""
        labelled = settled(rows.join(bits.select("node", "n"), "node").join(roots, "node", "left").select("hub", "node", "n", F.coalesce("root", "node").alias("root")))
        parts = labelled.groupBy("hub", "root").agg(F.count("*").alias("c"))
        split = settled(parts.groupBy("hub").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("c"), F.count("*").alias("parts")).where("parts > 1").select("hub", "c", F.col("most.root").alias("most")))
        left = join_groups(labelled, split, ["hub"], "c").select("hub", "node", "n", "root", (F.col("root") != F.col("most")).alias("probe"))
        dealt = tiles(left, percent, tile).join(bits, "node")
        dealt = dealt.join(held, "node") if held else dealt
        to = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return settled(dealt.repartition(to, "tile").sortWithinPartitions("tile").mapInArrow(freeing(_by_tile(judge, percent, held is not None)), "a long, b long"))

    linked = roots
    close = in_tiles(groups.where("many").select("hub", "node"), near_forest, None)
    if not close.isEmpty():
        clusters = settled(components(close).select(F.col("root").alias("hub"), "node"))
        more = in_tiles(clusters, linked_roots, settled(shingles_of(texts, settled(clusters.select("node").join(place, "node")), shingle, twice), 10_000))
        linked = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))

    ids = settled(classes.select("node", "first", "copies").join(linked, "node", "left"))
    least = ids.where("root is not null").groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("c"))
    joined = join_groups(ids.where("root is not null").select("node", "root", "copies"), least, ["root"], "c").select("node", "copies", "least")
    names = joined.unionByName(ids.where("root is null and copies > 1").select("node", "copies", F.col("first").alias("least")))
    out = join_groups(sets.select("id", "row", "n", "node"), names, ["node"], "copies", "left")
    found = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("least").isNull(), F.col("id")).otherwise(F.col("least.id")).alias("component_id")]
    own = F.col("least").isNull() | (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("row") == F.col("least.row")))
    return out.select(*found, *([F.col("row"), own.alias("first")] if rows else []))
