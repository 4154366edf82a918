"""Substring dedup, Jaccard join and decontamination against brute force."""

import hashlib
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cohortcast.llm.decontaminate import contamination, decontaminate
from cohortcast.llm.graphs import components
from cohortcast.llm.ngram_jaccard import signature_bits, similar_texts
from cohortcast.llm.substring_dedup import remove_repeats

from .conftest import kept_columns

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_repeats(rows, window):
    first = {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (d, i))
    out = {}
    for d, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] != (d, i) for j in range(i, i + window)}
        out[d] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("window", [3, 20])
def test_repeats(docs, corpus, window):
    got = {r[0]: tuple(r[1:]) for r in remove_repeats(docs, window=window).select("doc_id", "n_words", "n_removed", "kept").collect()}
    assert got == brute_repeats(corpus, window)


def test_repeated_rows_and_null_ids_keep_each_other(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text), (1, text), (None, text), (2, None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, 1, 0), (False, 1, 0), (False, 2, 0), (True, 0, 30)]


def test_empty_tables(empty):
    assert remove_repeats(empty).count() == 0
    assert similar_texts(empty).count() == 0
    assert contamination(empty, empty.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def brute_components(rows, n, percent):
    sets = {}
    for d, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    for a, b in combinations(sets, 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i) and label[a] != label[b]:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {d: new if x == old else x for d, x in label.items()}
    return {d: (len(s), label[d]) for d, s in sets.items()}


@pytest.mark.parametrize("percent,frequent,tile", [(85, 1 << 16, 256), (30, 4, 2)])
def test_components(docs, corpus, percent, frequent, tile):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_texts(docs, shingle=4, percent=percent, frequent=frequent, tile=tile).collect()}
    assert got == brute_components(corpus, 4, percent)


def test_large_group_of_near_copies(spark):
    """700 copies of one text, each with its own changes, over 30 partitions; a passage that every text has; texts alike by chance."""
    rnd = random.Random(11)
    base, passage = [f"b{k}" for k in range(120)], [f"p{k}" for k in range(12)]
    vocab = [f"v{k}" for k in range(30)]
    rows = []
    for k in range(700):
        words = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 5, 9])):
            words[rnd.randrange(120)] = f"n{rnd.randrange(40)}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join([*passage, *(rnd.choice(vocab) for _ in range(rnd.randint(3, 60)))])) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(30)
    for tile in (16, 128):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_texts(df, shingle=4, percent=85, tile=tile).collect()}
        assert got == brute_components(rows, 4, 85)
    assert len({c for _, c in got.values()}) > 160


def test_signatures_fold():
    import numpy as np

    from cohortcast.llm.ngram_jaccard import folded, signatures

    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 500, dtype=np.int64).astype(np.uint64))
    b = np.unique(np.concatenate((a[30:], rng.integers(0, 2**63, 60, dtype=np.int64).astype(np.uint64))))
    size = np.array([len(a), len(b)])
    assert signature_bits(size).tolist() == [1024, 2048]
    x, y = (np.frombuffer(s, np.uint64) for s in signatures(size, np.repeat([0, 1], size), np.concatenate((a, b))))
    assert int(np.bitwise_count(x ^ folded(y, len(x))).sum()) <= len(np.setxor1d(a, b))


def test_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {k: 0 for k in range(51)} | {100: 100, 101: 100}


def brute_contamination(rows, items, n):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        k = min(n, len(w))
        for p in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[p : p + k]), set()).add(str(i))
    out = {}
    for d, t, *_ in rows:
        w = word.findall((t or "").translate(LOWER))
        hit, seen = set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if found := windows.get(tuple(w[p : p + k])):
                    hit |= set(range(p, p + k))
                    seen |= found
        out[d] = (len(w), len(hit), ",".join(sorted(seen)), bool(hit) and 20 * len(hit) >= len(w))
    return out


def items_of(corpus):
    long = next(r[1] for r in corpus if r[1] and r[1].startswith("same text"))
    return [(3, long.upper()), (10, "One, two"), (11, None), (12, ""), (2, long), (20, "naïve-ünï")]


@pytest.mark.parametrize("max_windows", [500_000, 10])
def test_contamination(spark, docs, corpus, max_windows):
    items = items_of(corpus)
    got = contamination(docs, spark.createDataFrame(items, "item_id long, text string"), max_windows=max_windows)
    got = {r.id: (r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in got.collect()}
    assert got == brute_contamination(corpus, items, 13)


def test_removal_of_documents_and_spans(spark, docs, corpus):
    items = items_of(corpus)
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute_contamination(corpus, items, 13)
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, v in expected.items() if not v[3]}
    cut = decontaminate(docs, bench, remove="spans").collect()
    assert kept_columns(kept.collect(), docs.columns) and kept_columns(cut, docs.columns)
    cut = {r.doc_id: r.text for r in cut}
    left = brute_contamination([(d, t) for d, t in cut.items()], [], 13)
    for d, (n, hit, _, bad) in expected.items():
        assert left[d][0] == (n - hit if bad else n)


def test_kept_digest_is_of_utf8(spark):
    from cohortcast.llm.queries import digest

    got = spark.createDataFrame([("é b",)], "t string").select(digest(F.col("t")).alias("h")).first().h
    assert got == hashlib.sha256("é b".encode()).hexdigest()
