"""The audit of filters against running them, order by order."""

import re
from collections import Counter
from itertools import permutations

from cohortcast.llm import filter_audit


def failures(rows):
    """Names of the filters that each row (doc_id, text) fails."""
    least = {}
    for k, t in rows:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    out = []
    for k, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append(
            {f for f, bad in (("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)), ("C", 100 * len(re.findall("[A-Z]", t)) > 10 * len(t)), ("D", bool(re.search(r"[#$%&*|]", t))), ("E", k is not None and k > least[t])) if bad}
        )
    return out


def brute(docs, labels):
    fails = failures([(d[0], d[1]) for d in docs])
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, x in labels if x == 1 and k is not None}
    parts, got = {d[2] or "" for d in docs}, {}
    for part in parts:
        mine = [(d[0], f) for d, f in zip(docs, fails) if (d[2] or "") == part]
        share = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for k, name in enumerate(order, 1):
                gone = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                share[name] += len(gone)
                got[part, "".join(order), k] = [len(left), len(gone), sum(name in f for _, f in mine) - len(gone), sum(f == {name} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, k), row in got.items():
            if p == part:
                row.append(share[order[k - 1]])
    return got


def check(spark, rows, labels, schema="doc_id long, text string, lang string"):
    docs = spark.createDataFrame(rows, schema)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit_texts(docs.repartition(3), table).collect()
    want = brute(rows, labels)
    assert len(got) == len(want)
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step], r


def test_every_order(spark, corpus):
    texts = [(k, t, lang) for k, t, lang, *_ in corpus]
    wordy = " ".join(f"w{k}" for k in range(130))
    texts += [(1000, wordy, "en"), (1001, wordy + " #", "en"), (1002, wordy + " " + "A" * 200, ""), (1003, wordy, "de"), (1004, wordy.upper() + " |", None), (None, wordy, "en")]
    texts += [(1003, wordy, "de"), (1003, "other", "de"), (5, "one two", None)]  # repeated rows, and ids with two texts
    labels = [(k, k % 2, 1 if k % 3 == 0 else 0) for k in range(0, 60)] + [(1000, 1, None), (1003, None, 1), (1003, 1, 0), (1003, 0, 0), (None, 1, 1), (9999, 1, 1)]
    check(spark, texts, labels)


def test_extra_columns_and_empty_tables(spark):
    wide = "doc_id long, text string, lang string, row string, part string, E string, good string, digest string, n_words string"
    check(spark, [(1, "a", "en", *["clash"] * 6), (2, "a", "en", *["clash"] * 6)], [(1, 1, 0)], wide)
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.audit_texts(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
    check(spark, [(1, None, None)], [])


def test_long_texts_in_parts(monkeypatch):
    text = " ".join(f"w{k % 700}" for k in range(5000)).encode() + b"\n\x0b "
    want = filter_audit.word_counts(text)
    for size in (1, 64, 5000):
        monkeypatch.setattr(filter_audit, "CHUNK", size)
        assert filter_audit.word_counts(text) == want == (5000, 700)


def test_joins_neither_shuffle_nor_sort(spark):
    from cohortcast.llm.graphs import ready

    ready(spark)
    rows = spark.range(2000).selectExpr("id AS row", "'x' AS part", "id % 7 = 0 AS good", "id % 11 = 0 AS toxic", "id % 2 = 0 AS A", "id % 3 = 0 AS B", "id % 5 = 0 AS C")
    plan = filter_audit.Failures(rows, ["A", "B", "C"]).counts(range(8))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort [" not in plan and plan.count("SortMergeJoin") == 20
