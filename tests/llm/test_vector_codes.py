"""Vector codes against plain Lloyd on whole numbers."""

import math
import random

import numpy as np
import pytest

from cohortcast.llm import vector_codes as V


def brute(rows, parts=8, entries=16, rounds=6):
    """(code, error) of each kept row by place, and the codebooks. rows: (id, vector, label), kept ones only, ids distinct."""
    x = [[math.floor(4096 * c) for c in v] for _, v, _ in rows]
    d = len(x[0]) // parts
    cut = lambda v, p: v[p * d : p * d + d]
    first = sorted(range(len(rows)), key=lambda k: rows[k][0])[:entries]
    books = [[cut(x[k], p) for k in first] for p in range(parts)]

    def assign():
        far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
        return [[min((far(cut(v, p), e), k) for k, e in enumerate(books[p])) for p in range(parts)] for v in x]

    for _ in range(rounds):
        given = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(x[i], p) for i in range(len(x)) if given[i][p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    return [("".join(f"{k:02x}" for _, k in g), sum(f for f, _ in g)) for g in assign()], books


SCHEMA = "vec_id long, embedding array<float>, label int, row string, key string, code string, owner string"


@pytest.mark.parametrize("n", [5, 16, 300])
def test_equals_plain_lloyd(spark, n):
    rnd = random.Random(n)
    place = [[rnd.uniform(-0.3, 0.3) for _ in range(16)] for _ in range(20)]
    make = lambda: [np.float32(c + rnd.choice([0, 0, 0.01, -0.02])).item() for c in rnd.choice(place[:3] if rnd.random() < 0.5 else place)]  # noqa: E731  a few places hold half of all
    good = [(k, make(), rnd.choice([1, 2, None])) for k in rnd.sample(range(10 * n), n)]
    bad = [(-1, None, 1), (-2, [], 1), (-3, [1.0] * 15 + [None], 1), (-4, [1.0] * 15 + [float("nan")], 1), (-5, [1.0] * 15 + [float("-inf")], 2), (-6, [1.0] * 9, 2), (-7, [1.0] * 8, 2)]
    df = spark.createDataFrame([(*r, *["clash"] * 4) for r in good + bad], SCHEMA).repartition(3)
    coded, books = V.compress(df)
    got = {r.vec_id: r for r in coded.collect()}
    want, last = brute(good)
    assert books.tolist() == last and set(got) == {k for k, *_ in good}
    of_label = {}
    for (_, _, label), (_, error) in zip(good, want):
        of_label[label] = of_label.get(label, 0) + error
    for (k, _, label), (code, error) in zip(good, want):
        assert (got[k].code.hex(), got[k].error, got[k].label_error, got[k].label) == (code, error, of_label[label], label)


def test_repeated_rows_null_ids_and_great_numbers(spark):
    v = [float(k) for k in range(8)]
    rows = [(1, v, 1), (1, v, 1), (1, v[::-1], 1), (None, v, None), (2, [3e38] * 8, 2), (3, [-3e38] * 8, 2)]
    coded, books = V.compress(spark.createDataFrame([(*r, *["clash"] * 4) for r in rows], SCHEMA))
    got = coded.collect()
    assert len(got) == 6 and sum(r.vec_id == 1 for r in got) == 3 and all(r.error == 0 for r in got)
    assert abs(books).max() == V.BOUND


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert V.compress(df)[0].collect() == []
    assert V.compress(spark.createDataFrame([(1, None, 1, "", "", "", "")], SCHEMA))[0].columns == ["vec_id", "label", "code", "error", "label_error"]


def test_only_parts_that_change_entry_move(spark):
    """Members lie with their owners after each round, and the shuffle carries none but the movers."""
    layout = V.Layout(4, 3, 5)
    rnd = random.Random(2)
    numbers = [(k, rnd.randrange(100)) for k in range(500)]
    members = spark.sparkContext.parallelize([(layout.owner(0, k % 4, k), (np.array([k]), np.array([[x]]))) for k, x in numbers], 3).partitionBy(5, layout.place)
    books = np.array([[[10], [30], [60], [90]]])
    moved = []
    for _ in range(4):
        looked = V.reassigned(members, books, layout).persist()
        members = V.settled_members(looked, layout)
        moved.append(sum(len(rows) for _, (m, rows, _) in looked.collect() if m))
        assert members.getNumPartitions() == 5 and "PartitionerAwareUnion" in members._jrdd.rdd().toDebugString()
        held = members.glom().collect()
        assert all(layout.place(owner) == k for k, part in enumerate(held) for owner, _ in part)
        at = {int(r): owner for part in held for owner, (rows, _) in part for r in rows}
        assert at == {k: layout.owner(0, int(np.argmin([(x - e[0]) ** 2 for e in books[0]])), k) for k, x in numbers}
        books = V.means(members, books, layout)
    assert moved[0] > 200 > moved[-1]
