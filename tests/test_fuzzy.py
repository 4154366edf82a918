"""The index of names against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from cohortcast.operators import fuzzy


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(asked, known, cutoff):
    out = set()
    for block, a in set(asked):
        best = {}
        for block_b, b in set(known):
            if a and b and block == block_b and block is not None:
                best.setdefault(round(1 - distance(a, b) / max(len(a), len(b)), 9), set()).add(b)
        if best and max(best) >= cutoff - 1e-9:
            out |= {(block, a, b, max(best)) for b in best[max(best)]}
    return out


def typo(rnd, s):
    for _ in range(rnd.choice([0, 1, 1, 2, 3, 4])):
        k = rnd.randrange(len(s) + 1)
        s = rnd.choice([s[:k] + s[k + 1 :], s[:k] + rnd.choice("ABCXYZ019") + s[k:], s[:k] + rnd.choice("ABC9") + s[k + 1 :]])
    return s


@pytest.mark.parametrize("cutoff", [0.72, 0.85])
def test_finds_what_all_pairs_find(spark, cutoff):
    rnd = random.Random(6)
    words = ["".join(rnd.choices("ABCDE", k=rnd.randint(1, 14))) for _ in range(60)] + [f"CUSTOMER{k:09d}" for k in range(0, 400, 7)] + ["AAAAAAAA", "AAAAAAAAA", "A", "AB", "ÉÉÉABC"]
    known = [(rnd.choice([1, 1, 2]), w) for w in words] + [(1, ""), (1, None), (None, "ABC")]
    asked = [(rnd.choice([1, 2]), typo(rnd, rnd.choice(words))) for _ in range(150)] + [(1, ""), (1, None), (None, "ABC"), (3, "ABC"), (1, "AAAAAAAAAAA")]
    frame = lambda rows: spark.createDataFrame(rows, "card int, name string")
    got = {(r.card, r.name, r.match, round(r.similarity, 9)) for r in fuzzy.nearest_names(frame(asked), frame(known), "card", "name", cutoff).collect()}
    assert got == brute(asked, known, cutoff)
    assert len(got) > 50


def test_pairs_meet_through_the_index_only(spark):
    names = spark.range(3000).select(F.lit(1).alias("card"), F.concat(F.lit("NAME"), F.hex(F.xxhash64("id"))).alias("name"))
    rarity = names.select(F.explode(fuzzy.pairs_of(F.col("name"))).alias("p")).groupBy("p.pair").agg(F.count("*").alias("times"))
    index = fuzzy.indexed(names, "card", "name", rarity)
    met = fuzzy.candidates(index, index, "card", "name", 1)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert met.count() < 3000 * 3000 / 20


def test_empty_and_bad_cutoffs(spark):
    none = spark.createDataFrame([], "card int, name string")
    some = spark.createDataFrame([(1, "ABC")], "card int, name string")
    assert fuzzy.nearest_names(none, some, "card", "name").collect() == fuzzy.nearest_names(some, none, "card", "name").collect() == []
    with pytest.raises(ValueError):
        fuzzy.nearest_names(some, some, "card", "name", 0.5)


def test_dense_names_meet_few(spark):
    """Numbered names: each has some fifty others at distance 1, however many there are; through pairs a part of all would meet."""
    names = lambda n: spark.range(n).select(F.lit(1).alias("card"), F.format_string("NAME%06d", "id").alias("name"))
    asked = spark.range(0, 10_000, 100).select(F.lit(1).alias("card"), F.format_string("NAME%05dX", F.floor(F.col("id") / 10)).alias("name"))
    side = lambda df: df.select("card", F.explode(fuzzy.rests_of(F.col("name"), 1)).alias("rest"))
    met = [side(asked).join(side(names(n)), ["card", "rest"]).count() for n in (10_000, 40_000)]
    assert met[1] <= 1.2 * met[0]
    got = fuzzy.nearest_names(asked, names(40_000), "card", "name").groupBy("name").count()
    assert got.where("count != 10").count() == 0 and got.count() == asked.distinct().count()


@pytest.mark.parametrize("often", [0, 2000])
def test_two_errors_by_rests_and_by_pairs(spark, monkeypatch, often):
    monkeypatch.setattr(fuzzy, "OFTEN", often)
    rnd = random.Random(8)
    known = [(1, f"CUSTOMER{k:06d}") for k in range(0, 3000, 17)]
    asked = [(1, typo(rnd, typo(rnd, rnd.choice(known)[1]))) for _ in range(60)] + [(1, "X"), (1, "AB")]
    frame = lambda rows: spark.createDataFrame(rows, "card int, name string")
    got = {(r.card, r.name, r.match, round(r.similarity, 9)) for r in fuzzy.nearest_names(frame(asked), frame(known), "card", "name").collect()}
    assert got == brute(asked, known, 0.72)


def test_names_are_not_broadcast(spark):
    """A file of numbered names is small; unfolded to their rests and pairs they aren't. Parts hold bounded names."""
    from cohortcast.operators import joins

    names = spark.range(300).select(F.lit(1).alias("card"), "id", F.format_string("NAME%05d", "id").alias("name"))
    asked = names.select("card", F.concat("name", F.lit("X")).alias("typed"))
    rarity = names.select(F.explode(fuzzy.pairs_of(F.col("name"))).alias("p")).groupBy("p.pair").agg(F.count("*").alias("times"))
    index = fuzzy.cut(fuzzy.indexed(names, "card", "name", rarity))
    for got in (fuzzy.close_candidates(names, names, "card", "name", 2), fuzzy.candidates(index, index, "card", "name", 1), joins.best_match(asked, names, "card", "typed", "name", "id")):
        assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert joins.best_match(asked, names, "card", "typed", "name", "id").where("match_type = 'fuzzy' AND match_id = CAST(substring(typed, 5, 5) AS int)").count() == 300


def test_tasks_hold_bounded_names(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "NAMES_OF_A_TASK", 10)
    assert fuzzy._dealt(spark.range(95).toDF("name")).rdd.getNumPartitions() == 10
