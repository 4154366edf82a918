"""Audit operators against values worked out by hand."""

from pyspark.sql import functions as F

from cohortcast.operators import audits


def test_identity_ladder(spark):
    entries = spark.createDataFrame([(1, "Ann Lee", 10), (1, "Bo", 11), (1, "bo", 12), (1, "Cy-Co", 13), (1, "cy co", 14), (2, "Ann Lee", 20)], "g int, name string, id int")
    records = spark.createDataFrame([(1, "ANN LEE"), (1, "annlee"), (1, "BO"), (1, "CyCo"), (2, "Zed"), (2, None), (3, "Bo")], "g int, name string")
    got = audits.identity_ladder(records, entries, "g", "name", F.lower(F.regexp_replace("name", "[^A-Za-z]", "")), "id")
    assert {(r.g, r.name): (r.id, r.status, r.n_candidates) for r in got.collect()} == {
        (1, "ANN LEE"): (10, "EXACT_MATCH", 1), (1, "annlee"): (10, "NORMALIZED_EXACT_MATCH", 1), (1, "BO"): (None, "AMBIGUOUS", 2),
        (1, "CyCo"): (None, "AMBIGUOUS", 2), (2, "Zed"): (None, "UNMATCHED", 0), (2, None): (None, "UNMATCHED", 0), (3, "Bo"): (None, "UNMATCHED", 0)}
    errors = {r.g: r.errors for r in audits.second_source_errors(got, entries, "g", "id").collect()}
    assert errors == {1: ["COUNT_MISMATCH", "SEVERAL_TO_ONE", "AMBIGUOUS"], 2: ["COUNT_MISMATCH", "UNMATCHED"], 3: ["COUNT_MISMATCH", "UNMATCHED"]}


def test_stakes_and_legs(spark):
    rows = [("win", 1.99, 0.0), ("WIN", 7.9, 6.0), ("TRIFECTA", 0.99, 0.5), ("SUPERFECTA", 0.3, 0.3), ("other", 3.7, 3.0), ("WIN", None, 0.0)]
    got = spark.createDataFrame(rows, "kind string, stake double, want double").select("want", audits.rounded_stake(F.col("stake"), F.col("kind")).alias("got")).collect()
    assert all(r.got == r.want for r in got)
    legs = [("WIN", 1, "HIT"), ("WIN", 2, "MISS"), ("PLACE", 2, "HIT"), ("SHOW", 3, "HIT"), ("SHOW", 4, "MISS"), ("SHOW", None, "VOID"), ("WIN", 0, "VOID")]
    got = spark.createDataFrame(legs, "kind string, finish int, want string").select("want", audits.leg_status(F.col("kind"), F.col("finish")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_override_needs_the_whole_group(spark):
    rows = [(1, "closer", "E", 1, 2), (1, "closer", " e/p", 1, 2), (2, "closer", "E", 1, 2), (2, "closer", "?", 1, 2), (3, "closer", "S", 2, 2), (4, "closer", "P", None, 2)]
    got = audits.whole_group_override(spark.createDataFrame(rows, "g int, style string, code string, at int, post int"), "g", "style", "code", "at", "post").collect()
    assert sorted((r.g, r.style) for r in got) == [(1, "front"), (1, "presser"), (2, "closer"), (2, "closer"), (3, "closer"), (4, "closer")]


def test_validity_and_bins(spark):
    rows = [(None, "chart", 1, 1, ""), ("x", "seeded", 1, 1, ""), ("x", None, 1, 1, ""), ("x", "Chart ", None, 1, ""), ("x", "chart", 1, 5, ""), ("x", "chart", 1, None, ""), ("x", "chart", 1, 1, "")]
    df = spark.createDataFrame(rows, "s string, src string, n int, at int, e string")
    reason = audits.feature_validity(F.col("s"), F.col("src"), F.col("n"), F.col("at"), F.lit(5), ["UNKNOWN"], ["seeded"], ["chart"])
    ends = ["UNAVAILABLE", "DEFAULTED", "SOURCE", "EVIDENCE", "INVALID", "INVALID", ""]
    assert [r[0].rsplit("_", 1)[-1] for r in df.select(reason).collect()] == ends
    p = spark.createDataFrame([(k / 100, k % 2 == 0) for k in range(1, 101)], "p double, won boolean")
    got = audits.quantile_reliability(p, "p", "won").orderBy("bin").collect()
    assert [r.n for r in got] == [10] * 10 and got[0].mean_p == 0.055 and got[9].gap == 0.455
    assert audits.quantile_reliability(p.withColumn("p", F.lit(0.5)), "p", "won").collect()[0].n == 100


def test_preview(spark):
    members = spark.createDataFrame([(1, 1), (1, 2)], "card int, member int")
    results = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 3), (9, 1)], "card int, member int")
    assert {(r.card, r.member): r.status for r in audits.match_preview(results, members, "card", "member").collect()} == {(1, 1): "MATCHED", (1, 2): "DUPLICATE", (1, 3): "UNMATCHED", (9, 1): "RACE_MISSING"}


def test_exact_quantiles(spark):
    """Against numpy: ties, nulls, few rows, and brackets so rough that they miss."""
    import numpy as np

    rng = np.random.default_rng(2)
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    for values in (rng.random(3000), np.round(rng.random(2000), 1), np.array([1.0, 2.0, 4.0]), np.array([5.0]), np.concatenate((np.zeros(900), rng.random(100)))):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(3)
        for accuracy in (10_000, 20):
            assert np.allclose(audits.exact_quantiles(df, "x", shares, accuracy), np.quantile(values, shares), rtol=0, atol=1e-12)
    assert audits.exact_quantiles(spark.createDataFrame([], "x double"), "x", shares) == []
