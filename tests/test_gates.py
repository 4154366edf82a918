"""Operators of gates and intake against values worked out by hand, with nulls, ties and repeated rows."""

import math

from pyspark.sql import functions as F

from cohortcast.operators import gates, intake


def test_chaos(spark):
    rows = [(1, 1, 0.4, 0.25, "front", 3.0, 0.1), (1, 2, 0.3, 0.25, None, 20.0, 0.1), (1, 3, 0.2, 0.25, None, 40.0, 0.0), (1, 4, 0.1, 0.25, None, None, 0.1), (2, 1, 0.9, 0.97, "front", 3.0, 0.1), (2, 2, 0.1, 0.03, None, 30.0, 0.1), (3, 1, 1.0, 1.0, None, 50.0, 0.1)]
    df = spark.createDataFrame(rows, "g int, m int, p double, q double, style string, price double, career double").withColumn("fur", F.lit(6.0))
    got = {(r.g, r.m): r for r in gates.chaos(df, "g", "m", "p", "q", "style", "fur", F.col("price"), F.col("career"), F.lit(None).cast("int"), F.lit(None).cast("string")).collect()}
    assert got[1, 1].entropy == 1.0 and got[1, 1].intensity == 1.0 and got[1, 1].active
    assert [got[1, m].eligible for m in (1, 2, 3, 4)] == [False, True, False, False]  # no win, no price
    assert got[1, 2].boost == 0.06 and got[1, 2].tier == "HIGH"
    paid = [0.4 - 0.06 * 0.4 / 0.9, 0.3 - 0.06 * 0.3 / 0.9 + 0.06, 0.2 - 0.06 * 0.2 / 0.9, 0.1]
    assert all(math.isclose(got[1, m + 1].adjusted_p, paid[m] / sum(paid), abs_tol=1e-6) for m in range(4))
    assert not got[2, 1].active and got[2, 2].tier == "NONE" and got[2, 2].adjusted_p == 0.1
    assert got[3, 1].entropy == 0.0 and got[3, 1].adjusted_p == 1.0


def test_promotion(spark):
    columns = ["completed", "starters", "folds", "coverage", "groups_ok", "labels_ok", "no_leak", "brier_gain", "log_gain", "calibrated", "sizes_ok", "registered", "family_ok"]
    good = [500, 4000, 12, 0.8, True, True, True, 0.02, 0.01, True, True, True, True]
    change = lambda **kw: tuple(kw.get(c, v) for c, v in zip(columns, good))
    rows = [change(), change(completed=499), change(log_gain=None), change(no_leak=None), change(starters=99, brier_gain=0.0), change(registered=False, family_ok=False)]
    types = ["int", "int", "int", "double", *["boolean"] * 3, "double", "double", *["boolean"] * 4]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(columns, types)))
    assert [(r.mode, r.reasons) for r in gates.promotion(df).collect()] == [
        ("promoted", ["promoted"]), ("shadow", ["insufficient_completed_races", "shadow_only"]), ("shadow", ["oof_baseline_not_beaten", "shadow_only"]),
        ("baseline", ["leakage_check_failed"]), ("baseline", ["insufficient_labeled_starters"]), ("shadow", ["artifact_registration_incomplete", "artifact_family_mismatch", "shadow_only"])]


def test_styles_and_surfaces(spark):
    said = spark.createDataFrame([(1, "LED, then pressed"), (1, None), (2, "rallied; ran  on"), (2, "tracked"), (3, "misled"), (4, None)], "m int, c string")
    assert {r.m: (r.style, r.terms) for r in gates.comment_styles(said, "m", "c").collect()} == {1: ("front", 1), 2: ("closer", 2), 3: (None, 0), 4: (None, 0)}
    words = spark.createDataFrame([("Inner TURF (mud)", "turf"), ("Muddy", "dirt"), ("All-Weather", "all_weather"), ("", None), (None, None)], "t string, want string")
    assert all(r.got == r.want for r in words.select("want", gates.surface_of(F.col("t")).alias("got")).collect())


def test_outcomes_edits_and_lookups(spark):
    frame = lambda rows: spark.createDataFrame(rows, "g int, m int, f int")
    plan = frame([(g, m, m) for g in (1, 2, 3, 4) for m in (1, 2)])
    had = frame([(2, 1, 1), (2, 2, 2), (3, 1, 1), (3, 2, 1), (9, 1, 1)])
    got = gates.outcome_status(plan, had, plan.where("g < 4"), "g", "m", "f").collect()
    assert {r.g: (r.status, r.populated) for r in got} == {1: ("POPULATED", 2), 2: ("UNCHANGED", 0), 3: ("EXISTING_DIFFERS", 0), 4: ("NOT_MATCHED", 0)}
    assert gates.outcome_status(plan.limit(0), had, plan, "g", "m", "f").collect() == []
    stored = spark.createDataFrame([(1, "a", 1), (2, None, 2)], "id int, x string, y int")
    patch = spark.createDataFrame([(1, None, 5), (2, "n", None), (3, "z", 9)], "id int, x string, y int")
    assert sorted(tuple(r) for r in gates.patched(stored, patch, ["id"]).collect()) == [(1, "a", 5, 1), (2, "n", 2, 1)]
    rows = spark.createDataFrame([(1, None), (1, "s"), (2, "s")], "id int, sha string")
    assert {(r.id, r.sha): r.status for r in gates.appended(rows.limit(1).union(rows.limit(1)), rows, ["id", "sha"]).collect()} == {(1, None): "unchanged", (1, "s"): "new", (2, "s"): "new"}
    cards = spark.createDataFrame([("AQU", 1, 8), ("AQU", 1, 7)], "code string, no int, card int")
    asked = spark.createDataFrame([(" aqueduct ", 1), ("aqu", 1), ("AQU", 2), (None, 1)], "raw string, no int")
    aliases = spark.createDataFrame([("Aqueduct", "AQU")], "name string, code string")
    assert {(r.raw, r.no): r.card for r in gates.found_card(asked, cards, aliases, ["code", "no"], "card").collect()} == {(" aqueduct ", 1): 7, ("aqu", 1): 7, ("AQU", 2): None, (None, 1): None}


def test_contracts(spark):
    models = spark.createDataFrame([(1, "a"), (2, "a"), (3, "old"), (4, "b"), (5, "b"), (6, "c"), (7, None)], "id int, fam string")
    runs = spark.createDataFrame([(1, 10), (1, 12), (3, 12), (2, 11)], "id int, ts int")
    got = gates.contracts(models, runs, "fam", "id", "ts", {"old": "a"}, ["a", "b"]).collect()
    assert {r.fam: (r.id, r.from_run) for r in got} == {"a": (3, True), "b": (5, False)}


def test_official_order(spark):
    runs = spark.createDataFrame([(g, f"{g}{n}", n) for g in (1, 2) for n in (1, 2, 3, 4)], "g int, m string, run int")
    moves = spark.createDataFrame([(1, 1, "11", 3), (1, 2, "14", 1), (1, 3, "no", 1), (1, 4, "12", 9)], "g int, nth int, m string, to int")
    ties = spark.createDataFrame([(2, "24", 3)], "g int, m string, place int")
    got = {r.m: (r.place, r.moved) for r in intake.official_order(runs, moves, ties, "g", "m", "run").collect()}
    assert got == {"14": (1, True), "13": (2, False), "11": (3, True), "12": (4, True), "21": (1, False), "22": (2, False), "23": (3, False), "24": (3, False)}


def test_logs_and_models(spark):
    texts = spark.createDataFrame([("SCR", None, "7.5f", "ON"), ("3", "x ✓", "7", ""), (None, "", None, None)], "f string, m string, d string, s string")
    fields = intake.log_fields(*[F.col(c) for c in "fmds"])
    assert [tuple(r) for r in texts.select(*[c.alias(n) for n, c in fields.items()]).collect()] == [(None, True, False, 7.5, True), (3, False, True, None, False), (None, False, False, None, False)]
    asked = spark.createDataFrame([("a",), ("z",), (None,)], "seg string")
    models = spark.createDataFrame([("a", "1"), ("a", "2"), ("pooled", "9")], "seg string, v string")
    assert [(r.model_segment, r.model_version) for r in intake.chosen_models(asked, models, "seg", "v").orderBy(F.col("seg").asc_nulls_last()).collect()] == [("a", "2"), ("pooled", "9"), ("pooled", "9")]
    assert all(r.model_version is None for r in intake.chosen_models(asked, models.limit(0), "seg", "v").collect())
    one = spark.createDataFrame([(1, None, 1), (2, None, 1), (3, "x", 1)], "id int, s string, n int")
    other = spark.createDataFrame([(1, None, 1), (2, "x", 2)], "id int, s string, n int")
    assert [tuple(r) for r in intake.view_mismatches(one, other, ["id"], ["s", "n"]).collect()] == [(2, ["s", "n"])]


def test_history_and_registry(spark):
    entities = spark.createDataFrame([("Ann", 1), ("Bo", 2), (None, 3)], "name string, id int")
    parsed = spark.createDataFrame([("ANN", 5, 1), ("Ann", 5, 2), ("ann", 6, 3), ("Bo", 5, 4), ("Zed", 5, 5), (None, 5, 6), ("Ann", None, 7)], "name string, day int, row int")
    got = intake.history_status(parsed, entities, entities.where("id <> 2"), spark.createDataFrame([(1, 6)], "id int, day int"), "name", "id", "day")
    assert {r.row: r.status for r in got.collect()} == {1: "INSERTED", 2: "DUPLICATE", 3: "DUPLICATE", 4: "NOT_ON_CARD", 5: "UNMATCHED", 6: "UNMATCHED", 7: "INSERTED"}
    stored = spark.createDataFrame([("a", 7, 0.5), ("b", 8, 0.5)], "k string, id long, m double")
    arriving = spark.createDataFrame([("a", None), ("c", 0.1)], "k string, m double")
    got = {r.k: r for r in intake.upserted(stored, arriving, ["k"], "id").collect()}
    assert (got["a"].id, got["a"].m, got["a"].action) == (7, None, "updated") and (got["b"].id, got["b"].m, got["b"].action) == (8, 0.5, "kept")
    assert got["c"].id >= 0 and got["c"].action == "inserted"
    one = spark.createDataFrame([(1, 1, 5, "x"), (2, 9, 5, "x"), (3, None, 5, None)], "k int, t int, cut int, v string")
    two = spark.createDataFrame([(1, 9, "y"), (2, None, None)], "k int, t int, v string")
    assert [tuple(r) for r in intake.provider_coverage(one, two, "k", ["v"], "t", "cut").collect()] == [("v", 1, 1, 1, 0, 1, 1)]


def test_created_groups(spark):
    feed = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "t int, d string")
    got = intake.created_groups(feed, spark.createDataFrame([(1, "a"), (3, "z")], "t int, d string"), ["t", "d"]).collect()
    assert sorted(tuple(r) for r in got) == [(1, "a", False), (2, "b", True), (3, "z", False)]
