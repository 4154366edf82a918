"""What only larger tables show: keys beyond a million, halves, many pairs from few rows, tasks bounded by rows."""

import datetime as dt
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortcast import queries as registry
from cohortcast.operators import joins
from cohortcast.queries import frames, learned

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp"
DAY = dt.datetime(1997, 5, 1)


def same_as_sql(spark, folder, name):
    out = f"{folder}/out-{name}"
    registry.queries()[name](spark, folder).write.parquet(out)
    c = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}/*.parquet'")
    c.execute(f"CREATE TABLE ours AS SELECT * FROM '{out}/*.parquet'")
    c.execute(f"CREATE TABLE theirs AS {registry.oracle_sql()[name]}")
    cols = ", ".join(r[0] for r in c.execute("DESCRIBE theirs").fetchall())
    for a, b in (("ours", "theirs"), ("theirs", "ours")):
        assert c.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b}").fetchall() == []
    return spark.read.parquet(out)


def stored(spark, folder, rows):
    spark.createDataFrame(rows, LINES).write.parquet(f"{folder}/lineitem.parquet")
    cards = sorted({r[0] for r in rows})
    spark.createDataFrame([(k, 1, DAY, "5-LOW") for k in cards], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")


def test_stakes_at_halves(spark, tmp_path):
    stored(spark, str(tmp_path), [(k, k % 7, 1, 1, 1.0, 25.0 * k, "N", DAY) for k in range(1, 4400)])
    got = same_as_sql(spark, str(tmp_path), "f13_stakes")
    assert got.where("l_orderkey = 1999").first().stake == 10.0  # 9.995, a show's step is 2


def test_part_keys_beyond_a_million(spark, tmp_path):
    stored(spark, str(tmp_path), [(1, 1_000_005, 1, 1, 9.0, 10.0, "N", DAY), (1, 7, 2, 2, 5.0, 10.0, "N", DAY), (2, 5, 4, 1, 3.0, 10.0, "N", DAY), (2, 9, 5, 2, 8.0, 10.0, "N", DAY)])
    got = same_as_sql(spark, str(tmp_path), "x20_speed_figures")
    assert got.count() == got.select("id").distinct().count() == 4


def test_near_values_in_parts(spark):
    rows = spark.range(400).select((F.col("id") % 2).alias("k"), "id", (F.col("id") % 40 / 4).alias("x"))
    a, b = rows.withColumnRenamed("id", "a"), rows.select("k", F.col("id").alias("b"), F.col("x").alias("y"))
    got = joins.near_value(a, b, ["k"], "x", "y", 2.0, pairs_of_a_part=300)
    want = a.crossJoin(b.withColumnRenamed("k", "k2")).where("k = k2 AND abs(x - y) <= 2").select("k", "a", "x", "b", "y")
    assert got.select("k", "a", "x", "b", "y").exceptAll(want).count() == want.exceptAll(got.select("k", "a", "x", "b", "y")).count() == 0
    assert got.rdd.getNumPartitions() > 8 and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString().split("Project")[0]


def test_a_card_task_holds_bounded_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(frames, "ROWS_OF_A_TASK", 300)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert frames.field(spark, sf_dir).rdd.getNumPartitions() == -(-lines // 300)


def test_degenerate_features_shuffle_no_distinct_values(spark):
    from cohortcast.operators import quality

    rows = spark.createDataFrame([(1, "a", None, 1.0), (1, "a", None, 2.0), (2, "a", 1, None), (2, None, 2, 3.0), (3, "b", 1, 1.0)], "card int, x string, y int, z double")
    got = quality.degenerate_features(rows, "card", ["x", "y", "z"])
    assert {r.card: r.degenerate for r in got.collect()} == {1: ["x", "y"], 2: ["x", "z"]}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


@pytest.mark.parametrize("name", ["x17_workouts", "x19_velocity", "x19_standalone", "a15_verdicts", "a15_performance", "e12_settle"])
def test_the_field_is_worked_out_once(spark, sf_dir, name):
    assert "l_extendedprice" not in registry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name, asked", [("l04_calibration", "out_of_fold"), ("l06_rolling_forecasts", "out_of_fold"), ("l07_serve", "fit_classifier")])
def test_learners_read_stored_rows(spark, sf_dir, monkeypatch, name, asked):
    class Asked(Exception):
        pass

    def tell(df, *_):
        raise Asked(df._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(learned.learning, asked, tell)
    with pytest.raises(Asked) as plan:
        registry.queries()[name](spark, sf_dir)
    assert "l_extendedprice" not in str(plan.value)


def test_captures_and_previews_are_shuffled_once_by_group(spark):
    from cohortcast.operators import audits

    rows = spark.createDataFrame([(1, "a", "x", 1, 2.0), (1, "b", "x", 1, 2.0), (1, "a", "y", 2, 2.0), (2, "a", "x", 1, 2.0), (2, None, "x", 2, 2.0), (None, "a", "x", 1, 2.0), (3, "a", "x", None, 2.0), (4, "a", "x", 1, 2.0), (4, "a", "y", 1, 2.0)], "card int, member string, provider string, ts int, price double")
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, None), (None, "a"), (3, "a"), (4, "a")], "card int, member string")
    got = joins.complete_capture(rows, asked, "card", "member", ["provider"], "ts", "price", 7)
    assert sorted((r.card, r.member, r.ts) for r in got.collect()) == [(1, "a", 1), (1, "b", 1), (2, "a", 1)]  # 4 is a tie
    told = audits.match_preview(rows, asked.where("card < 3"), "card", "member", 7)
    assert {(r.card, r.member): (r.rows, r.status) for r in told.collect()} == {(1, "a"): (2, "DUPLICATE"), (1, "b"): (1, "MATCHED"), (2, "a"): (1, "MATCHED"), (2, None): (1, "UNMATCHED"), (None, "a"): (1, "RACE_MISSING"), (3, "a"): (1, "RACE_MISSING"), (4, "a"): (2, "RACE_MISSING")}
    for df in (got, told):
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]  # the final one alone
        assert df.rdd.getNumPartitions() == 7 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize("name", ["w20_free_slots", "q04_self_checks", "e06_run", "e03_evaluation", "l05_metrics", "q17_missing", "a03_segments"])
def test_work_by_card_stays_in_bounded_parts(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(frames, "ROWS_OF_A_TASK", 300)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with larger tables
    try:
        plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    parts = -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 300)
    assert set(re.findall(r"hashpartitioning\((?:.*, )?(?:card|l_orderkey)#[^)]*, (\d+)\)", plan)) == {str(parts)}
