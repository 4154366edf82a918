"""Frames that the queries share: a card is an order, its members are the parts of its lines.

Prices are summed as decimals, so that both engines' sums agree to the last digit. Each frame has its SQL.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a table that one task of its card's work takes.
ROWS_OF_A_TASK = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_of(spark: SparkSession, rows: int, rows_of_a_task: int | None = None) -> int | None:
    """How many parts keep a task's rows bounded; None where that isn't more than there are cores."""
    parts = math.ceil(rows / (rows_of_a_task or ROWS_OF_A_TASK))
    return parts if parts > spark.sparkContext.defaultParallelism else None


def spread(df: DataFrame, rows: int, *keys: str, rows_of_a_task: int | None = None) -> DataFrame:
    """df shuffled by its keys into as many parts as keep a task's rows bounded, where that is more than there are cores; else df, which Spark shuffles as it needs.

    What follows by these keys (sums, windows, joins) stays in these parts, so that a task's memory doesn't grow with the table.
    """
    parts = parts_of(df.sparkSession, rows, rows_of_a_task)
    return df.repartition(parts, *keys) if parts else df


def shared_folder(spark, name: str) -> str:
    """A new folder under the cluster's checkpoint folder; under the warehouse where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root}/{name}-{uuid.uuid4()}"


def once(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder, for what several branches of a plan read: each of them would work it out again."""
    at = shared_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def lineitem_by_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return spread(lines, lines.count(), "l_orderkey")


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each (card, member): price, qty, jockey, ship date, surface; p and m, the shares of price and qty; n, post, decimal, finish."""
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    lines = lineitem_by_card(spark, sf_dir).groupBy(F.col("l_orderkey").alias("card"), F.col("l_partkey").alias("member")).agg(money("l_extendedprice").alias("price"), money("l_quantity").alias("qty"), F.min("l_suppkey").alias("jockey"), F.max("l_shipdate").cast("date").alias("ship"), F.min("l_returnflag").alias("surface"))
    w = Window.partitionBy("card")
    shares = lines.withColumn("p", F.col("price") / F.sum(F.col("price").cast("decimal(18,2)")).over(w).cast("double")).withColumn("m", F.col("qty") / F.sum(F.col("qty").cast("decimal(18,2)")).over(w).cast("double"))
    return shares.withColumn("n", F.count("*").over(w)).withColumn("post", F.row_number().over(w.orderBy("member"))).withColumn("decimal", 1 / (F.col("m") * 1.18)).withColumn("finish", F.row_number().over(w.orderBy(F.desc("qty"), "member")))


FIELD = """
lines AS (SELECT l_orderkey AS card, l_partkey AS member, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
  min(l_suppkey) AS jockey, CAST(max(l_shipdate) AS DATE) AS ship, min(l_returnflag) AS surface FROM lineitem GROUP BY 1, 2),
shares AS (SELECT *, price / CAST(sum(CAST(price AS DECIMAL(18,2))) OVER (PARTITION BY card) AS DOUBLE) AS p, qty / CAST(sum(CAST(qty AS DECIMAL(18,2))) OVER (PARTITION BY card) AS DOUBLE) AS m FROM lines),
field AS (SELECT *, count(*) OVER (PARTITION BY card) AS n, row_number() OVER (PARTITION BY card ORDER BY member) AS post, 1 / (m * 1.18) AS decimal,
  row_number() OVER (PARTITION BY card ORDER BY qty DESC, member) AS finish FROM shares)"""


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field with its card's date, class and owner; cards without an order fall out."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("card"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("class"), F.col("o_custkey").alias("owner"))
    return field(spark, sf_dir).join(orders, "card")


DATED = FIELD + """,
dated AS (SELECT f.*, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS class, o_custkey AS owner FROM field f JOIN orders ON o_orderkey = card)"""


def with_sql(frame: str, body: str) -> str:
    return f"WITH {frame.strip()}\n{body}"
