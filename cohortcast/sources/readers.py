"""Readers: aliased headers, rows split into good and bad with reasons, sectioned texts, artifact inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcast.functions.text import any_date, ascii_key


def read_delimited(spark: SparkSession, path: str, aliases: dict[str, list[str]], sep: str = ",") -> DataFrame:
    """Text columns under canonical names: for each name the first of its header aliases that the file has, else null."""
    raw = spark.read.csv(path, header=True, sep=sep, mode="PERMISSIVE")
    plain = {"".join(ch for ch in c.lower() if ch.isalnum()): c for c in raw.columns}
    picked = []
    for name, others in aliases.items():
        found = next((plain[k] for a in [name, *others] if (k := "".join(ch for ch in a.lower() if ch.isalnum())) in plain), None)
        picked.append((F.col(f"`{found}`") if found else F.lit(None).cast("string")).alias(name))
    return raw.select(*picked)


def split_bad(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with `reason`): the first rule that a row breaks; a rule that is null is broken."""
    reason = F.coalesce(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules.items()])
    marked = df.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def typed_results(raw: DataFrame) -> DataFrame:
    """Result rows with types: date, race number, name key, finish and decimal odds."""
    from cohortcast.functions.odds import text_to_decimal
    from cohortcast.functions.text import flag

    return raw.select(any_date(F.col("race_date")).alias("race_date"), ascii_key(F.col("track")).alias("track"), F.col("race_number").try_cast("int").alias("race_number"), F.col("name"), ascii_key(F.col("name")).alias("name_key"), F.col("finish").try_cast("int").alias("finish"), text_to_decimal(F.col("odds")).alias("decimal_odds"), F.coalesce(flag(F.col("scratched")), F.lit(False)).alias("scratched"))


def sections(df: DataFrame, text: str, header: str) -> DataFrame:
    """A row for each section of a text: its number, header line and body. Headers are lines that match the pattern."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.col(text)), rf"\n(?=(?:{header}))"), lambda p: p.rlike(rf"^(?:{header})"))
    out = df.select(*[c for c in df.columns if c != text], F.posexplode(parts).alias("section", "_p"))
    return out.withColumn("header", F.regexp_extract("_p", r"^([^\n]*)", 1)).withColumn("body", F.regexp_replace("_p", r"^[^\n]*\n?", "")).drop("_p")


def inventory(spark: SparkSession, roots: list[str], pattern: str = r"([A-Z]{2,4})_R(\d+)_(\d{4}-\d{2}-\d{2})") -> DataFrame:
    """Files under the roots: path, size, SHA-256, first bytes, and the key in the name if it has one. Bytes don't leave the tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.hex(F.substring("content", 1, 4)).alias("signature"), F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).alias("track"), F.regexp_extract(name, pattern, 2).try_cast("int").alias("race_number"), F.to_date(F.nullif(F.regexp_extract(name, pattern, 3), F.lit(""))).alias("race_date"))


def prioritised(frames: list[DataFrame], key: str, value: str) -> DataFrame:
    """One row a key from sources in order of priority; a source with two values for a key is ambiguous, and the key gets none."""
    from functools import reduce

    from pyspark.sql import Window

    rows = reduce(DataFrame.unionByName, [f.select(key, value, F.lit(k).alias("priority")) for k, f in enumerate(frames)])
    w = Window.partitionBy(key)
    top = rows.withColumn("_first", F.min("priority").over(w)).where("priority = _first")
    return top.groupBy(key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias("_v"), F.min("priority").alias("priority")).select(key, F.when(F.col("_n") == 1, F.col("_v")).alias(value), "priority", (F.col("_n") > 1).alias("ambiguous"))
