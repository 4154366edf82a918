"""The corpus pipeline: documents to token ids, by five of the operators of cohortcast.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last
return the columns of documents. Rows of which a stage decides by the whole table (groups, estimates) are
judged on that stage's own input.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcast.llm.bpe import encode
from cohortcast.llm.decontaminate import decontaminate
from cohortcast.llm.exprs import packed, unpacked
from cohortcast.llm.graphs import few, ready
from cohortcast.llm.ngram_jaccard import similar_texts
from cohortcast.llm.pii import pseudonymise
from cohortcast.llm.quality_rules import judge
from cohortcast.llm.queries import PII_KEY, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return judge(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (Jaccard 0.8 or more on 5-word shingles) the first document by id (null last), of equal rows one.

    Rows are told by id and hash. Their texts aren't shuffled while the rows to drop, and those to count once, are few.
    """
    id, on = F.col("doc_id").cast("long"), ["none", "id", "row"]
    found = similar_texts(docs, shingle=5, percent=80, rows=True).select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row", "first").checkpoint()
    keyed = docs.select(packed(docs.columns).alias("docs"), id.isNull().alias("none"), F.coalesce(id, F.lit(0)).alias("id"), F.xxhash64(id, "text").alias("row"))
    kept = keyed.join(few(found.where("not first").select(*on).distinct()), on, "left_anti")
    again = few(found.where("first").groupBy(*on).count().where("count > 1").select(*on))
    once = kept.join(again, on, "left_anti").unionByName(kept.join(again, on, "left_semi").dropDuplicates(on)) if not again.isEmpty() else kept
    return once.select(*unpacked("docs", docs.columns))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars is counted anew."""
    return pseudonymise(docs, PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and decoded (what the ids stand for)."""
    coded = encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"), decoded_col="decoded")
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", contamination), ("PII", private_data), ("BPE encoding and decoding", tokens)]

#: SQL can't express the robust outliers, components, keyed surrogates and merges of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is a table in the shared folder before the next begins."""
    ready(spark)
    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
