"""A corpus pipeline: toxicity, near duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``docs``. Extra
columns come along under any name. Null texts count as empty, empty tables pass through, long texts
are worked on whole. Near duplicates are judged by doc_id and text: of rows that repeat both one stays, unlike texts under one
doc_id both do, and rows without a doc_id are documents like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.llm.common import documents, written
from tandem.llm.decontamination import clean
from tandem.llm.mixing import mix
from tandem.llm.near_dups import near_duplicates
from tandem.llm.token_output import tokenised
from tandem.llm.toxicity import reject


def spare(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that ``docs`` has no column of, in upper or lower case."""
    taken = {c.lower() for c in docs.columns}
    return [next(x for k in range(len(taken) + 1) if (x := name + "_" * k).lower() not in taken) for name in names]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold, learnt from all labels."""
    return reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id, those without one last.

    A document is a doc_id and a text, so unlike texts under one doc_id are judged apart; a hash of both names it. Should two
    documents share that hash, none is lost for it: rows of a chosen name are told apart by doc_id and a second hash.
    """
    name, other, order = spare(docs, "name", "other", "order")
    hashed, again = F.xxhash64("doc_id", "text"), F.xxhash64(F.lit("again"), "text")
    found = near_duplicates(docs.select(hashed.alias("doc_id"), "text")).select(F.col("doc_id").alias(name), "component_id").distinct()
    ids = docs.select(hashed.alias(name), F.struct(F.col("doc_id").isNull(), "doc_id", hashed).alias(order)).distinct()
    stay = found.join(ids, name).groupBy("component_id").agg(F.min_by(name, order).alias(name)).select(name)
    kept = docs.withColumn(name, hashed).join(stay, name, "left_semi").withColumn(other, again)
    # repeated rows: each task hands on one at most, that whose other columns come first
    rest = F.to_json(F.struct(F.lit(1).alias(order), *(c for c in docs.columns if c not in ("doc_id", "text"))))
    return kept.groupBy(name, "doc_id", other).agg(F.min_by(F.struct(*docs.columns), rest).alias("row")).select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or several rows each."""
    key, copies, alike, rank, times, copy = spare(docs, "key", "copies", "alike", "rank", "times", "copy")
    hashed = F.xxhash64("doc_id", "text", "source")
    taken = mix(docs.select(hashed.alias("doc_id"), "text", "source")).groupBy(F.col("doc_id").alias(key)).agg(F.sum("copies").alias(copies), F.count("*").alias(alike))
    # rows that are alike share their copies evenly
    order = F.row_number().over(Window.partitionBy(key).orderBy(copies))
    rows = docs.withColumn(key, hashed).join(taken.where(F.col(copies) > 0), key).withColumn(rank, order)
    rows = rows.withColumn(times, F.floor(F.col(copies) / F.col(alike)) + (F.col(rank) <= F.col(copies) % F.col(alike)).cast("long")).where(F.col(times) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the token files."""
    return tokenised(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_output", token_files),
]

#: SQL can't express the stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
