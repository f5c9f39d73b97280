"""A corpus made ready for training: stages over the documents table, each one operator's decision.

Every stage takes ``(spark, docs, sf_dir)``, is written as Parquet and read again as the
next one's documents.  All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearroll.llm import decontaminate, langid, mixing, secret_scan, similar
from clearroll.llm.store import fresh, saved

#: A document is rejected if its language is unknown or its label is less sure than this.
LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; null texts and texts without letters go."""
    found = langid.label(docs, langid.fit(docs))
    pred, score = found.columns[-3], found.columns[-2]
    sure = (F.col(f"`{pred}`") != langid.UNKNOWN) & (F.col(f"`{score}`") >= LANGUAGE_SCORE)
    return found.where(sure).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (five-word shingle similarity 0.8), that with the smallest doc_id."""
    return similar.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``; what is found is a matter of the text, so ids may be null or repeat."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = F.xxhash64(F.col("text").cast("string"))
    found = decontaminate.find_leaks(docs.select(key.alias("doc_id"), "text"), items)
    leaked = saved(found.select(F.col("doc_id").alias("_leaked")).distinct(), "leaked")
    return docs.join(leaked, key == leaked["_leaked"], "left_anti")


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the values of secrets replaced in their texts."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, once each, with ``copies`` (1 or 2), ``taken`` words and their source's ``target``.

    Rows that share a doc_id are taken as often as the one taken most.
    """
    decided = mixing.mix(docs).groupBy("doc_id").agg(F.max("copies").alias("copies"), F.max("size").alias("size"), F.max("target").alias("target"))
    decided = saved(decided.where("copies > 0"), "decided").withColumnRenamed("doc_id", "_doc_id")
    names = {}
    for n in ("copies", "size", "target", "taken"):
        names[n] = fresh([*docs.columns, *names.values()], n)
    # the decisions are as many as the documents, so this is a merge join at any size
    decided = decided.select("_doc_id", *[F.col(n).alias(f"_{n}_") for n in ("copies", "size", "target")]).hint("merge")
    both = docs.join(decided, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc_id")))
    return both.select(
        *[docs[f"`{c}`"] for c in docs.columns],
        F.col("_copies_").alias(names["copies"]),
        (F.col("_size_") * F.col("_copies_")).alias(names["taken"]),
        F.col("_target_").alias(names["target"]),
    )


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_free),
    ("secret scans", secrets_out),
    ("source mix", mixed),
]

#: language models, fingerprints and the budget fit have no SQL form; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
