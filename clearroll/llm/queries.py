"""One query per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontaminate, embeddings, langid, mixing, nearest, pii, quality, secret_scan, simhash, spans, toxicity, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op2_secret_scan(spark, folder):
    found = secret_scan.find_secrets(table(spark, folder, "documents"), keep=["doc_id"])
    return spans.digested(found, "secrets", secret_scan.BASE)


@query
def op9_personal_data(spark, folder):
    found = pii.find_personal_data(table(spark, folder, "documents"), keep=["doc_id"])
    return spans.digested(found, "personal", pii.BASE)


@query
def op3_source_mix(spark, folder):
    return mixing.mix(table(spark, folder, "documents")).drop("copies")


@query
def op4_language_id(spark, folder):
    return langid.identify(table(spark, folder, "documents"))


@query
def op8_decontamination(spark, folder):
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op7_chat_format(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    same = "</s>[INST] ok [/INST]"
    odd = spark.createDataFrame([(-1, 0, "user", same), (-1, 1, "assistant", same)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(turns.unionByName(odd)))


ORACLE["op7_chat_format"] = chat.SQL


@query
def op6_quality_score(spark, folder):
    return quality.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op5_embedding_copies(spark, folder):
    return embeddings.near_vectors(table(spark, folder, "embeddings"))


@query
def op10_toxicity(spark, folder):
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op13_nearest_vectors(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query
def op12_spelling_variants(spark, folder):
    return variants.variants(table(spark, folder, "documents"))


@query
def op11_collocations(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"))


ORACLE["op11_collocations"] = collocations.SQL
