"""Documents: type, pages put together, and the fields their text holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as D


def scan_documents(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, length and type of every file, by leading bytes, else by suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    by_bytes = D.document_type("path", F.col("content"))
    return files.select(
        "path",
        "length",
        F.when(by_bytes != "unknown", by_bytes).otherwise(D.document_type("path")).alias("document_type"),
    )


def combine_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", body: str = "text") -> DataFrame:
    """One text per document, its pages in order with an empty line between.

    The pages of one document end up in one row by definition; documents are spread
    by their id.
    """
    parts = F.sort_array(F.collect_list(F.struct(F.col(page).alias("n"), F.col(body).alias("t"))))
    return pages.groupBy(doc).agg(parts.alias("_pages")).select(
        doc,
        F.array_join(F.transform("_pages", lambda p: p["t"]), "\n\n").alias("text"),
        F.size("_pages").cast("bigint").alias("page_count"),
    )


def split_pages(docs: DataFrame, doc: str = "doc_id", body: str = "text", size: int = 1000) -> DataFrame:
    """A text cut in pages of ``size`` characters; nothing is left out."""
    count = F.greatest(F.lit(1), F.ceil(F.length(body) / size)).cast("int")
    return docs.select(
        doc, F.col(body).alias("_body"), F.explode(F.sequence(F.lit(1), count)).alias("page_no")
    ).select(
        doc,
        F.col("page_no").cast("bigint").alias("page_no"),
        F.substr("_body", (F.col("page_no") - 1) * size + 1, F.lit(size)).alias("text"),
    )


def extract_document_fields(docs: DataFrame, doc: str = "doc_id", body: str = "text", patterns=None) -> DataFrame:
    """One row per document and pattern that found something in its whole text."""
    found = docs.select(doc, F.explode(D.extract_fields(body, patterns)).alias("f"))
    return found.select(doc, "f.field", "f.pattern_no", "f.value", "f.confidence")


def combine_entities(entities: DataFrame, by_pattern: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Entity-based fields (entity_type, value, confidence) and pattern-based ones, in one table."""
    named = entities.withColumn("field", D.entity_field("entity_type")).where(F.col("field").isNotNull())
    left = named.select(doc, "field", "value", "confidence", F.lit("entity").alias("origin"))
    right = by_pattern.select(doc, "field", "value", "confidence", F.lit("pattern").alias("origin"))
    return left.unionByName(right)
