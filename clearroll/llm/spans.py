"""Span lists of a text scan: their column type, digest and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,value_start:int,score:double>>"


def written(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined in the order they have."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digested(found: DataFrame, spans: str, kinds: list[str]) -> DataFrame:
    """Counts and digest of the base ``kinds``, and all spans as one string, per row."""
    s = F.col(spans)
    base = F.filter(s, lambda x: x["kind"].isin(kinds))
    rest = [F.size(F.filter(s["kind"], lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select(
        "doc_id", *rest, F.sha2(written(base), 256).alias("base_sha256"), written(s).alias("spans")
    )


def in_order(spans: list[tuple], kinds: list[str]) -> list[dict]:
    """``(kind, start, end, value_start, score)`` tuples sorted by start, then kind, as rows of :data:`SPAN`."""
    rank = {k: i for i, k in enumerate(kinds)}
    spans.sort(key=lambda s: (s[1], rank[s[0]], s[2]))
    return [{"kind": k, "start": a, "end": b, "value_start": v, "score": float(x)} for k, a, b, v, x in spans]
