"""Retention policies: what is past its time, and what becomes of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from .audit import mask_record


def cutoff(as_of: str, days: int) -> Column:
    return F.lit(as_of).cast("timestamp") - F.expr(f"make_dt_interval({int(days)})")


def expired(df: DataFrame, as_of: str, days: int, at: str = "created_at") -> DataFrame:
    return df.where(F.col(at) < cutoff(as_of, days))


def expiring_first(df: DataFrame, as_of: str, days: int, at: str, tie: str) -> DataFrame:
    return expired(df, as_of, days, at).orderBy(at, tie)


def record_bytes(df: DataFrame) -> Column:
    """Size of a row as the bytes of its values as text; nested columns as JSON."""
    parts = [
        F.to_json(c.name) if isinstance(c.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c.name).cast("string")
        for c in df.schema.fields
    ]
    return F.octet_length(F.concat_ws("", *parts))


def retention_preview(df: DataFrame, as_of: str, days: int, at: str = "created_at") -> DataFrame:
    return expired(df, as_of, days, at).agg(
        F.count(F.lit(1)).alias("affected_records"),
        F.coalesce(F.sum(record_bytes(df)), F.lit(0)).alias("affected_bytes"),
    )


def retention_report(tables: dict[str, tuple[DataFrame, str]], as_of: str, policies=None) -> DataFrame:
    """One row per policy: records and bytes past their time, and the action due.

    ``tables`` maps a policy to (table, time column); a policy without a table is
    left out.
    """
    table = policies or K.RETENTION_POLICIES
    rows = None
    for policy, (days, action) in table.items():
        if policy not in tables:
            continue
        df, at = tables[policy]
        row = retention_preview(df, as_of, days, at).select(
            F.lit(policy).alias("policy"),
            F.lit(action).alias("action"),
            F.lit(days).cast("bigint").alias("retention_days"),
            "affected_records",
            F.round(F.col("affected_bytes") / F.lit(1024.0 * 1024.0), 2).alias("affected_mb"),
            F.lit(True).alias("success"),
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


def apply_retention(
    df: DataFrame, as_of: str, days: int, action: str, at: str = "created_at", fields=None
) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows to archive).

    archive: old rows move to the second frame; delete: they are dropped; anonymize:
    they stay with their personal columns masked.  A row without a time stays.
    """
    old = F.coalesce(F.col(at) < cutoff(as_of, days), F.lit(False))
    if action == "anonymize":
        hidden = mask_record(df.where(old), fields=fields)
        typed = hidden.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in df.columns])
        return df.where(~old).unionByName(typed), df.where(F.lit(False))
    if action in ("archive", "compress"):
        return df.where(~old), df.where(old)
    if action == "delete":
        return df.where(~old), df.where(F.lit(False))
    raise ValueError(f"unknown retention action: {action}")


def finished_jobs_older_than(jobs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    done = F.col("status").isin("completed", "failed")
    return jobs.where(done & (F.col("completed_at") < cutoff(as_of, days)))
