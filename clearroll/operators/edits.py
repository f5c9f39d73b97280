"""Changes to records, reviews and jobs, each as a new DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CHECK_ADDRESS, CHECK_DOCUMENT, CHECK_ENRICHMENT, CHECK_LICENSE, CHECK_REGISTRY
from ..functions.text import is_present
from .lookup import one_per_key


def patch(
    df: DataFrame, updates: DataFrame, key: str, as_of: Column, stamp: str = "updated_at", nulls: str | None = None
) -> DataFrame:
    """Partial update: a column changes where ``updates`` supplies a value.

    ``updates`` has the key and any subset of columns; of several rows with one key the
    smallest counts.  ``nulls`` names a column of ``updates`` with an array of the columns
    that are supplied as NULL, which sets them so.
    """
    supplied = [c for c in updates.columns if c not in (key, nulls)]
    keyed = one_per_key(updates, [key])
    cleared = F.coalesce(F.col(nulls), F.array().cast("array<string>")) if nulls else F.array().cast("array<string>")
    new = keyed.select(
        key, *[F.col(c).alias(f"_new_{c}") for c in supplied], cleared.alias("_cleared"), F.lit(True).alias("_hit")
    )
    joined = df.join(new, key, "left")
    gone = lambda c: F.coalesce(F.array_contains("_cleared", c), F.lit(False))
    changes = {c: F.when(~gone(c), F.coalesce(F.col(f"_new_{c}"), F.col(c))) for c in supplied}
    changes[stamp] = F.when(F.col("_hit"), as_of).otherwise(F.col(stamp))
    return joined.withColumns(changes).select(*df.columns)


def delete_by_key(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def add_flag(df: DataFrame, code: str, reason: str | None, at: Column, column: str = "flags") -> DataFrame:
    """Append a flag unless an identical one is there already."""
    entry = F.struct(
        F.lit(code).alias("code"), F.lit(reason).cast("string").alias("reason"), at.alias("timestamp")
    )
    same = F.coalesce(
        F.exists(
            F.col(column),
            lambda f: (f["code"] == entry["code"])
            & f["reason"].eqNullSafe(entry["reason"])
            & f["timestamp"].eqNullSafe(entry["timestamp"]),
        ),
        F.lit(False),
    )
    grown = F.concat(F.coalesce(F.col(column), F.array().cast(df.schema[column].dataType)), F.array(entry))
    return df.withColumn(column, F.when(same, F.col(column)).otherwise(grown))


def set_field_confidence(df: DataFrame, field: str, score: float, at: Column, column: str = "field_confidence") -> DataFrame:
    """Insert or replace one entry of the field-confidence map."""
    entry = F.create_map(F.lit(field), F.struct(F.lit(float(score)).alias("score"), at.alias("updated_at")))
    kept = F.map_filter(F.col(column), lambda k, _: k != field)
    return df.withColumn(column, F.map_concat(F.coalesce(kept, F.map_filter(entry, lambda k, _: F.lit(False))), entry))


REVIEW_STATUS = {"accept": "valid", "reject": "invalid", "flag": "warning", "revalidate": "pending"}


def review_actions(df: DataFrame, decisions: DataFrame, key: str = "provider_id") -> DataFrame:
    """Accept, reject, flag, revalidate or assign the selected records.

    ``decisions`` has the key, ``action`` and ``assignee``; of several rows with one key the
    smallest counts.
    """
    joined = df.join(one_per_key(decisions.select(key, "action", "assignee"), [key]), key, "left")
    status = F.col("validation_status")
    for action, outcome in REVIEW_STATUS.items():
        status = F.when(F.col("action") == action, F.lit(outcome)).otherwise(status)
    return (
        joined.withColumn("validation_status", status)
        .withColumn("assigned_to", F.when(F.col("action") == "assign", F.col("assignee")))
        .drop("action", "assignee")
    )


def job_transitions(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Apply retry and cancel requests (job_id, request) to jobs.

    Only a failed job may be retried; a completed or failed one cannot be
    cancelled.  ``error`` tells why a request was refused.  Of several requests for a job
    the first by name counts.
    """
    joined = jobs.join(one_per_key(requests.select("job_id", "request"), ["job_id"]), "job_id", "left")
    retry = (F.col("request") == "retry") & (F.col("status") == "failed")
    cancel = (F.col("request") == "cancel") & ~F.col("status").isin("completed", "failed")
    legal = F.coalesce(retry | cancel, F.lit(False))
    error = F.when(
        F.col("request").isNotNull() & ~legal,
        F.concat(F.lit("cannot "), F.col("request"), F.lit(" a job that is "), F.col("status")),
    )
    retried = F.coalesce(retry, F.lit(False))
    return joined.withColumns(
        {
            "error": error,
            "status": F.when(retried, "pending")
            .when(F.coalesce(cancel, F.lit(False)), "cancelled")
            .otherwise(F.col("status")),
            "started_at": F.when(~retried, F.col("started_at")),
            "completed_at": F.when(~retried, F.col("completed_at")),
            "retry_count": F.when(retried, F.col("retry_count") + 1).otherwise(F.col("retry_count")),
        }
    )


def materialise_jobs(records: DataFrame, priority: str = "medium") -> DataFrame:
    """One pending job per record."""
    return records.select(
        F.concat(F.lit("job_"), F.col("provider_id")).alias("job_id"),
        "provider_id",
        F.lit("pending").alias("status"),
        F.lit(priority).alias("priority"),
        F.lit(0).cast("bigint").alias("progress"),
        F.lit(0).cast("bigint").alias("retry_count"),
    )


CHECK_OPTIONS = {
    CHECK_REGISTRY: "enable_npi_check",
    CHECK_ADDRESS: "enable_address_validation",
    CHECK_DOCUMENT: "enable_ocr_processing",
    CHECK_LICENSE: "enable_license_validation",
    CHECK_ENRICHMENT: "enable_enrichment",
}


def expand_checks(records: DataFrame, options: dict[str, bool] | None = None) -> DataFrame:
    """One task row per record and enabled check; documents only where there is one."""
    chosen = options or {}
    tasks = []
    for check, option in CHECK_OPTIONS.items():
        if not chosen.get(option, True):
            continue
        task = F.lit(check)
        tasks.append(F.when(is_present("document_path"), task) if check == CHECK_DOCUMENT else task)
    every = F.array_compact(F.array(*tasks)) if tasks else F.array().cast("array<string>")
    return records.withColumn("task_type", F.explode(every))


def reject_existing(new: DataFrame, existing: DataFrame, key: str = "npi_number", tie: str = "provider_id") -> DataFrame:
    """Bulk create: every new row with ``outcome`` created or an error.

    A key that exists already is refused; of several new rows with one key, the
    first by ``tie`` is created.
    """
    first = new.groupBy(key).agg(F.min(tie).alias("_first"))
    known = existing.select(F.col(key).alias("_known")).distinct()
    decided = first.join(known, F.col(key) == F.col("_known"), "left").select(
        F.col(key).alias("_key"), "_first", F.col("_known").isNotNull().alias("_exists")
    )
    from .lookup import attach

    joined = attach(new, decided, F.col(key), F.col("_key"), "_d", tie)
    outcome = (
        F.when(F.col("_d._exists"), F.concat(F.lit("already exists: "), F.col(key)))
        .when(F.col(tie) != F.col("_d._first"), F.concat(F.lit("repeated in batch: "), F.col(key)))
        .otherwise(F.lit("created"))
    )
    return joined.withColumn("outcome", outcome).drop("_d")


def bulk_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count_if(F.col("outcome") == "created").alias("created"),
        F.count_if(F.col("outcome") != "created").alias("failed"),
    )


def require_parent(children: DataFrame, parents: DataFrame, key: str = "provider_id") -> tuple[DataFrame, DataFrame]:
    """(children with a parent, children without)."""
    ids = parents.select(key).distinct()
    return children.join(ids, key, "left_semi"), children.join(ids, key, "left_anti")


def job_results(jobs: DataFrame, results: DataFrame, job_id: str | None = None, provider_id: str | None = None) -> DataFrame:
    """Results with their job's status, newest first; of one job or record when given."""
    picked = jobs
    if job_id is not None:
        picked = picked.where(F.col("job_id") == job_id)
    if provider_id is not None:
        picked = picked.where(F.col("provider_id") == provider_id)
    parent = picked.select("job_id", F.col("status").alias("job_status"), "priority")
    return results.join(parent, "job_id").orderBy(F.col("created_at").desc(), "job_id")
