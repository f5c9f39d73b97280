"""Exports: flat CSV, report JSON, archives and the audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EXPORT_COLUMNS
from ..operators.audit import with_partitions
from ..operators.retention import expired

ISO = "yyyy-MM-dd'T'HH:mm:ss"

# export column -> column of the record
EXPORT_SOURCES = {
    "ID": "provider_id", "NPI": "npi_number", "First Name": "given_name", "Last Name": "family_name",
    "Middle Name": "middle_name", "Suffix": "suffix", "Specialty": "primary_taxonomy",
    "Organization": "practice_name", "Organization NPI": "organization_npi", "Email": "email",
    "Phone": "phone_primary", "Address Line 1": "address_street", "Address Line 2": "address_line2",
    "City": "address_city", "State": "address_state", "ZIP Code": "address_zip", "Country": "country",
    "License Number": "license_number", "License State": "license_state", "License Expiry": "license_expiry",
    "Status": "validation_status", "Validation Score": "validation_score",
    "Last Validated": "last_validated_at", "Created At": "created_at", "Updated At": "updated_at",
}


def export_rows(df: DataFrame, status: str | None = None) -> DataFrame:
    """The 25 export columns as text; a column the record lacks is NULL."""
    kept = df.where(F.col("validation_status") == status) if status else df

    def value(name: str) -> Column:
        source = EXPORT_SOURCES[name]
        if source not in df.columns:
            return F.lit(None).cast("string")
        if df.schema[source].dataType.typeName() in ("timestamp", "timestamp_ntz", "date"):
            return F.date_format(source, ISO)
        return F.col(source).cast("string")

    return kept.select(*[value(n).alias(n) for n in EXPORT_COLUMNS])


def export_csv(df: DataFrame, path: str, status: str | None = None) -> None:
    export_rows(df, status).write.mode("overwrite").csv(path, header=True, escape='"')


def report_json(reports: DataFrame) -> DataFrame:
    """report_id and the whole report as one JSON text with ISO times."""
    body = F.to_json(F.struct(*reports.columns), {"timestampFormat": ISO, "ignoreNullFields": "false"})
    return reports.select("report_id", "provider_id", body.alias("json"))


def export_report_json(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path, timestampFormat=ISO)


def report_digest(reports: DataFrame) -> DataFrame:
    """Summary, flags and recommendations, and only the critical and error insights."""
    grave = F.filter("insights", lambda i: i["severity"].isin("critical", "error"))
    return reports.select(
        "report_id",
        "provider_id",
        F.date_format("generated_at", ISO).alias("generated_at"),
        "summary",
        "flags",
        "recommendations",
        F.transform(
            grave,
            lambda i: F.struct(
                i["title"].alias("title"), i["severity"].alias("severity"), i["action_required"].alias("action_required")
            ),
        ).alias("critical_insights"),
    )


def archive(df: DataFrame, as_of: str, days: int, path: str, at: str = "created_at", fmt: str = "parquet") -> DataFrame:
    """Write the rows past their time, by the day of the run and their date; the rows that stay are returned.

    The archive is complete before the caller can write what stays.  A run of the same day
    replaces the partitions it writes, so a retry leaves no row twice, and keeps those of
    other days.  Adaptive execution cuts a large date into several files and puts small
    ones together.
    """
    old = expired(df, as_of, days, at).withColumn("archive_date", F.date_format(at, "yyyy-MM-dd"))
    old = old.withColumn("archived_on", F.date_format(F.lit(as_of).cast("timestamp"), "yyyy-MM-dd"))
    old.hint("rebalance", "archive_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "archived_on", "archive_date"
    ).format(fmt).save(path)
    return df.where(~F.coalesce(F.col(at) < F.lit(as_of).cast("timestamp") - F.expr(f"make_dt_interval({int(days)})"), F.lit(False)))


def append_audit(df: DataFrame, path: str, at: str = "logged_at") -> None:
    with_partitions(df, at).write.mode("append").partitionBy("date", "hour").parquet(path)


def audit_stream(log: DataFrame, path: str, checkpoint: str, at: str = "logged_at"):
    """Audit rows as they arrive, partitioned by date and hour, each exactly once however often the stream is started.

    Returns the started query, which ends when all there is has been taken.
    """
    return (
        with_partitions(log, at).writeStream.format("parquet").option("path", path).partitionBy("date", "hour")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
