"""The main batch plan: check every record, merge the evidence, report.

The answers of all checks are joined onto the record's row, so from there on the
merge, the scores, the flags and the report are expressions over one row.  The
records are exchanged once per reference table that is not small, and never again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import matching, merge, report
from ..operators.checks import answer_records
from ..operators.lookup import hot_values

CLEANED = [
    "npi_number", "phone_primary", "email", "license_number", "address_street",
    "address_city", "address_state", "address_zip", "primary_taxonomy",
]


def clean_records(records: DataFrame) -> DataFrame:
    """Blank values become NULL and every field its canonical form."""
    have = [c for c in CLEANED if c in records.columns]
    return records.withColumns({c: text.clean_field(c, c) for c in have})


def validate_records(*tables: DataFrame, normalise: bool = False, **options) -> DataFrame:
    """provider_id, overall_confidence, validation_status, flags, fields of each record."""
    answered = answer_records(*tables, **options)
    score = "raw" if normalise else "weighted"
    merged = answered.withColumn("merged", merge.merged_in_row())
    confidence = merge.weighted_mean_in_row(F.col("merged"), score)
    return (
        merged.withColumn("overall_confidence", confidence)
        .withColumn("validation_status", scores.status_of("overall_confidence"))
        .withColumn("flags", merge.merge_flags())
    )


def report_records(records: DataFrame, *tables: DataFrame, as_of: str, **options) -> DataFrame:
    """Reports of all records; how many records carry an NPI is counted first, an aggregate and one exchange more."""
    hot = hot_values(records, {"npi_number": F.col("npi_number")}, "provider_id")["npi_number"]
    counted = matching.mark_duplicates(records, hot=hot)
    answered = answer_records(counted, *tables, **options)
    flags = report.license_flags(F.lit(as_of).cast("timestamp")) + report.record_flags()
    return report.build_report(answered, as_of, extra_flags=flags)
