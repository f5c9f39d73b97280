"""The detailed report of a record, computed inside the record's own row.

Input everywhere: a record with ``answers``, the array of its source results (at
most one per check).  Output columns are nested structs and arrays; nothing here
shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scores, text
from .merge import best_in_row

REPORTED = [
    "npi_number", "given_name", "family_name", "primary_taxonomy", "practice_name",
    "address_street", "license_number", "license_state", "license_status",
    "phone_primary", "email",
]


def field_issues(field: Column, value: Column, confidence: Column) -> Column:
    """array<struct<issue, suggestion>> of one field."""
    empty = ~text.is_present(value)
    critical = field.isin(*K.CRITICAL_FIELDS)
    shown = F.concat(F.lit("("), F.format_string("%.2f", confidence), F.lit(")"))

    def note(when: Column, issue: Column, suggestion: Column) -> Column:
        return F.when(when, F.struct(issue.alias("issue"), suggestion.alias("suggestion")))

    def words(*parts: str | Column) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    filled = ~empty
    return F.array_compact(
        F.array(
            note(
                empty,
                words(field, " is missing or empty"),
                F.when(critical, words("Provide ", field, " as it is required for validation")).otherwise(
                    words("Consider providing ", field, " for better validation")
                ),
            ),
            note(
                confidence < K.LOW,
                words(field, " has very low confidence ", shown),
                words("Verify ", field, " data quality and source"),
            ),
            note(
                (confidence >= K.LOW) & (confidence < K.MEDIUM),
                words(field, " has low confidence ", shown),
                words("Review ", field, " for accuracy"),
            ),
            note(
                (field == "npi_number") & filled & (F.length(value) != 10),
                F.lit("NPI number should be 10 digits"),
                F.lit("Verify NPI number format"),
            ),
            note(
                (field == "phone_primary") & filled & ~value.startswith("+"),
                F.lit("Phone number should be in E.164 format"),
                F.lit("Format phone number as +1XXXXXXXXXX"),
            ),
            note(
                (field == "email") & filled & ~value.contains("@"),
                F.lit("Invalid email format"),
                F.lit("Provide valid email address"),
            ),
            note(
                (field == "license_number") & filled & (F.length(value) < 3),
                F.lit("License number appears too short"),
                F.lit("Verify license number format"),
            ),
        )
    )


def _original(field: Column, columns: list[str]) -> Column:
    case = None
    for name in REPORTED:
        if name in columns:
            hit = field == name
            value = F.col(name).cast("string")
            case = F.when(hit, value) if case is None else case.when(hit, value)
    return case if case is not None else F.lit(None).cast("string")


def field_analysis(columns: list[str], answers: str = "answers") -> Column:
    """One entry per field any source knew: best raw confidence, original and found value."""

    def entry(b: Column) -> Column:
        return F.struct(
            b["field"].alias("field_name"),
            _original(b["field"], columns).alias("original_value"),
            b["value"].alias("validated_value"),
            b["raw"].alias("confidence"),
            scores.status_of(b["raw"]).alias("validation_status"),
            b["source"].alias("validation_source"),
            field_issues(b["field"], b["value"], b["raw"]).alias("issues"),
        )

    return F.transform(best_in_row(answers), entry)


def _value_of(fields: str, name: str) -> Column:
    hit = F.filter(F.col(fields), lambda f: f["field_name"] == name)
    return F.try_element_at(hit, F.lit(1))["validated_value"]


def consistency_issues(fields: str = "fields") -> Column:
    given, family = _value_of(fields, "given_name"), _value_of(fields, "family_name")
    street = F.lower(_value_of(fields, "address_street"))
    same = text.is_present(given) & text.is_present(family) & (F.lower(given) == F.lower(family))
    both = street.contains("po box") & street.contains("street")
    return F.array_compact(
        F.array(
            F.when(same, F.lit("Given name and family name are identical")),
            F.when(both, F.lit("Address contains both PO Box and street information")),
        )
    )


def _missing_critical(fields: str) -> Column:
    gone = F.filter(
        F.col(fields),
        lambda f: f["field_name"].isin(*K.CRITICAL_FIELDS) & ~text.is_present(f["validated_value"]),
    )
    return F.transform(gone, lambda f: f["field_name"])


def _low_count(fields: str) -> Column:
    return F.size(F.filter(F.col(fields), lambda f: f["confidence"] < K.MEDIUM))


def _failed_count(answers: str) -> Column:
    return F.size(F.filter(F.col(answers), lambda a: ~a["success"]))


def insights(fields: str = "fields", answers: str = "answers") -> Column:
    missing = _missing_critical(fields)
    low = _low_count(fields)
    failed = _failed_count(answers)
    odd = F.size(consistency_issues(fields))
    coverage = F.size(F.col(fields)) / F.lit(len(K.CRITICAL_FIELDS + K.IMPORTANT_FIELDS))

    def insight(when: Column, kind: str, severity: str, title: str, description: Column, impact: float, act: bool) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(kind).alias("type"),
                F.lit(severity).alias("severity"),
                F.lit(title).alias("title"),
                description.alias("description"),
                F.lit(impact).alias("confidence_impact"),
                F.lit(act).alias("action_required"),
            ),
        )

    return F.array_compact(
        F.array(
            insight(
                F.size(missing) > 0, "missing_critical_fields", "critical", "Missing Critical Fields",
                F.concat(F.lit("Critical fields are missing: "), F.array_join(missing, ", ")), -0.3, True,
            ),
            insight(
                low > 0, "low_confidence_fields", "warning", "Low Confidence Fields",
                F.concat(low.cast("string"), F.lit(" fields have low confidence scores")), -0.2, False,
            ),
            insight(
                failed > 0, "failed_validations", "error", "Failed Validations",
                F.concat(failed.cast("string"), F.lit(" validation tasks failed")), -0.4, True,
            ),
            insight(
                odd > 0, "data_inconsistency", "warning", "Data Inconsistency",
                F.concat(F.lit("Found "), odd.cast("string"), F.lit(" data consistency issues")), -0.1, False,
            ),
            insight(
                coverage < 0.8, "low_coverage", "warning", "Low Validation Coverage",
                F.concat(
                    F.lit("Only "), F.format_string("%.1f", coverage * 100),
                    F.lit("% of important fields were validated"),
                ), -0.15, False,
            ),
        )
    )


def report_flags(fields: str = "fields", answers: str = "answers", extra: list[Column] | None = None) -> Column:
    """Flags of the report; ``extra`` are further (nullable) flag names."""

    def empty(name: str) -> Column:
        return F.exists(
            F.col(fields), lambda f: (f["field_name"] == name) & ~text.is_present(f["validated_value"])
        )

    def invalid(name: str) -> Column:
        return F.exists(
            F.col(fields), lambda f: (f["field_name"] == name) & (f["validation_status"] == "invalid")
        )

    documents = F.filter(F.col(answers), lambda a: a["source"] == K.CHECK_DOCUMENT)
    unread = (F.size(documents) > 0) & ~F.exists(documents, lambda a: a["success"])
    return F.array_compact(
        F.array(
            F.when(F.size(_missing_critical(fields)) > 0, F.lit("missing_critical_field")),
            F.when(_low_count(fields) * 2 > F.size(F.col(fields)), F.lit("low_confidence")),
            F.when(_failed_count(answers) > 0, F.lit("validation_failed")),
            F.when(empty("npi_number"), F.lit("npi_not_found")),
            F.when(invalid("phone_primary"), F.lit("invalid_phone")),
            F.when(invalid("email"), F.lit("invalid_email")),
            F.when(empty("address_street"), F.lit("address_not_found")),
            F.when(unread, F.lit("ocr_failed")),
            *(extra or []),
        )
    )


def license_flags(as_of: Column, status: str = "license.license_status", expiry: str = "license.expiry_date") -> list[Column]:
    """Flags that need the license row itself: expired and suspended."""
    lapsed = F.col(expiry) < as_of
    return [
        F.when((F.lower(F.col(status)) == "expired") | lapsed, F.lit("expired_license")),
        F.when(F.lower(F.col(status)) == "suspended", F.lit("suspended_license")),
    ]


def record_flags(fields: str = "fields", copies: str = "copies") -> list[Column]:
    """Flags that need the whole record or its copies: inconsistent data, and an NPI that other records carry too."""
    return [
        F.when(F.size(consistency_issues(fields)) > 0, F.lit("data_inconsistency")),
        F.when(F.col(copies) > 1, F.lit("potential_duplicate")),
    ]


def recommendations(flags: str = "flags", found: str = "insights") -> Column:
    by_flag = [
        F.when(F.array_contains(F.col(flags), flag), F.lit(advice))
        for flag, advice in K.FLAG_RECOMMENDATIONS.items()
    ]

    def urgent(kind: str) -> Column:
        return F.exists(F.col(found), lambda i: (i["type"] == kind) & i["action_required"])

    by_insight = [F.when(urgent(kind), F.lit(advice)) for kind, advice in K.INSIGHT_RECOMMENDATIONS.items()]
    advice = F.array_compact(F.array(*by_flag, *by_insight))
    return F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit(K.DEFAULT_RECOMMENDATION)))


def report_summary(fields: str = "fields", answers: str = "answers") -> Column:
    f = F.col(fields)

    def count(test) -> Column:
        return F.size(F.filter(f, test)).cast("bigint")

    total = F.size(f).cast("bigint")
    summed = F.aggregate(f, F.lit(0.0), lambda acc, x: acc + x["confidence"])
    mean = scores.stable(scores.ratio(summed, total))
    return F.struct(
        total.alias("total_fields"),
        count(lambda x: text.is_present(x["validated_value"])).alias("validated_fields"),
        count(lambda x: x["confidence"] >= K.HIGH).alias("high_confidence_fields"),
        count(lambda x: (x["confidence"] >= K.MEDIUM) & (x["confidence"] < K.HIGH)).alias("medium_confidence_fields"),
        count(lambda x: x["confidence"] < K.MEDIUM).alias("low_confidence_fields"),
        _failed_count(answers).cast("bigint").alias("failed_validations"),
        mean.alias("overall_confidence"),
        scores.status_of(mean).alias("validation_status"),
    )


def report_metadata(columns: list[str], answers: str = "answers") -> Column:
    a = F.col(answers)
    return F.struct(
        F.size(a).cast("bigint").alias("worker_results_count"),
        F.size(F.filter(a, lambda x: x["success"])).cast("bigint").alias("successful_workers"),
        F.size(F.filter(a, lambda x: ~x["success"])).cast("bigint").alias("failed_workers"),
        F.transform(a, lambda x: x["source"]).alias("worker_types"),
        F.array(*[F.lit(c) for c in columns]).alias("original_data_fields"),
        F.create_map(*[F.lit(v) for kv in K.CHECK_WEIGHTS.items() for v in kv]).alias("validation_weights"),
        F.struct(
            F.lit(K.HIGH).alias("high"), F.lit(K.MEDIUM).alias("medium"), F.lit(K.LOW).alias("low")
        ).alias("confidence_thresholds"),
        F.lit("1.0").alias("report_version"),
    )


def build_report(records: DataFrame, as_of: str, extra_flags: list[Column] | None = None) -> DataFrame:
    """The whole report of every record that carries ``answers``."""
    originals = [c for c in records.columns if c in REPORTED]
    return (
        records.withColumn("fields", field_analysis(originals))
        .withColumn("insights", insights())
        .withColumn("flags", report_flags(extra=extra_flags))
        .withColumn("recommendations", recommendations())
        .withColumn("summary", report_summary())
        .withColumn("metadata", report_metadata(originals))
        .select(
            F.concat(F.lit("report_"), F.md5(F.concat_ws("|", "provider_id", F.lit(as_of)))).alias("report_id"),
            "provider_id",
            F.lit(as_of).cast("timestamp").alias("generated_at"),
            "summary",
            F.col("fields").alias("field_analyses"),
            "insights",
            "flags",
            "recommendations",
            "metadata",
        )
    )
