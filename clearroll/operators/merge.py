"""Evidence of several sources combined per field and per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scores


def _source_weight(source: str | Column) -> Column:
    return scores.weight_of(source, K.CHECK_WEIGHTS, K.DEFAULT_SOURCE_WEIGHT)


def _source_rank(source: str | Column) -> Column:
    return scores.weight_of(
        source, {s: float(len(K.CHECK_ORDER) - i) for i, s in enumerate(K.CHECK_ORDER)}, 0.0
    )


# -- rule engine: field_results -> field summary -> record summary -----------------


def field_summary(results: DataFrame) -> DataFrame:
    """Per record and field: weighted confidence, status and count."""
    weight = scores.weight_of("source", K.RULE_SOURCE_WEIGHTS, K.DEFAULT_SOURCE_WEIGHT)
    hit = {s: F.count_if(F.col("status") == s) for s in ("valid", "invalid", "warning")}
    return (
        results.groupBy("provider_id", "field_name")
        .agg(
            F.sum(F.col("confidence") * weight).alias("_weighted"),
            F.sum(weight).alias("_weight"),
            F.count(F.lit(1)).alias("validation_count"),
            *[n.alias(f"_{s}") for s, n in hit.items()],
        )
        .select(
            "provider_id",
            "field_name",
            scores.stable(scores.ratio(F.col("_weighted"), F.col("_weight"))).alias("overall_confidence"),
            scores.stable(F.col("_weighted")).alias("weighted_score"),
            F.when(F.col("_invalid") > 0, "invalid")
            .when(F.col("_valid") > 0, "valid")
            .when(F.col("_warning") > 0, "warning")
            .otherwise("unknown")
            .alias("status"),
            "validation_count",
        )
    )


def record_summary(fields: DataFrame) -> DataFrame:
    """Per record: weighted confidence over its fields, status and counts."""
    weight = scores.weight_of("field_name", K.RULE_FIELD_WEIGHTS, K.DEFAULT_FIELD_WEIGHT)
    grouped = fields.groupBy("provider_id").agg(
        F.sum(F.col("overall_confidence") * weight).alias("_weighted"),
        F.sum(weight).alias("_weight"),
        F.count(F.lit(1)).alias("total_fields"),
        F.count_if(F.col("status") == "valid").alias("valid_fields"),
        F.count_if(F.col("status") == "invalid").alias("invalid_fields"),
        F.count_if(F.col("status") == "warning").alias("warning_fields"),
    )
    total = F.col("total_fields")
    return grouped.select(
        "provider_id",
        scores.stable(scores.ratio(F.col("_weighted"), F.col("_weight"))).alias("overall_confidence"),
        F.when(total == 0, "unknown")
        .when(F.col("invalid_fields") > 0, "invalid")
        .when(F.col("warning_fields") * 2 > total, "warning")
        .when(F.col("valid_fields") * 5 > total * 4, "valid")
        .otherwise("warning")
        .alias("status"),
        "total_fields",
        "valid_fields",
        "invalid_fields",
        "warning_fields",
    )


def record_counts(results: DataFrame) -> DataFrame:
    """Validations per record: all, successful, failed, with a warning."""
    return results.groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("total_validations"),
        F.count_if(F.col("status") == "valid").alias("successful_validations"),
        F.count_if(F.col("status") == "invalid").alias("failed_validations"),
        F.count_if(F.col("status") == "warning").alias("warning_validations"),
    )


# -- merge over a stored table of source results ---------------------------------------


def merge_sources(results: DataFrame, normalise: bool = False) -> DataFrame:
    """Per record and field the value with the highest confidence x source weight.

    A plain aggregate with a map-side part, so any number of results per record is
    fine.  Ties go to the source that comes first in check order.  With
    ``normalise`` the source weight only ranks and does not scale the outcome.
    """
    rows = results.where("success").select(
        "provider_id",
        "source",
        F.explode("fields").alias("f"),
    )
    weighted = scores.stable(F.col("f.confidence") * _source_weight("source"))
    best = rows.groupBy(F.col("provider_id"), F.col("f.field").alias("field_name")).agg(
        F.max(
            F.struct(
                weighted.alias("weighted"),
                _source_rank("source").alias("rank"),
                F.col("f.confidence").alias("raw"),
                F.col("source").alias("source"),
                F.col("f.value").alias("value"),
            )
        ).alias("b")
    )
    return best.select(
        "provider_id",
        "field_name",
        F.col("b.value").alias("value"),
        F.col("b.source").alias("source"),
        F.col("b.raw" if normalise else "b.weighted").alias("confidence"),
        F.col("b.raw").alias("raw_confidence"),
    )


def merged_confidence(merged: DataFrame) -> DataFrame:
    """Per record the weighted confidence of its merged fields, and the status."""
    weight = scores.weight_of("field_name", K.MERGE_FIELD_WEIGHTS, K.DEFAULT_FIELD_WEIGHT)
    grouped = merged.groupBy("provider_id").agg(
        F.sum(F.col("confidence") * weight).alias("_weighted"), F.sum(weight).alias("_weight")
    )
    confidence = scores.stable(scores.ratio(F.col("_weighted"), F.col("_weight")))
    return grouped.select(
        "provider_id",
        confidence.alias("overall_confidence"),
        scores.status_of(confidence).alias("validation_status"),
    )


def best_field_summary(results: DataFrame) -> DataFrame:
    """Per record and field the highest raw confidence, with source, value and count."""
    rows = results.where("success").select("provider_id", "source", F.explode("fields").alias("f"))
    best = rows.groupBy(F.col("provider_id"), F.col("f.field").alias("field_name")).agg(
        F.max(
            F.struct(
                F.col("f.confidence").alias("confidence"),
                _source_rank("source").alias("rank"),
                F.col("source").alias("source"),
                F.col("f.value").alias("value"),
            )
        ).alias("b"),
        F.count(F.lit(1)).alias("validation_count"),
    )
    return best.select(
        "provider_id", "field_name", "b.confidence", "b.source", "b.value", "validation_count"
    )


# -- the same merge inside one row --------------------------------------------------------
#
# When the answers of all checks stand side by side in the record's row (at most one per
# check), merging needs no shuffle at all.


def _entries(answers: Column, lead: str) -> Column:
    """All (field, lead, rank, ...) of the successful answers, ordered by field, then lead."""

    def of_answer(a: Column) -> Column:
        weight, rank = _source_weight(a["source"]), _source_rank(a["source"])

        def entry(f: Column) -> Column:
            weighted = f["confidence"] * weight
            return F.struct(
                f["field"].alias("field"),
                (weighted if lead == "weighted" else f["confidence"]).alias("lead"),
                rank.alias("rank"),
                f["value"].alias("value"),
                a["source"].alias("source"),
                weighted.alias("weighted"),
                f["confidence"].alias("raw"),
            )

        return F.transform(a["fields"], entry)

    return F.sort_array(F.flatten(F.transform(F.filter(answers, lambda a: a["success"]), of_answer)))


def _last_of_each_field(entries: Column) -> Column:
    """The greatest entry per field of an ordered array: the one before the field changes."""
    return F.filter(
        entries, lambda e, i: ~F.coalesce(F.get(entries, i + 1)["field"] == e["field"], F.lit(False))
    )


def _best(answers: str, lead: str) -> Column:
    # a one-element array names the ordered entries, so that they are computed once
    return F.transform(F.array(_entries(F.col(answers), lead)), _last_of_each_field)[0]


def merged_in_row(answers: str = "answers") -> Column:
    """Per field the entry with the highest confidence x source weight, fields in order."""
    return _best(answers, "weighted")


def best_in_row(answers: str = "answers") -> Column:
    """Per field the entry with the highest raw confidence, fields in order."""
    return _best(answers, "raw")


def weighted_mean_in_row(fields: Column, score: str) -> Column:
    def weigh(acc: Column, f: Column) -> Column:
        w = scores.weight_of(f["field"], K.MERGE_FIELD_WEIGHTS, K.DEFAULT_FIELD_WEIGHT)
        return F.struct(
            (acc["top"] + f[score] * w).alias("top"), (acc["bottom"] + w).alias("bottom")
        )

    zero = F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("bottom"))
    return F.aggregate(
        fields, zero, weigh, lambda acc: scores.stable(scores.ratio(acc["top"], acc["bottom"]))
    )


def merge_flags(answers: str = "answers") -> Column:
    """Failed checks, low confidences per (source, field), missing critical fields."""
    every = F.col(answers)
    failed = F.size(F.filter(every, lambda a: ~a["success"]))
    good = F.filter(every, lambda a: a["success"])
    seen = F.flatten(F.transform(good, lambda a: a["fields"]))
    low = F.transform(
        F.filter(seen, lambda f: f["confidence"] < 0.5),
        lambda f: F.concat(F.lit("LOW_CONFIDENCE_"), F.upper(f["field"])),
    )
    have = F.transform(seen, lambda f: f["field"])
    missing = F.transform(
        F.array_except(F.array(*[F.lit(f) for f in K.CRITICAL_MERGE_FIELDS]), have),
        lambda f: F.concat(F.lit("MISSING_"), F.upper(f)),
    )
    head = F.when(
        failed > 0, F.array(F.concat(F.lit("FAILED_VALIDATIONS: "), failed.cast("string")))
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(head, low, missing)


def gather_answers(results: DataFrame, at: str | None = None) -> DataFrame:
    """One row per record with its answers as an array, from a table of results.

    First reduced to one row per (record, check), the newest by ``at`` where the results
    carry a time, so the array holds at most as many entries as there are checks.
    """
    answer = F.struct("source", "success", "confidence", "error_message", "fields")
    newest = F.max_by(answer, F.struct(at, answer)) if at else F.max(answer)
    one = results.groupBy("provider_id", "source").agg(newest.alias("a"))
    return one.groupBy("provider_id").agg(F.sort_array(F.collect_list("a")).alias("answers"))


def score_checks(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Score of a job's registry, address and license checks.

    ``outcomes`` has provider_id, npi_valid, address_valid, license_valid.  A check
    that is switched off counts as valid but not in the total, so a score may
    exceed 100; a job with no check at all scores 0.
    """
    joined = jobs.join(outcomes, "provider_id")

    def on(flag: str) -> Column:
        return F.col(flag).cast("int")

    def passed(flag: str, valid: str) -> Column:
        return F.when(F.col(flag), F.col(valid).cast("int")).otherwise(1)

    total = on("validate_npi") + on("validate_address") + on("validate_license")
    good = (
        passed("validate_npi", "npi_valid")
        + passed("validate_address", "address_valid")
        + passed("validate_license", "license_valid")
    )
    score = scores.ratio(good * 100, total)
    errors = F.array_compact(
        F.array(
            F.when(F.col("validate_npi") & ~F.col("npi_valid"), F.lit("NPI validation failed")),
            F.when(F.col("validate_license") & ~F.col("license_valid"), F.lit("License validation failed")),
        )
    )
    warnings = F.array_compact(
        F.array(F.when(F.col("validate_address") & ~F.col("address_valid"), F.lit("Address validation warning")))
    )
    return joined.withColumns(
        {
            "overall_score": score,
            "validation_status": F.when(score >= 80, "valid").when(score >= 60, "warning").otherwise("invalid"),
            "errors": errors,
            "warnings": warnings,
        }
    )
