"""Confidences, statuses and other numeric rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import col, is_present, present, word_overlap

PRECISION = 12


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def weight_of(key: str | Column, weights: dict[str, float], default: float) -> Column:
    """Weight of a key, ``default`` for any other.

    A literal map is one expression to build, however many entries it has.
    """
    if not weights:
        return F.lit(float(default))
    entries = ", ".join(f"{_quoted(k)}, double('{float(v)!r}')" for k, v in weights.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({entries})"), col(key)), F.lit(float(default)))


def label_of(key: str | Column, labels: dict[str, str], default: str | None) -> Column:
    if not labels:
        return F.lit(default).cast("string")
    entries = ", ".join(f"{_quoted(k)}, {_quoted(v)}" for k, v in labels.items())
    found = F.try_element_at(F.expr(f"map({entries})"), col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def stable(c: Column) -> Column:
    """Rounded below any rule's resolution, so that the order in which a
    distributed sum was taken cannot move a value across a threshold."""
    return F.round(c, PRECISION)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where bottom is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def status_of(confidence: str | Column) -> Column:
    """valid from .8, warning from .6, else invalid."""
    c = stable(col(confidence))
    return F.when(c >= K.HIGH, "valid").when(c >= K.MEDIUM, "warning").otherwise("invalid")


def confidence_band(confidence: str | Column) -> Column:
    c = col(confidence)
    return (
        F.when(c >= 0.9, "high")
        .when(c >= 0.8, "good")
        .when(c >= 0.6, "medium")
        .when(c >= 0.4, "low")
        .otherwise("very_low")
    )


def confidence_range(confidence: str | Column) -> Column:
    c = col(confidence)
    return F.when(c >= 0.8, "High").when(c >= 0.6, "Medium").otherwise("Low")


def geometry_confidence(location_type: str | Column) -> Column:
    return weight_of(location_type, K.GEOMETRY_CONFIDENCE, K.DEFAULT_GEOMETRY_CONFIDENCE)


def address_match_confidence(types: Column, formatted: str | Column, asked: str | Column) -> Column:
    by_type = (
        F.when(F.arrays_overlap(types, F.array(F.lit("street_address"), F.lit("premise"))), 0.3)
        .when(F.array_contains(types, "route"), 0.2)
        .otherwise(0.0)
    )
    return F.least(F.lit(1.0), 0.5 + by_type + 0.2 * word_overlap(asked, formatted))


def address_type_ok(types: Column) -> Column:
    return F.arrays_overlap(types, F.array(*[F.lit(t) for t in K.ADDRESS_TYPES]))


def address_presence_check(line1: str, city: str, state: str, zip_code: str) -> Column:
    """struct(valid, confidence): all four parts there, or not."""
    whole = is_present(line1) & is_present(city) & is_present(state) & is_present(zip_code)
    return F.struct(
        whole.alias("valid"), F.when(whole, 0.8).otherwise(0.3).alias("confidence")
    )


def check_phone(phone: str | Column, carrier: str | Column, region: str | Column) -> Column:
    """struct(value, status, confidence) of a North-American number.

    ``phone`` is the normalised form; carrier and region come from an area-code
    table and may be NULL.
    """
    ok = F.coalesce(col(phone).rlike(r"^\+1[2-9][0-9]{2}[2-9][0-9]{6}$"), F.lit(False))
    score = (
        F.lit(0.8)
        + F.when(is_present(carrier), 0.1).otherwise(0.0)
        + F.when(is_present(region), 0.05).otherwise(0.0)
        + F.lit(0.05)
    )
    confidence = F.when(ok, F.least(F.lit(1.0), stable(score))).otherwise(0.0)
    return F.struct(
        col(phone).alias("value"),
        F.when(~ok, "invalid").when(confidence > 0.8, "valid").otherwise("warning").alias("status"),
        confidence.alias("confidence"),
    )


def _first_word_match(text: Column, table: list[tuple[str, list[str]]], default: str, whole: bool) -> Column:
    lowered = F.lower(text)
    case = None
    for label, words in table:
        pattern = "|".join(words)
        hit = lowered.rlike(rf"\b({pattern})\b" if whole else f"({pattern})")
        case = F.when(hit, F.lit(label)) if case is None else case.when(hit, F.lit(label))
    return case.otherwise(F.lit(default))


def license_status_of(text: str | Column, compat: bool = False) -> Column:
    """Status named in a text.

    Whole words decide by default; ``compat`` matches parts of words as well,
    where "inactive" reads as active.
    """
    value = present(text)
    found = _first_word_match(value, K.LICENSE_STATUS_WORDS, K.DEFAULT_LICENSE_STATUS, not compat)
    return F.when(value.isNull(), F.lit(K.DEFAULT_LICENSE_STATUS)).otherwise(found)


def first_date(text: str | Column) -> Column:
    """First date by priority of the three notations, NULL if none."""
    found = [F.nullif(F.regexp_extract(col(text), p, 1), F.lit("")) for p in K.DATE_PATTERNS]
    return F.coalesce(*found)


def action_type(text: str | Column) -> Column:
    return _first_word_match(col(text), K.ACTION_WORDS, "other", whole=False)


def license_confidence(name: str | Column, status: str | Column, status_text: str | Column) -> Column:
    named = is_present(name) & (col(name) != "Unknown")
    has_text = is_present(status_text)
    score = (
        F.lit(0.3)
        + F.when(named, 0.2).otherwise(0.0)
        + F.when(has_text, 0.2).otherwise(-0.1)
        + F.when(col(status) == "active", 0.2)
        .when(col(status).isin("suspended", "revoked"), 0.1)
        .otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), stable(score)))


def source_reliability(source: str | Column) -> Column:
    return label_of(source, K.SOURCE_RELIABILITY, "unknown")


def risk_of(action: str | Column) -> Column:
    levels = {action: level for level, actions in K.RISK_ACTIONS.items() for action in actions}
    return label_of(action, levels, K.DEFAULT_RISK)


def mean_field_confidence(scores: str | Column) -> Column:
    """Mean of a map<string,double>; 0 when empty or NULL."""
    values = F.filter(F.map_values(col(scores)), lambda v: v.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(F.lit(0.0))


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.lit(2 * 6371000.0) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def backoff_delay(attempt: str | Column, base: float, longest: float, exponential: bool = True) -> Column:
    step = F.pow(F.lit(2.0), col(attempt)) if exponential else col(attempt) + 1
    return F.least(F.lit(float(base)) * step, F.lit(float(longest)))


def estimate_seconds(n: str | Column, documents: Column | bool = True, licenses: Column | bool = True) -> Column:
    def flag(v: Column | bool) -> Column:
        return v if isinstance(v, Column) else F.lit(bool(v))

    each = (
        F.lit(30)
        + F.when(flag(documents), 20).otherwise(0)
        + F.when(flag(licenses), 10).otherwise(0)
    )
    return col(n) * each


def estimate_duration(n: str | Column, documents: Column | bool = True, licenses: Column | bool = True) -> Column:
    """Expected run time of ``n`` records as a short text."""
    total = estimate_seconds(n, documents, licenses).cast("bigint")
    minutes = F.floor(total / 60)
    hours = F.floor(total / 3600)
    return (
        F.when(total < 60, F.concat(total.cast("string"), F.lit(" seconds")))
        .when(total < 3600, F.concat(minutes.cast("string"), F.lit(" minutes")))
        .otherwise(
            F.concat(
                hours.cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m")
            )
        )
    )


def health_score(queue: str | Column, workers: str | Column, failed: str | Column) -> Column:
    """struct(score, status) of the service's three key numbers."""
    score = F.greatest(
        F.lit(0.0),
        stable(
            F.lit(1.0)
            - F.when(col(queue) > 100, 0.2).otherwise(0.0)
            - F.when(col(workers) == 0, 0.5).otherwise(0.0)
            - F.when(col(failed) > 10, 0.3).otherwise(0.0)
        ),
    )
    status = F.when(score > 0.7, "healthy").when(score > 0.4, "degraded").otherwise("unhealthy")
    return F.struct(score.alias("score"), status.alias("status"))
