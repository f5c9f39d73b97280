"""Fields found in document text, as array expressions over a pattern table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DOCUMENT_PATTERNS, EMAIL_PATTERN, ENTITY_FIELDS
from .scores import label_of, stable
from .text import col, strip


def clean_text(c: str | Column, fixups: bool = False) -> Column:
    """Single spaces, no control characters; ``fixups`` swaps look-alikes for letters."""
    flat = F.regexp_replace(col(c), r"\s+", " ")
    plain = F.regexp_replace(flat, r"[\x00-\x1f\x7f-\x9f]", "")
    return strip(F.translate(plain, "|05", "IOS") if fixups else plain)


def clean_value(c: str | Column) -> Column:
    kept = F.regexp_replace(col(c), r"[^A-Za-z0-9_\s@.\-]", "")
    return strip(F.regexp_replace(kept, r"\s+", " "))


def field_confidence(field: str, value: Column, pattern: str) -> Column:
    """Confidence of a found value: a tier per field type, a little more for anchors."""
    size = F.length(value)
    if field == "phone":
        base = (
            F.when(value.rlike(r"^\([0-9]{3}\)\s*[0-9]{3}-[0-9]{4}$"), 0.95)
            .when(value.rlike(r"^[0-9]{3}-[0-9]{3}-[0-9]{4}$"), 0.90)
            .otherwise(0.70)
        )
    elif field == "email":
        base = F.when(value.rlike(EMAIL_PATTERN), 0.95).otherwise(0.70)
    elif field == "license":
        base = F.when(value.rlike(r"^[A-Z0-9\-]+$") & (size >= 3), 0.90).otherwise(0.75)
    elif field == "name":
        base = F.when(value.rlike(r"^[A-Za-z\s.,]+$") & (size >= 3), 0.85).otherwise(0.70)
    else:
        base = F.lit(0.80)
    anchored = 0.05 if ("^" in pattern or "$" in pattern) else 0.0
    return F.least(F.lit(1.0), stable(base + anchored))


def _first_good(text: Column, pattern: str) -> Column:
    """First match whose cleaned value has more than one character."""
    flags = "(?imd)"  # only a line feed ends a line
    found = F.regexp_extract_all(text, F.lit(flags + pattern.replace("(?i)", "")), F.lit(1))
    cleaned = F.transform(found, clean_value)
    return F.try_element_at(F.filter(cleaned, lambda v: F.length(v) > 1), F.lit(1))


def extract_fields(c: str | Column, patterns: dict[str, list[str]] | None = None) -> Column:
    """array<struct<field, pattern_no, value, confidence>>, one entry per pattern that hits.

    The whole text is searched by every pattern.
    """
    text = F.coalesce(col(c), F.lit(""))
    entries = []
    number = 0
    for field, regexes in (patterns or DOCUMENT_PATTERNS).items():
        for regex in regexes:
            number += 1
            value = _first_good(text, regex)
            entries.append(
                F.struct(
                    F.lit(field).alias("field"),
                    F.lit(number).alias("pattern_no"),
                    value.alias("value"),
                )
            )
    found = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())

    def scored(e: Column) -> Column:
        case = None
        n = 0
        for field, regexes in (patterns or DOCUMENT_PATTERNS).items():
            for regex in regexes:
                n += 1
                score = field_confidence(field, e["value"], regex)
                hit = e["pattern_no"] == n
                case = F.when(hit, score) if case is None else case.when(hit, score)
        return F.struct(
            e["field"].alias("field"),
            e["pattern_no"].alias("pattern_no"),
            e["value"].alias("value"),
            case.alias("confidence"),
        )

    return F.transform(found, scored)


def add_field_pattern(field: str, regex: str, patterns: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """A pattern table with one more pattern; the given table is left as it is."""
    table = {k: list(v) for k, v in (patterns or DOCUMENT_PATTERNS).items()}
    table.setdefault(field, []).append(regex)
    return table


def entity_field(entity_type: str | Column) -> Column:
    """Our field name of a recognised entity type, NULL for other types."""
    return label_of(F.lower(col(entity_type)), ENTITY_FIELDS, None)


def document_type(path: str | Column, content: Column | None = None) -> Column:
    """pdf / image / unknown by leading bytes when content is given, else by suffix."""
    from ..constants import IMAGE_SUFFIXES

    if content is not None:
        head = F.hex(F.substring(content, 1, 4))
        return (
            F.when(head == "25504446", "pdf")
            .when(head.startswith("FFD8FF"), "image")
            .when(head == "89504E47", "image")
            .otherwise("unknown")
        )
    suffix = F.lower(F.regexp_extract(col(path), r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(suffix == "pdf", "pdf")
        .when(suffix.isin(*IMAGE_SUFFIXES), "image")
        .otherwise("unknown")
    )
