"""Cleaning, format checks and comparison of record fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EMAIL_PATTERN, FIELD_PATTERNS

_BLANKS = " \t\n\r\x0b\x0c"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    return F.btrim(col(c), F.lit(_BLANKS))


def present(c: str | Column) -> Column:
    """The stripped value, or NULL where it is NULL or blank."""
    stripped = strip(c)
    return F.when(stripped != "", stripped)


def is_present(c: str | Column) -> Column:
    return F.coalesce(strip(c) != "", F.lit(False))


def digits_only(c: str | Column) -> Column:
    return F.regexp_replace(col(c), "[^0-9]", "")


def npi_valid(c: str | Column) -> Column:
    """Ten digits after clean-up that pass the plain Luhn check."""
    digits = F.coalesce(digits_only(c), F.lit(""))
    return (F.length(digits) == 10) & F.call_function("luhn_check", digits)


def normalize_phone(c: str | Column) -> Column:
    kept = F.regexp_replace(col(c), "[^0-9+]", "")
    return (
        F.when(kept.startswith("+1"), kept)
        .when(kept.startswith("1") & (F.length(kept) == 11), F.concat(F.lit("+"), kept))
        .when(F.length(kept) == 10, F.concat(F.lit("+1"), kept))
        .otherwise(kept)
    )


def phone_shape_ok(c: str | Column) -> Column:
    kept = F.coalesce(F.regexp_replace(col(c), "[^0-9+]", ""), F.lit(""))
    size = F.length(kept)
    return (
        (kept.startswith("+1") & (size == 12))
        | (kept.startswith("1") & (size == 11))
        | (size == 10)
    )


def email_ok(c: str | Column) -> Column:
    return F.coalesce(col(c).rlike(EMAIL_PATTERN), F.lit(False))


def collapse_spaces(c: str | Column) -> Column:
    return strip(F.regexp_replace(col(c), r"\s+", " "))


def clean_zip(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"[^0-9\-]", "")


def zip_ok(c: str | Column) -> Column:
    return F.coalesce(col(c).rlike(FIELD_PATTERNS["address_zip"]), F.lit(False))


def license_ok(c: str | Column) -> Column:
    return F.coalesce(col(c).rlike(FIELD_PATTERNS["license_number"]), F.lit(False))


CLEANERS = {
    "npi_number": digits_only,
    "phone_primary": normalize_phone,
    "email": F.lower,
    "license_number": collapse_spaces,
    "address_street": collapse_spaces,
    "address_city": collapse_spaces,
    "address_state": collapse_spaces,
    "address_zip": clean_zip,
    "primary_taxonomy": collapse_spaces,
}


def clean_field(name: str, c: str | Column) -> Column:
    """Blank becomes NULL, then the cleaner of that field."""
    value = present(c)
    return CLEANERS[name](value) if name in CLEANERS else value


def row_errors(fields: list[str] | None = None) -> Column:
    """Error texts of one cleaned record, in rule order.

    ``fields`` names the columns at hand; a format that fails both its pattern
    and its own re-check is reported by each, as two texts.
    """
    have = set(fields) if fields is not None else None

    def known(name: str) -> bool:
        return have is None or name in have

    checks: list[Column] = []
    for name in ("given_name", "family_name"):
        missing = ~is_present(name) if known(name) else F.lit(True)
        checks.append(F.when(missing, F.lit(f"Missing required field: {name}")))
    for name, pattern in FIELD_PATTERNS.items():
        if known(name):
            bad = is_present(name) & ~F.col(name).rlike(pattern)
            checks.append(F.when(bad, F.concat(F.lit(f"Invalid format for {name}: "), F.col(name))))
    if known("npi_number"):
        bad = is_present("npi_number") & ~F.col("npi_number").rlike("^[0-9]{10}$")
        checks.append(F.when(bad, F.concat(F.lit("Invalid NPI number format: "), "npi_number")))
    if known("phone_primary"):
        bad = is_present("phone_primary") & ~phone_shape_ok("phone_primary")
        checks.append(F.when(bad, F.concat(F.lit("Invalid phone number format: "), "phone_primary")))
    if known("email"):
        bad = is_present("email") & ~email_ok("email")
        checks.append(F.when(bad, F.concat(F.lit("Invalid email format: "), "email")))
    return F.array_compact(F.array(*checks))


def name_similarity(a: str | Column, b: str | Column) -> Column:
    """1 - edit distance / longer length, ignoring case; 0 for two empty names."""
    left = F.lower(F.coalesce(col(a), F.lit("")))
    right = F.lower(F.coalesce(col(b), F.lit("")))
    longer = F.greatest(F.length(left), F.length(right))
    return F.when(longer > 0, 1 - F.levenshtein(left, right) / longer).otherwise(F.lit(0.0))


def words(c: str | Column) -> Column:
    """Distinct lower-case words."""
    parts = F.split(F.lower(F.coalesce(col(c), F.lit(""))), r"\s+")
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def word_overlap(a: str | Column, b: str | Column) -> Column:
    """Share of the words of ``a`` that occur in ``b``; 0 if either has none."""
    left, right = words(a), words(b)
    return F.when(
        (F.size(left) > 0) & (F.size(right) > 0),
        F.size(F.array_intersect(left, right)) / F.size(left),
    ).otherwise(F.lit(0.0))


def joined(*parts: str | Column, sep: str = ", ") -> Column:
    """Non-empty parts joined; NULL and blank parts are skipped."""
    return F.concat_ws(sep, *[F.nullif(col(p), F.lit("")) for p in parts])


def full_name(given: str | Column = "given_name", family: str | Column = "family_name") -> Column:
    return F.trim(F.concat_ws(" ", col(given), col(family)))


def full_address() -> Column:
    return joined("address_street", "address_city", "address_state", "address_zip")


def address_key(c: str | Column) -> Column:
    """Upper-case letters, digits and single spaces: the join key of an address."""
    plain = F.regexp_replace(F.upper(col(c)), "[^A-Z0-9]+", " ")
    return F.nullif(F.trim(plain), F.lit(""))


def license_key(c: str | Column) -> Column:
    return F.nullif(F.upper(strip(c)), F.lit(""))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(True)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)
