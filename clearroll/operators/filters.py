"""Searches, filters, constraint checks and paging over record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MAX_LENGTHS
from ..functions.text import all_of, any_of, full_address, full_name, is_present

SEARCH_COLUMNS = ["given_name", "family_name", "npi_number", "primary_taxonomy", "practice_name"]


def search(df: DataFrame, text: str | None, columns: list[str] | None = None) -> DataFrame:
    """Rows where any of the columns contains the text, ignoring case; no wildcards."""
    if not text:
        return df
    needle = F.lit(text.lower())
    return df.where(any_of([F.lower(F.col(c)).contains(needle) for c in columns or SEARCH_COLUMNS]))


def equals(df: DataFrame, column: str, value) -> DataFrame:
    return df if value is None else df.where(F.col(column) == value)


def between(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Inclusive at both ends; an open end is no bound."""
    tests = []
    if low is not None:
        tests.append(F.col(column) >= F.lit(low))
    if high is not None:
        tests.append(F.col(column) <= F.lit(high))
    return df.where(all_of(tests))


def in_list(df: DataFrame, column: str, values: list | None) -> DataFrame:
    """An empty list is no filter."""
    return df.where(F.col(column).isin(*values)) if values else df


def any_flag(df: DataFrame, flags: list[str] | None, column: str = "flag_codes") -> DataFrame:
    if not flags:
        return df
    return df.where(F.arrays_overlap(F.col(column), F.array(*[F.lit(f) for f in flags])))


def any_source(df: DataFrame, names: list[str] | None, column: str = "sources") -> DataFrame:
    """Rows whose nested sources include one of the names."""
    if not names:
        return df
    return df.where(F.exists(F.col(column), lambda s: s["source"].isin(*names)))


def search_filters(
    df: DataFrame,
    given_name: str | None = None,
    family_name: str | None = None,
    npi_number: str | None = None,
    primary_taxonomy: str | None = None,
    practice_name: str | None = None,
    address_state: str | None = None,
    license_state: str | None = None,
    license_status: str | None = None,
    min_confidence: float | None = None,
    validated_since: str | None = None,
) -> DataFrame:
    """All given criteria must hold."""
    exact = {
        "given_name": given_name,
        "family_name": family_name,
        "npi_number": npi_number,
        "primary_taxonomy": primary_taxonomy,
        "practice_name": practice_name,
        "address_state": address_state,
        "license_state": license_state,
        "license_status": license_status,
    }
    tests = [F.col(c) == v for c, v in exact.items() if v is not None]
    if min_confidence is not None:
        tests.append(F.col("overall_confidence") >= min_confidence)
    if validated_since is not None:
        tests.append(F.col("last_validated_at") >= F.lit(validated_since).cast("timestamp"))
    return df.where(all_of(tests))


def lookup_by(df: DataFrame, column: str, *values) -> DataFrame:
    return df.where(F.col(column).isin(*values))


def audit_filter(
    df: DataFrame,
    user_id: str | None = None,
    action: str | None = None,
    resource_type: str | None = None,
    resource_id: str | None = None,
    risk_level: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Audit rows by criteria; the time range is inclusive.

    Where the table carries the ``date`` partition column, the range also prunes
    partitions.
    """
    exact = {
        "user_id": user_id,
        "action": action,
        "resource_type": resource_type,
        "resource_id": resource_id,
        "risk_level": risk_level,
    }
    tests = [F.col(c) == v for c, v in exact.items() if v is not None]
    if start is not None:
        tests.append(F.col("logged_at") >= F.lit(start).cast("timestamp"))
        if "date" in df.columns:
            tests.append(F.col("date") >= start[:10])
    if end is not None:
        tests.append(F.col("logged_at") <= F.lit(end).cast("timestamp"))
        if "date" in df.columns:
            tests.append(F.col("date") <= end[:10])
    return df.where(all_of(tests))


def timeline_filter(
    df: DataFrame,
    status: str | None = None,
    source: str | None = None,
    start: str | None = None,
    end: str | None = None,
    at: str = "validated_at",
) -> DataFrame:
    tests = []
    if status:
        tests.append(F.col("status") == status)
    if source:
        tests.append(F.col("source") == source)
    if start:
        tests.append(F.col(at) >= F.lit(start).cast("timestamp"))
    if end:
        tests.append(F.col(at) <= F.lit(end).cast("timestamp"))
    return df.where(all_of(tests))


def with_display_names(df: DataFrame) -> DataFrame:
    return df.withColumns({"full_name": full_name(), "full_address": full_address()})


def violations() -> Column:
    """Names of the constraints a record breaks, in rule order."""

    def over(name: str, size: int) -> Column:
        return F.when(F.length(F.col(name)) > size, F.lit(f"{name}_too_long"))

    def bad_state(name: str) -> Column:
        wrong = is_present(name) & ~F.col(name).rlike("^[A-Z]{2}$")
        return F.when(wrong, F.lit(f"{name}_format"))

    npi = F.coalesce(F.col("npi_number"), F.lit(""))
    confidence = F.col("overall_confidence")
    return F.array_compact(
        F.array(
            F.when(~is_present("given_name"), F.lit("given_name_missing")),
            F.when(~is_present("family_name"), F.lit("family_name_missing")),
            F.when(~npi.rlike("^[0-9]{10}$"), F.lit("npi_number_format")),
            bad_state("address_state"),
            bad_state("license_state"),
            F.when((confidence < 0) | (confidence > 1), F.lit("overall_confidence_range")),
            *[over(n, s) for n, s in MAX_LENGTHS.items() if n not in ("place_id", "phone_alt")],
        )
    )


def check_constraints(df: DataFrame) -> DataFrame:
    return df.withColumn("violations", violations())


def ordered(df: DataFrame, column: str, descending: bool, tie: str) -> DataFrame:
    lead = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return df.orderBy(lead, F.col(tie))


def page(df: DataFrame, number: int, size: int, column: str, tie: str, descending: bool = True) -> DataFrame:
    """One page, newest first by default; ties by id, so that pages do not overlap."""
    return ordered(df, column, descending, tie).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, column: str, tie: str, last_value, last_tie, size: int) -> DataFrame:
    """The page after a given row: deep pages without sorting what came before.

    Newest first; rows with a NULL in the order column are not part of it.
    """
    value = F.lit(last_value)
    rest = df.where((F.col(column) < value) | ((F.col(column) == value) & (F.col(tie) > F.lit(last_tie))))
    return ordered(rest, column, True, tie).limit(size)


def page_totals(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "pages", F.ceil(F.col("total") / size).cast("bigint")
    )


def recent(df: DataFrame, column: str, tie: str, n: int = 10) -> DataFrame:
    """The n newest rows with a time."""
    return ordered(df.where(F.col(column).isNotNull()), column, True, tie).limit(n)
