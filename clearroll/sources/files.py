"""Reading record files: CSV with free headers, batch CSV and JSON."""

from __future__ import annotations

import csv
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import HEADER_ALIASES
from ..functions import text
from ..schema import BATCH_FIELDS, BATCH_JSON, V1_NAMES

REQUIRED_HEADERS = ["given_name", "family_name"]


def map_headers(headers: list[str], compat: bool = False) -> dict[str, str]:
    """Target field -> header of the file.

    All headers are tried for an exact alias first, then for one that contains an alias
    or is contained in one; the first such header wins.  ``compat`` takes headers in file
    order, where an inexact header may be replaced by a later one until an exact one
    ends the search.
    """

    def exact(header: str, names: list[str]) -> bool:
        return header.lower().strip() in names

    def partial(header: str, names: list[str]) -> bool:
        h = header.lower().strip()
        return any(n in h or h in n for n in names)

    mapping: dict[str, str] = {}
    for target, names in HEADER_ALIASES.items():
        hits = [h for h in headers if exact(h, names)]
        near = [h for h in headers if partial(h, names)]
        if compat:
            upto = headers[: headers.index(hits[0])] if hits else headers
            near = [h for h in upto if h in near]
            chosen = hits[:1] or near[-1:]
        else:
            chosen = hits[:1] or near[:1]
        if chosen:
            mapping[target] = chosen[0]
    return mapping


@dataclass
class CheckedRows:
    """Rows of a file with an ``errors`` array, and the mapping that was used."""

    rows: DataFrame
    mapping: dict[str, str]

    @property
    def good(self) -> DataFrame:
        return self.rows.where(F.size("errors") == 0).drop("errors")

    @property
    def bad(self) -> DataFrame:
        return self.rows.where(F.size("errors") > 0)


def canonical_rows(raw: DataFrame, mapping: dict[str, str] | None = None, compat: bool = False) -> CheckedRows:
    """Cleaned canonical columns and per-row errors of a table with free headers.

    A row without provider_id gets one made from its own content, so that reading a
    file twice gives the same ids.
    """
    chosen = mapping or map_headers([c for c in raw.columns if c != _BAD], compat)
    usable = {t: h for t, h in chosen.items() if h in raw.columns}
    cleaned = raw.select(
        *[text.clean_field(t, F.col(f"`{h}`").cast("string")).alias(t) for t, h in usable.items()],
        *[c for c in (_BAD,) if c in raw.columns],
    )
    for field in ("given_name", "family_name"):
        if field not in usable:
            cleaned = cleaned.withColumn(field, F.lit(None).cast("string"))
    content = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in sorted(cleaned.columns) if c != _BAD]))
    made = F.concat(F.lit("rec_"), content)
    ids = F.coalesce(F.col("provider_id"), made) if "provider_id" in cleaned.columns else made
    identified = cleaned.withColumn("provider_id", ids)
    checked = identified.withColumn("errors", text.row_errors(identified.columns))
    if _BAD in cleaned.columns:
        torn = F.array(F.lit(MALFORMED))
        checked = checked.withColumn("errors", F.when(F.col(_BAD), F.concat(torn, "errors")).otherwise(F.col("errors"))).drop(_BAD)
    return CheckedRows(checked, usable)


MALFORMED = "Row has more or fewer values than the header"
_BAD = "_malformed"


def file_headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Header names, as they stand in the files and repeats included -> the files that have them.

    The first line of every file is found by an aggregate over its lines, so only headers
    and file names reach the driver.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )
    first = lines.groupBy("file").agg(F.min_by("value", F.struct("start", "line")).alias("line"))
    found: dict[tuple[str, ...], list[str]] = {}
    for row in first.orderBy("file").collect():
        names = tuple(h.strip() for h in next(csv.reader([row.line]), []))
        found.setdefault(names, []).append(unquote(row.file))
    return found


def headed_files(spark: SparkSession, path: str, multi_line: bool = True) -> list[DataFrame]:
    """One text table per header that occurs, each file read by its own header.

    Quoted line breaks stay in their value (``multi_line``; without it a large file is
    split, but a value must end in its line).  ``_malformed`` marks rows with more or fewer
    values than the header.  A repeated header name gets a number.
    """
    tables = []
    for names, paths in file_headers(spark, path).items():
        unique = [n if n.lower() not in [x.lower() for x in names[:i]] else f"{n}_{i}" for i, n in enumerate(names)]
        fields = [T.StructField(n or f"column_{i}", T.StringType()) for i, n in enumerate(unique)]
        schema = T.StructType([*fields, T.StructField("_corrupt", T.StringType())])
        reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").option("columnPruning", False)
        rows = reader.csv(paths, header=True, mode="PERMISSIVE", multiLine=multi_line, escape='"', enforceSchema=True)
        tables.append(rows.withColumn(_BAD, F.col("_corrupt").isNotNull()).drop("_corrupt"))
    return tables


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_directory_csv(
    spark: SparkSession,
    path: str,
    mapping: dict[str, str] | None = None,
    compat: bool = False,
    multi_line: bool = True,
) -> CheckedRows:
    """Header CSV files as canonical rows; every column is text, so no inference pass.

    Files may differ in their headers and in the order of their columns.  A malformed row
    is kept, with an error of its own.
    """
    parts = [canonical_rows(raw, mapping, compat) for raw in headed_files(spark, path, multi_line)]
    if not parts:
        raise ValueError(f"no file with a header in {path}")
    return CheckedRows(_together([p.rows for p in parts]), {k: v for p in reversed(parts) for k, v in p.mapping.items()})


def headers_told(headers: list[str], aliases: bool = False) -> dict:
    """Missing and repeated headers, and the mapping; with ``aliases`` a header that maps to a required one will do."""
    lowered = [h.lower() for h in headers]
    mapped = map_headers(headers)
    missing = [r for r in REQUIRED_HEADERS if not any(r in h for h in lowered) and not (aliases and r in mapped)]
    repeated = [h for i, h in enumerate(headers) if h.lower() in lowered[:i]]
    return {
        "valid": not missing and not repeated,
        "headers": headers,
        "missing_headers": missing,
        "duplicate_headers": repeated,
        "field_mappings": mapped,
    }


def check_structure(df: DataFrame) -> dict:
    """Headers, missing and repeated headers, row count and mapping of a table that has been read."""
    return headers_told(list(df.columns)) | {"row_count": df.count()}


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Header names as they stand in the first file, repeats included."""
    return list(next(iter(file_headers(spark, path)), ()))


def check_files(spark: SparkSession, path: str) -> dict:
    """:func:`check_structure` of CSV files by the headers that stand in them, repeats included."""
    told = [headers_told(list(names), aliases=True) for names in file_headers(spark, path)]
    return {
        "valid": bool(told) and all(t["valid"] for t in told),
        "headers": sorted({h for t in told for h in t["headers"]}),
        "missing_headers": sorted({h for t in told for h in t["missing_headers"]}),
        "duplicate_headers": sorted({h for t in told for h in t["duplicate_headers"]}),
        "row_count": sum(t.count() for t in headed_files(spark, path)),
    }


def batch_rows(raw: DataFrame) -> DataFrame:
    """The ten batch fields; rows with nothing but an id are dropped."""
    have = {c.lower(): c for c in raw.columns}
    chosen = raw.select(
        *[(F.col(have[f]).cast("string") if f in have else F.lit(None).cast("string")).alias(f) for f in BATCH_FIELDS]
    )
    filled = [F.coalesce(F.col(f) != "", F.lit(False)) for f in BATCH_FIELDS if f != "provider_id"]
    return chosen.where(text.any_of(filled))


def read_batch_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The batch fields of CSV files, each read by its own header."""
    return _together([batch_rows(raw) for raw in headed_files(spark, path, multi_line)])


def read_batch_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Record objects with a declared schema; any number of them."""
    return spark.read.schema(BATCH_JSON).json(path, multiLine=multi_line)


def from_v1(df: DataFrame) -> DataFrame:
    """First-generation column names replaced by the canonical ones."""
    known = {old: new for old, new in V1_NAMES.items() if old in df.columns and new not in df.columns}
    return df.withColumnsRenamed(known)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)
