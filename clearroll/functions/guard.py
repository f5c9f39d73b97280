"""Input hygiene: trimming, hostile-content classes, content keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import PATH_PATTERNS, SQL_PATTERNS, XSS_PATTERNS
from .text import col, strip


def sanitize(c: str | Column, longest: int = 1000) -> Column:
    """Strip, cut, drop NUL characters and invalid UTF-8."""
    cut = F.left(strip(c), F.lit(longest))
    return F.make_valid_utf8(F.replace(cut, F.lit("\x00"), F.lit("")))


def sanitize_map(c: str | Column) -> Column:
    """Keys cut to 100 characters, values to 1000; of keys that become equal the last one stays."""
    entries = F.transform(
        F.map_entries(col(c)),
        lambda e: F.struct(sanitize(e["key"], 100).alias("key"), sanitize(e["value"]).alias("value")),
    )
    later = lambda e, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: ~later(e, i)))


def _sanitized(c: Column, kind: T.DataType) -> Column:
    """A value of any type with all strings in it sanitised; what is no string stays."""
    if isinstance(kind, T.StringType):
        return sanitize(c)
    if isinstance(kind, T.StructType):
        fields = [_sanitized(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _sanitized(x, kind.elementType))
    if isinstance(kind, T.MapType):
        cut = lambda k: sanitize(k, 100) if isinstance(kind.keyType, T.StringType) else k
        entries = F.transform(
            F.map_entries(c),
            lambda e: F.struct(cut(e["key"]).alias("key"), _sanitized(e["value"], kind.valueType).alias("value")),
        )
        later = lambda e, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"])
        return F.map_from_entries(F.filter(entries, lambda e, i: ~later(e, i)))
    return c


def sanitize_nested(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``df`` with the strings in ``columns`` (all by default) sanitised, in structs, arrays and maps of any depth.

    Values are cut to 1000 characters, keys of maps to 100; of keys that become equal the
    last one stays.  The expression is built from the schema, so it stays native.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: _sanitized(F.col(f"`{c}`"), kinds[c]) for c in columns or df.columns})


# class -> (patterns, whether a dot also matches a line end)
HOSTILE_CLASSES = {
    "xss_attempt": (XSS_PATTERNS, True),
    "sql_injection_attempt": (SQL_PATTERNS, False),
    "path_traversal_attempt": (PATH_PATTERNS, False),
}
_TAG_LEAD = "<.*?"


def _either(patterns: list[str], across_lines: bool) -> str:
    # only a line feed ends a line
    return ("(?is)" if across_lines else "(?id)") + "|".join(f"(?:{p})" for p in patterns)


def _found(c: Column, name: str) -> Column:
    """Whether any pattern of a class occurs; the text is scanned once per class.

    A pattern that starts with "any < and then anything" occurs if its rest occurs after
    the first <, so that rest is searched there, instead of from every < anew.
    """
    patterns, across_lines = HOSTILE_CLASSES[name]
    rests = [p[len(_TAG_LEAD):] for p in patterns if across_lines and p.startswith(_TAG_LEAD)]
    plain = [p for p in patterns if not (across_lines and p.startswith(_TAG_LEAD))]
    found = c.rlike(_either(plain, across_lines))
    if rests:
        bracket = F.instr(c, "<")
        found = found | ((bracket > 0) & F.substr(c, bracket + 1).rlike(_either(rests, across_lines)))
    return F.coalesce(found, F.lit(False))


def detect_malicious(c: str | Column) -> Column:
    """Names of the hostile classes found in a text."""
    return F.array_compact(F.array(*[F.when(_found(col(c), n), F.lit(n)) for n in HOSTILE_CLASSES]))


def content_key(columns: list[str], prefix: str = "validation") -> Column:
    """prefix + md5 of the record's columns in name order, NULLs included."""
    named = [F.col(c).cast("string").alias(c) for c in sorted(columns)]
    body = F.to_json(F.struct(*named), {"ignoreNullFields": "false"})
    return F.concat(F.lit(f"{prefix}_"), F.md5(body))
