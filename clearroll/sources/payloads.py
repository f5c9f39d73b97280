"""Nested JSON payloads of registry and address services, flattened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..schema import PLACE_JSON, REGISTRY_JSON


def flatten_registry(df: DataFrame, column: str = "payload") -> DataFrame:
    """First address and taxonomy, names, and metadata of a registry payload."""
    parsed = df.withColumn("_p", F.from_json(column, REGISTRY_JSON))
    address = F.try_element_at("_p.addresses", F.lit(1))
    taxonomy = F.try_element_at("_p.taxonomies", F.lit(1))

    def text_of(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    basic = F.col("_p.basic")
    return parsed.select(
        *[c for c in df.columns if c != column],
        text_of(F.col("_p.number")).alias("npi_number"),
        text_of(basic["first_name"]).alias("given_name"),
        text_of(basic["last_name"]).alias("family_name"),
        taxonomy["code"].alias("primary_taxonomy"),
        text_of(basic["organization_name"]).alias("practice_name"),
        text_of(address["address_1"]).alias("address_street"),
        text_of(address["city"]).alias("address_city"),
        text_of(address["state"]).alias("address_state"),
        text_of(address["postal_code"]).alias("address_zip"),
        text_of(address["telephone_number"]).alias("phone_primary"),
        text_of(basic["email"]).alias("email"),
        F.lit("").alias("license_number"),
        F.lit("").alias("license_state"),
        F.lit("").alias("license_status"),
        F.struct(
            text_of(F.col("_p.enumeration_type")).alias("enumeration_type"),
            *[
                text_of(basic[n]).alias(n)
                for n in ("credential", "middle_name", "name_prefix", "name_suffix", "sole_proprietor", "gender")
            ],
            text_of(F.col("_p.enumeration_date")).alias("enumeration_date"),
            text_of(F.col("_p.last_updated")).alias("last_updated"),
            text_of(F.col("_p.certification_date")).alias("certification_date"),
            F.transform(
                F.coalesce("_p.taxonomies", F.array().cast(REGISTRY_JSON["taxonomies"].dataType)),
                lambda t: text_of(t["desc"]),
            ).alias("all_taxonomies"),
            F.coalesce(F.size("_p.addresses"), F.lit(0)).alias("all_addresses"),
        ).alias("metadata"),
    )


def _component(components: Column, kind: str, name: str) -> Column:
    """The last component of that type, as a later one replaces an earlier one."""
    hits = F.filter(components, lambda c: F.array_contains(c["types"], kind))
    return F.try_element_at(hits, F.lit(-1))[name]


def _flatten_place(df: DataFrame, column: str, extra: bool) -> DataFrame:
    parsed = df.withColumn("_p", F.from_json(column, PLACE_JSON))
    parts = F.col("_p.address_components")
    number = _component(parts, "street_number", "long_name")
    route = _component(parts, "route", "long_name")
    kind = F.col("_p.geometry.location_type")
    street = F.nullif(F.concat_ws(" ", F.nullif(number, F.lit("")), F.nullif(route, F.lit(""))), F.lit(""))
    own = [c for c in df.columns if c != column]
    return parsed.select(
        *own,
        F.col("_p.place_id").alias("place_id"),
        *([F.col("_p.name").alias("name")] if extra else []),
        F.col("_p.formatted_address").alias("formatted_address"),
        F.col("_p.geometry.location.lat").alias("latitude"),
        F.col("_p.geometry.location.lng").alias("longitude"),
        *([] if extra else [number.alias("street_number"), route.alias("route")]),
        street.alias("address_street"),
        _component(parts, "locality", "long_name").alias("address_city"),
        _component(parts, "administrative_area_level_1", "short_name").alias("address_state"),
        _component(parts, "postal_code", "long_name").alias("address_zip"),
        _component(parts, "country", "short_name").alias("country"),
        *([F.col("_p.types").alias("types")] if extra else []),
        F.coalesce(kind, F.lit("")).alias("geometry_accuracy"),
        scores.geometry_confidence(F.coalesce(kind, F.lit(""))).alias("match_confidence"),
    )


def flatten_geocode(df: DataFrame, column: str = "payload") -> DataFrame:
    return _flatten_place(df, column, extra=False)


def flatten_place_details(df: DataFrame, column: str = "payload") -> DataFrame:
    """Like :func:`flatten_geocode`, with the place's name and types."""
    return _flatten_place(df, column, extra=True)


def trust_scores(df: DataFrame, source: str, mode: str) -> DataFrame:
    """One row per record and field with the fixed trust of that source.

    ``df`` has the id in its first column.  Fields whose trust depends on the record:
    the registry's e-mail (0 if absent), the geocode's match confidence and the
    license's own confidence score.
    """
    from ..constants import TRUST_SCORES

    key = df.columns[0]
    entries = [
        F.struct(F.lit(f).alias("field_name"), F.lit(float(v)).alias("score"))
        for f, v in TRUST_SCORES[(source, mode)].items()
        if not (f == "email" and "email" in df.columns)
    ]
    if "email" in TRUST_SCORES[(source, mode)] and "email" in df.columns:
        has = F.coalesce(F.col("email") != "", F.lit(False))
        entries.append(F.struct(F.lit("email").alias("field_name"), F.when(has, 0.60).otherwise(0.0).alias("score")))
    for own in ("match_confidence", "confidence_score"):
        if own in df.columns:
            entries.append(F.struct(F.lit(own).alias("field_name"), F.col(own).alias("score")))
    return df.select(key, F.explode(F.array(*entries)).alias("t")).select(
        key, "t.*", F.when(F.col("t.score") > 0.8, "high").otherwise("medium").alias("level")
    )
