"""Schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

RECORD = T.StructType(
    [
        T.StructField("provider_id", T.StringType()),
        T.StructField("npi_number", T.StringType()),
        T.StructField("given_name", T.StringType()),
        T.StructField("family_name", T.StringType()),
        T.StructField("primary_taxonomy", T.StringType()),
        T.StructField("practice_name", T.StringType()),
        T.StructField("address_street", T.StringType()),
        T.StructField("address_city", T.StringType()),
        T.StructField("address_state", T.StringType()),
        T.StructField("address_zip", T.StringType()),
        T.StructField("place_id", T.StringType()),
        T.StructField("phone_primary", T.StringType()),
        T.StructField("phone_alt", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("license_number", T.StringType()),
        T.StructField("license_state", T.StringType()),
        T.StructField("license_status", T.StringType()),
        T.StructField(
            "affiliations",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("organization", T.StringType()),
                        T.StructField("role", T.StringType()),
                        T.StructField("start_date", T.StringType()),
                        T.StructField("end_date", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("services_offered", T.MapType(T.StringType(), T.BooleanType())),
        T.StructField("document_path", T.StringType()),
        T.StructField("last_validated_at", T.TimestampType()),
        T.StructField("validated_by", T.StringType()),
        T.StructField("overall_confidence", T.DoubleType()),
        T.StructField(
            "field_confidence",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("score", T.DoubleType()),
                        T.StructField("updated_at", T.TimestampType()),
                    ]
                ),
            ),
        ),
        T.StructField(
            "flags",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("code", T.StringType()),
                        T.StructField("reason", T.StringType()),
                        T.StructField("timestamp", T.TimestampType()),
                    ]
                )
            ),
        ),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

# first-generation column names -> the names above
V1_NAMES = {
    "id": "provider_id",
    "npi": "npi_number",
    "first_name": "given_name",
    "last_name": "family_name",
    "specialty": "primary_taxonomy",
    "organization": "practice_name",
    "address_line1": "address_street",
    "city": "address_city",
    "state": "address_state",
    "zip_code": "address_zip",
    "phone": "phone_primary",
    "last_validated": "last_validated_at",
}

BATCH_FIELDS = [
    "provider_id", "given_name", "family_name", "npi_number", "phone_primary",
    "email", "address_street", "license_number", "license_state", "document_path",
]

BATCH_JSON = T.StructType([T.StructField(f, T.StringType()) for f in BATCH_FIELDS])

REGISTRY_JSON = T.StructType(
    [
        T.StructField("number", T.StringType()),
        T.StructField("enumeration_type", T.StringType()),
        T.StructField("enumeration_date", T.StringType()),
        T.StructField("last_updated", T.StringType()),
        T.StructField("certification_date", T.StringType()),
        T.StructField(
            "basic",
            T.StructType(
                [
                    T.StructField(n, T.StringType())
                    for n in (
                        "first_name", "last_name", "middle_name", "organization_name", "email",
                        "credential", "name_prefix", "name_suffix", "sole_proprietor", "gender",
                        "status",
                    )
                ]
            ),
        ),
        T.StructField(
            "addresses",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(n, T.StringType())
                        for n in ("address_1", "city", "state", "postal_code", "telephone_number")
                    ]
                )
            ),
        ),
        T.StructField(
            "taxonomies",
            T.ArrayType(
                T.StructType(
                    [T.StructField("code", T.StringType()), T.StructField("desc", T.StringType())]
                )
            ),
        ),
    ]
)

_GEOMETRY = T.StructType(
    [
        T.StructField(
            "location",
            T.StructType(
                [T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType())]
            ),
        ),
        T.StructField("location_type", T.StringType()),
    ]
)
_COMPONENTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("long_name", T.StringType()),
            T.StructField("short_name", T.StringType()),
            T.StructField("types", T.ArrayType(T.StringType())),
        ]
    )
)
PLACE_JSON = T.StructType(
    [
        T.StructField("place_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("formatted_address", T.StringType()),
        T.StructField("types", T.ArrayType(T.StringType())),
        T.StructField("geometry", _GEOMETRY),
        T.StructField("address_components", _COMPONENTS),
    ]
)
