"""Checks of each record against reference tables.

Every check answers in one shape, the source result::

    source, success, confidence, error_message,
    fields array<struct<field, value, confidence>>

as a column of the record's own row (``*_answer``) or as a table of its own
(``check_*``).  A field that a source knows but leaves empty is still listed,
with a NULL value.

A reference table that lists a key twice is reduced to one row per key first, so a
record never becomes two; ``unique=True`` states that a table is keyed and saves that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scores, text
from .lookup import attach, attach_by_id, hot_values

FIELD_TYPE = "array<struct<field:string,value:string,confidence:double>>"
RESULT_COLUMNS = ["provider_id", "source", "success", "confidence", "error_message", "fields"]


def _fields(values: dict[str, Column], confidences: dict[str, float]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("field"),
                values[name].cast("string").alias("value"),
                F.lit(score).alias("confidence"),
            )
            for name, score in confidences.items()
        ]
    )


def _answer(source: str, ok: Column, error: Column, fields: Column, confidence: Column | None = None) -> Column:
    score = confidence if confidence is not None else F.lit(K.CHECK_CONFIDENCE[source])
    return F.struct(
        F.lit(source).alias("source"),
        ok.alias("success"),
        F.when(ok, score).otherwise(0.0).alias("confidence"),
        F.when(~ok, error).alias("error_message"),
        F.when(ok, fields).otherwise(F.array().cast(FIELD_TYPE)).alias("fields"),
    )


def as_results(df: DataFrame, answer: str) -> DataFrame:
    return df.select("provider_id", f"{answer}.*")


# -- registry ----------------------------------------------------------------


def registry_key() -> Column:
    npi = text.digits_only("npi_number")
    return F.when(F.length(npi) == 10, npi)


def with_registry(records: DataFrame, registry: DataFrame, unique: bool = False, **skew) -> DataFrame:
    return attach(records, registry, registry_key(), F.col("npi_number"), "registry", "provider_id", unique, **skew)


def registry_answer(hit: str = "registry") -> Column:
    given = text.is_present("npi_number")
    shaped = F.length(text.digits_only("npi_number")) == 10
    ok = F.col(hit).isNotNull()
    error = (
        F.when(~given, F.lit("No NPI number provided"))
        .when(~shaped, F.lit("Invalid NPI format. Must be 10 digits."))
        .otherwise(F.concat(F.lit("NPI "), F.col("npi_number"), F.lit(" not found in registry")))
    )
    values = {f: F.col(f"{hit}.{f}") for f in K.REGISTRY_CONFIDENCE}
    return _answer(K.CHECK_REGISTRY, ok, error, _fields(values, K.REGISTRY_CONFIDENCE))


def check_registry(records: DataFrame, registry: DataFrame, unique: bool = False, **skew) -> DataFrame:
    found = with_registry(records, registry, unique, **skew)
    return as_results(found.withColumn("answer", registry_answer()), "answer")


def registry_status(hit: str = "registry") -> Column:
    """struct(valid, error): active status and a known kind of entry."""
    status = F.lower(F.coalesce(F.col(f"{hit}.registry_status"), F.lit("")))
    kind = F.lower(F.coalesce(F.col(f"{hit}.enumeration_type"), F.lit("")))
    known = kind.isin("npi-1", "npi-2")
    error = (
        F.when(F.col(hit).isNull(), F.lit("No results returned from NPI registry"))
        .when(~known, F.concat(F.lit("Invalid enumeration type: "), kind))
        .when(status != "a", F.concat(F.lit("NPI status is not active: "), status))
    )
    return F.struct(error.isNull().alias("valid"), error.alias("error"))


def registry_name_check(hit: str = "registry", field: str = "family_name") -> Column:
    """struct(value, status, confidence): how like the registry's name is."""
    similarity = scores.stable(text.name_similarity(F.col(field), F.col(f"{hit}.{field}")))
    score = F.when(F.col(hit).isNull(), 0.0).otherwise(similarity)
    return F.struct(
        F.col(field).alias("value"),
        F.when(score >= 0.85, "valid").when(score >= 0.7, "warning").otherwise("invalid").alias("status"),
        score.alias("confidence"),
    )


# -- address -------------------------------------------------------------------


def geocode_key() -> Column:
    return F.when(text.is_present("address_street"), text.address_key(text.full_address()))


def with_geocode(records: DataFrame, geocodes: DataFrame, unique: bool = False, **skew) -> DataFrame:
    return attach(
        records, geocodes, geocode_key(), text.address_key("formatted_address"), "geocode", "provider_id", unique, **skew
    )


def address_answer(hit: str = "geocode") -> Column:
    ok = F.coalesce(scores.geometry_confidence(f"{hit}.location_type") > 0.5, F.lit(False)) & F.col(hit).isNotNull()
    error = (
        F.when(~text.is_present("address_street"), F.lit("No address provided"))
        .when(F.col(hit).isNull(), F.lit("Address not found"))
        .otherwise(F.lit("Address match confidence too low"))
    )
    values = {
        "address_street": F.col(f"{hit}.formatted_address"),
        "place_id": F.col(f"{hit}.place_id"),
        "latitude": F.format_string("%.4f", F.col(f"{hit}.latitude")),
        "longitude": F.format_string("%.4f", F.col(f"{hit}.longitude")),
    }
    return _answer(K.CHECK_ADDRESS, ok, error, _fields(values, K.ADDRESS_CONFIDENCE))


def check_address(records: DataFrame, geocodes: DataFrame, unique: bool = False, **skew) -> DataFrame:
    found = with_geocode(records, geocodes, unique, **skew)
    return as_results(found.withColumn("answer", address_answer()), "answer")


def address_place_check(hit: str = "geocode", limit_m: float = 100.0) -> Column:
    """struct(status, confidence, distance_m) by place id and distance from the claim."""
    distance = scores.haversine_m(
        F.col("claimed_lat"), F.col("claimed_lng"), F.col(f"{hit}.latitude"), F.col(f"{hit}.longitude")
    )
    missing = F.col(hit).isNull()
    no_place = F.col(f"{hit}.place_id").isNull()
    near = distance <= limit_m
    return F.struct(
        F.when(missing, "invalid").when(no_place, "warning").when(near, "valid").otherwise("warning").alias("status"),
        F.when(missing, 0.0).when(no_place, 0.6).when(near, 0.9).otherwise(0.5).alias("confidence"),
        distance.alias("distance_m"),
    )


# -- license ---------------------------------------------------------------------


def license_pair() -> Column:
    number = text.license_key("license_number")
    return F.when(number.isNotNull(), F.concat_ws("|", number, F.upper(F.trim("license_state"))))


def with_license(records: DataFrame, licenses: DataFrame, unique: bool = False, **skew) -> DataFrame:
    return attach(records, licenses, license_pair(), license_pair(), "license", "provider_id", unique, **skew)


def license_answer(hit: str = "license") -> Column:
    ok = F.col(hit).isNotNull()
    error = F.when(~text.is_present("license_number"), F.lit("No license number provided")).otherwise(
        F.concat(F.lit("License "), F.col("license_number"), F.lit(" not found"))
    )
    values = {
        "license_number": F.col(f"{hit}.license_number"),
        "license_state": F.col(f"{hit}.license_state"),
        "license_status": F.col(f"{hit}.license_status"),
        "issue_date": F.date_format(F.col(f"{hit}.issue_date"), "yyyy-MM-dd"),
        "expiry_date": F.date_format(F.col(f"{hit}.expiry_date"), "yyyy-MM-dd"),
    }
    return _answer(K.CHECK_LICENSE, ok, error, _fields(values, K.LICENSE_CONFIDENCE))


def check_license(records: DataFrame, licenses: DataFrame, unique: bool = False, **skew) -> DataFrame:
    found = with_license(records, licenses, unique, **skew)
    return as_results(found.withColumn("answer", license_answer()), "answer")


def license_status_check(hit: str = "license") -> Column:
    """struct(status, confidence): active, barred, any other, or not found."""
    status = F.upper(F.col(f"{hit}.license_status"))
    missing = F.col(hit).isNull()
    barred = status.isin("SUSPENDED", "REVOKED")
    return F.struct(
        F.when(missing, "invalid").when(status == "ACTIVE", "valid").when(barred, "invalid").otherwise("warning").alias("status"),
        F.when(missing, 0.0).when(status == "ACTIVE", 0.95).when(barred, 0.1).otherwise(0.5).alias("confidence"),
    )


# -- enrichment, documents, e-mail, phone --------------------------------------------


def with_enrichment(records: DataFrame, enrichment: DataFrame) -> DataFrame:
    return attach_by_id(records, enrichment, "extra", "provider_id")


def enrichment_answer(hit: str = "extra") -> Column:
    """Always succeeds: own phone and e-mail pass through, the rest is looked up."""
    values = {
        "phone_primary": F.col("phone_primary"),
        "email": F.col("email"),
        "affiliations": F.col(f"{hit}.affiliations"),
        "services_offered": F.col(f"{hit}.services_offered"),
    }
    return _answer(K.CHECK_ENRICHMENT, F.lit(True), F.lit(None).cast("string"), _fields(values, K.ENRICHMENT_CONFIDENCE))


def enrich(records: DataFrame, enrichment: DataFrame) -> DataFrame:
    found = with_enrichment(records, enrichment)
    return as_results(found.withColumn("answer", enrichment_answer()), "answer")


def document_answers(extracted: DataFrame) -> DataFrame:
    """Per record the fields read from its documents; the last one of a name wins.

    ``extracted`` has provider_id, seq, field_name, field_value, confidence.  The
    first aggregate leaves one row per field name, so the list that is collected
    next is as long as the vocabulary of field names, not as the document.
    """
    last = extracted.groupBy("provider_id", "field_name").agg(
        F.max(F.struct("seq", "field_value", "confidence")).alias("last")
    )
    entry = F.struct(
        F.col("field_name").alias("field"),
        F.col("last.field_value").alias("value"),
        F.col("last.confidence").alias("confidence"),
    )
    return last.groupBy("provider_id").agg(
        F.sort_array(F.collect_list(entry)).alias("fields"),
        scores.stable(F.avg("last.confidence")).alias("confidence"),
    )


def with_documents(records: DataFrame, extracted: DataFrame) -> DataFrame:
    return attach_by_id(records, document_answers(extracted), "document", "provider_id", unique=True)


def document_answer(hit: str = "document") -> Column:
    ok = text.is_present("document_path") & F.col(hit).isNotNull()
    error = F.when(~text.is_present("document_path"), F.lit("No document path provided")).otherwise(
        F.lit("OCR processing failed")
    )
    return _answer(
        K.CHECK_DOCUMENT, ok, error, F.col(f"{hit}.fields").cast(FIELD_TYPE), F.col(f"{hit}.confidence")
    )


def attach_document_fields(records: DataFrame, extracted: DataFrame) -> DataFrame:
    found = with_documents(records, extracted)
    return as_results(found.withColumn("answer", document_answer()), "answer")


def check_email_domain(records: DataFrame, domains: DataFrame) -> DataFrame:
    """provider_id, domain, status, confidence of the e-mail address.

    ``domains`` (one column ``domain``) is the table of domains known to take mail.
    """
    asked = records.select("provider_id", F.col("email").alias("value"))
    ok = text.email_ok("value")
    domain = F.when(ok, F.substring_index(F.col("value"), "@", -1))
    found = attach(asked.withColumn("domain", domain), domains, F.col("domain"), F.col("domain"), "known", "provider_id")
    return found.select(
        "provider_id",
        "value",
        "domain",
        F.when(~ok, "invalid").when(F.col("known").isNotNull(), "valid").otherwise("warning").alias("status"),
        F.when(~ok, 0.0).when(F.col("known").isNotNull(), 0.8).otherwise(0.3).alias("confidence"),
    )


def check_phones(records: DataFrame, area_codes: DataFrame) -> DataFrame:
    """provider_id, value, status, confidence of the primary phone number.

    Area codes are three digits of which the first is 2 to 9, 800 at most, so the table is broadcast.
    """
    phone = text.normalize_phone("phone_primary")
    asked = records.select("provider_id", phone.alias("phone")).withColumn(
        "area", F.when(F.col("phone").startswith("+1"), F.substring("phone", 3, 3))
    )
    codes = area_codes.where(F.col("area").rlike("^[2-9][0-9]{2}$"))
    areas = codes.groupBy("area").agg(F.max("carrier").alias("carrier"), F.max("region").alias("region"))
    found = asked.join(F.broadcast(areas), "area", "left")
    return found.withColumn("check", scores.check_phone("phone", "carrier", "region")).select("provider_id", "check.*")


# -- union of all checks -----------------------------------------------------------------


def with_references(
    records: DataFrame, registry: DataFrame, geocodes: DataFrame, licenses: DataFrame, unique_references: bool = False, **skew
) -> DataFrame:
    """Records with ``geocode``, ``registry`` and ``license`` beside them.

    The hot keys of all three are found in one pass over the records, before any join; with
    none, each look-up is one exchange of the records and one of its reference.
    """
    keys = {"geocode": geocode_key()}
    if not unique_references:
        keys |= {"registry": registry_key(), "license": license_pair()}
    hot = hot_values(records, keys, "provider_id", **skew)
    found = with_geocode(records, geocodes, hot=hot["geocode"])
    found = with_registry(found, registry, unique_references, hot=hot.get("registry"))
    return with_license(found, licenses, unique_references, hot=hot.get("license"))


def answer_records(
    records: DataFrame,
    registry: DataFrame,
    geocodes: DataFrame,
    licenses: DataFrame,
    enrichment: DataFrame,
    extracted: DataFrame,
    unique_references: bool = False,
) -> DataFrame:
    """Records with ``answers``, and the matched reference rows beside them.

    ``unique_references`` states that registry and licenses are keyed tables; otherwise
    they are reduced to one row per key, as the geocode table always is.  The two joins by
    record id come last and share one exchange, which is also that of any step after.
    The document check is left out for records without a document, as such a task is never
    created.
    """
    found = with_references(records, registry, geocodes, licenses, unique_references)
    found = with_documents(with_enrichment(found, enrichment), extracted)
    document = F.when(text.is_present("document_path"), document_answer())
    answers = F.array_compact(
        F.array(registry_answer(), address_answer(), document, license_answer(), enrichment_answer())
    )
    return found.withColumn("answers", answers)


def run_checks(*tables: DataFrame, **options) -> DataFrame:
    """Source results of all five checks, one row per record and check: :func:`answer_records` in long form.

    The records are read once, whatever the number of checks.
    """
    return answer_records(*tables, **options).select("provider_id", F.inline("answers"))


def registry_search(
    registry: DataFrame,
    given_name: str | None = None,
    family_name: str | None = None,
    state: str | None = None,
    city: str | None = None,
    taxonomy: str | None = None,
    limit: int = 50,
) -> DataFrame:
    """Registry entries by any criteria, ignoring case; the first ``limit`` by number."""
    asked = {
        "given_name": given_name,
        "family_name": family_name,
        "address_state": state,
        "address_city": city,
        "primary_taxonomy": taxonomy,
    }
    tests = [F.lower(F.col(c)) == v.lower() for c, v in asked.items() if v]
    return registry.where(text.all_of(tests)).orderBy("npi_number").limit(limit)


def registry_candidates(records: DataFrame, registry: DataFrame, keys: list[str], limit: int = 50) -> DataFrame:
    """For every distinct combination of ``keys`` in records, its first registry entries.

    The registry is cut to those combinations first, then ranked; the ranking is limited
    before the shuffle.
    """
    from pyspark.sql import Window

    asked = records.select(*keys).distinct()
    per_key = Window.partitionBy(*keys).orderBy("npi_number")
    met = registry.join(asked, keys, "left_semi")
    return met.withColumn("rank", F.row_number().over(per_key)).where(F.col("rank") <= limit)


def license_search(licenses: DataFrame, top: int = 3) -> DataFrame:
    """The first licenses of every state."""
    from pyspark.sql import Window

    per_state = Window.partitionBy("license_state").orderBy("license_number")
    return licenses.withColumn("rank", F.row_number().over(per_state)).where(F.col("rank") <= top)


def disciplinary_actions(licenses: DataFrame, actions: DataFrame) -> DataFrame:
    """Board actions of known licenses, with their type."""
    acts = actions.withColumn("action_type", scores.action_type("description"))
    return licenses.select("license_number", "license_state", "holder_name").join(
        acts, ["license_number", "license_state"]
    )
