"""Queries: scalar rules, filters and paging over the record tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import constants as K
from ...functions import guard, scores, text
from ...operators import filters
from ...sources import files, payloads, sinks
from ...sources.derived import AS_OF
from .registry import joined_list, query, r6, ts

EMAIL = K.EMAIL_PATTERN


def weights_case(column: str, weights: dict[str, float], default: float) -> str:
    hits = " ".join(f"WHEN '{k}' THEN {float(v)}e0" for k, v in weights.items())
    return f"(CASE {column} {hits} ELSE {float(default)}e0 END)"


def r6_sql(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE) + 1e-9, 6)"


def ts_sql(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def status_sql(expr: str) -> str:
    return f"(CASE WHEN round({expr}, 9) >= 0.8e0 THEN 'valid' WHEN round({expr}, 9) >= 0.6e0 THEN 'warning' ELSE 'invalid' END)"


def luhn_sql(digits: str) -> str:
    """Luhn test of a ten-digit text by digit arithmetic."""
    terms = []
    for place in range(1, 11):
        d = f"CAST(substr({digits}, {place}, 1) AS INT)"
        terms.append(f"(2 * {d} - CASE WHEN {d} >= 5 THEN 9 ELSE 0 END)" if place % 2 else d)
    return f"(({' + '.join(terms)}) % 10 = 0)"


KEPT = "regexp_replace(phone_primary, '[^0-9+]', '', 'g')"
PHONE = f"""CASE WHEN starts_with({KEPT}, '+1') THEN {KEPT}
     WHEN starts_with({KEPT}, '1') AND length({KEPT}) = 11 THEN concat('+', {KEPT})
     WHEN length({KEPT}) = 10 THEN concat('+1', {KEPT}) ELSE {KEPT} END"""


def shape_sql(c: str) -> str:
    kept = f"regexp_replace({c}, '[^0-9+]', '', 'g')"
    return f"""((starts_with({kept}, '+1') AND length({kept}) = 12)
  OR (starts_with({kept}, '1') AND length({kept}) = 11) OR length({kept}) = 10)"""


@query(
    "normalised_fields", "F2 F3 F4 F6 F7 F8", "directory",
    f"""SELECT provider_id, regexp_replace(npi_number, '[^0-9]', '', 'g') AS npi_digits,
  {PHONE} AS phone, {shape_sql('phone_primary')} AS phone_ok, lower(email) AS email_lower,
  regexp_matches(email, '{EMAIL}') AS email_ok,
  trim(regexp_replace(concat('  ', address_street, '  '), '\\s+', ' ', 'g')) AS street,
  regexp_replace(concat(address_zip, ' US'), '[^0-9-]', '', 'g') AS zip,
  regexp_matches(address_zip, '^[0-9]{{5}}(-[0-9]{{4}})?$') AS zip_ok,
  regexp_matches(license_number, '^[A-Za-z0-9-]+$') AS license_ok
FROM directory""",
)
def _(t):
    return t.directory.select(
        "provider_id",
        text.digits_only("npi_number").alias("npi_digits"),
        text.normalize_phone("phone_primary").alias("phone"),
        text.phone_shape_ok("phone_primary").alias("phone_ok"),
        F.lower("email").alias("email_lower"),
        text.email_ok("email").alias("email_ok"),
        text.collapse_spaces(F.concat(F.lit("  "), "address_street", F.lit("  "))).alias("street"),
        text.clean_zip(F.concat("address_zip", F.lit(" US"))).alias("zip"),
        text.zip_ok("address_zip").alias("zip_ok"),
        text.license_ok("license_number").alias("license_ok"),
    )


@query(
    "npi_check_digit", "F1", "directory",
    f"""SELECT provider_id, npi_number,
  CASE WHEN length(d) = 10 THEN {luhn_sql('d')} ELSE false END AS npi_ok
FROM (SELECT provider_id, npi_number, regexp_replace(npi_number, '[^0-9]', '', 'g') AS d FROM directory) x""",
)
def _(t):
    return t.directory.select("provider_id", "npi_number", text.npi_valid("npi_number").alias("npi_ok"))


CANONICAL = f"""SELECT provider_id, given_name, family_name,
  nullif(regexp_replace(npi_number, '[^0-9]', '', 'g'), '') AS npi_number, {PHONE} AS phone_primary,
  lower(email) AS email, nullif(license_number, '') AS license_number, address_zip FROM directory"""

ERRORS = f"""concat_ws('; ',
  CASE WHEN coalesce(given_name, '') = '' THEN 'Missing required field: given_name' END,
  CASE WHEN coalesce(family_name, '') = '' THEN 'Missing required field: family_name' END,
  CASE WHEN npi_number <> '' AND NOT regexp_matches(npi_number, '^[0-9]{{10}}$') THEN concat('Invalid format for npi_number: ', npi_number) END,
  CASE WHEN phone_primary <> '' AND NOT regexp_matches(phone_primary, '^\\+?[0-9\\s\\-\\(\\)\\.]+$') THEN concat('Invalid format for phone_primary: ', phone_primary) END,
  CASE WHEN email <> '' AND NOT regexp_matches(email, '{EMAIL}') THEN concat('Invalid format for email: ', email) END,
  CASE WHEN license_number <> '' AND NOT regexp_matches(license_number, '^[A-Za-z0-9\\-]+$') THEN concat('Invalid format for license_number: ', license_number) END,
  CASE WHEN address_zip <> '' AND NOT regexp_matches(address_zip, '^[0-9]{{5}}(-[0-9]{{4}})?$') THEN concat('Invalid format for address_zip: ', address_zip) END,
  CASE WHEN npi_number <> '' AND NOT regexp_matches(npi_number, '^[0-9]{{10}}$') THEN concat('Invalid NPI number format: ', npi_number) END,
  CASE WHEN phone_primary <> '' AND NOT {shape_sql('phone_primary')} THEN concat('Invalid phone number format: ', phone_primary) END,
  CASE WHEN email <> '' AND NOT regexp_matches(email, '{EMAIL}') THEN concat('Invalid email format: ', email) END)"""

CSV_FIELDS = ["provider_id", "given_name", "family_name", "npi_number", "phone_primary", "email",
              "license_number", "address_zip"]


@query(
    "row_errors", "F9 S1 S3", "directory",
    f"SELECT provider_id, {ERRORS} AS errors FROM ({CANONICAL}) c",
)
def _(t):
    checked = files.canonical_rows(t.directory.select(*CSV_FIELDS), {f: f for f in CSV_FIELDS})
    return checked.rows.select("provider_id", joined_list("errors").alias("errors"))


@query(
    "ingest_summary", "A47 S1", "directory",
    f"""SELECT CAST(count(*) AS BIGINT) AS rows_read,
  CAST(sum(CASE WHEN errors = '' THEN 1 ELSE 0 END) AS BIGINT) AS valid_rows,
  CAST(sum(CASE WHEN errors <> '' THEN 1 ELSE 0 END) AS BIGINT) AS rejected_rows,
  CAST(sum(CASE WHEN errors = '' THEN 0 ELSE len(string_split(errors, '; ')) END) AS BIGINT) AS error_count,
  concat_ws('; ', CASE WHEN count(*) FILTER (errors = '') = 0 THEN 'No valid provider records found in CSV' END,
    CASE WHEN count(*) FILTER (errors = '') < count(*) THEN concat('Only ', count(*) FILTER (errors = ''), ' out of ', count(*), ' rows were processed successfully') END) AS warnings
FROM (SELECT {ERRORS} AS errors FROM ({CANONICAL}) c) e""",
)
def _(t):
    from ...operators.metrics import ingest_summary

    checked = files.canonical_rows(t.directory.select(*CSV_FIELDS), {f: f for f in CSV_FIELDS})
    return ingest_summary(checked.rows).withColumn("warnings", joined_list("warnings"))


@query(
    "ingest_errors", "A47 S1", "directory",
    f"""SELECT provider_id, unnest(string_split(errors, '; ')) AS error FROM (SELECT provider_id, {ERRORS} AS errors FROM ({CANONICAL}) c) e
WHERE errors <> ''""",
)
def _(t):
    from ...operators.metrics import ingest_errors

    return ingest_errors(files.canonical_rows(t.directory.select(*CSV_FIELDS), {f: f for f in CSV_FIELDS}).rows)


@query(
    "batch_rows", "S5 S7", "directory",
    """SELECT provider_id, given_name, license_number, document_path FROM (
  SELECT provider_id, CASE WHEN k % 2 = 0 THEN '' ELSE given_name END AS given_name,
         CASE WHEN k % 3 = 0 THEN '' ELSE license_number END AS license_number,
         document_path FROM directory) x
WHERE coalesce(given_name, '') <> '' OR coalesce(license_number, '') <> '' OR coalesce(document_path, '') <> ''""",
)
def _(t):
    raw = t.directory.select(
        "provider_id",
        F.when(F.col("k") % 2 == 0, "").otherwise(F.col("given_name")).alias("given_name"),
        F.when(F.col("k") % 3 == 0, "").otherwise(F.col("license_number")).alias("license_number"),
        "document_path",
    )
    return files.batch_rows(raw).select("provider_id", "given_name", "license_number", "document_path")


@query(
    "address_scores", "F11 F12 F13 F14 U3", "geocodes",
    f"""SELECT place_id, formatted_address,
  {r6_sql(weights_case('location_type', K.GEOMETRY_CONFIDENCE, 0.5))} AS geometry,
  {r6_sql('''least(1.0e0, 0.5e0
    + CASE WHEN place_type = 'street_address' THEN 0.3e0 WHEN place_type = 'route' THEN 0.2e0 ELSE 0e0 END
    + 0.2e0 * len(list_intersect(list_distinct(string_split(lower(asked), ' ')), list_distinct(string_split(lower(formatted_address), ' '))))
      / len(list_distinct(string_split(lower(asked), ' '))))''')} AS match,
  place_type IN ('street_address', 'route') AS type_ok, asked,
  street <> '' AND city <> '' AND state <> '' AND zip <> '' AS complete
FROM (SELECT *, concat_ws(', ', street, nullif(city, 'Austin'), state) AS asked FROM geocodes) g""",
)
def _(t):
    types = F.array("place_type")
    asked = text.joined("street", F.nullif("city", F.lit("Austin")), "state")
    return t.geocodes.withColumn("asked", asked).select(
        "place_id",
        "formatted_address",
        r6(scores.geometry_confidence("location_type")).alias("geometry"),
        r6(scores.address_match_confidence(types, "formatted_address", "asked")).alias("match"),
        scores.address_type_ok(types).alias("type_ok"),
        "asked",
        scores.address_presence_check("street", "city", "state", "zip")["valid"].alias("complete"),
    )


STATUS_WORDS = " ".join(
    f"WHEN regexp_matches(s, '\\b({'|'.join(words)})\\b') THEN '{label}'" for label, words in K.LICENSE_STATUS_WORDS
)
STATUS_PARTS = " ".join(
    f"WHEN regexp_matches(s, '({'|'.join(words)})') THEN '{label}'" for label, words in K.LICENSE_STATUS_WORDS
)


@query(
    "license_texts", "F15 F16 F18", "licenses",
    f"""SELECT license_number, license_state, status, compat_status, issued,
  {r6_sql('''greatest(0e0, least(1e0, 0.3e0 + CASE WHEN holder_name <> 'Unknown' THEN 0.2e0 ELSE 0e0 END
    + CASE WHEN s <> '' THEN 0.2e0 ELSE -0.1e0 END
    + CASE WHEN status = 'active' THEN 0.2e0 WHEN status IN ('suspended', 'revoked') THEN 0.1e0 ELSE 0e0 END))''')} AS confidence
FROM (SELECT *, CASE WHEN s = '' THEN 'inactive' {STATUS_WORDS} ELSE 'inactive' END AS status,
    CASE WHEN s = '' THEN 'inactive' {STATUS_PARTS} ELSE 'inactive' END AS compat_status
  FROM (SELECT license_number, license_state, holder_name,
      CASE license_status WHEN 'pending' THEN '' WHEN 'expired' THEN 'status: inactive'
           ELSE concat('status: ', license_status) END AS s,
      strftime(issue_date, '%Y-%m-%d') AS issued FROM licenses) a) b""",
)
def _(t):
    said = (
        F.when(F.col("license_status") == "pending", "")
        .when(F.col("license_status") == "expired", "Status: Inactive")
        .otherwise(F.concat(F.lit("Status: "), F.initcap("license_status")))
    )
    issued = F.concat(F.lit("issued on "), F.date_format("issue_date", "yyyy-MM-dd"), F.lit(" by the board"))
    return (
        t.licenses.withColumn("said", said)
        .withColumn("status", scores.license_status_of("said"))
        .select(
            "license_number",
            "license_state",
            "status",
            scores.license_status_of("said", compat=True).alias("compat_status"),
            scores.first_date(issued).alias("issued"),
            r6(scores.license_confidence("holder_name", "status", "said")).alias("confidence"),
        )
    )


def trust_sql(source: str, mode: str, table: str, key: str, email: str | None = None, own: tuple[str, str] | None = None) -> str:
    fixed = ", ".join(f"('{f}', {v}e0)" for f, v in K.TRUST_SCORES[source, mode].items() if not (email and f == "email"))
    rows = [f"SELECT {key} AS id, f AS field_name, CAST(s AS DOUBLE) AS score FROM {table}, (VALUES {fixed}) v(f, s)"]
    if email:
        rows.append(f"SELECT {key}, 'email', CASE WHEN coalesce({email}, '') <> '' THEN 0.6e0 ELSE 0e0 END FROM {table}")
    if own:
        rows.append(f"SELECT {key}, '{own[0]}', {own[1]} FROM {table}")
    return f"SELECT '{source}' AS source, '{mode}' AS mode, * FROM ({' UNION ALL '.join(rows)}) x"


TRUSTED = [
    trust_sql("npi_registry", "npi_search", "directory", "provider_id", "email"),
    trust_sql("npi_registry", "name_search", "registry", "npi_number"),
    trust_sql("google_places", "geocoding", "geocodes g", "formatted_address", own=("match_confidence", weights_case("g.location_type", K.GEOMETRY_CONFIDENCE, 0.5))),
    trust_sql("state_board", "verification", "licenses", "license_number", own=("confidence_score", "CASE WHEN license_status = 'active' THEN 0.9e0 ELSE 0.6e0 END")),
]


@query(
    "trust_scores", "F19", "directory registry geocodes licenses",
    f"SELECT *, CASE WHEN score > 0.8e0 THEN 'high' ELSE 'medium' END AS level FROM ({' UNION ALL '.join(TRUSTED)}) z",
)
def _(t):
    """All four tables of trust: records by number with their own e-mail, by name, places and licenses with a score of their own."""
    shape = F.when(F.col("license_status") == "active", 0.9).otherwise(0.6)
    known = {
        ("npi_registry", "npi_search"): t.directory.select("provider_id", "email"),
        ("npi_registry", "name_search"): t.registry.select("npi_number"),
        ("google_places", "geocoding"): t.geocodes.select("formatted_address", scores.geometry_confidence("location_type").alias("match_confidence")),
        ("state_board", "verification"): t.licenses.select("license_number", shape.alias("confidence_score")),
    }
    rows = None
    for (source, mode), df in known.items():
        row = payloads.trust_scores(df, source, mode)
        row = row.select(F.lit(source).alias("source"), F.lit(mode).alias("mode"), F.col(df.columns[0]).alias("id"), "field_name", "score", "level")
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query(
    "source_reliability", "F20", "field_results",
    f"""SELECT source, level, CAST(count(*) AS BIGINT) AS n FROM (SELECT source,
  CASE source {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in K.SOURCE_RELIABILITY.items())} ELSE 'unknown' END AS level
  FROM field_results) x GROUP BY source, level""",
)
def _(t):
    return (
        t.field_results.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        .select("source", scores.source_reliability("source").alias("level"), "n")
    )


@query(
    "content_keys", "F34", "directory",
    """SELECT provider_id, concat('validation_', md5(concat('{"given_name":"', given_name, '","license_number":"', license_number,
  '","npi_number":"', npi_number, '"}'))) AS request_key FROM directory""",
)
def _(t):
    return t.directory.select(
        "provider_id", guard.content_key(["npi_number", "given_name", "license_number"]).alias("request_key")
    )


@query(
    "duration_estimates", "F35", "jobs",
    """SELECT job_no, CASE WHEN s < 60 THEN concat(CAST(s AS STRING), ' seconds')
  WHEN s < 3600 THEN concat(CAST(s // 60 AS STRING), ' minutes')
  ELSE concat(CAST(s // 3600 AS STRING), 'h ', CAST((s % 3600) // 60 AS STRING), 'm') END AS estimate
FROM (SELECT job_no, (job_no % 150) * (30 + CASE WHEN validate_npi THEN 20 ELSE 0 END
        + CASE WHEN validate_license THEN 10 ELSE 0 END) AS s FROM jobs) x""",
)
def _(t):
    return t.jobs.select(
        "job_no",
        scores.estimate_duration(
            F.col("job_no") % 150, documents=F.col("validate_npi"), licenses=F.col("validate_license")
        ).alias("estimate"),
    )


@query(
    "retry_delays", "F36", "jobs",
    """SELECT job_no, CAST(least(1e0 * pow(2e0, retry_count * 3), 60e0) AS DOUBLE) AS delay,
  CAST(least(2e0 * (retry_count + 1), 5e0) AS DOUBLE) AS linear_delay FROM jobs""",
)
def _(t):
    return t.jobs.select(
        "job_no",
        scores.backoff_delay(F.col("retry_count") * 3, 1.0, 60.0).alias("delay"),
        scores.backoff_delay("retry_count", 2.0, 5.0, exponential=False).alias("linear_delay"),
    )


# -- filters ------------------------------------------------------------------------


@query(
    "search_records", "P1", "directory",
    """SELECT provider_id, given_name, family_name FROM directory
WHERE contains(lower(given_name), 'ar') OR contains(lower(family_name), 'ar') OR contains(lower(npi_number), 'ar')
   OR contains(lower(primary_taxonomy), 'ar') OR contains(lower(practice_name), 'ar')""",
)
def _(t):
    return filters.search(t.directory, "AR").select("provider_id", "given_name", "family_name")


@query(
    "records_by_status_and_range", "P2 P3 P4", "directory",
    """SELECT provider_id, overall_confidence, license_status FROM directory
WHERE validation_status = 'warning' AND overall_confidence BETWEEN 0.65e0 AND 0.75e0
  AND license_status IN ('active', 'expired')""",
)
def _(t):
    kept = filters.equals(t.directory, "validation_status", "warning")
    kept = filters.between(kept, "overall_confidence", 0.65, 0.75)
    kept = filters.in_list(kept, "license_status", ["active", "expired"])
    return kept.select("provider_id", "overall_confidence", "license_status")


@query(
    "records_with_any_flag", "P5", "directory",
    """SELECT provider_id, array_to_string(list_sort(flag_codes), ',') AS codes FROM directory
WHERE len(list_intersect(flag_codes, ['EXPIRED_LICENSE', 'POTENTIAL_DUPLICATE'])) > 0""",
)
def _(t):
    kept = filters.any_flag(t.directory, ["EXPIRED_LICENSE", "POTENTIAL_DUPLICATE"])
    return kept.select("provider_id", joined_list(F.array_sort("flag_codes"), ",").alias("codes"))


@query(
    "records_with_any_source", "P6", "field_results",
    """SELECT provider_id, CAST(count(DISTINCT source) AS BIGINT) AS sources FROM field_results
WHERE provider_id IN (SELECT provider_id FROM field_results WHERE source IN ('state_board')) GROUP BY provider_id""",
)
def _(t):
    per_record = (
        t.field_results.groupBy("provider_id")
        .agg(F.collect_set(F.struct("source")).alias("sources"))
    )
    return filters.any_source(per_record, ["state_board"]).select(
        "provider_id", F.size("sources").cast("bigint").alias("sources")
    )


@query(
    "filtered_search", "P7 P9", "directory",
    """SELECT provider_id, address_state, overall_confidence FROM directory
WHERE family_name = 'Baker' AND license_status = 'active' AND overall_confidence >= 0.5e0
  AND last_validated_at >= TIMESTAMP '2024-02-01 00:00:00'""",
)
def _(t):
    return filters.search_filters(
        t.directory, family_name="Baker", license_status="active", min_confidence=0.5,
        validated_since="2024-02-01 00:00:00",
    ).select("provider_id", "address_state", "overall_confidence")


@query(
    "point_lookup", "P8", "directory",
    "SELECT provider_id, given_name, npi_number FROM directory WHERE provider_id IN ('P3', 'P77', 'P149')",
)
def _(t):
    return filters.lookup_by(t.directory, "provider_id", "P3", "P77", "P149").select(
        "provider_id", "given_name", "npi_number"
    )


@query(
    "timeline", "P11", "field_results",
    f"""SELECT job_no, line_no, status, source, {ts_sql('validated_at')} AS validated_at FROM field_results
WHERE status = 'warning' AND source = 'npi' AND validated_at >= TIMESTAMP '1997-01-01 00:00:00'
  AND validated_at <= TIMESTAMP '1998-12-31 00:00:00'""",
)
def _(t):
    kept = filters.timeline_filter(
        t.field_results, "warning", "npi", "1997-01-01 00:00:00", "1998-12-31 00:00:00"
    )
    return kept.select("job_no", "line_no", "status", "source", ts("validated_at").alias("validated_at"))


@query(
    "display_names", "P12", "directory",
    """SELECT provider_id, trim(concat_ws(' ', given_name, family_name)) AS full_name,
  concat_ws(', ', address_street, CASE WHEN k % 3 = 0 THEN NULL ELSE address_city END, address_state,
            address_zip) AS full_address FROM directory""",
)
def _(t):
    holes = t.directory.withColumn(
        "address_city", F.when(F.col("k") % 3 == 0, "").otherwise(F.col("address_city"))
    )
    return filters.with_display_names(holes).select("provider_id", "full_name", "full_address")


@query(
    "constraint_violations", "P13", "directory",
    """SELECT provider_id, concat_ws(',',
  CASE WHEN NOT regexp_matches(npi_number, '^[0-9]{10}$') THEN 'npi_number_format' END,
  CASE WHEN NOT regexp_matches(s, '^[A-Z]{2}$') THEN 'address_state_format' END,
  CASE WHEN c < 0 OR c > 1 THEN 'overall_confidence_range' END,
  CASE WHEN length(phone_primary) > 20 THEN 'phone_primary_too_long' END) AS violations
FROM (SELECT *, CASE WHEN k % 19 = 0 THEN lower(address_state) ELSE address_state END AS s,
             CASE WHEN k % 21 = 0 THEN overall_confidence + 1 ELSE overall_confidence END AS c FROM directory) d""",
)
def _(t):
    spoiled = t.directory.withColumns(
        {
            "address_state": F.when(F.col("k") % 19 == 0, F.lower("address_state")).otherwise(F.col("address_state")),
            "overall_confidence": F.when(F.col("k") % 21 == 0, F.col("overall_confidence") + 1).otherwise(
                F.col("overall_confidence")
            ),
        }
    )
    return filters.check_constraints(spoiled).select("provider_id", joined_list("violations", ",").alias("violations"))


# -- pages and orders -----------------------------------------------------------------


@query(
    "record_page", "L1 L2", "directory",
    f"""SELECT provider_id, {ts_sql('created_at')} AS created_at FROM directory
ORDER BY created_at DESC, provider_id LIMIT 20 OFFSET 40""",
)
def _(t):
    return filters.page(t.directory, 3, 20, "created_at", "provider_id").select(
        "provider_id", ts("created_at").alias("created_at")
    )


@query(
    "record_page_after", "L1", "directory",
    f"""SELECT provider_id, {ts_sql('created_at')} AS created_at FROM directory
WHERE created_at < TIMESTAMP '2020-01-01 00:00:00'
   OR (created_at = TIMESTAMP '2020-01-01 00:00:00' AND provider_id > 'P5')
ORDER BY created_at DESC, provider_id LIMIT 20""",
)
def _(t):
    start = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    return filters.page_after(t.directory, "created_at", "provider_id", start, "P5", 20).select(
        "provider_id", ts("created_at").alias("created_at")
    )


@query(
    "page_totals", "L1", "jobs",
    "SELECT CAST(count(*) AS BIGINT) AS total, CAST((count(*) + 19) // 20 AS BIGINT) AS pages FROM jobs WHERE status = 'failed'",
)
def _(t):
    return filters.page_totals(filters.equals(t.jobs, "status", "failed"), 20)


@query(
    "recently_validated", "L3", "directory",
    f"""SELECT provider_id, {ts_sql('last_validated_at')} AS validated_at FROM directory
WHERE last_validated_at IS NOT NULL ORDER BY last_validated_at DESC, provider_id LIMIT 10""",
)
def _(t):
    return filters.recent(t.directory, "last_validated_at", "provider_id").select(
        "provider_id", ts("last_validated_at").alias("validated_at")
    )


# -- payloads and exports --------------------------------------------------------------


@query(
    "registry_payloads", "S13", "registry",
    """SELECT npi_number, given_name, family_name, 'tx0' AS primary_taxonomy, address_street, address_city,
  phone_primary, '' AS email, enumeration_type, concat_ws('|', primary_taxonomy, 'Other') AS all_taxonomies,
  CAST(2 AS BIGINT) AS addresses FROM registry""",
)
def _(t):
    address = F.struct(
        F.col("address_street").alias("address_1"), F.col("address_city").alias("city"),
        F.col("address_state").alias("state"), F.col("address_zip").alias("postal_code"),
        F.col("phone_primary").alias("telephone_number"),
    )
    body = F.to_json(
        F.struct(
            F.col("npi_number").alias("number"),
            "enumeration_type",
            F.struct(F.col("given_name").alias("first_name"), F.col("family_name").alias("last_name")).alias("basic"),
            F.array(address, address).alias("addresses"),
            F.array(
                F.struct(F.lit("tx0").alias("code"), F.col("primary_taxonomy").alias("desc")),
                F.struct(F.lit("tx1").alias("code"), F.lit("Other").alias("desc")),
            ).alias("taxonomies"),
        )
    )
    return payloads.flatten_registry(t.registry.select(body.alias("payload"))).select(
        "npi_number", "given_name", "family_name", "primary_taxonomy", "address_street", "address_city",
        "phone_primary", "email", "metadata.enumeration_type",
        joined_list("metadata.all_taxonomies", "|").alias("all_taxonomies"),
        F.col("metadata.all_addresses").cast("bigint").alias("addresses"),
    )


@query(
    "geocode_payloads", "S14 F11", "geocodes",
    f"""SELECT coalesce(place_id, '') AS place_id, formatted_address, {r6_sql('latitude')} AS latitude, street AS address_street,
  city AS address_city, state AS address_state, zip AS address_zip, 'US' AS country,
  {r6_sql(weights_case('location_type', K.GEOMETRY_CONFIDENCE, 0.5))} AS match_confidence FROM geocodes""",
)
def _(t):
    return payloads.flatten_geocode(place_bodies(t)).select(
        F.coalesce("place_id", F.lit("")).alias("place_id"), "formatted_address", r6("latitude").alias("latitude"),
        "address_street", "address_city", "address_state", "address_zip", "country",
        r6("match_confidence").alias("match_confidence"),
    )


def place_bodies(t):
    """The geocodes as the JSON answers they come from."""
    def part(long, short, kind):
        return F.struct(long.alias("long_name"), short.alias("short_name"), F.array(F.lit(kind)).alias("types"))

    number, route = F.split_part("street", F.lit(" "), F.lit(1)), F.regexp_replace("street", "^[0-9]+ ", "")
    parts = F.array(
        part(number, number, "street_number"), part(route, route, "route"),
        part(F.col("city"), F.col("city"), "locality"),
        part(F.lit("State name"), F.col("state"), "administrative_area_level_1"),
        part(F.lit("United States"), F.lit("US"), "country"), part(F.col("zip"), F.col("zip"), "postal_code"),
    )
    body = F.to_json(
        F.struct(
            "place_id", "formatted_address",
            F.struct(
                F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lng")).alias("location"),
                "location_type",
            ).alias("geometry"),
            parts.alias("address_components"),
            F.concat("city", F.lit(" office")).alias("name"),
            F.array(F.lower("location_type"), F.lit("premise")).alias("types"),
        )
    )
    return t.geocodes.select(body.alias("payload"))


@query(
    "place_details", "S15", "geocodes",
    """SELECT coalesce(place_id, '') AS place_id, concat(city, ' office') AS name, formatted_address, street AS address_street,
  concat_ws(',', lower(location_type), 'premise') AS types, coalesce(location_type, '') AS geometry_accuracy FROM geocodes""",
)
def _(t):
    return payloads.flatten_place_details(place_bodies(t)).select(
        F.coalesce("place_id", F.lit("")).alias("place_id"), "name", "formatted_address", "address_street",
        joined_list("types", ",").alias("types"), "geometry_accuracy",
    )


@query(
    "sanitised_headers", "F31", "directory",
    """SELECT provider_id, coalesce(trim(email), '') AS same, trim(given_name) AS own FROM directory""",
)
def _(t):
    from ...functions import guard

    longest = F.repeat(F.lit("k"), F.lit(100))  # two keys that are equal once they are cut
    sent = F.create_map(
        F.concat(longest, F.lit("1")), F.lit("first"), F.lit(" own "), F.concat(F.lit(" "), "given_name"),
        F.concat(longest, F.lit("2")), F.coalesce("email", F.lit("")),
    )
    return t.directory.select("provider_id", guard.sanitize_map(sent).alias("m")).select(
        "provider_id", F.col("m")[longest].alias("same"), F.col("m")["own"].alias("own")
    )


@query(
    "sanitised_payloads", "F31", "directory",
    """SELECT provider_id, to_json({'name': trim(given_name), 'k': k, 'contact': {'mail': trim(email), 'gone': NULL::VARCHAR},
  'tags': [trim(family_name), 'b'], 'extra': MAP {'city': [{'at': trim(address_city), 'n': k}], 'zip': [{'at': trim(address_zip), 'n': NULL}]}})::VARCHAR AS payload FROM directory""",
)
def _(t):
    """Strings at any depth of structs, arrays and maps, keys too."""
    from ...functions import guard

    messy = lambda c: F.concat(F.lit("\t "), F.col(c), F.lit("\x00 \n"))
    place = lambda c, n: F.array(F.struct(messy(c).alias("at"), n.alias("n")))
    none = F.lit(None)
    payload = F.struct(
        messy("given_name").alias("name"), F.col("k"),
        F.struct(messy("email").alias("mail"), none.cast("string").alias("gone")).alias("contact"),
        F.array(messy("family_name"), F.lit(" b")).alias("tags"),
        F.create_map(F.lit(" city"), place("address_city", F.col("k")), F.lit("zip\x00"), place("address_zip", none.cast("bigint"))).alias("extra"),
    )
    clean = guard.sanitize_nested(t.directory.select("provider_id", payload.alias("payload")), ["payload"])
    return clean.select("provider_id", F.to_json("payload", {"ignoreNullFields": "false"}).alias("payload"))


HELD = {
    "provider_id", "npi_number", "given_name", "family_name", "primary_taxonomy", "practice_name", "address_street", "address_city",
    "address_state", "address_zip", "phone_primary", "email", "license_number", "license_state", "license_status", "validation_status",
    "overall_confidence",
}


def export_sql(name: str) -> str:
    """An export column in SQL; what the directory does not hold is NULL."""
    source = sinks.EXPORT_SOURCES[name]
    value = "CAST(NULL AS STRING)"
    if source.endswith("_at"):
        value = f"strftime({source}, '%Y-%m-%dT%H:%M:%S')"
    elif source in HELD:
        value = f"CAST({source} AS STRING)"
    return f'{value} AS "{name}"'


@query(
    "export_rows", "S8", "directory",
    "SELECT " + ", ".join(export_sql(n) for n in sinks.EXPORT_COLUMNS) + " FROM directory WHERE validation_status = 'valid'",
)
def _(t):
    return sinks.export_rows(t.directory, "valid")


@query(
    "archive_files", "S11 R1", "directory",
    f"""SELECT provider_id, strftime(created_at, '%Y-%m-%d') AS archive_date FROM directory WHERE created_at < TIMESTAMP '{AS_OF}' - INTERVAL 2555 DAYS""",
)
def _(t):
    """The archive written twice, as a retry would, and read back."""
    from ...streaming.run import work_folder

    target = work_folder(t.spark, "archive")
    for _ in range(2):
        sinks.archive(t.directory, AS_OF, 2555, target)
    return t.spark.read.parquet(target).select("provider_id", F.date_format("archive_date", "yyyy-MM-dd").alias("archive_date"))


@query(
    "archived_rows", "S11 L5", "directory",
    f"""SELECT provider_id, strftime(created_at, '%Y-%m-%d') AS archive_date FROM directory
WHERE created_at < TIMESTAMP '{AS_OF}' - INTERVAL 2555 DAYS ORDER BY created_at, provider_id""",
)
def _(t):
    from ...operators.retention import expiring_first

    return expiring_first(t.directory, AS_OF, 2555, "created_at", "provider_id").select(
        "provider_id", F.date_format("created_at", "yyyy-MM-dd").alias("archive_date")
    )
