"""Queries: checks against reference tables, merging, scores and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import constants as K
from ...functions import scores, text
from ...operators import checks, edits, matching, merge, report, rules
from ...plans import validate
from ...sources import sinks
from ...sources.derived import AS_OF, KNOWN_DOMAINS
from .records import PHONE, luhn_sql, r6_sql, status_sql, weights_case
from .registry import joined_list, query, r6

SOURCES = "directory registry geocodes licenses enrichment document_fields"


def key_sql(c: str) -> str:
    return f"nullif(trim(regexp_replace(upper({c}), '[^A-Z0-9]+', ' ', 'g')), '')"


ADDRESS = "concat_ws(', ', nullif(d.address_street, ''), nullif(d.address_city, ''), nullif(d.address_state, ''), nullif(d.address_zip, ''))"
REG_JOIN = "directory d LEFT JOIN registry r ON regexp_replace(d.npi_number, '[^0-9]', '', 'g') = r.npi_number AND length(regexp_replace(d.npi_number, '[^0-9]', '', 'g')) = 10"
GEO_JOIN = f"directory d LEFT JOIN geocodes g ON {key_sql(ADDRESS)} = {key_sql('g.formatted_address')}"
LIC_JOIN = "directory d LEFT JOIN licenses l ON nullif(upper(trim(d.license_number)), '') = upper(trim(l.license_number)) AND upper(trim(d.license_state)) = upper(trim(l.license_state))"
GEO_SCORE = weights_case("g.location_type", K.GEOMETRY_CONFIDENCE, 0.5)


def tables(t):
    return t.wide(t.directory, "provider_id"), t.registry, t.geocodes, t.licenses, t.enrichment, t.document_fields


# -- the five checks, as rows ------------------------------------------------------------

REG_SQL = f"""SELECT d.provider_id, r.npi_number IS NOT NULL AS success,
  CASE WHEN r.npi_number IS NOT NULL THEN NULL WHEN coalesce(trim(d.npi_number), '') = '' THEN 'No NPI number provided'
       WHEN length(regexp_replace(d.npi_number, '[^0-9]', '', 'g')) <> 10 THEN 'Invalid NPI format. Must be 10 digits.'
       ELSE concat('NPI ', d.npi_number, ' not found in registry') END AS error_message,
  r.given_name, r.family_name, r.primary_taxonomy, r.practice_name, r.npi_number,
  r.registry_status, r.enumeration_type FROM {REG_JOIN}"""


@query("registry_check", "J1", "directory registry",
       f"SELECT provider_id, success, error_message, given_name, family_name, CASE WHEN success THEN 0.9e0 ELSE 0e0 END AS confidence FROM ({REG_SQL}) x")
def _(t):
    done = checks.check_registry(t.directory, t.registry)
    by = F.map_from_entries(F.transform("fields", lambda f: F.struct(f["field"], f["value"])))
    return done.select(
        "provider_id", "success", "error_message",
        F.try_element_at(by, F.lit("given_name")).alias("given_name"),
        F.try_element_at(by, F.lit("family_name")).alias("family_name"), "confidence",
    )


@query("registry_status", "J1b", "directory registry",
       """SELECT d.provider_id, error IS NULL AS valid, error FROM (SELECT d.provider_id,
  CASE WHEN r.npi_number IS NULL THEN 'No results returned from NPI registry'
       WHEN lower(r.enumeration_type) NOT IN ('npi-1', 'npi-2') THEN concat('Invalid enumeration type: ', lower(r.enumeration_type))
       WHEN lower(r.registry_status) <> 'a' THEN concat('NPI status is not active: ', lower(r.registry_status)) END AS error
  FROM """ + REG_JOIN + ") d")
def _(t):
    found = checks.with_registry(t.directory, t.registry)
    return found.withColumn("s", checks.registry_status()).select("provider_id", "s.valid", "s.error")


@query("registry_search", "J2", "registry",
       """SELECT npi_number, given_name, family_name FROM registry
WHERE lower(family_name) = 'carter' AND address_state = 'NC' ORDER BY npi_number LIMIT 50""")
def _(t):
    return checks.registry_search(t.registry, family_name="CARTER", state="nc").select(
        "npi_number", "given_name", "family_name"
    )


@query("registry_candidates", "J2 W8", "directory registry",
       """SELECT family_name, address_state, npi_number, CAST(rank AS BIGINT) AS rank FROM (
  SELECT family_name, address_state, npi_number,
         row_number() OVER (PARTITION BY family_name, address_state ORDER BY npi_number) AS rank FROM registry) r
WHERE rank <= 2 AND EXISTS (SELECT 1 FROM directory d WHERE d.family_name = r.family_name AND d.address_state = r.address_state)""")
def _(t):
    return checks.registry_candidates(t.directory, t.registry, ["family_name", "address_state"], 2).select(
        "family_name", "address_state", "npi_number", F.col("rank").cast("bigint").alias("rank")
    )


@query("address_check", "J3", "directory geocodes",
       f"""SELECT d.provider_id, g.formatted_address IS NOT NULL AND {GEO_SCORE} > 0.5e0 AS success,
  CASE WHEN g.formatted_address IS NOT NULL AND {GEO_SCORE} > 0.5e0 THEN NULL
       WHEN coalesce(d.address_street, '') = '' THEN 'No address provided'
       WHEN g.formatted_address IS NULL THEN 'Address not found' ELSE 'Address match confidence too low' END AS error_message,
  CASE WHEN g.formatted_address IS NOT NULL AND {GEO_SCORE} > 0.5e0 THEN g.place_id END AS place_id FROM {GEO_JOIN}""")
def _(t):
    done = checks.check_address(t.directory, t.geocodes)
    hit = F.filter("fields", lambda f: f["field"] == "place_id")
    return done.select(
        "provider_id", "success", "error_message", F.try_element_at(hit, F.lit(1))["value"].alias("place_id")
    )


HAVERSINE = """2 * 6371000e0 * asin(sqrt(least(1e0, pow(sin(radians(g.latitude - d.claimed_lat) / 2), 2)
  + cos(radians(d.claimed_lat)) * cos(radians(g.latitude)) * pow(sin(radians(g.longitude - d.claimed_lng) / 2), 2))))"""


@query("address_distance", "J3b F37", "directory geocodes",
       f"""SELECT provider_id, round(m, 3) AS distance_m,
  CASE WHEN missing THEN 'invalid' WHEN place_id IS NULL THEN 'warning' WHEN m <= 100 THEN 'valid' ELSE 'warning' END AS status,
  CASE WHEN missing THEN 0e0 WHEN place_id IS NULL THEN 0.6e0 WHEN m <= 100 THEN 0.9e0 ELSE 0.5e0 END AS confidence
FROM (SELECT d.provider_id, g.formatted_address IS NULL AS missing, g.place_id, {HAVERSINE} AS m FROM {GEO_JOIN}) x""")
def _(t):
    found = checks.with_geocode(t.directory, t.geocodes).withColumn("c", checks.address_place_check())
    return found.select(
        "provider_id", F.round("c.distance_m", 3).alias("distance_m"), "c.status", "c.confidence"
    )


@query("license_check", "J4 J4b", "directory licenses",
       f"""SELECT d.provider_id, l.license_number IS NOT NULL AS success,
  CASE WHEN l.license_number IS NOT NULL THEN NULL WHEN coalesce(trim(d.license_number), '') = '' THEN 'No license number provided'
       ELSE concat('License ', d.license_number, ' not found') END AS error_message,
  CASE WHEN l.license_number IS NULL THEN 'invalid' WHEN upper(l.license_status) = 'ACTIVE' THEN 'valid'
       WHEN upper(l.license_status) IN ('SUSPENDED', 'REVOKED') THEN 'invalid' ELSE 'warning' END AS status,
  CASE WHEN l.license_number IS NULL THEN 0e0 WHEN upper(l.license_status) = 'ACTIVE' THEN 0.95e0
       WHEN upper(l.license_status) IN ('SUSPENDED', 'REVOKED') THEN 0.1e0 ELSE 0.5e0 END AS rule_confidence FROM {LIC_JOIN}""")
def _(t):
    found = checks.with_license(t.directory, t.licenses)
    return found.withColumns({"a": checks.license_answer(), "s": checks.license_status_check()}).select(
        "provider_id", "a.success", "a.error_message", "s.status", F.col("s.confidence").alias("rule_confidence")
    )


@query("license_search", "J4c", "licenses",
       """SELECT license_state, license_number, CAST(rank AS BIGINT) AS rank FROM (SELECT license_state, license_number,
  row_number() OVER (PARTITION BY license_state ORDER BY license_number) AS rank FROM licenses) x WHERE rank <= 3""")
def _(t):
    return checks.license_search(t.licenses).select(
        "license_state", "license_number", F.col("rank").cast("bigint").alias("rank")
    )


ACTION_CASE = " ".join(
    f"WHEN regexp_matches(lower(description), '({'|'.join(words)})') THEN '{label}'" for label, words in K.ACTION_WORDS
)


@query("disciplinary_actions", "J4c F17", "licenses license_actions",
       f"""SELECT l.license_number, l.license_state, l.holder_name, a.description, CASE {ACTION_CASE} ELSE 'other' END AS action_type
FROM licenses l JOIN license_actions a ON l.license_number = a.license_number AND l.license_state = a.license_state""")
def _(t):
    return checks.disciplinary_actions(t.licenses, t.license_actions).select(
        "license_number", "license_state", "holder_name", "description", "action_type"
    )


@query("enrichment", "J5", "directory enrichment",
       """SELECT d.provider_id, d.phone_primary, e.affiliations, e.services_offered FROM directory d
LEFT JOIN enrichment e ON d.provider_id = e.provider_id""")
def _(t):
    by = F.map_from_entries(F.transform("fields", lambda f: F.struct(f["field"], f["value"])))
    done = checks.enrich(t.directory, t.enrichment).withColumn("by", by)
    return done.select(
        "provider_id",
        *[F.col("by")[n].alias(n) for n in ("phone_primary", "affiliations", "services_offered")],
    )


DOMAINS_SQL = ", ".join(f"'{d}'" for d in KNOWN_DOMAINS)


@query("email_domains", "J6", "directory",
       f"""SELECT provider_id, CASE WHEN NOT ok THEN 'invalid' WHEN known THEN 'valid' ELSE 'warning' END AS status,
  CASE WHEN NOT ok THEN 0e0 WHEN known THEN 0.8e0 ELSE 0.3e0 END AS confidence
FROM (SELECT provider_id, regexp_matches(email, '{K.EMAIL_PATTERN}') AS ok, split_part(email, '@', 2) IN ({DOMAINS_SQL}) AS known FROM directory) x""")
def _(t):
    domains = t.spark.createDataFrame([(d,) for d in KNOWN_DOMAINS], "domain string")
    return checks.check_email_domain(t.directory, domains).select("provider_id", "status", "confidence")


@query("phone_check", "F5", "directory area_codes",
       f"""SELECT provider_id, phone AS value, CASE WHEN NOT ok THEN 'invalid' WHEN score > 0.8e0 THEN 'valid' ELSE 'warning' END AS status,
  {r6_sql('CASE WHEN ok THEN score ELSE 0e0 END')} AS confidence
FROM (SELECT p.provider_id, phone, coalesce(regexp_matches(phone, '^\\+1[2-9][0-9]{{2}}[2-9][0-9]{{6}}$'), false) AS ok,
   least(1e0, 0.85e0 + CASE WHEN a.carrier IS NOT NULL THEN 0.1e0 ELSE 0e0 END + CASE WHEN a.region IS NOT NULL THEN 0.05e0 ELSE 0e0 END) AS score
  FROM (SELECT provider_id, {PHONE} AS phone FROM directory) p
  LEFT JOIN area_codes a ON starts_with(phone, '+1') AND substr(phone, 3, 3) = a.area) x""")
def _(t):
    return checks.check_phones(t.directory, t.area_codes).select(
        "provider_id", "value", "status", r6("confidence").alias("confidence")
    )


DOC_LAST = """SELECT provider_id, field_name, field_value, confidence FROM (SELECT *,
  row_number() OVER (PARTITION BY provider_id, field_name ORDER BY seq DESC) AS rn FROM document_fields) x WHERE rn = 1"""


@query("document_check", "J7", "directory document_fields",
       f"""SELECT d.provider_id, n IS NOT NULL AS success, CASE WHEN n IS NULL THEN 'OCR processing failed' END AS error_message,
  coalesce(phone, '') AS phone, {r6_sql('coalesce(c, 0e0)')} AS confidence
FROM (SELECT provider_id FROM directory WHERE document_path IS NOT NULL) d LEFT JOIN (
  SELECT provider_id, count(*) AS n, max(CASE WHEN field_name = 'phone' THEN field_value END) AS phone, avg(confidence) AS c
  FROM ({DOC_LAST}) l GROUP BY provider_id) a ON d.provider_id = a.provider_id""")
def _(t):
    done = checks.attach_document_fields(t.directory.where("document_path IS NOT NULL"), t.document_fields)
    hit = F.try_element_at(F.filter("fields", lambda f: f["field"] == "phone"), F.lit(1))["value"]
    return done.select(
        "provider_id", "success", "error_message", F.coalesce(hit, F.lit("")).alias("phone"),
        r6("confidence").alias("confidence"),
    )


@query("name_similarity", "J11 F10", "directory registry",
       f"""SELECT provider_id, {r6_sql('s')} AS confidence, CASE WHEN round(s, 9) >= 0.85e0 THEN 'valid' WHEN round(s, 9) >= 0.7e0 THEN 'warning' ELSE 'invalid' END AS status
FROM (SELECT d.provider_id, CASE WHEN r.npi_number IS NULL THEN 0e0 ELSE
  1 - levenshtein(lower(d.family_name), lower(r.family_name)) / CAST(greatest(length(d.family_name), length(r.family_name)) AS DOUBLE) END AS s FROM {REG_JOIN}) x""")
def _(t):
    found = checks.with_registry(t.directory, t.registry).withColumn("c", checks.registry_name_check())
    return found.select("provider_id", r6("c.confidence").alias("confidence"), "c.status")


# -- all results as one long table of fields ------------------------------------------------

REG_FIELDS = " UNION ALL ".join(
    f"SELECT provider_id, 'npi_check' AS source, '{f}' AS field, {f} AS value, {c}e0 AS conf FROM ({REG_SQL}) x WHERE success"
    for f, c in K.REGISTRY_CONFIDENCE.items()
)
GEO_OK = f"SELECT d.provider_id, g.* FROM {GEO_JOIN} WHERE g.formatted_address IS NOT NULL AND {GEO_SCORE} > 0.5e0"
GEO_VALUES = {"address_street": "formatted_address", "place_id": "place_id",
              "latitude": "printf('%.4f', latitude)", "longitude": "printf('%.4f', longitude)"}
GEO_FIELDS = " UNION ALL ".join(
    f"SELECT provider_id, 'google_places', '{f}', {GEO_VALUES[f]}, {c}e0 FROM ({GEO_OK}) x"
    for f, c in K.ADDRESS_CONFIDENCE.items()
)
LIC_OK = f"SELECT d.provider_id, l.* FROM {LIC_JOIN} WHERE l.license_number IS NOT NULL"
LIC_VALUES = {"license_number": "license_number", "license_state": "license_state", "license_status": "license_status",
              "issue_date": "strftime(issue_date, '%Y-%m-%d')", "expiry_date": "strftime(expiry_date, '%Y-%m-%d')"}
LIC_FIELDS = " UNION ALL ".join(
    f"SELECT provider_id, 'state_board_check', '{f}', {LIC_VALUES[f]}, {c}e0 FROM ({LIC_OK}) x"
    for f, c in K.LICENSE_CONFIDENCE.items()
)
EXTRA = "SELECT d.provider_id, d.phone_primary, d.email, e.affiliations, e.services_offered FROM directory d LEFT JOIN enrichment e ON d.provider_id = e.provider_id"
EXTRA_FIELDS = " UNION ALL ".join(
    f"SELECT provider_id, 'enrichment_lookup', '{f}', {f}, {c}e0 FROM ({EXTRA}) x" for f, c in K.ENRICHMENT_CONFIDENCE.items()
)
DOC_FIELDS = f"SELECT provider_id, 'ocr_processing', field_name, field_value, confidence FROM ({DOC_LAST}) x"
LONG = f"({REG_FIELDS} UNION ALL {GEO_FIELDS} UNION ALL {LIC_FIELDS} UNION ALL {EXTRA_FIELDS} UNION ALL {DOC_FIELDS})"
WEIGHT = weights_case("source", K.CHECK_WEIGHTS, 0.1)
RANK = weights_case("source", {s: float(5 - i) for i, s in enumerate(K.CHECK_ORDER)}, 0.0)
MERGED = f"""SELECT provider_id, field, value, source, weighted, conf FROM (SELECT *, row_number() OVER (
  PARTITION BY provider_id, field ORDER BY weighted DESC, rank DESC) AS rn
  FROM (SELECT *, round(conf * {WEIGHT}, 9) AS weighted, {RANK} AS rank FROM {LONG} l) a) b WHERE rn = 1"""
FIELD_WEIGHT = weights_case("field", K.MERGE_FIELD_WEIGHTS, 0.05)
OUTCOME = f"SELECT provider_id, sum(weighted * {FIELD_WEIGHT}) / sum({FIELD_WEIGHT}) AS c FROM ({MERGED}) m GROUP BY provider_id"

TASKS = f"""(SELECT provider_id, 'npi_check' AS source, success FROM ({REG_SQL}) x
UNION ALL SELECT d.provider_id, 'google_places', g.formatted_address IS NOT NULL AND {GEO_SCORE} > 0.5e0 FROM {GEO_JOIN}
UNION ALL SELECT d.provider_id, 'state_board_check', l.license_number IS NOT NULL FROM {LIC_JOIN}
UNION ALL SELECT provider_id, 'enrichment_lookup', true FROM directory
UNION ALL SELECT provider_id, 'ocr_processing', provider_id IN (SELECT provider_id FROM document_fields) FROM directory WHERE document_path IS NOT NULL)"""


@query("source_results", "U1 P21", SOURCES,
       f"SELECT provider_id, source, success FROM {TASKS} x")
def _(t):
    return checks.run_checks(*tables(t)).select("provider_id", "source", "success")


@query("merged_fields", "A4", SOURCES,
       f"SELECT provider_id, field AS field_name, value, source, {r6_sql('weighted')} AS confidence, {r6_sql('conf')} AS raw_confidence FROM ({MERGED}) m")
def _(t):
    merged = merge.merge_sources(checks.run_checks(*tables(t)))
    return merged.select(
        "provider_id", "field_name", "value", "source", r6("confidence").alias("confidence"),
        r6("raw_confidence").alias("raw_confidence"),
    )


@query("merged_confidence", "A5 A6", SOURCES,
       f"SELECT provider_id, {r6_sql('c')} AS overall_confidence, {status_sql('c')} AS validation_status FROM ({OUTCOME}) o")
def _(t):
    done = merge.merged_confidence(merge.merge_sources(checks.run_checks(*tables(t))))
    return done.select("provider_id", r6("overall_confidence").alias("overall_confidence"), "validation_status")


@query("normalised_confidence", "A4 A5 A6", SOURCES,
       f"""SELECT provider_id, {r6_sql('c')} AS overall_confidence, {status_sql('c')} AS validation_status FROM (
  SELECT provider_id, sum(conf * {FIELD_WEIGHT}) / sum({FIELD_WEIGHT}) AS c FROM ({MERGED}) m GROUP BY provider_id) o""")
def _(t):
    done = merge.merged_confidence(merge.merge_sources(checks.run_checks(*tables(t)), normalise=True))
    return done.select("provider_id", r6("overall_confidence").alias("overall_confidence"), "validation_status")


MISSING_CASES = ", ".join(
    f"CASE WHEN bool_or(field = '{f}') IS NOT TRUE THEN 'MISSING_{f.upper()}' END" for f in K.CRITICAL_MERGE_FIELDS
)


@query("merge_flags", "A7 U4", SOURCES,
       f"""SELECT d.provider_id, concat_ws('; ', CASE WHEN failed > 0 THEN concat('FAILED_VALIDATIONS: ', CAST(failed AS STRING)) END,
  low, missing) AS flags FROM directory d
LEFT JOIN (SELECT provider_id, sum(CASE WHEN success THEN 0 ELSE 1 END) AS failed FROM {TASKS} x GROUP BY provider_id) f ON d.provider_id = f.provider_id
LEFT JOIN (SELECT provider_id, string_agg(concat('LOW_CONFIDENCE_', upper(field)), '; ' ORDER BY field) AS low FROM {LONG} l WHERE conf < 0.5e0 GROUP BY provider_id) w ON d.provider_id = w.provider_id
LEFT JOIN (SELECT provider_id, nullif(concat_ws('; ', {MISSING_CASES}), '') AS missing FROM {LONG} l GROUP BY provider_id) m ON d.provider_id = m.provider_id""")
def _(t):
    gathered = merge.gather_answers(checks.run_checks(*tables(t)))
    return gathered.select("provider_id", joined_list(merge.merge_flags()).alias("flags"))


BEST_RAW = f"""SELECT provider_id, field, value, source, conf, n FROM (SELECT *, row_number() OVER (
  PARTITION BY provider_id, field ORDER BY conf DESC, {RANK} DESC) AS rn, count(*) OVER (PARTITION BY provider_id, field) AS n FROM {LONG} l) b WHERE rn = 1"""


@query("best_fields", "A8", SOURCES,
       f"SELECT provider_id, field AS field_name, {r6_sql('conf')} AS confidence, source, value, CAST(n AS BIGINT) AS validation_count FROM ({BEST_RAW}) b")
def _(t):
    best = merge.best_field_summary(checks.run_checks(*tables(t)))
    return best.withColumn("confidence", r6("confidence"))


@query("validation_outcomes", "F1 F3 J1 J3 J4 J5 J7 A4 A5 A6 A7 A22", SOURCES,
       f"""SELECT validation_status, CAST(count(*) AS BIGINT) AS records, {r6_sql('avg(c)')} AS avg_confidence,
  CAST(sum(npi_ok) AS BIGINT) AS npi_ok, CAST(sum(failed) AS BIGINT) AS failed_checks
FROM (SELECT d.provider_id, o.c, {status_sql('o.c')} AS validation_status, f.failed,
   CASE WHEN length(d.npi_number) = 10 AND {luhn_sql("lpad(d.npi_number, 10, '0')")} THEN 1 ELSE 0 END AS npi_ok
  FROM directory d JOIN ({OUTCOME}) o ON d.provider_id = o.provider_id
  JOIN (SELECT provider_id, sum(CASE WHEN success THEN 0 ELSE 1 END) AS failed FROM {TASKS} x GROUP BY provider_id) f ON d.provider_id = f.provider_id) y
GROUP BY validation_status""")
def _(t):
    done = validate.validate_records(*tables(t))
    failed = F.size(F.filter("answers", lambda a: ~a["success"]))
    return (
        done.groupBy("validation_status")
        .agg(
            F.count(F.lit(1)).alias("records"),
            r6(F.avg("overall_confidence")).alias("avg_confidence"),
            F.count_if(text.npi_valid("npi_number")).alias("npi_ok"),
            F.sum(failed).alias("failed_checks"),
        )
    )


@query("validated_records", "A4 A5 A6 A7", SOURCES,
       f"""SELECT provider_id, {r6_sql('c')} AS overall_confidence, {status_sql('c')} AS validation_status FROM ({OUTCOME}) o""")
def _(t):
    return validate.validate_records(*tables(t)).select(
        "provider_id", r6("overall_confidence").alias("overall_confidence"), "validation_status"
    )


# -- rule engine --------------------------------------------------------------------------------

RULE_WEIGHT = weights_case("source", K.RULE_SOURCE_WEIGHTS, 0.1)
SUMMARY = f"""SELECT provider_id, field_name, sum(confidence * {RULE_WEIGHT}) / sum({RULE_WEIGHT}) AS c, sum(confidence * {RULE_WEIGHT}) AS w, count(*) AS n,
  CASE WHEN bool_or(status = 'invalid') THEN 'invalid' WHEN bool_or(status = 'valid') THEN 'valid'
       WHEN bool_or(status = 'warning') THEN 'warning' ELSE 'unknown' END AS status FROM field_results GROUP BY provider_id, field_name"""


@query("field_summary", "A1", "field_results",
       f"SELECT provider_id, field_name, {r6_sql('c')} AS overall_confidence, {r6_sql('w')} AS weighted_score, status, CAST(n AS BIGINT) AS validation_count FROM ({SUMMARY}) s")
def _(t):
    done = merge.field_summary(t.field_results)
    return done.withColumns({c: r6(c) for c in ("overall_confidence", "weighted_score")})


RULE_FIELD = weights_case("field_name", K.RULE_FIELD_WEIGHTS, 0.05)


@query("record_summary", "A2 A3", "field_results",
       f"""SELECT provider_id, {r6_sql('c')} AS overall_confidence, CASE WHEN i > 0 THEN 'invalid' WHEN w > n * 0.5e0 THEN 'warning'
  WHEN v > n * 0.8e0 THEN 'valid' ELSE 'warning' END AS status, CAST(n AS BIGINT) AS total_fields, CAST(v AS BIGINT) AS valid_fields,
  CAST(i AS BIGINT) AS invalid_fields, CAST(w AS BIGINT) AS warning_fields
FROM (SELECT provider_id, sum(c * {RULE_FIELD}) / sum({RULE_FIELD}) AS c, count(*) AS n,
  sum(CASE WHEN status = 'valid' THEN 1 ELSE 0 END) AS v, sum(CASE WHEN status = 'invalid' THEN 1 ELSE 0 END) AS i,
  sum(CASE WHEN status = 'warning' THEN 1 ELSE 0 END) AS w FROM ({SUMMARY}) s GROUP BY provider_id) x""")
def _(t):
    return merge.record_summary(merge.field_summary(t.field_results)).withColumn(
        "overall_confidence", r6("overall_confidence")
    )


@query("record_counts", "A3b", "field_results",
       """SELECT provider_id, CAST(count(*) AS BIGINT) AS total_validations,
  CAST(sum(CASE WHEN status = 'valid' THEN 1 ELSE 0 END) AS BIGINT) AS successful_validations,
  CAST(sum(CASE WHEN status = 'invalid' THEN 1 ELSE 0 END) AS BIGINT) AS failed_validations,
  CAST(sum(CASE WHEN status = 'warning' THEN 1 ELSE 0 END) AS BIGINT) AS warning_validations FROM field_results GROUP BY provider_id""")
def _(t):
    return merge.record_counts(t.field_results)


def fuzzy_sql(field: str) -> str:
    return f"""SELECT 'fuzzy_matching' AS rule_type, '{field}' AS field_name, CASE WHEN r.npi_number IS NULL THEN 'invalid' WHEN s >= 0.85e0 THEN 'valid' WHEN s >= 0.7e0 THEN 'warning' ELSE 'invalid' END AS status
  FROM (SELECT r.npi_number, round(1 - levenshtein(lower(d.{field}), lower(r.{field})) / CAST(greatest(length(d.{field}), length(r.{field})) AS DOUBLE), 9) AS s FROM {REG_JOIN}
    WHERE coalesce(trim(d.{field}), '') <> '') r"""


@query("rule_results", "X1 J3b J4b J6 J11 F5", "directory registry geocodes licenses",
       f"""SELECT rule_type, field_name, status, CAST(count(*) AS BIGINT) AS n FROM ({fuzzy_sql('given_name')} UNION ALL {fuzzy_sql('family_name')}
UNION ALL SELECT 'e164_normalization', 'phone_primary', CASE WHEN coalesce(regexp_matches(phone, '^\\+1[2-9][0-9]{{2}}[2-9][0-9]{{6}}$'), false) THEN 'valid' ELSE 'invalid' END
  FROM (SELECT {PHONE} AS phone FROM directory WHERE coalesce(trim(phone_primary), '') <> '') p
UNION ALL SELECT 'place_id_matching', 'address_street', CASE WHEN missing THEN 'invalid' WHEN place_id IS NULL THEN 'warning' WHEN m <= 100 THEN 'valid' ELSE 'warning' END
  FROM (SELECT g.formatted_address IS NULL AS missing, g.place_id, {HAVERSINE} AS m FROM {GEO_JOIN} WHERE coalesce(trim(d.address_street), '') <> '') x
UNION ALL SELECT 'mx_record_check', 'email', CASE WHEN NOT regexp_matches(email, '{K.EMAIL_PATTERN}') THEN 'invalid'
    WHEN split_part(email, '@', 2) IN ({', '.join(f"'{d}'" for d in K.MAIL_DOMAINS)}) THEN 'valid' ELSE 'warning' END FROM directory WHERE coalesce(trim(email), '') <> ''
UNION ALL SELECT 'state_board_verification', 'license_number', CASE WHEN l.license_number IS NULL THEN 'invalid' WHEN upper(l.license_status) = 'ACTIVE' THEN 'valid'
  WHEN upper(l.license_status) IN ('SUSPENDED', 'REVOKED') THEN 'invalid' ELSE 'warning' END FROM {LIC_JOIN} WHERE coalesce(trim(d.license_number), '') <> ''
UNION ALL SELECT 'unheard_of', 'given_name', 'unknown' FROM directory WHERE coalesce(trim(given_name), '') <> '') x GROUP BY rule_type, field_name, status""")
def _(t):
    """All default rules, and one of a type nobody knows."""
    found = checks.with_references(t.directory, t.registry, t.geocodes, t.licenses)
    done = rules.apply_rules(found, [*rules.DEFAULT_RULES, rules.Rule("given_name", "unheard_of", {})])
    return done.groupBy("rule_type", "field_name", "status").agg(F.count(F.lit(1)).alias("n"))


@query("mean_field_confidence", "A9", "field_results",
       f"""SELECT provider_id, {r6_sql('avg(c)')} AS mean_confidence FROM (
  SELECT provider_id, field_name, max(confidence) AS c FROM field_results GROUP BY provider_id, field_name) x GROUP BY provider_id""")
def _(t):
    best = t.field_results.groupBy("provider_id", "field_name").agg(F.max("confidence").alias("c"))
    maps = best.groupBy("provider_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field_name", "c"))).alias("field_confidence")
    )
    return maps.select(
        "provider_id", r6(scores.mean_field_confidence("field_confidence")).alias("mean_confidence")
    )


@query("job_scores", "A10", "jobs directory registry geocodes licenses",
       f"""SELECT job_no, {r6_sql('score')} AS overall_score, CASE WHEN score >= 80 THEN 'valid' WHEN score >= 60 THEN 'warning' ELSE 'invalid' END AS validation_status,
  concat_ws('; ', CASE WHEN validate_npi AND NOT npi_valid THEN 'NPI validation failed' END, CASE WHEN validate_license AND NOT license_valid THEN 'License validation failed' END) AS errors,
  concat_ws('; ', CASE WHEN validate_address AND NOT address_valid THEN 'Address validation warning' END) AS warnings
FROM (SELECT *, CASE WHEN total = 0 THEN 0e0 ELSE good * 100e0 / total END AS score FROM (
  SELECT j.*, npi_valid, address_valid, license_valid, CAST(validate_npi AS INT) + CAST(validate_address AS INT) + CAST(validate_license AS INT) AS total,
   CASE WHEN validate_npi THEN CAST(npi_valid AS INT) ELSE 1 END + CASE WHEN validate_address THEN CAST(address_valid AS INT) ELSE 1 END
   + CASE WHEN validate_license THEN CAST(license_valid AS INT) ELSE 1 END AS good
  FROM jobs j JOIN (SELECT a.provider_id, a.ok AS npi_valid, b.ok AS address_valid, c.ok AS license_valid FROM
    (SELECT provider_id, success AS ok FROM ({REG_SQL}) x) a
    JOIN (SELECT d.provider_id, g.formatted_address IS NOT NULL AND {GEO_SCORE} > 0.5e0 AS ok FROM {GEO_JOIN}) b ON a.provider_id = b.provider_id
    JOIN (SELECT d.provider_id, l.license_number IS NOT NULL AS ok FROM {LIC_JOIN}) c ON a.provider_id = c.provider_id) v
  ON j.provider_id = v.provider_id) y) z""")
def _(t):
    found = checks.with_references(t.directory, t.registry, t.geocodes, t.licenses)
    outcomes = found.select(
        "provider_id",
        checks.registry_answer()["success"].alias("npi_valid"),
        checks.address_answer()["success"].alias("address_valid"),
        checks.license_answer()["success"].alias("license_valid"),
    )
    return merge.score_checks(t.jobs, outcomes).select(
        "job_no", r6("overall_score").alias("overall_score"), "validation_status",
        joined_list("errors").alias("errors"), joined_list("warnings").alias("warnings"),
    )


# -- report -----------------------------------------------------------------------------------------

ORIGINALS = "CASE field " + " ".join(f"WHEN '{f}' THEN d.{f}" for f in report.REPORTED) + " END"


@query("field_analyses", "A11 A12", SOURCES,
       f"""SELECT b.provider_id, field AS field_name, {ORIGINALS} AS original_value, value AS validated_value, {r6_sql('conf')} AS confidence,
  {status_sql('conf')} AS validation_status, source AS validation_source, concat_ws('; ',
   CASE WHEN coalesce(trim(value), '') = '' THEN concat(field, ' is missing or empty') END,
   CASE WHEN conf < 0.4e0 THEN concat(field, ' has very low confidence (', printf('%.2f', conf), ')')
        WHEN conf < 0.6e0 THEN concat(field, ' has low confidence (', printf('%.2f', conf), ')') END,
   CASE WHEN field = 'npi_number' AND length(value) <> 10 THEN 'NPI number should be 10 digits' END,
   CASE WHEN field = 'phone_primary' AND NOT starts_with(value, '+') THEN 'Phone number should be in E.164 format' END,
   CASE WHEN field = 'email' AND NOT contains(value, '@') THEN 'Invalid email format' END,
   CASE WHEN field = 'license_number' AND length(value) < 3 THEN 'License number appears too short' END) AS issues
FROM ({BEST_RAW}) b JOIN directory d ON b.provider_id = d.provider_id""")
def _(t):
    answered = validate.answer_records(*tables(t))
    fields = report.field_analysis([c for c in answered.columns if c in report.REPORTED])
    return answered.select("provider_id", F.explode(fields).alias("f")).select(
        "provider_id", "f.field_name", "f.original_value", "f.validated_value",
        r6("f.confidence").alias("confidence"), "f.validation_status", "f.validation_source",
        joined_list(F.transform("f.issues", lambda i: i["issue"])).alias("issues"),
    )


REPORT_BASE = f"""SELECT d.provider_id, n, vals, hi, med, lo, c, failed, docs_bad, missing, npi_gone, phone_bad, mail_bad, street_gone, same,
   lower(l.license_status) = 'expired' OR l.expiry_date < TIMESTAMP '{AS_OF}' AS lapsed, lower(l.license_status) = 'suspended' AS barred,
   (SELECT count(*) FROM directory q WHERE q.npi_number = d.npi_number AND trim(q.npi_number) <> '') AS copies
FROM {LIC_JOIN}
JOIN (SELECT provider_id, count(*) AS n, sum(CASE WHEN coalesce(trim(value), '') <> '' THEN 1 ELSE 0 END) AS vals,
   sum(CASE WHEN conf >= 0.8e0 THEN 1 ELSE 0 END) AS hi, sum(CASE WHEN conf >= 0.6e0 AND conf < 0.8e0 THEN 1 ELSE 0 END) AS med,
   sum(CASE WHEN conf < 0.6e0 THEN 1 ELSE 0 END) AS lo, avg(conf) AS c,
   string_agg(CASE WHEN field IN ({', '.join(f"'{f}'" for f in K.CRITICAL_FIELDS)}) AND coalesce(trim(value), '') = '' THEN field END, ', ' ORDER BY field) AS missing,
   bool_or(field = 'npi_number' AND coalesce(value, '') = '') AS npi_gone,
   bool_or(field = 'phone_primary' AND conf < 0.6e0) AS phone_bad, bool_or(field = 'email' AND conf < 0.6e0) AS mail_bad,
   bool_or(field = 'address_street' AND coalesce(value, '') = '') AS street_gone,
   lower(max(CASE WHEN field = 'given_name' THEN value END)) = lower(max(CASE WHEN field = 'family_name' THEN value END)) AS same
  FROM ({BEST_RAW}) b GROUP BY provider_id) b ON d.provider_id = b.provider_id
JOIN (SELECT provider_id, sum(CASE WHEN success THEN 0 ELSE 1 END) AS failed,
   coalesce(bool_and(NOT success) FILTER (WHERE source = 'ocr_processing'), false) AS docs_bad FROM {TASKS} x GROUP BY provider_id) f ON d.provider_id = f.provider_id"""
ADVICE = K.FLAG_RECOMMENDATIONS


REPORT_SQL = f"""SELECT provider_id, CAST(n AS BIGINT) AS total_fields, CAST(vals AS BIGINT) AS validated_fields, CAST(hi AS BIGINT) AS high_fields,
  CAST(med AS BIGINT) AS medium_fields, CAST(lo AS BIGINT) AS low_fields, CAST(failed AS BIGINT) AS failed_validations, {r6_sql('c')} AS confidence,
  {status_sql('c')} AS status,
  concat_ws(',', CASE WHEN missing IS NOT NULL THEN 'missing_critical_field' END, CASE WHEN lo > n * 0.5e0 THEN 'low_confidence' END,
    CASE WHEN failed > 0 THEN 'validation_failed' END, CASE WHEN npi_gone THEN 'npi_not_found' END, CASE WHEN phone_bad THEN 'invalid_phone' END,
    CASE WHEN mail_bad THEN 'invalid_email' END, CASE WHEN street_gone THEN 'address_not_found' END, CASE WHEN docs_bad THEN 'ocr_failed' END,
    CASE WHEN lapsed THEN 'expired_license' END, CASE WHEN barred THEN 'suspended_license' END,
    CASE WHEN same THEN 'data_inconsistency' END, CASE WHEN copies > 1 THEN 'potential_duplicate' END) AS flags,
  concat_ws(',', CASE WHEN missing IS NOT NULL THEN 'Missing Critical Fields' END, CASE WHEN lo > 0 THEN 'Low Confidence Fields' END,
    CASE WHEN failed > 0 THEN 'Failed Validations' END, CASE WHEN same THEN 'Data Inconsistency' END,
    CASE WHEN n / 9e0 < 0.8e0 THEN 'Low Validation Coverage' END) AS insights,
  concat_ws(',', CASE WHEN missing IS NOT NULL THEN 'Missing Critical Fields' END, CASE WHEN failed > 0 THEN 'Failed Validations' END) AS critical,
  coalesce(nullif(concat_ws('; ', CASE WHEN missing IS NOT NULL THEN '{ADVICE["missing_critical_field"]}' END,
    CASE WHEN lo > n * 0.5e0 THEN '{ADVICE["low_confidence"]}' END, CASE WHEN failed > 0 THEN '{ADVICE["validation_failed"]}' END,
    CASE WHEN npi_gone THEN '{ADVICE["npi_not_found"]}' END, CASE WHEN phone_bad THEN '{ADVICE["invalid_phone"]}' END,
    CASE WHEN mail_bad THEN '{ADVICE["invalid_email"]}' END, CASE WHEN street_gone THEN '{ADVICE["address_not_found"]}' END,
    CASE WHEN docs_bad THEN '{ADVICE["ocr_failed"]}' END, CASE WHEN missing IS NOT NULL THEN '{K.INSIGHT_RECOMMENDATIONS["missing_critical_fields"]}' END,
    CASE WHEN failed > 0 THEN '{K.INSIGHT_RECOMMENDATIONS["failed_validations"]}' END), ''), '{K.DEFAULT_RECOMMENDATION}') AS advice
FROM ({REPORT_BASE}) r"""


@query("validation_reports", "A13 A14 A15 A15b A16 A17 A18", SOURCES, REPORT_SQL)
def _(t):
    reports = validate.report_records(*tables(t), as_of=AS_OF)
    grave = F.filter("insights", lambda i: i["severity"].isin("critical", "error"))
    return reports.select(
        "provider_id", "summary.total_fields", "summary.validated_fields",
        F.col("summary.high_confidence_fields").alias("high_fields"),
        F.col("summary.medium_confidence_fields").alias("medium_fields"),
        F.col("summary.low_confidence_fields").alias("low_fields"), "summary.failed_validations",
        r6("summary.overall_confidence").alias("confidence"), F.col("summary.validation_status").alias("status"),
        joined_list("flags", ",").alias("flags"),
        joined_list(F.transform("insights", lambda i: i["title"]), ",").alias("insights"),
        joined_list(F.transform(grave, lambda i: i["title"]), ",").alias("critical"),
        joined_list("recommendations").alias("advice"),
    )


@query("report_digests", "S10", SOURCES,
       f"SELECT provider_id, '2024-01-31T00:00:00' AS generated_at, status, flags, critical, advice FROM ({REPORT_SQL}) v")
def _(t):
    digests = sinks.report_digest(validate.report_records(*tables(t), as_of=AS_OF))
    return digests.select(
        "provider_id", "generated_at", F.col("summary.validation_status").alias("status"),
        joined_list("flags", ",").alias("flags"),
        joined_list(F.transform("critical_insights", lambda i: i["title"]), ",").alias("critical"),
        joined_list("recommendations").alias("advice"),
    )


@query("report_json", "S9", SOURCES,
       f"SELECT provider_id, '2024-01-31T00:00:00' AS generated_at, status, CAST(total_fields AS STRING) AS total_fields, split_part(flags, ',', 1) AS first_flag FROM ({REPORT_SQL}) v")
def _(t):
    texts = sinks.report_json(validate.report_records(*tables(t), as_of=AS_OF))

    def at(path: str):
        return F.get_json_object("json", path)

    return texts.select(
        "provider_id", at("$.generated_at").alias("generated_at"), at("$.summary.validation_status").alias("status"),
        at("$.summary.total_fields").alias("total_fields"), F.coalesce(at("$.flags[0]"), F.lit("")).alias("first_flag"),
    )


# -- duplicates and candidates --------------------------------------------------------------------------


@query("duplicate_groups", "J12", "directory",
       "SELECT npi_number, CAST(count(*) AS BIGINT) AS copies, min(provider_id) AS keep FROM directory WHERE npi_number <> '' GROUP BY npi_number HAVING count(*) > 1")
def _(t):
    return matching.duplicate_groups(t.directory)


@query("marked_duplicates", "J12 A15b", "directory",
       """SELECT provider_id, CAST(count(*) OVER (PARTITION BY npi_number) AS BIGINT) AS copies,
  min(provider_id) OVER (PARTITION BY npi_number) AS keep FROM directory""")
def _(t):
    return matching.mark_duplicates(t.directory).select("provider_id", "copies", "keep")


NAMES = """SELECT address_state AS state, lower(concat(given_name, ' ', family_name)) AS name, lower(left(given_name, 1)) AS gi,
  lower(left(family_name, 1)) AS fi, count(*) AS records FROM (SELECT address_state, given_name,
    CASE WHEN (k // 400) % 2 = 1 THEN concat(family_name, 's') ELSE family_name END AS family_name FROM directory) d GROUP BY ALL"""


@query("near_names", "J12", "directory",
       f"""SELECT state, name, CAST(records AS BIGINT) AS records, CAST(count(*) AS BIGINT) AS near_names,
  first(near ORDER BY s DESC, near) AS nearest, {r6_sql('max(s)')} AS similarity
FROM (SELECT a.state, a.name, a.records, b.name AS near, round(1 - levenshtein(a.name, b.name) / CAST(greatest(length(a.name), length(b.name)) AS DOUBLE), 9) AS s
  FROM ({NAMES}) a JOIN ({NAMES}) b ON a.state = b.state AND a.gi = b.gi AND a.fi = b.fi AND a.name <> b.name) x
WHERE s >= 0.85e0 GROUP BY state, name, records""")
def _(t):
    spelled = t.directory.withColumn(
        "family_name",
        F.when(F.floor(F.col("k") / 400) % 2 == 1, F.concat("family_name", F.lit("s"))).otherwise(F.col("family_name")),
    )
    return matching.near_names(spelled).withColumn("similarity", r6("similarity"))


@query("address_candidates", "J13 W8", "directory geocodes",
       f"""SELECT provider_id, formatted_address, {r6_sql('c')} AS confidence, valid, CASE WHEN c < 0.8e0 THEN others ELSE 0 END AS suggestions
FROM (SELECT provider_id, max(CASE WHEN rn = 1 THEN formatted_address END) AS formatted_address, max(CASE WHEN rn = 1 THEN c END) AS c,
   bool_or(rn = 1 AND place_type <> 'locality') AS valid, CAST(count(*) - 1 AS BIGINT) AS others
  FROM (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY c DESC, formatted_address) AS rn
   FROM (SELECT d.provider_id, g.formatted_address, g.place_type, round(least(1e0, 0.5e0 + CASE g.place_type WHEN 'street_address' THEN 0.3e0 WHEN 'route' THEN 0.2e0 ELSE 0e0 END
      + 0.2e0 * len(list_intersect(list_distinct(string_split(lower(d.address_street), ' ')), list_distinct(string_split(lower(g.formatted_address), ' '))))
        / len(list_distinct(string_split(lower(d.address_street), ' ')))), 9) AS c
     FROM directory d JOIN geocodes g ON left(d.address_zip, 4) = left(g.zip, 4)) p) q WHERE rn <= 6 GROUP BY provider_id) z""")
def _(t):
    asked = t.directory.select(
        "provider_id", F.col("address_street").alias("address"), F.left("address_zip", F.lit(4)).alias("block")
    )
    candidates = t.geocodes.select(
        F.left("zip", F.lit(4)).alias("block"), "formatted_address", "place_id", F.array("place_type").alias("types")
    )
    best = matching.best_address_match(asked, candidates, "block")
    return best.select(
        "provider_id", "formatted_address", r6("confidence").alias("confidence"), "valid",
        F.size("suggestions").cast("bigint").alias("suggestions"),
    )


@query("check_tasks", "P21 X7", "directory",
       """SELECT provider_id, task_type FROM directory CROSS JOIN (VALUES ('npi_check'), ('google_places'), ('ocr_processing'), ('state_board_check')) v(task_type)
WHERE task_type <> 'ocr_processing' OR document_path IS NOT NULL""")
def _(t):
    return edits.expand_checks(t.directory, {"enable_enrichment": False}).select("provider_id", "task_type")
