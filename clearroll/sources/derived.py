"""Directory-style relations derived from the driver's star-schema tables.

There is no directory table among the inputs, so each view below is a rule over
the columns of one or two input tables: integer arithmetic and literal lists
only, no randomness, no hashing.  A view is one SELECT, rendered either for Spark
or for the checking engine, so that both sides start from the same relation.
Every view is row-local or a plain join/aggregate and grows with its tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

AS_OF = "2024-01-31 00:00:00"

# -- fixed values: vocabulary of the derived directory --------------------------

GIVEN = ["Ada", "Ben", "Cora", "Dan", "Eva", "Finn", "Gail", "Hugo", "Ida", "Jon",
         "Kira", "Liam", "Mona", "Nils", "Olga", "Paul", "Rosa", "Sam", "Tess", "Uwe"]
FAMILY = ["Abbott", "Baker", "Carter", "Dalton", "Ellis", "Foster", "Grant", "Harper",
          "Irwin", "Jensen", "Keller", "Lambert", "Mason", "Norris", "Osborn", "Porter",
          "Quinn", "Reed", "Sutton", "Turner"]
STATES = ["CA", "NY", "TX", "FL", "IL", "PA", "OH", "GA", "NC", "MI", "WA", "AZ", "MA",
          "TN", "IN", "MO", "MD", "WI", "CO", "MN", "SC", "AL", "LA", "KY", "OR"]
CITIES = ["Fresno", "Albany", "Austin", "Tampa", "Peoria", "Erie", "Akron", "Macon",
          "Durham", "Flint", "Tacoma", "Mesa", "Salem", "Memphis", "Gary", "Joplin",
          "Laurel", "Racine", "Pueblo", "Duluth", "Aiken", "Mobile", "Houma", "Paducah", "Bend"]
STREETS = ["Main St", "Oak Ave", "First St", "Pine St", "Elm Street", "Park Ave", "Hill Rd", "Lake Dr"]
DOMAINS = ["gmail.com", "yahoo.com", "outlook.com", "example.org", "nowhere.test"]
KNOWN_DOMAINS = ["gmail.com", "yahoo.com", "outlook.com", "example.org"]
BAD_PHONES = ["555-000-0000", "555-123-456", "000-000-0000", "555-1234-567", "5551234567"]
BAD_EMAILS = ["invalid-email", "test@", "@domain.com", "test@domain", "test@domain@com"]
FAKE_NPIS = ["0000000000", "1111111111", "9999999999", "123456789"]
FIELDS = ["npi_number", "given_name", "family_name", "phone_primary", "email",
          "address_street", "license_number"]
RULE_SOURCES = ["npi", "google_places", "hospital_website", "state_board"]
REVIEWERS = ["R1", "R2", "R3"]


_SCHEMAS: dict[str, T.StructType] = {}


class Spark:
    """Rendering for Spark SQL over parquet files in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> str:
        relation = f"clearroll_input_{name}"
        table(self.spark, self.folder, name).createOrReplaceTempView(relation)
        return relation

    def div(self, a: str, b: int) -> str:
        return f"(({a}) div {b})"

    def pick(self, index: str, items: list[str]) -> str:
        quoted = ", ".join(f"'{i}'" for i in items)
        return f"element_at(array({quoted}), CAST(({index}) + 1 AS INT))"

    def days(self, start: str, n: str) -> str:
        return f"(TIMESTAMP_NTZ '{start}' + make_dt_interval(CAST({n} AS INT)))"

    def later(self, ts: str, seconds: str) -> str:
        return f"({ts} + make_dt_interval(0, 0, 0, {seconds}))"

    def compact(self, items: list[str]) -> str:
        return f"array_compact(array({', '.join(items)}))"


class Duck:
    """Rendering for the checking engine, over registered tables."""

    def table(self, name: str) -> str:
        return name

    def div(self, a: str, b: int) -> str:
        return f"(({a}) // {b})"

    def pick(self, index: str, items: list[str]) -> str:
        quoted = ", ".join(f"'{i}'" for i in items)
        return f"list_value({quoted})[CAST(({index}) + 1 AS INT)]"

    def days(self, start: str, n: str) -> str:
        return f"(TIMESTAMP '{start} 00:00:00' + to_days(CAST({n} AS INT)))"

    def later(self, ts: str, seconds: str) -> str:
        return f"({ts} + to_seconds({seconds}))"

    def compact(self, items: list[str]) -> str:
        return f"list_filter(list_value({', '.join(items)}), lambda x: x IS NOT NULL)"


def _npi(d, nine: str) -> str:
    """Nine digits and the check digit that makes all ten pass the Luhn check.

    The text of ten digits holds, at each digit's place, the digit sum of its double.
    """
    terms = []
    for place in range(9):
        digit = f"({d.div(nine, 10 ** (8 - place))} % 10)"
        terms.append(
            f"CAST(substr('0246813579', CAST({digit} + 1 AS INT), 1) AS INT)" if place % 2 == 0 else digit
        )
    total = " + ".join(terms)
    return f"CAST(({nine}) * 10 + (10 - ({total}) % 10) % 10 AS STRING)"


def _nine(k: str) -> str:
    return f"(100000000 + (({k}) * 7919) % 900000000)"


def people(d, copied: bool = False) -> str:
    """True facts about every customer, before any error is put in.

    With ``copied`` the records of class 7 carry the number of an earlier one.
    """
    k = "c_custkey"
    owner = f"({k} - CASE WHEN {k} % 10 = 7 THEN 7 ELSE 0 END)" if copied else k
    return f"""
SELECT {k} AS k,
       {k} % 10 AS class,
       c_nationkey AS nk,
       concat('P', CAST({k} AS STRING)) AS provider_id,
       {d.pick(f"{k} % 20", GIVEN)} AS given_name,
       {d.pick(f"{d.div(k, 20)} % 20", FAMILY)} AS family_name,
       {_npi(d, "nine")} AS npi_number,
       {d.pick("c_nationkey", STATES)} AS state,
       {d.pick("c_nationkey", CITIES)} AS city,
       CAST(10000 + ({k} * 37) % 90000 AS STRING) AS zip,
       concat(CAST(1 + ({k} * 31) % 9999 AS STRING), ' ', {d.pick(f"{k} % 8", STREETS)}) AS street,
       CAST(200 + {k} % 800 AS STRING) AS area,
       CAST(200 + ({k} * 7) % 800 AS STRING) AS exchange,
       CAST(1000 + ({k} * 13) % 9000 AS STRING) AS line,
       {d.pick(f"{k} % 5", DOMAINS)} AS domain,
       concat({d.pick(f"{k} % 3", ["A", "B", "C"])},
              CAST(100000 + ({k} * 7919) % 900000 AS STRING)) AS license_no,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Family Medicine' WHEN 'BUILDING' THEN 'Pediatrics'
            WHEN 'FURNITURE' THEN 'Dermatology' WHEN 'HOUSEHOLD' THEN 'Urology'
            ELSE 'Internal Medicine' END AS taxonomy,
       CAST(25 + (({k} * 13) % 2400) / 100e0 AS DOUBLE) AS lat,
       CAST(-70 - (({k} * 17) % 5000) / 100e0 AS DOUBLE) AS lng
FROM (SELECT *, {_nine(owner)} AS nine FROM {d.table("customer")}) c"""


def directory(d) -> str:
    """Records with ten error classes by ``k % 10``."""
    status = """CASE class WHEN 3 THEN 'expired' WHEN 6 THEN '' WHEN 8 THEN 'suspended'
            WHEN 9 THEN CASE WHEN k % 20 = 9 THEN 'expired' ELSE 'suspended' END ELSE 'active' END"""
    flags = d.compact([
        "CASE WHEN class IN (3, 9) THEN 'EXPIRED_LICENSE' END",
        "CASE WHEN class = 7 THEN 'POTENTIAL_DUPLICATE' END",
        "CASE WHEN k % 6 = 0 THEN 'LOW_CONFIDENCE_PHONE' END",
        "CASE WHEN k % 15 = 0 THEN 'COMPLIANCE_VIOLATION' END",
    ])
    return f"""
SELECT k, class, provider_id, given_name, family_name,
       CASE class WHEN 4 THEN {d.pick(f"{d.div('k', 10)} % 4", FAKE_NPIS)}
                  ELSE npi_number END AS npi_number,
       taxonomy AS primary_taxonomy,
       concat(family_name, ' ', taxonomy) AS practice_name,
       CASE WHEN class = 5 THEN concat(street, ' (MOVED)') ELSE street END AS address_street,
       city AS address_city, state AS address_state, zip AS address_zip,
       CASE WHEN class = 1 THEN {d.pick(f"{d.div('k', 10)} % 5", BAD_PHONES)}
            WHEN k % 3 = 0 THEN concat('(', area, ') ', exchange, '-', line)
            WHEN k % 3 = 1 THEN concat(area, '-', exchange, '-', line)
            ELSE concat('+1', area, exchange, line) END AS phone_primary,
       CASE WHEN class = 2 THEN {d.pick(f"{d.div('k', 10)} % 5", BAD_EMAILS)}
            ELSE lower(concat(given_name, '.', family_name, '@', domain)) END AS email,
       CASE WHEN class = 6 THEN '' ELSE license_no END AS license_number,
       state AS license_state,
       {status} AS license_status,
       CASE WHEN k % 4 = 0 THEN concat('docs/', CAST(k AS STRING), '.pdf') END AS document_path,
       lat + (k % 4) * 0.0006e0 AS claimed_lat, lng AS claimed_lng,
       CASE WHEN k % 17 <> 0 THEN {d.days("2024-01-01", "k % 365")} END AS last_validated_at,
       {d.days("2016-01-01", "(k * 11) % 2900")} AS created_at,
       {d.days("2024-01-01", "k % 30")} AS updated_at,
       CAST((40 + (k * 37) % 61) / 100e0 AS DOUBLE) AS overall_confidence,
       CASE WHEN k % 17 = 0 THEN 'pending'
            WHEN 40 + (k * 37) % 61 >= 80 THEN 'valid'
            WHEN 40 + (k * 37) % 61 >= 60 THEN 'warning' ELSE 'invalid' END AS validation_status,
       {flags} AS flag_codes
FROM ({people(d, copied=True)}) p"""


def registry(d) -> str:
    return f"""
SELECT npi_number, given_name,
       CASE WHEN k % 11 = 0 THEN concat(family_name, 'x') ELSE family_name END AS family_name,
       taxonomy AS primary_taxonomy, concat(family_name, ' ', taxonomy) AS practice_name,
       street AS address_street, city AS address_city, state AS address_state, zip AS address_zip,
       concat(area, '-', exchange, '-', line) AS phone_primary,
       CASE WHEN k % 13 = 0 THEN 'D' ELSE 'A' END AS registry_status,
       CASE WHEN k % 29 = 0 THEN 'NPI-9' WHEN k % 5 = 0 THEN 'NPI-2' ELSE 'NPI-1' END AS enumeration_type
FROM ({people(d)}) p WHERE k % 7 <> 0"""


def geocodes(d) -> str:
    return f"""
SELECT concat(street, ', ', city, ', ', state, ' ', zip) AS formatted_address,
       CASE WHEN k % 23 <> 0 THEN concat('pl', CAST(k AS STRING)) END AS place_id,
       street, city, state, zip, lat AS latitude, lng AS longitude,
       {d.pick("k % 5", ["NONE", "ROOFTOP", "RANGE_INTERPOLATED", "GEOMETRIC_CENTER", "OTHER"])} AS location_type,
       {d.pick("k % 3", ["street_address", "route", "locality"])} AS place_type
FROM ({people(d)}) p WHERE k % 5 <> 0"""


def licenses(d) -> str:
    return f"""
SELECT license_no AS license_number, state AS license_state,
       CASE WHEN class = 3 THEN 'expired' WHEN class = 8 THEN 'suspended'
            WHEN class = 9 AND k % 20 = 9 THEN 'revoked' WHEN class = 9 THEN 'pending'
            ELSE 'active' END AS license_status,
       concat(given_name, ' ', family_name) AS holder_name, taxonomy AS specialty,
       {d.days("2010-01-01", "k % 3000")} AS issue_date,
       {d.days("2020-01-01", "k % 3000")} AS expiry_date
FROM ({people(d)}) p WHERE class <> 6"""


def license_actions(d) -> str:
    return f"""
SELECT license_no AS license_number, state AS license_state,
       {d.pick("k % 6", ["Suspension for six months", "Revoked by order of the board",
                         "Placed on probation for a year", "Fine of 500 for late renewal",
                         "Letter of reprimand was issued", "Closed"])} AS description,
       {d.days("2021-01-01", "k % 900")} AS action_date
FROM ({people(d)}) p WHERE class IN (3, 8, 9)"""


def enrichment(d) -> str:
    return f"""
SELECT provider_id,
       concat('["', {d.pick("k % 4", ["North Hospital", "South Hospital", "Lake Clinic", "Hill Clinic"])}, '"]') AS affiliations,
       CASE WHEN k % 2 = 0 THEN '{{"primary_care":true}}' ELSE '{{"primary_care":false}}' END AS services_offered
FROM ({people(d)}) p WHERE k % 3 <> 0"""


def document_fields(d) -> str:
    """Fields read from the documents of every fourth record; phone occurs twice."""
    rows = []
    for seq, field, value, score in (
        (1, "name", "concat(given_name, ' ', family_name)", "0.85e0"),
        (2, "phone", "concat(area, '-', exchange, '-', line)", "0.9e0"),
        (3, "license", "license_no", "CASE WHEN k % 8 = 0 THEN 0.45e0 ELSE 0.9e0 END"),
        (4, "phone", "concat('(', area, ') ', exchange, '-', line)", "0.7e0"),
    ):
        rows.append(f"""
SELECT provider_id, {seq} AS seq, '{field}' AS field_name, {value} AS field_value,
       CAST({score} AS DOUBLE) AS confidence
FROM ({people(d)}) p WHERE k % 4 = 0 AND k % 12 <> 0""")
    return " UNION ALL ".join(rows)


def jobs(d) -> str:
    done = "o_orderstatus = 'F'"
    return f"""
SELECT concat('J', CAST(o_orderkey AS STRING)) AS job_id,
       o_orderkey AS job_no,
       concat('P', CAST(o_custkey AS STRING)) AS provider_id,
       CASE WHEN {done} AND o_orderkey % 9 = 0 THEN 'failed' WHEN {done} THEN 'completed'
            WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'running' END AS status,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high'
            WHEN '5-LOW' THEN 'low' ELSE 'medium' END AS priority,
       o_orderdate AS created_at,
       CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS started_at,
       CASE WHEN {done} THEN {d.later("o_orderdate", "o_orderkey % 300")} END AS completed_at,
       o_orderkey % 4 AS retry_count,
       o_orderkey % 2 = 0 AS validate_npi, o_orderkey % 3 = 0 AS validate_address,
       o_orderkey % 5 <> 0 AS validate_license
FROM {d.table("orders")}"""


def field_results(d) -> str:
    confidence = "CAST(round(1 - l_discount * 5, 4) AS DOUBLE)"
    return f"""
SELECT job_id, job_no, provider_id, field_name, source, line_no, confidence,
       CASE WHEN confidence >= 0.8e0 THEN 'valid' WHEN confidence >= 0.6e0 THEN 'warning'
            ELSE 'invalid' END AS status, validated_at
FROM (SELECT concat('J', CAST(l_orderkey AS STRING)) AS job_id, l_orderkey AS job_no,
             concat('P', CAST(o_custkey AS STRING)) AS provider_id,
             {d.pick("l_linenumber - 1", FIELDS)} AS field_name,
             {d.pick("l_suppkey % 4", RULE_SOURCES)} AS source,
             CAST(l_linenumber AS BIGINT) AS line_no,
             {confidence} AS confidence, l_shipdate AS validated_at
      FROM {d.table("lineitem")} JOIN {d.table("orders")} ON l_orderkey = o_orderkey) f"""


def provider_results(d) -> str:
    """One result per job: mean confidence of its fields, newest time."""
    return f"""
SELECT job_id, job_no, provider_id, overall_confidence, created_at,
       CASE WHEN overall_confidence >= 0.8e0 THEN 'valid'
            WHEN overall_confidence >= 0.7e0 THEN 'warning' ELSE 'invalid' END AS validation_status
FROM (SELECT job_id, job_no, provider_id, CAST(round(avg(confidence), 6) AS DOUBLE) AS overall_confidence,
             max(validated_at) AS created_at
      FROM ({field_results(d)}) r GROUP BY job_id, job_no, provider_id) a"""


def audit_logs(d) -> str:
    return f"""
SELECT event_id AS log_id, ts AS logged_at, concat('U', CAST(user_id AS STRING)) AS user_id,
       {d.pick("user_id % 5", ["admin", "reviewer", "auditor", "operator", "guest"])} AS user_role,
       CASE event_type WHEN 'click' THEN 'provider.read' WHEN 'view' THEN 'validation.review'
            WHEN 'purchase' THEN 'pii.reveal' WHEN 'signup' THEN 'admin.user_create'
            ELSE 'auth.login_failed' END AS action,
       CASE WHEN event_id % 2 = 0 THEN 'provider' ELSE 'job' END AS resource_type,
       concat('X', CAST(event_id % 50 AS STRING)) AS resource_id,
       concat('10.0.0.', CAST((user_id + event_id) % 8 AS STRING)) AS ip_address,
       event_type <> 'error' AS success, CAST(value AS DOUBLE) AS duration_ms
FROM {d.table("events")}"""


def request_log(d) -> str:
    return f"""
SELECT event_id AS request_id, ts AS requested_at,
       CASE event_type WHEN 'click' THEN 'npi_registry' WHEN 'view' THEN 'google_places'
            WHEN 'purchase' THEN 'state_board' WHEN 'signup' THEN 'enrichment'
            ELSE 'hospital_website' END AS connector,
       concat('10.0.0.', CAST(user_id % 8 AS STRING)) AS client,
       CASE WHEN event_id % 10 = 0 THEN 'error' ELSE 'success' END AS status,
       CASE WHEN event_id % 3 = 0 THEN 'miss' ELSE 'hit' END AS cache,
       CAST(value AS DOUBLE) AS duration_seconds
FROM {d.table("events")}"""


def pii_access(d) -> str:
    return f"""
SELECT event_id AS access_id, ts AS accessed_at, concat('U', CAST(user_id AS STRING)) AS user_id,
       {d.pick("user_id % 5", ["admin", "reviewer", "auditor", "operator", "guest"])} AS user_role,
       {d.pick("event_id % 6", ["phone_primary", "email", "npi_number", "ssn", "given_name", "nickname"])} AS field_name,
       {d.pick("event_id % 4", ["audit_review", "data_correction", "customer_service", "legal_requirement"])} AS reason
FROM {d.table("events")}"""


def idempotency(d) -> str:
    return f"""
SELECT concat('validation_', CAST(event_id AS STRING)) AS request_key,
       {d.pick("event_id % 4", ["pending", "processing", "completed", "failed"])} AS status,
       ts AS created_at, {d.later("ts", "86400")} AS expires_at
FROM {d.table("events")}"""


def metric_ticks(d) -> str:
    """One metrics row per day and event hour bucket: queue length, failures, rate."""
    return f"""
SELECT date_trunc('hour', ts) AS tick,
       CAST(count(*) AS BIGINT) AS requests,
       CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failures
FROM {d.table("events")} GROUP BY date_trunc('hour', ts)"""


def area_codes(d) -> str:
    """The area codes in use, with carrier and region known for most of them."""
    return f"""
SELECT DISTINCT CAST(200 + c_custkey % 800 AS STRING) AS area,
       CASE WHEN c_custkey % 800 % 3 <> 0 THEN 'carrier' END AS carrier,
       CASE WHEN c_custkey % 800 % 4 <> 0 THEN 'region' END AS region
FROM {d.table("customer")}"""


VIEWS = {
    f.__name__: f
    for f in (
        people, directory, registry, geocodes, licenses, license_actions, enrichment,
        document_fields, jobs, field_results, provider_results, audit_logs, request_log,
        pii_access, idempotency, metric_ticks, area_codes,
    )
}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived relation over the parquet tables of a folder."""
    return spark.sql(VIEWS[name](Spark(spark, folder.rstrip("/"))))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An input table; the footers are read for the schema once per path only."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def with_views(*names: str) -> str:
    """The same relations as common table expressions for the checking engine."""
    parts = ", ".join(f"{n} AS ({VIEWS[n](Duck())})" for n in names)
    return f"WITH {parts} "
