"""Queries: masks, access control, audit trail, input hygiene and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import constants as K
from ...functions import guard, privacy
from ...operators import audit, filters, retention
from ...sources.derived import AS_OF
from .records import r6_sql, ts_sql
from .registry import joined_list, query, r6, ts

DIGITS = "regexp_replace({c}, '[^0-9]', '', 'g')"


def phone_mask(c: str) -> str:
    d = DIGITS.format(c=c)
    return f"concat('***-***-', CASE WHEN {d} = '' THEN '****' ELSE right({d}, 4) END)"


def email_mask(c: str) -> str:
    return f"""CASE WHEN position('@' IN {c}) = 0 THEN '***@***.***' WHEN position('@' IN {c}) > 2 THEN concat(left({c}, 1), '***@', substr({c}, position('@' IN {c}) + 1))
  ELSE concat('***@', substr({c}, position('@' IN {c}) + 1)) END"""


def npi_mask(c: str) -> str:
    return f"CASE WHEN length({c}) >= 4 THEN concat('***', right({c}, 4)) ELSE '**********' END"


def street_mask(c: str) -> str:
    n = f"regexp_extract({c}, '^([0-9]+)', 1)"
    return f"CASE WHEN {n} <> '' THEN concat({n}, ' *** Street') ELSE '*** Street' END"


def name_mask(c: str) -> str:
    return f"CASE WHEN length({c}) > 1 THEN concat(left({c}, 1), '***') ELSE '***' END"


def generic_mask(c: str) -> str:
    return f"CASE WHEN length({c}) > 4 THEN concat(repeat('*', length({c}) - 4), right({c}, 4)) ELSE repeat('*', length({c})) END"


@query("masked_records", "F25 F26 X4", "directory",
       f"""SELECT provider_id, {phone_mask('phone_primary')} AS phone_primary, {email_mask('email')} AS email, {npi_mask('npi_number')} AS npi_number,
  {street_mask('address_street')} AS address_street, {name_mask('given_name')} AS given_name, family_name,
  CASE WHEN license_number = '' THEN '' ELSE {generic_mask('license_number')} END AS license_number, '***-**-****' AS ssn,
  concat('****-**-** (', strftime(created_at, '%Y'), ')') AS date_of_birth, '***-***-****' AS medical_record_number FROM directory""")
def _(t):
    fields = audit.remove_pii_field("family_name")
    fields = audit.add_pii_field("license_number", "generic", "medium", "pii:reveal:license", 10, fields)
    full = t.directory.withColumns(
        {
            "ssn": F.lit("123-45-6789"),
            "date_of_birth": F.date_format("created_at", "yyyy-MM-dd"),
            "medical_record_number": F.col("provider_id"),
        }
    )
    return audit.mask_record(full, fields=fields).select(
        "provider_id", "phone_primary", "email", "npi_number", "address_street", "given_name", "family_name",
        "license_number", "ssn", "date_of_birth", "medical_record_number",
    )


@query("masked_for_readers", "F26", "directory",
       f"""SELECT provider_id, CASE WHEN k % 3 = 0 THEN phone_primary ELSE {phone_mask('phone_primary')} END AS phone_primary,
  CASE WHEN k % 2 = 0 THEN email ELSE {email_mask('email')} END AS email, {npi_mask('npi_number')} AS npi_number FROM directory""")
def _(t):
    permissions = F.array_compact(
        F.array(
            F.when(F.col("k") % 3 == 0, F.lit("pii:reveal:phone")), F.when(F.col("k") % 2 == 0, F.lit("pii:reveal:email"))
        )
    )
    seen = t.directory.select("provider_id", "phone_primary", "email", "npi_number", permissions.alias("permissions"))
    return audit.mask_for_readers(seen).drop("permissions")


LEVEL_CASE = "CASE field_name " + " ".join(f"WHEN '{n}' THEN '{v[1]}'" for n, v in K.PII_FIELDS.items()) + " END"


def quoted(items) -> str:
    return ", ".join(f"'{i}'" for i in items)


ALLOWED = "CASE " + " ".join(
    f"WHEN user_role = '{role}' THEN reason IN ({quoted(reasons)}) AND level IN ({quoted(levels)})"
    for role, (reasons, levels) in K.ACCESS_POLICIES.items() if reasons
) + " ELSE false END"


@query("access_decisions", "F27", "pii_access",
       f"""SELECT access_id, level AS sensitivity, CASE WHEN level IS NULL THEN true ELSE {ALLOWED} END AS allowed
FROM (SELECT *, {LEVEL_CASE} AS level FROM pii_access) p""")
def _(t):
    return audit.access_allowed(t.pii_access).select("access_id", "sensitivity", "allowed")


REVEAL_PERMISSIONS = {
    "admin": [v[2] for v in K.PII_FIELDS.values()],
    "reviewer": ["pii:reveal:phone", "pii:reveal:email", "pii:reveal:name"],
    "auditor": ["pii:reveal:npi"],
}
PERMISSION_CASE = "CASE field_name " + " ".join(f"WHEN '{n}' THEN '{v[2]}'" for n, v in K.PII_FIELDS.items()) + " END"
TIGHT = {n: (kind, level, permission, 1) for n, (kind, level, permission, _) in K.PII_FIELDS.items()}
MAY = "CASE " + " ".join(f"WHEN user_role = '{r}' THEN permission IN ({quoted(p)})" for r, p in REVEAL_PERMISSIONS.items()) + " ELSE false END"


@query("reveal_requests", "F28", "pii_access",
       f"""SELECT access_id, error_message IS NULL AS success, error_message FROM (SELECT access_id, CASE WHEN permission IS NULL THEN NULL
  WHEN NOT may THEN 'Insufficient permissions' WHEN nth > 1 THEN 'Access frequency limit exceeded' END AS error_message
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, field_name, may, date_trunc('hour', accessed_at) ORDER BY accessed_at, access_id) AS nth
  FROM (SELECT *, {MAY} AS may FROM (SELECT * REPLACE (CASE WHEN access_id % 4 < 3 THEN 'U0' ELSE user_id END AS user_id, 'admin' AS user_role), {PERMISSION_CASE} AS permission FROM pii_access) a) b) c) d""")
def _(t):
    busy = t.pii_access.withColumns(
        {
            "user_id": F.when(F.col("access_id") % 4 < 3, "U0").otherwise(F.col("user_id")),
            "user_role": F.lit("admin"),
        }
    )
    return audit.audit_reveals(busy, REVEAL_PERMISSIONS, TIGHT).select("access_id", "success", "error_message")


@query("reveal_permissions", "F28", "pii_access",
       f"""SELECT error_message, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN permission IS NOT NULL AND NOT {MAY} THEN 'Insufficient permissions' END AS error_message
FROM (SELECT *, {PERMISSION_CASE} AS permission FROM pii_access) a) b GROUP BY error_message""")
def _(t):
    done = audit.audit_reveals(t.pii_access, REVEAL_PERMISSIONS, {n: (*v[:3], 10**9) for n, v in K.PII_FIELDS.items()})
    return done.groupBy("error_message").agg(F.count(F.lit(1)).alias("n"))


RISK = "CASE " + " ".join(f"WHEN action IN ({quoted(a)}) THEN '{level}'" for level, a in K.RISK_ACTIONS.items()) + " ELSE 'medium' END"


@query("audit_risk", "F30 M5", "audit_logs",
       f"SELECT risk_level, CAST(count(*) AS BIGINT) AS n FROM (SELECT {RISK} AS risk_level FROM audit_logs) a GROUP BY risk_level")
def _(t):
    return audit.with_risk(t.audit_logs).groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))


@query("high_risk_events", "M5", "audit_logs",
       f"SELECT log_id, action FROM (SELECT log_id, action, {RISK} AS risk_level FROM audit_logs) a WHERE risk_level IN ('high', 'critical')")
def _(t):
    return audit.high_risk(t.audit_logs).select("log_id", "action")


@query("audit_search", "P10 L4", "audit_logs",
       f"""SELECT log_id, {ts_sql('a.logged_at')} AS logged_at FROM audit_logs a WHERE action = 'pii.reveal' AND resource_type = 'job'
  AND logged_at >= TIMESTAMP '2024-01-05 00:00:00' AND logged_at <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY a.logged_at DESC, log_id LIMIT 30 OFFSET 5""")
def _(t):
    found = filters.audit_filter(
        audit.with_partitions(t.audit_logs), action="pii.reveal", resource_type="job",
        start="2024-01-05 00:00:00", end="2024-01-20 00:00:00",
    )
    newest = found.orderBy(F.col("logged_at").desc(), "log_id").offset(5).limit(30)
    return newest.select("log_id", ts("logged_at").alias("logged_at"))


@query("audit_partitions", "S12", "audit_logs",
       """SELECT strftime(logged_at, '%Y-%m-%d') AS date, CAST(hour(logged_at) AS BIGINT) AS hour, CAST(count(*) AS BIGINT) AS n FROM audit_logs GROUP BY 1, 2""")
def _(t):
    return audit.with_partitions(t.audit_logs).groupBy("date", F.col("hour").cast("bigint").alias("hour")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("user_activity", "A40", "audit_logs",
       f"""SELECT a.user_id, total_actions, successful_actions, failed_actions, success_rate, unique_ips, high_risk, low_risk, action_counts, first_activity, last_activity FROM
 (SELECT user_id, CAST(count(*) AS BIGINT) AS total_actions, CAST(count(*) FILTER (WHERE success) AS BIGINT) AS successful_actions,
   CAST(count(*) FILTER (WHERE NOT success) AS BIGINT) AS failed_actions, {r6_sql('count(*) FILTER (WHERE success) / CAST(count(*) AS DOUBLE)')} AS success_rate,
   CAST(count(DISTINCT ip_address) AS BIGINT) AS unique_ips, CAST(count(*) FILTER (WHERE risk = 'high') AS BIGINT) AS high_risk, CAST(count(*) FILTER (WHERE risk = 'low') AS BIGINT) AS low_risk,
   {ts_sql('min(logged_at)')} AS first_activity, {ts_sql('max(logged_at)')} AS last_activity
  FROM (SELECT *, {RISK} AS risk FROM audit_logs WHERE logged_at >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAYS AND logged_at <= TIMESTAMP '{AS_OF}') l GROUP BY user_id) a
 JOIN (SELECT user_id, string_agg(concat(action, '=', CAST(n AS STRING)), ',' ORDER BY action) AS action_counts FROM (SELECT user_id, action, count(*) AS n FROM audit_logs
   WHERE logged_at >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAYS AND logged_at <= TIMESTAMP '{AS_OF}' GROUP BY user_id, action) c GROUP BY user_id) b ON a.user_id = b.user_id""")
def _(t):
    done = audit.user_activity(t.audit_logs, AS_OF, 20)
    counts = F.transform(F.map_entries("action_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return done.select(
        "user_id", "total_actions", "successful_actions", "failed_actions", r6("success_rate").alias("success_rate"),
        "unique_ips", "high_risk", "low_risk", F.array_join(F.array_sort(counts), ",").alias("action_counts"),
        ts("first_activity").alias("first_activity"), ts("last_activity").alias("last_activity"),
    )


@query("user_addresses", "A40", "audit_logs", "SELECT DISTINCT user_id, ip_address FROM audit_logs")
def _(t):
    return audit.user_addresses(t.audit_logs)


@query("sanitised_text", "F31", "",
       "SELECT doc_id, md5(replace(left(trim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 1000), chr(0), '')) AS digest FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", F.md5(guard.sanitize("text")).alias("digest"))


def sql_text(s: str) -> str:
    return s.replace("'", "''")


HITS = ", ".join(
    f"CASE WHEN regexp_matches(html, '{'(?is)' if across else '(?i)'}{sql_text('|'.join(f'(?:{p})' for p in patterns))}') THEN '{n}' END"
    for n, (patterns, across) in guard.HOSTILE_CLASSES.items()
)


@query("hostile_pages", "F32", "", f"SELECT page_id, concat_ws(',', {HITS}) AS classes FROM pages")
def _(t):
    return t.wide(t.raw("pages"), "page_id").select("page_id", joined_list(guard.detect_malicious("html"), ",").alias("classes"))


DOC_HITS = HITS.replace("html", "text")


@query("hostile_documents", "F32", "",
       f"SELECT doc_id, concat_ws(',', {DOC_HITS}) AS classes FROM documents")
def _(t):
    return t.wide(t.raw("documents"), "doc_id").select("doc_id", joined_list(guard.detect_malicious("text"), ",").alias("classes"))


@query("redacted_entries", "F33", "directory",
       "SELECT provider_id, '***REDACTED***' AS token, email AS mail FROM directory")
def _(t):
    entries = F.create_map(F.lit("Token"), F.col("npi_number"), F.lit("mail"), F.col("email"))
    hidden = t.directory.withColumn("e", privacy.redact(entries, K.SECRET_KEYS))
    return hidden.select("provider_id", F.col("e")["Token"].alias("token"), F.col("e")["mail"].alias("mail"))


@query("encrypted_round_trip", "F29", "directory",
       "SELECT provider_id, npi_number, true AS hidden, 'plain' AS passed_through FROM directory")
def _(t):
    key = F.lit("0123456789abcdef")
    secret = t.directory.withColumn("secret", privacy.encrypt("npi_number", key))
    return secret.select(
        "provider_id",
        privacy.decrypt("secret", key).alias("npi_number"),
        (F.col("secret") != F.col("npi_number")).alias("hidden"),
        privacy.decrypt(F.concat(F.lit("plain"), F.when(F.col("k") < 0, "x").otherwise("")), key).alias("passed_through"),
    )


# -- retention -------------------------------------------------------------------------------

SIZE = """strlen(concat_ws('', k, class, provider_id, given_name, family_name, npi_number, primary_taxonomy, practice_name, address_street,
  address_city, address_state, address_zip, phone_primary, email, license_number, license_state, license_status, document_path, claimed_lat, claimed_lng,
  strftime(last_validated_at, '%Y-%m-%d %H:%M:%S'), strftime(created_at, '%Y-%m-%d %H:%M:%S'), strftime(updated_at, '%Y-%m-%d %H:%M:%S'),
  overall_confidence, validation_status, CAST(to_json(flag_codes) AS STRING)))"""


@query("retention_preview", "A41", "directory",
       f"""SELECT CAST(count(*) AS BIGINT) AS affected_records, CAST(coalesce(sum({SIZE}), 0) AS BIGINT) AS affected_bytes FROM directory
WHERE created_at < TIMESTAMP '{AS_OF}' - INTERVAL 1000 DAYS""")
def _(t):
    return retention.retention_preview(t.directory, AS_OF, 1000)


@query("retention_report", "A42 X5", "directory provider_results audit_logs",
       " UNION ALL ".join(
           f"""SELECT '{p}' AS policy, '{K.RETENTION_POLICIES[p][1]}' AS action, CAST({K.RETENTION_POLICIES[p][0]} AS BIGINT) AS retention_days, CAST(count(*) AS BIGINT) AS affected_records
FROM {table} WHERE {at} < TIMESTAMP '{AS_OF}' - INTERVAL {K.RETENTION_POLICIES[p][0]} DAYS"""
           for p, table, at in (("provider_data", "directory", "created_at"), ("validation_results", "provider_results", "created_at"),
                                ("audit_logs", "audit_logs", "logged_at"), ("session_data", "audit_logs", "logged_at"))
       ))
def _(t):
    tables = {
        "provider_data": (t.directory, "created_at"),
        "validation_results": (t.provider_results, "created_at"),
        "audit_logs": (t.audit_logs, "logged_at"),
        "session_data": (t.audit_logs, "logged_at"),
    }
    return retention.retention_report(tables, AS_OF).drop("affected_mb", "success")


OLD = f"created_at < TIMESTAMP '{AS_OF}' - INTERVAL 2000 DAYS"


@query("anonymised_records", "R1", "directory",
       f"""SELECT provider_id, CASE WHEN {OLD} THEN {name_mask('given_name')} ELSE given_name END AS given_name,
  CASE WHEN {OLD} THEN {email_mask('email')} ELSE email END AS email FROM directory""")
def _(t):
    kept, _ = retention.apply_retention(
        t.directory.select("provider_id", "given_name", "email", "created_at"), AS_OF, 2000, "anonymize"
    )
    return kept.select("provider_id", "given_name", "email")


@query("retained_and_archived", "R1 S11", "directory",
       f"SELECT provider_id, CASE WHEN {OLD} THEN 'archived' ELSE 'kept' END AS outcome FROM directory")
def _(t):
    kept, old = retention.apply_retention(t.directory, AS_OF, 2000, "archive")
    return kept.select("provider_id", F.lit("kept").alias("outcome")).unionByName(
        old.select("provider_id", F.lit("archived").alias("outcome"))
    )


@query("finished_jobs_to_drop", "R1", "jobs",
       "SELECT job_id FROM jobs WHERE status IN ('completed', 'failed') AND completed_at < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 7 DAYS")
def _(t):
    return retention.finished_jobs_older_than(t.jobs, "1998-01-01 00:00:00").select("job_id")
