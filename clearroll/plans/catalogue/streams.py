"""Queries: the stream forms, run over the input files to their end.

Append-mode results hold what the final watermark (newest event minus the allowed
lateness) has closed, and the SQL says so.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.scores import label_of
from ...operators import audit, windows
from ...schema import BATCH_FIELDS
from ...sources import files, sinks
from ...streaming import (
    alert_stream, closing_tick, drain, high_risk_stream, job_progress_stream, latest_updates, request_limit_stream,
    retry_failed, retry_stream, retryable_requests, session_stream, stream_table, unique_requests, validate_arrivals,
    validation_rate_stream,
)
from ...streaming.run import work_folder
from .monitoring import BREACHES, TICK_RULES, tick_metrics
from .privacy import RISK
from .records import CANONICAL, ERRORS, r6_sql, ts_sql
from .registry import joined_list, query, r6, ts

ACTIONS = {
    "click": "provider.read", "view": "validation.review", "purchase": "pii.reveal",
    "signup": "admin.user_create", "error": "auth.login_failed",
}
CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTES FROM events)"


def attempts_of(t):
    status = F.when(F.col("status") == "valid", "completed").when(F.col("status") == "invalid", "failed").otherwise("running")
    return t.field_results.select(F.col("job_id").alias("task_id"), status.alias("status"), F.col("line_no").alias("attempt"))


def events(t):
    return stream_table(t.spark, t._folder, "events")


@query("stream_event_rate", "M1", "",
       f"""SELECT {ts_sql('w')} AS window_start, event_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type,
  time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01 00:00:00') AS w FROM events) e
WHERE w + INTERVAL 1 HOUR <= {CLOSED} GROUP BY w, event_type""")
def _(t):
    done = drain(validation_rate_stream(events(t), "ts", "1 hour", by=["event_type"]))
    return done.select(ts("window_start").alias("window_start"), "event_type", "n")


@query("stream_request_limits", "M2", "",
       f"""SELECT {ts_sql('w')} AS window_start, event_type, CAST(count(*) AS BIGINT) AS requests FROM (SELECT event_type,
  time_bucket(INTERVAL 10 MINUTES, ts, TIMESTAMP '1970-01-01 00:00:00') - to_minutes(10 * i) AS w FROM events, range(6) r(i)) e
WHERE w + INTERVAL 1 HOUR <= {CLOSED} GROUP BY w, event_type HAVING count(*) > 2""")
def _(t):
    done = drain(request_limit_stream(events(t), "event_type", "ts", 2, "60 minutes", "10 minutes"))
    return done.select(ts("window_start").alias("window_start"), "event_type", "requests")


@query("stream_unique_requests", "M3", "", "SELECT DISTINCT concat(event_type, CAST(user_id AS STRING)) AS request_key FROM events")
def _(t):
    keyed = events(t).select("ts", F.concat("event_type", F.col("user_id").cast("string")).alias("request_key"))
    return drain(unique_requests(keyed, "request_key", "ts", "40 days")).select("request_key")


@query("stream_retryable_requests", "M3", "",
       """WITH RECURSIVE e AS (SELECT concat(event_type, CAST(user_id AS STRING)) AS request_key, event_id, ts, event_id % 3 = 0 AS failed FROM events),
a AS (SELECT request_key, ts, failed FROM (SELECT *, row_number() OVER (PARTITION BY request_key ORDER BY ts) AS rn FROM e) x WHERE rn = 1
  UNION ALL SELECT n.request_key, n.ts, n.failed FROM a, LATERAL (SELECT e.request_key, e.ts, e.failed FROM e WHERE e.request_key = a.request_key AND e.ts > a.ts
    AND (a.failed OR e.ts > a.ts + INTERVAL 24 HOURS) ORDER BY e.ts LIMIT 1) n)
SELECT request_key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS accepted_at FROM a WHERE time_bucket(INTERVAL 10 MINUTES, ts, TIMESTAMP '1970-01-01 00:00:00') + INTERVAL 10 MINUTES <= """ + CLOSED)
def _(t):
    status = F.when(F.col("event_id") % 3 == 0, "failed").otherwise("completed")
    keyed = events(t).select(
        "ts", F.concat("event_type", F.col("user_id").cast("string")).alias("request_key"), status.alias("status")
    )
    done = drain(retryable_requests(keyed, "request_key", "ts"))
    return done.select("request_key", ts("ts").alias("accepted_at"))


@query("stream_high_risk_events", "M5", "audit_logs",
       f"SELECT log_id, action FROM (SELECT log_id, action, {RISK} AS risk_level FROM audit_logs) a WHERE risk_level IN ('high', 'critical')")
def _(t):
    log = events(t).select(F.col("event_id").alias("log_id"), label_of("event_type", ACTIONS, None).alias("action"))
    return drain(high_risk_stream(log)).select("log_id", "action")


@query("audit_trail", "S12 P10", "audit_logs",
       "SELECT log_id, strftime(logged_at, '%Y-%m-%d') AS date, CAST(10 AS BIGINT) AS hour FROM audit_logs WHERE hour(logged_at) = 10")
def _(t):
    """The trail written as a stream, started twice; one hour of all days is read back, other partitions are not opened."""
    base = work_folder(t.spark, "audit")
    for _ in range(2):
        log = events(t).select(F.col("event_id").alias("log_id"), F.col("ts").alias("logged_at"))
        sinks.audit_stream(log, f"{base}/trail", f"{base}/checkpoint").awaitTermination()
    trail = t.spark.read.schema("log_id long, logged_at timestamp, date string, hour int").parquet(f"{base}/trail")
    return trail.where("hour = 10").select("log_id", "date", F.col("hour").cast("bigint").alias("hour"))


@query("stream_sessions", "M6", "",
       f"""SELECT user_id, {ts_sql('min(ts)')} AS session_start, CAST(count(*) AS BIGINT) AS events FROM (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s
  FROM (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) a) b
GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOURS <= {CLOSED}""")
def _(t):
    done = drain(session_stream(events(t), "user_id", "ts", "6 hours"))
    return done.select("user_id", ts("session_start").alias("session_start"), "events")


@query("stream_job_progress", "M7", "",
       f"""SELECT job_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE s = 'completed') AS BIGINT) AS completed, CAST(count(*) FILTER (WHERE s = 'failed') AS BIGINT) AS failed,
  {r6_sql("count(*) FILTER (WHERE s <> 'running') * 100e0 / count(*)")} AS percentage FROM (SELECT concat('J', CAST(l_orderkey AS STRING)) AS job_id,
  CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'failed' ELSE 'running' END AS s FROM lineitem) x GROUP BY job_id""")
def _(t):
    status = F.when(F.col("l_returnflag") == "A", "completed").when(F.col("l_returnflag") == "R", "failed").otherwise("running")
    tasks = stream_table(t.spark, t._folder, "lineitem").select(
        F.concat(F.lit("J"), F.col("l_orderkey").cast("string")).alias("job_id"), status.alias("status")
    )
    done = latest_updates(drain(job_progress_stream(tasks), "update"), ["job_id"])
    return done.withColumn("percentage", r6("percentage"))


@query("stream_alerts", "M4", "metric_ticks",
       f"""SELECT rule, severity, {ts_sql('fired_at')} AS fired_at FROM (
WITH RECURSIVE b AS (SELECT rule, severity, minutes, tick FROM {BREACHES} x WHERE breached),
f AS (SELECT rule, severity, minutes, min(tick) AS fired_at FROM b GROUP BY rule, severity, minutes
  UNION ALL SELECT f.rule, f.severity, f.minutes, (SELECT min(tick) FROM b WHERE b.rule = f.rule AND b.tick >= f.fired_at + to_minutes(f.minutes)) FROM f
  WHERE f.fired_at IS NOT NULL) SELECT * FROM f WHERE fired_at IS NOT NULL) z""")
def _(t):
    breaches = windows.rule_breaches(tick_metrics(t), TICK_RULES)
    folder = work_folder(t.spark, "ticks")
    breaches.write.parquet(folder)
    closing_tick(t.spark.read.schema(breaches.schema).parquet(folder)).write.mode("append").parquet(folder)
    # the files are in no order of time, so that all of them are one batch
    arriving = t.spark.readStream.schema(breaches.schema).parquet(folder)
    return drain(alert_stream(arriving)).select("rule", "severity", ts("fired_at").alias("fired_at"))


CSV_HEADERS = {
    "provider_id": "Id", "given_name": "First_Name", "family_name": "LastName", "npi_number": "NPI", "phone_primary": "Telephone",
    "email": "E_Mail", "license_number": "License_No", "address_zip": "Zip_Code",
}


def csv_files(t) -> str:
    """The directory written out as CSV files with headers of another make."""
    target = work_folder(t.spark, "csv")
    named = t.directory.select(*[F.col(c).alias(h) for c, h in CSV_HEADERS.items()])
    named.write.csv(target, header=True, escape='"')
    return target


@query("csv_round_trip", "S1 S2 S4", "directory", f"SELECT provider_id, {ERRORS} AS errors, true AS complete FROM ({CANONICAL}) c")
def _(t):
    """Two sets of files, the columns of one in another order, with line breaks and quotes in a value."""
    target = work_folder(t.spark, "csv")
    columns = [F.col(c).alias(h) for c, h in CSV_HEADERS.items()] + [F.lit('first\nsecond, "third"').alias("Notes")]
    for i, order in enumerate((columns, columns[::-1])):
        t.directory.where(F.col("k") % 2 == i).select(*order).write.csv(f"{target}/{i}", header=True, escape='"')
    told = files.check_files(t.spark, f"{target}/*")
    checked = files.read_directory_csv(t.spark, f"{target}/*")
    return checked.rows.select("provider_id", joined_list("errors").alias("errors"), F.lit(told["valid"]).alias("complete"))


@query("json_round_trip", "S6", "directory", "SELECT provider_id, given_name, email, document_path FROM directory")
def _(t):
    target = work_folder(t.spark, "json")
    t.directory.select(*BATCH_FIELDS, F.lit("ignored").alias("other")).write.json(target)
    return files.read_batch_json(t.spark, target).select("provider_id", "given_name", "email", "document_path")


@query("arriving_files", "M8 S1", "directory", f"SELECT provider_id, CASE WHEN {ERRORS} = '' THEN 'good' ELSE 'bad' END AS outcome FROM ({CANONICAL}) c")
def _(t):
    base = work_folder(t.spark, "arrivals")
    schema = ", ".join(f"{h} string" for h in CSV_HEADERS.values())
    validate_arrivals(t.spark, csv_files(t), schema, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    parts = [
        t.spark.read.parquet(f"{base}/out/{o}").select("provider_id", F.lit(o).alias("outcome")) for o in ("good", "bad")
    ]
    return parts[0].unionByName(parts[1])


@query("retry_tasks", "M9", "field_results",
       """SELECT job_id AS task_id, max(line_no) + 1 AS attempt FROM field_results GROUP BY job_id
HAVING bool_or(status = 'invalid') AND NOT bool_or(status = 'valid') AND max(line_no) < 6""")
def _(t):
    return retry_failed(attempts_of(t), 6)


@query("stream_retries", "M9", "field_results",
       """SELECT task_id, attempt, part FROM (SELECT job_id AS task_id, part, max(last) OVER w + 1 AS attempt, bool_or(bad) OVER w AS bad, bool_or(good) OVER w AS good FROM (
  SELECT job_id, CAST(greatest(least((line_no + 1) // 2, 3), 1) AS BIGINT) AS part, max(line_no) AS last, bool_or(status = 'invalid') AS bad, bool_or(status = 'valid') AS good
  FROM field_results GROUP BY 1, 2) x WINDOW w AS (PARTITION BY job_id ORDER BY part)) y WHERE bad AND NOT good AND attempt <= 6""")
def _(t):
    """Results arrive in three parts; the stream is started anew for each and goes on from its state."""
    base = work_folder(t.spark, "retries")
    part = F.greatest(F.least(F.floor((F.col("attempt") + 1) / 2), F.lit(3)), F.lit(1)).cast("long")
    attempts = attempts_of(t).withColumn("part", part)
    schema = attempts.drop("part").schema
    for n in (1, 2, 3):
        attempts.where(F.col("part") == n).drop("part").write.parquet(f"{base}/in/{n}")
        arriving = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{base}/in/*")
        retry_stream(arriving.select("task_id", "status", "attempt"), f"{base}/queue/part={n}", f"{base}/checkpoint", 6).awaitTermination()
    queued = t.spark.read.option("basePath", f"{base}/queue").schema("task_id string, attempt long, part long, batch_id long").parquet(f"{base}/queue/*")
    return queued.select("task_id", "attempt", "part")


@query("audit_partition_totals", "S12 M5", "audit_logs",
       f"SELECT risk_level, date, CAST(count(*) AS BIGINT) AS n FROM (SELECT {RISK} AS risk_level, strftime(logged_at, '%Y-%m-%d') AS date FROM audit_logs) a GROUP BY 1, 2")
def _(t):
    log = audit.with_partitions(audit.with_risk(t.audit_logs))
    return log.groupBy("risk_level", "date").agg(F.count(F.lit(1)).alias("n"))
