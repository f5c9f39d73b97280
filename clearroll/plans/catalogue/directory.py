"""Queries: changes to records, jobs and reviews, and the directory's own figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import edits, filters, metrics, review, windows
from ...sources.derived import AS_OF, REVIEWERS
from .records import r6_sql, ts_sql
from .registry import query, r6, ts


@query("patched_records", "P14", "directory",
       f"""SELECT provider_id, CASE WHEN k % 5 = 0 THEN 'new@example.org' ELSE email END AS email,
  CASE WHEN k % 10 = 0 THEN concat('+1555', CAST(1000000 + k AS STRING)) ELSE phone_primary END AS phone_primary,
  CASE WHEN k % 5 = 0 THEN '2024-01-31 00:00:00' ELSE {ts_sql('updated_at')} END AS updated_at FROM directory""")
def _(t):
    updates = t.directory.where("k % 5 = 0").select(
        "provider_id",
        F.lit("new@example.org").alias("email"),
        F.when(F.col("k") % 10 == 0, F.concat(F.lit("+1555"), (F.col("k") + 1000000).cast("string"))).alias("phone_primary"),
    )
    at = F.lit(AS_OF).cast("timestamp_ntz")
    return edits.patch(t.directory, updates, "provider_id", at).select(
        "provider_id", "email", "phone_primary", ts("updated_at").alias("updated_at")
    )


@query("deleted_records", "P15", "directory", "SELECT provider_id FROM directory WHERE class <> 7")
def _(t):
    return edits.delete_by_key(t.directory, t.directory.where("class = 7"), "provider_id").select("provider_id")


@query("flags_added", "P16", "directory",
       """SELECT provider_id, CAST(CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS flags FROM directory""")
def _(t):
    at = F.lit(AS_OF).cast("timestamp")
    kind = "array<struct<code:string,reason:string,timestamp:timestamp>>"
    mine = F.struct(F.lit("MANUAL").alias("code"), F.lit("seen").alias("reason"), at.alias("timestamp"))
    other = F.struct(F.lit("OTHER").alias("code"), F.lit("seen").alias("reason"), at.alias("timestamp"))
    before = t.directory.withColumn(
        "flags", F.when(F.col("k") % 3 == 0, F.array(mine)).otherwise(F.array(other)).cast(kind)
    )
    return edits.add_flag(before, "MANUAL", "seen", at).select("provider_id", F.size("flags").cast("bigint").alias("flags"))


@query("field_confidence_set", "P17 A9", "directory",
       f"""SELECT provider_id, {r6_sql("(overall_confidence + 0.5e0) / 2")} AS mean_confidence FROM directory""")
def _(t):
    from ...functions.scores import mean_field_confidence

    at = F.lit(AS_OF).cast("timestamp")
    entry = lambda score: F.struct(score.alias("score"), at.alias("updated_at"))
    before = t.directory.withColumn(
        "field_confidence",
        F.create_map(F.lit("email"), entry(F.lit(0.9)), F.lit("npi_number"), entry(F.col("overall_confidence"))),
    )
    after = edits.set_field_confidence(before, "email", 0.5, at)
    plain = F.transform_values("field_confidence", lambda _, v: v["score"])
    return after.select("provider_id", r6(mean_field_confidence(plain)).alias("mean_confidence"))


@query("review_actions", "P18", "directory",
       """SELECT provider_id, CASE k % 6 WHEN 0 THEN 'valid' WHEN 1 THEN 'invalid' WHEN 2 THEN 'warning' WHEN 3 THEN 'pending'
  ELSE validation_status END AS validation_status, CASE WHEN k % 6 = 4 THEN 'R1' END AS assigned_to FROM directory""")
def _(t):
    actions = F.array(*[F.lit(a) for a in ("accept", "reject", "flag", "revalidate", "assign")])
    decisions = t.directory.where("k % 6 < 5").select(
        "provider_id", F.element_at(actions, (F.col("k") % 6 + 1).cast("int")).alias("action"), F.lit("R1").alias("assignee")
    )
    return edits.review_actions(t.directory, decisions).select("provider_id", "validation_status", "assigned_to")


@query("job_transitions", "P19", "jobs",
       """SELECT job_no, CASE WHEN job_no % 3 = 0 AND status = 'failed' THEN 'pending'
    WHEN job_no % 3 = 1 AND status NOT IN ('completed', 'failed') THEN 'cancelled' ELSE status END AS status,
  CASE WHEN job_no % 3 = 0 AND status = 'failed' THEN retry_count + 1 ELSE retry_count END AS retry_count,
  CASE WHEN job_no % 3 = 0 AND status <> 'failed' THEN concat('cannot retry a job that is ', status)
    WHEN job_no % 3 = 1 AND status IN ('completed', 'failed') THEN concat('cannot cancel a job that is ', status) END AS error,
  started_at IS NOT NULL AND NOT (job_no % 3 = 0 AND status = 'failed') AS started FROM jobs""")
def _(t):
    requests = t.jobs.where("job_no % 3 < 2").select(
        "job_id", F.when(F.col("job_no") % 3 == 0, "retry").otherwise("cancel").alias("request")
    )
    return edits.job_transitions(t.jobs, requests).select(
        "job_no", "status", "retry_count", "error", F.col("started_at").isNotNull().alias("started")
    )


@query("new_jobs", "P20", "directory",
       "SELECT concat('job_', provider_id) AS job_id, provider_id, 'pending' AS status, 'medium' AS priority FROM directory")
def _(t):
    return edits.materialise_jobs(t.directory).select("job_id", "provider_id", "status", "priority")


@query("bulk_create", "J8", "directory registry",
       """SELECT provider_id, CASE WHEN npi_number IN (SELECT npi_number FROM registry WHERE registry_status = 'D') THEN concat('already exists: ', npi_number)
  WHEN provider_id <> min(provider_id) OVER (PARTITION BY npi_number) THEN concat('repeated in batch: ', npi_number) ELSE 'created' END AS outcome FROM directory""")
def _(t):
    existing = t.registry.where("registry_status = 'D'").select("npi_number")
    return edits.reject_existing(t.directory.select("provider_id", "npi_number"), existing).select("provider_id", "outcome")


@query("bulk_create_summary", "J8", "directory registry",
       """SELECT CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS created, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS failed FROM (
  SELECT npi_number NOT IN (SELECT npi_number FROM registry WHERE registry_status = 'D') AND provider_id = min(provider_id) OVER (PARTITION BY npi_number) AS ok FROM directory) x""")
def _(t):
    existing = t.registry.where("registry_status = 'D'").select("npi_number")
    return edits.bulk_summary(edits.reject_existing(t.directory.select("provider_id", "npi_number"), existing))


@query("orphan_jobs", "J9", "jobs directory",
       """SELECT job_no, false AS has_parent FROM jobs WHERE provider_id NOT IN (SELECT provider_id FROM directory WHERE k % 9 <> 0)
UNION ALL SELECT job_no, true FROM jobs WHERE provider_id IN (SELECT provider_id FROM directory WHERE k % 9 <> 0)""")
def _(t):
    kept, orphans = edits.require_parent(t.jobs, t.directory.where("k % 9 <> 0"))
    return kept.select("job_no", F.lit(True).alias("has_parent")).unionByName(
        orphans.select("job_no", F.lit(False).alias("has_parent"))
    )


@query("job_results", "J10", "jobs provider_results",
       f"""SELECT r.job_no, j.status AS job_status, round(overall_confidence, 6) AS overall_confidence, {ts_sql('r.created_at')} AS created_at
FROM provider_results r JOIN jobs j ON r.job_id = j.job_id WHERE j.provider_id = 'P11'""")
def _(t):
    return edits.job_results(t.jobs, t.provider_results, provider_id="P11").select(
        "job_no", "job_status", F.round("overall_confidence", 6).alias("overall_confidence"), ts("created_at").alias("created_at")
    )


@query("latest_results", "W1", "provider_results",
       f"""SELECT provider_id, job_no, {ts_sql('created_at')} AS created_at FROM (SELECT *, row_number() OVER (
  PARTITION BY provider_id ORDER BY created_at DESC, job_no DESC) AS rn FROM provider_results) x WHERE rn = 1""")
def _(t):
    return windows.latest_per_key(t.provider_results, "provider_id", "created_at", "job_no").select(
        "provider_id", "job_no", ts("created_at").alias("created_at")
    )


def count_if(test: str, name: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {test}) AS BIGINT) AS {name}"


@query("dashboard_counts", "A20", "directory",
       f"SELECT CAST(count(*) AS BIGINT) AS total, {', '.join(count_if(f'''validation_status = '{s}' ''', s) for s in ('valid', 'pending', 'invalid'))} FROM directory")
def _(t):
    return metrics.dashboard_counts(t.directory)


@query("daily_validations", "A21", "directory",
       """SELECT strftime(last_validated_at, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS validations FROM directory
WHERE last_validated_at >= TIMESTAMP '2024-03-01 00:00:00' GROUP BY 1 ORDER BY 1""")
def _(t):
    return metrics.daily_counts(t.directory, "last_validated_at", "2024-03-01 00:00:00")


@query("status_distribution", "A22", "directory",
       "SELECT validation_status, CAST(count(*) AS BIGINT) AS n FROM directory GROUP BY validation_status")
def _(t):
    return metrics.count_by(t.directory, "validation_status")


STATUS_COUNTS = ", ".join(count_if(f"status = '{s}'", s) for s in ("pending", "running", "completed", "failed"))


@query("queue_status", "A23", "jobs", f"SELECT {STATUS_COUNTS}, CAST(count(*) AS BIGINT) AS total FROM jobs")
def _(t):
    return metrics.queue_status(t.jobs)


@query("queue_by_priority", "A23", "jobs", f"SELECT priority, {STATUS_COUNTS} FROM jobs GROUP BY priority")
def _(t):
    return metrics.queue_by(t.jobs, "priority")


@query("validation_performance", "A24", "jobs",
       f"""SELECT {r6_sql("avg(date_diff('second', started_at, completed_at))")} AS avg_seconds,
  {r6_sql("count(*) FILTER (WHERE status = 'completed') * 100e0 / count(*) FILTER (WHERE status IN ('completed', 'failed'))")} AS success_pct,
  {count_if("status IN ('completed', 'failed')", 'finished')} FROM jobs""")
def _(t):
    return metrics.validation_performance(t.jobs).withColumns(
        {"avg_seconds": r6("avg_seconds"), "success_pct": r6("success_pct")}
    )


@query("retry_distribution", "A24", "jobs", "SELECT retry_count, CAST(count(*) AS BIGINT) AS jobs FROM jobs GROUP BY retry_count")
def _(t):
    return metrics.retry_distribution(t.jobs)


@query("directory_stats", "A25", "directory",
       " UNION ALL ".join(
           f"SELECT '{kind}' AS kind, {label} AS label, CAST(count(*) AS BIGINT) AS n, {r6_sql('avg(overall_confidence)')} AS avg_confidence FROM directory {group}"
           for kind, label, group in (
               ("state", "address_state", "GROUP BY address_state"),
               ("taxonomy", "primary_taxonomy", "GROUP BY primary_taxonomy"),
               ("status", "validation_status", "GROUP BY validation_status"),
               ("all", "CAST(NULL AS STRING)", ""),
           )
       ))
def _(t):
    return metrics.directory_stats(t.directory).withColumn("avg_confidence", r6("avg_confidence"))


@query("job_metrics", "A26", "jobs",
       f"""SELECT CAST(count(*) AS BIGINT) AS total_jobs, {count_if("status = 'completed'", 'completed_jobs')}, {count_if("status = 'failed'", 'failed_jobs')},
  {r6_sql("count(*) FILTER (WHERE status = 'completed') / CAST(count(*) AS DOUBLE)")} AS success_rate FROM jobs""")
def _(t):
    return metrics.job_metrics(t.jobs).withColumn("success_rate", r6("success_rate"))


TASKS = """SELECT job_id, CASE WHEN status = 'valid' THEN 'completed' WHEN status = 'invalid' THEN 'failed' ELSE 'running' END AS status FROM field_results"""


@query("job_progress", "A19", "field_results",
       f"""SELECT job_id, CAST(count(*) AS BIGINT) AS total, {count_if("status = 'completed'", 'completed')}, {count_if("status = 'failed'", 'failed')},
  {r6_sql("count(*) FILTER (WHERE status IN ('completed', 'failed')) * 100e0 / count(*)")} AS percentage FROM ({TASKS}) t GROUP BY job_id""")
def _(t):
    status = (
        F.when(F.col("status") == "valid", "completed").when(F.col("status") == "invalid", "failed").otherwise("running")
    )
    tasks = t.field_results.select("job_id", status.alias("status"))
    return metrics.job_progress(tasks).withColumn("percentage", r6("percentage"))


@query("total_processing_time", "A8b", "jobs",
       f"SELECT provider_id, {r6_sql('sum(job_no % 300)')} AS processing_seconds FROM jobs WHERE completed_at IS NOT NULL GROUP BY provider_id")
def _(t):
    return (
        t.jobs.where("completed_at IS NOT NULL").groupBy("provider_id")
        .agg(F.sum(metrics._seconds("completed_at", "started_at")).alias("s"))
        .select("provider_id", r6("s").alias("processing_seconds"))
    )


@query("accuracy_by_source", "A44", "field_results",
       f"""SELECT source, CAST(count(*) AS BIGINT) AS n, {r6_sql("count(*) FILTER (WHERE status = 'valid') / CAST(count(*) AS DOUBLE)")} AS accuracy
FROM field_results GROUP BY source""")
def _(t):
    return metrics.accuracy_by_source(t.field_results).withColumn("accuracy", r6("accuracy"))


@query("confidence_ranges", "A45", "directory",
       f"""SELECT range, CAST(n AS BIGINT) AS n, {r6_sql('n * 100e0 / sum(n) OVER ()')} AS pct FROM (SELECT
  CASE WHEN overall_confidence >= 0.8e0 THEN 'High' WHEN overall_confidence >= 0.6e0 THEN 'Medium' ELSE 'Low' END AS range, count(*) AS n
  FROM directory GROUP BY 1) x""")
def _(t):
    return metrics.count_by_confidence_range(t.directory).withColumn("pct", r6("pct"))


REVIEW_NO = " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(REVIEWERS))


@query("reviewer_workload", "A46", "jobs",
       f"""SELECT assigned_to, {count_if('completed_at IS NULL', 'assigned')},
  {count_if("strftime(completed_at, '%Y-%m-%d') = '1997-01-15'", 'completed_today')}, {r6_sql('avg(job_no % 300) FILTER (WHERE completed_at IS NOT NULL) / 60')} AS avg_minutes
FROM (SELECT *, CASE job_no % 4 {REVIEW_NO} END AS assigned_to FROM jobs) j WHERE assigned_to IS NOT NULL GROUP BY assigned_to""")
def _(t):
    names = F.array(*[F.lit(r) for r in REVIEWERS])
    queue = t.jobs.withColumns(
        {
            "assigned_to": F.when(F.col("job_no") % 4 < 3, F.element_at(names, (F.col("job_no") % 4 + 1).cast("int"))),
            "assigned_at": F.col("created_at"),
        }
    )
    return metrics.reviewer_workload(queue.drop("job_no"), "1997-01-15 12:00:00").withColumn("avg_minutes", r6("avg_minutes"))


@query("balanced_assignment", "W9", "jobs",
       """SELECT job_id, CAST(position AS BIGINT) AS position, concat('R', CAST(position % 3 + 1 AS STRING)) AS assigned_to FROM (
  SELECT job_id, row_number() OVER (ORDER BY CASE priority WHEN 'urgent' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END,
    created_at, md5(job_id), job_id) - 1 AS position FROM jobs WHERE status = 'pending') x""")
def _(t):
    return review.assign_balanced(t.jobs.where("status = 'pending'"), REVIEWERS).select("job_id", "position", "assigned_to")


@query("recent_jobs", "L1 L3", "jobs",
       f"SELECT job_id, {ts_sql('created_at')} AS created_at FROM jobs ORDER BY created_at DESC, job_id LIMIT 25")
def _(t):
    return filters.recent(t.jobs, "created_at", "job_id", 25).select("job_id", ts("created_at").alias("created_at"))
