"""Queries: rates, histograms, key figures, limits and alerts over logs and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import constants as K
from ...functions import scores
from ...operators import metrics, rules, windows
from .records import r6_sql, ts_sql, weights_case
from .registry import query, r6, ts

NOW = "2001-06-30 12:00:00"
HIGH = "count(*) FILTER (WHERE overall_confidence >= 0.8e0)"


@query("validation_rate", "A27", "provider_results",
       f"""SELECT CAST(count(*) AS BIGINT) AS recent, {r6_sql('count(*) / 604800e0')} AS per_second FROM provider_results
WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS AND created_at <= TIMESTAMP '{NOW}'""")
def _(t):
    return metrics.validation_rate(t.provider_results, NOW, seconds=604800).withColumn("per_second", r6("per_second"))


@query("high_confidence_pct", "A28", "provider_results",
       f"SELECT {r6_sql(f'{HIGH} * 100e0 / count(*)')} AS high_confidence_pct FROM provider_results")
def _(t):
    return metrics.high_confidence_pct(t.provider_results).withColumn("high_confidence_pct", r6("high_confidence_pct"))


@query("manual_review_length", "A29", "provider_results",
       f"""SELECT CAST(count(*) AS BIGINT) AS queue_length FROM provider_results WHERE validation_status = 'warning'
  AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS""")
def _(t):
    return metrics.manual_review_length(t.provider_results, NOW)


@query("quality_score", "A30", "provider_results directory",
       f"""SELECT CAST(h AS BIGINT) AS high, CAST(n AS BIGINT) AS records, {r6_sql('h / CAST(n AS DOUBLE)')} AS quality_score FROM
  (SELECT {HIGH} AS h FROM provider_results) a, (SELECT count(*) AS n FROM directory) b""")
def _(t):
    return metrics.quality_score(t.provider_results, t.directory).withColumn("quality_score", r6("quality_score"))


@query("compliance_violations", "A31", "directory",
       "SELECT CAST(count(*) FILTER (WHERE list_contains(flag_codes, 'COMPLIANCE_VIOLATION')) AS BIGINT) AS flagged FROM directory")
def _(t):
    return metrics.flagged_count(t.directory, "COMPLIANCE_VIOLATION")


@query("confidence_bands", "A32", "provider_results",
       """SELECT validation_status, CASE WHEN overall_confidence >= 0.9e0 THEN 'high' WHEN overall_confidence >= 0.8e0 THEN 'good'
  WHEN overall_confidence >= 0.6e0 THEN 'medium' WHEN overall_confidence >= 0.4e0 THEN 'low' ELSE 'very_low' END AS band, CAST(count(*) AS BIGINT) AS n
FROM provider_results GROUP BY 1, 2""")
def _(t):
    return metrics.confidence_bands(t.provider_results)


BOUNDS = K.BUCKETS["confidence"]
BUCKET_ROWS = " UNION ALL ".join(
    f"SELECT field_name, {float(b)}e0 AS le, CAST(count(*) FILTER (WHERE confidence <= {float(b)}e0) AS BIGINT) AS cumulative, CAST(count(confidence) AS BIGINT) AS observations FROM field_results GROUP BY field_name"
    for b in BOUNDS
)


@query("confidence_histogram", "A33", "field_results",
       f"""SELECT field_name, CAST(le AS DOUBLE) AS le, cumulative, observations FROM ({BUCKET_ROWS}
UNION ALL SELECT field_name, 1e308, CAST(count(*) AS BIGINT), CAST(count(confidence) AS BIGINT) FROM field_results GROUP BY field_name) x""")
def _(t):
    done = metrics.histogram(t.field_results, "confidence", BOUNDS, "field_name").drop("total")
    return done.withColumn("le", F.when(F.col("le") > 1e308, F.lit(1e308)).otherwise(F.col("le")))


LATENCY = K.BUCKETS["validation_seconds"]


def quantile_sql(q: float) -> str:
    answer = f"{float(LATENCY[-1])}e0"
    for i in reversed(range(len(LATENCY))):
        low = 0.0 if i == 0 else float(LATENCY[i - 1])
        below = "0" if i == 0 else f"b{i - 1}"
        answer = f"CASE WHEN b{i} >= n * {q}e0 THEN {low}e0 + ({float(LATENCY[i])}e0 - {low}e0) * coalesce((n * {q}e0 - {below}) / nullif(CAST(b{i} - {below} AS DOUBLE), 0), 0) ELSE {answer} END"
    return answer


@query("latency_quantiles", "A34", "request_log",
       f"""SELECT connector, CAST(n AS BIGINT) AS observations, {r6_sql(quantile_sql(0.95))} AS p95 FROM (SELECT connector, count(*) AS n,
  {', '.join(f'count(*) FILTER (WHERE duration_seconds <= {float(b)}e0) AS b{i}' for i, b in enumerate(LATENCY))} FROM request_log GROUP BY connector) x""")
def _(t):
    done = metrics.histogram_quantile(t.request_log, "duration_seconds", LATENCY, 0.95, "connector")
    return done.select("connector", "observations", r6("quantile").alias("p95"))


@query("exact_latency_quantiles", "A34", "request_log",
       f"""SELECT connector, {', '.join(f"{r6_sql(f'quantile_cont(duration_seconds, {q}e0)')} AS p{int(q * 100)}" for q in (0.5, 0.95, 0.99))} FROM request_log GROUP BY connector""")
def _(t):
    done = metrics.exact_quantiles(t.request_log, "duration_seconds", [0.5, 0.95, 0.99], "connector")
    return done.select("connector", *[r6(p).alias(p) for p in ("p50", "p95", "p99")])


@query("request_counters", "A35", "request_log",
       "SELECT connector, status, CAST(count(*) AS BIGINT) AS total FROM request_log GROUP BY connector, status")
def _(t):
    return metrics.labelled_counter(t.request_log, "connector", "status")


@query("service_ratios", "A36", "request_log",
       f"""SELECT connector, {r6_sql("count(*) FILTER (WHERE cache = 'hit') * 100e0 / count(*)")} AS cache_hit_pct, {r6_sql('avg(duration_seconds)')} AS avg_duration,
  {r6_sql("count(*) FILTER (WHERE status = 'error') / CAST(count(*) AS DOUBLE)")} AS error_rate FROM request_log GROUP BY connector""")
def _(t):
    done = metrics.service_ratios(t.request_log, "connector")
    return done.withColumns({c: r6(c) for c in ("cache_hit_pct", "avg_duration", "error_rate")})


@query("failure_rate", "A36 A31", "jobs",
       f"SELECT {r6_sql('''count(*) FILTER (WHERE status = 'failed') / CAST(count(*) AS DOUBLE)''')} AS failure_rate FROM jobs")
def _(t):
    return metrics.failure_rate(t.jobs).withColumn("failure_rate", r6("failure_rate"))


@query("health_by_priority", "A37", "jobs",
       f"""SELECT priority, {r6_sql('s')} AS score, CASE WHEN round(s, 9) > 0.7e0 THEN 'healthy' WHEN round(s, 9) > 0.4e0 THEN 'degraded' ELSE 'unhealthy' END AS status
FROM (SELECT priority, greatest(0e0, 1e0 - CASE WHEN count(*) FILTER (WHERE status = 'pending') > 100 THEN 0.2e0 ELSE 0e0 END
  - CASE WHEN count(*) FILTER (WHERE status = 'running') = 0 THEN 0.5e0 ELSE 0e0 END - CASE WHEN count(*) FILTER (WHERE status = 'failed') > 10 THEN 0.3e0 ELSE 0e0 END) AS s
  FROM jobs GROUP BY priority) x""")
def _(t):
    counts = metrics.queue_by(t.jobs, "priority")
    done = counts.withColumn("h", scores.health_score("pending", "running", "failed"))
    return done.select("priority", r6("h.score").alias("score"), "h.status")


@query("dashboard_metrics", "A38", "directory provider_results jobs request_log",
       f"""SELECT CAST(total AS BIGINT) AS total_validations, {r6_sql('recent / 3600e0')} AS validations_per_second, {r6_sql('high * 100e0 / total')} AS high_confidence_percentage,
  CAST(queue AS BIGINT) AS manual_review_queue_length, CAST(violations AS BIGINT) AS compliance_violations, {r6_sql('latency')} AS avg_validation_latency,
  CAST(workers AS BIGINT) AS active_workers, CAST(failed AS BIGINT) AS failed_jobs, CAST(requests AS BIGINT) AS api_requests_total, CAST(errors AS BIGINT) AS external_api_errors,
  {r6_sql('hits * 100e0 / requests')} AS cache_hit_rate, {r6_sql('duration')} AS external_api_avg_duration, {r6_sql('high / CAST(records AS DOUBLE)')} AS data_quality_score,
  {r6_sql('health')} AS health_score, CASE WHEN round(health, 9) > 0.7e0 THEN 'healthy' WHEN round(health, 9) > 0.4e0 THEN 'degraded' ELSE 'unhealthy' END AS health_status
FROM (SELECT *, greatest(0e0, 1e0 - CASE WHEN queue > 100 THEN 0.2e0 ELSE 0e0 END - CASE WHEN workers = 0 THEN 0.5e0 ELSE 0e0 END - CASE WHEN failed > 10 THEN 0.3e0 ELSE 0e0 END) AS health FROM
 (SELECT count(*) AS total, {HIGH} AS high, count(*) FILTER (WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 1 HOUR AND created_at <= TIMESTAMP '{NOW}') AS recent,
    count(*) FILTER (WHERE validation_status = 'warning' AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS) AS queue FROM provider_results) a,
 (SELECT count(*) AS records, count(*) FILTER (WHERE list_contains(flag_codes, 'COMPLIANCE_VIOLATION')) AS violations FROM directory) b,
 (SELECT avg(date_diff('second', started_at, completed_at)) AS latency, count(*) FILTER (WHERE status = 'running') AS workers, count(*) FILTER (WHERE status = 'failed') AS failed FROM jobs) c,
 (SELECT count(*) AS requests, count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE cache = 'hit') AS hits, avg(duration_seconds) AS duration FROM request_log) d) x""")
def _(t):
    row = metrics.dashboard_metrics(t.directory, t.provider_results, t.jobs, t.request_log, NOW)
    doubles = [c for c, kind in row.dtypes if kind == "double"]
    return row.withColumns({c: r6(c) for c in doubles})


@query("rate_usage", "A49", "request_log",
       f"""SELECT connector, CAST(count(*) AS BIGINT) AS requests, {r6_sql(f"count(*) * 100e0 / {weights_case('connector', {c: float(m) for c, (_, m) in K.CONNECTOR_LIMITS.items()}, 1.0)}")} AS used_pct
FROM request_log WHERE requested_at > TIMESTAMP '2024-01-15 00:00:00' AND requested_at <= TIMESTAMP '2024-01-16 00:00:00' GROUP BY connector""")
def _(t):
    return metrics.rate_usage(t.request_log, "2024-01-16 00:00:00", 86400).withColumn("used_pct", r6("used_pct"))


@query("idempotency_metrics", "A43", "idempotency",
       """SELECT CASE WHEN expires_at < TIMESTAMP '2024-01-20 00:00:00' THEN 'expired' ELSE status END AS status, CAST(count(*) AS BIGINT) AS n
FROM idempotency GROUP BY 1""")
def _(t):
    return metrics.idempotency_metrics(t.idempotency, "2024-01-20 00:00:00")


# -- limits and alerts ---------------------------------------------------------------------

MINUTE_LIMIT = {"npi_registry": 3, "google_places": 3, "state_board": 2, "enrichment": 2}
LIMIT_CASE = weights_case("connector", {c: float(m) for c, m in MINUTE_LIMIT.items()}, 1e9)


@query("sliding_limits", "W4", "request_log",
       f"""SELECT connector, strftime(seen, '%Y-%m-%d %H:%M:%S.%f') AS seen_at, CAST(requests AS BIGINT) AS requests, CAST(in_window AS BIGINT) AS in_window, in_window > {LIMIT_CASE} AS over_limit,
  coalesce(us - lag(us) OVER (PARTITION BY connector ORDER BY us) < 1000, false) OR requests > 1 AS too_close
FROM (SELECT connector, seen, us, requests, sum(requests) OVER (PARTITION BY connector ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window
  FROM (SELECT connector, requested_at AS seen, epoch_us(requested_at) AS us, count(*) AS requests FROM request_log GROUP BY ALL) c) x""")
def _(t):
    limits = {c: (1000.0, m) for c, m in MINUTE_LIMIT.items()}
    done = windows.sliding_limit(t.request_log, "connector", "requested_at", limits, seconds=3600)
    return done.select(
        "connector", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("seen_at"), "requests", "in_window", "over_limit", "too_close"
    )


@query("fixed_limits", "W5", "request_log",
       " UNION ALL ".join(
           f"""SELECT client, CAST({s} AS BIGINT) AS span, CAST(epoch_us(requested_at) // 1000000 // {s} * {s} AS BIGINT) AS start, CAST({limit} AS BIGINT) AS "limit",
  CAST(count(*) AS BIGINT) AS requests, CAST(greatest(count(*) - {limit}, 0) AS BIGINT) AS over FROM request_log GROUP BY 1, 2, 3"""
           for s, limit in ((60, 2), (3600, 3), (86400, 40))
       ))
def _(t):
    return windows.fixed_limits(t.request_log, "client", "requested_at", {60: 2, 3600: 3, 86400: 40})


@query("request_bursts", "W5", "request_log",
       """SELECT client, CAST(opened AS BIGINT) AS opened, CAST((SELECT count(*) FROM request_log l WHERE l.client = z.client AND epoch_us(l.requested_at) // 1000000 >= opened
    AND epoch_us(l.requested_at) // 1000000 < opened + 1800) AS BIGINT) AS requests,
  CAST(greatest((SELECT count(*) FROM request_log l WHERE l.client = z.client AND epoch_us(l.requested_at) // 1000000 >= opened
    AND epoch_us(l.requested_at) // 1000000 < opened + 1800) - 2, 0) AS BIGINT) AS over FROM (
WITH RECURSIVE s AS (SELECT DISTINCT client, epoch_us(requested_at) // 1000000 AS sec FROM request_log),
b AS (SELECT client, min(sec) AS opened FROM s GROUP BY client
  UNION ALL SELECT n.client, n.sec FROM b, LATERAL (SELECT s.client, s.sec FROM s WHERE s.client = b.client AND s.sec >= b.opened + 1800 ORDER BY s.sec LIMIT 1) n)
SELECT * FROM b) z""")
def _(t):
    return windows.burst_limits(t.request_log, "client", "requested_at", seconds=1800, limit=2).select(
        "client", "opened", "requests", "over"
    )


def tick_metrics(t):
    """The hourly metrics rows with the names that alert conditions use."""
    return t.metric_ticks.select(
        "tick",
        F.col("requests").alias("manual_review_queue_length"),
        (F.col("failures") / F.col("requests")).alias("failure_rate"),
        (F.col("requests") / 3600.0).alias("provider_validations_per_second"),
        F.col("failures").alias("security_events_increase"),
    )


TICK_RULES = {
    "queue": ("manual_review_queue_length > 14", "warning", 180),
    "failures": ("failure_rate > 0.1", "critical", 120),
    "slow": ("provider_validations_per_second < 0.004", "warning", 60),
}
TICK_CASES = " UNION ALL ".join(
    f"SELECT '{n}' AS rule, '{sev}' AS severity, CAST({m} AS BIGINT) AS minutes, tick, {cond} AS breached FROM m"
    for n, (cond, sev, m) in TICK_RULES.items()
)
BREACHES = f"""(WITH m AS (SELECT tick, requests AS manual_review_queue_length, failures / CAST(requests AS DOUBLE) AS failure_rate,
  requests / 3600e0 AS provider_validations_per_second FROM metric_ticks) {TICK_CASES})"""


@query("rule_breaches", "X2", "metric_ticks",
       f"SELECT rule, severity, CAST(count(*) AS BIGINT) AS ticks, CAST(count(*) FILTER (WHERE breached) AS BIGINT) AS breaches FROM {BREACHES} b GROUP BY rule, severity")
def _(t):
    found = windows.rule_breaches(tick_metrics(t), rules.alert_rules(TICK_RULES, list(K.ALERT_RULES)))
    return found.groupBy("rule", "severity").agg(
        F.count(F.lit(1)).alias("ticks"), F.count_if("breached").alias("breaches")
    )


DEFAULT_CASES = " UNION ALL ".join(
    f"SELECT '{n}' AS rule, '{sev}' AS severity, {cond} AS breached FROM m" for n, (cond, sev, _) in K.ALERT_RULES.items()
)


@query("default_rule_breaches", "X2", "metric_ticks",
       f"""SELECT rule, severity, CAST(count(*) AS BIGINT) AS ticks, CAST(count(*) FILTER (WHERE breached) AS BIGINT) AS breaches FROM (
WITH m AS (SELECT tick, requests * 6 AS manual_review_queue_length, requests / 36e0 AS provider_validations_per_second, requests % 7 AS validation_workers_active,
  failures / CAST(requests AS DOUBLE) AS failure_rate, 100 - failures * 100e0 / requests AS provider_high_confidence_percentage,
  failures / (requests * 2e0) AS external_api_error_rate, failures AS security_events_total, requests % 11 AS database_connections_active FROM metric_ticks)
{DEFAULT_CASES}) b GROUP BY rule, severity""")
def _(t):
    """The nine default rules over a metrics row that has all their figures."""
    asked, bad = F.col("requests"), F.col("failures")
    row = t.metric_ticks.select(
        "tick",
        (asked * 6).alias("manual_review_queue_length"),
        (asked / 36.0).alias("provider_validations_per_second"),
        (asked % 7).alias("validation_workers_active"),
        (bad / asked).alias("failure_rate"),
        (100 - bad * 100.0 / asked).alias("provider_high_confidence_percentage"),
        (bad / (asked * 2.0)).alias("external_api_error_rate"),
        bad.alias("security_events_total"),
        (asked % 11).alias("database_connections_active"),
    )
    found = windows.rule_breaches(row, rules.alert_rules())
    return found.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("ticks"), F.count_if("breached").alias("breaches"))


@query("sustained_alerts", "W3", "metric_ticks",
       f"""SELECT rule, severity, {ts_sql('min(tick)')} AS since, {ts_sql('max(tick)')} AS until, CAST(count(*) AS BIGINT) AS ticks FROM (
  SELECT *, row_number() OVER (PARTITION BY rule ORDER BY tick) - row_number() OVER (PARTITION BY rule, breached ORDER BY tick) AS island FROM {BREACHES} b) x
WHERE breached GROUP BY rule, severity, minutes, island HAVING date_diff('minute', min(tick), max(tick)) >= minutes""")
def _(t):
    found = windows.sustained(windows.rule_breaches(tick_metrics(t), TICK_RULES))
    return found.select("rule", "severity", ts("since").alias("since"), ts("until").alias("until"), "ticks")


@query("fired_alerts", "W2", "metric_ticks",
       f"""SELECT rule, severity, {ts_sql('fired_at')} AS fired_at FROM (
WITH RECURSIVE b AS (SELECT rule, severity, minutes, tick FROM {BREACHES} x WHERE breached),
f AS (SELECT rule, severity, minutes, min(tick) AS fired_at FROM b GROUP BY rule, severity, minutes
  UNION ALL SELECT f.rule, f.severity, f.minutes, (SELECT min(tick) FROM b WHERE b.rule = f.rule AND b.tick >= f.fired_at + to_minutes(f.minutes)) FROM f
  WHERE f.fired_at IS NOT NULL) SELECT * FROM f WHERE fired_at IS NOT NULL) z""")
def _(t):
    fired = windows.alert_cooldown(windows.rule_breaches(tick_metrics(t), TICK_RULES))
    return fired.select("rule", "severity", ts("fired_at").alias("fired_at"))


def alerts(t):
    """Alerts made of the jobs: failed ones critical, pending ones warning; finished ones resolved."""
    return t.jobs.where("status IN ('failed', 'pending')").select(
        F.col("job_id").alias("alert_id"),
        F.col("priority").alias("rule"),
        F.when(F.col("status") == "failed", "critical").otherwise("warning").alias("severity"),
        F.col("created_at").alias("fired_at"),
        F.when(F.col("job_no") % 4 == 0, F.col("created_at")).alias("resolved_at"),
    )


@query("alert_summary", "A39", "jobs",
       """SELECT CASE WHEN status = 'failed' THEN 'critical' ELSE 'warning' END AS severity, CAST(count(*) AS BIGINT) AS n FROM jobs
WHERE status IN ('failed', 'pending') AND job_no % 4 <> 0 AND job_no % 3 <> 0 GROUP BY 1""")
def _(t):
    known = alerts(t)
    closing = t.jobs.where("job_no % 3 = 0").select(F.col("job_id").alias("alert_id"))
    return metrics.alert_summary(metrics.resolve_alerts(known, closing, NOW))


@query("alert_history", "A39", "jobs",
       f"""SELECT job_id AS alert_id, {ts_sql('created_at')} AS fired_at FROM jobs WHERE status IN ('failed', 'pending')
  AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 2400 HOURS AND created_at <= TIMESTAMP '{NOW}'""")
def _(t):
    return metrics.alert_history(alerts(t), NOW, 2400).select("alert_id", ts("fired_at").alias("fired_at"))


@query("request_rates", "W6 M1", "request_log",
       f"""SELECT connector, {ts_sql("time_bucket(INTERVAL 5 MINUTES, requested_at, TIMESTAMP '1970-01-01 00:00:00')")} AS window_start, CAST(count(*) AS BIGINT) AS increase,
  {r6_sql('count(*) / 300e0')} AS per_second FROM request_log GROUP BY 1, 2""")
def _(t):
    done = windows.rate_per_window(t.request_log, "requested_at", 5, "connector")
    return done.select("connector", ts("window_start").alias("window_start"), "increase", r6("per_second").alias("per_second"))


@query("counter_increases", "W6", "request_log",
       """SELECT connector, day, CAST(CASE WHEN before IS NULL THEN NULL WHEN v < before THEN v ELSE v - before END AS BIGINT) AS increase FROM (
  SELECT connector, day, v, lag(v) OVER (PARTITION BY connector ORDER BY day) AS before FROM (
   SELECT connector, strftime(requested_at, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS v FROM request_log GROUP BY 1, 2) a) b""")
def _(t):
    samples = t.request_log.groupBy("connector", F.date_format("requested_at", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("v")
    )
    return windows.counter_increase(samples, "connector", "day", "v").select("connector", "day", "increase")


@query("period_changes", "W7", "request_log",
       """SELECT connector, day, v - before AS change, CASE WHEN v > before THEN 'up' WHEN v < before THEN 'down' WHEN v = before THEN 'flat' END AS trend FROM (
  SELECT connector, day, v, lag(v) OVER (PARTITION BY connector ORDER BY day) AS before FROM (
   SELECT connector, strftime(requested_at, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS v FROM request_log GROUP BY 1, 2) a) b""")
def _(t):
    series = t.request_log.groupBy("connector", F.date_format("requested_at", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("v")
    )
    return windows.period_change(series, "connector", "day", "v").select("connector", "day", "change", "trend")
