"""Counts, rates, histograms and key figures for dashboards and alerts.

Each figure is one aggregate pass: conditional counts instead of one query per
status, and scalar results joined only when they are one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scores
from ..functions.text import is_present
from ..session import written

def _day(c: str) -> Column:
    return F.date_format(F.col(c), "yyyy-MM-dd")


def _seconds(later: str, earlier: str) -> Column:
    """Seconds between two times, to the microsecond."""
    return (
        F.unix_micros(F.col(later).cast("timestamp")) - F.unix_micros(F.col(earlier).cast("timestamp"))
    ) / F.lit(1e6)


def status_counts(df: DataFrame, column: str, statuses: list[str], total: str = "total") -> DataFrame:
    """One row: how many rows have each status, and how many there are."""
    return df.agg(
        F.count(F.lit(1)).alias(total), *[F.count_if(F.col(column) == s).alias(s) for s in statuses]
    )


def dashboard_counts(records: DataFrame) -> DataFrame:
    return status_counts(records, "validation_status", ["valid", "pending", "invalid"])


def daily_counts(df: DataFrame, at: str, since: str | None = None) -> DataFrame:
    kept = df.where(F.col(at) >= F.lit(since).cast("timestamp")) if since else df.where(F.col(at).isNotNull())
    return kept.groupBy(_day(at).alias("day")).agg(F.count(F.lit(1)).alias("validations")).orderBy("day")


def count_by(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))


def queue_status(jobs: DataFrame) -> DataFrame:
    """Jobs per status; the total leaves out any other status (cancelled)."""
    counted = status_counts(jobs, "status", ["pending", "running", "completed", "failed"], "_all")
    total = F.col("pending") + F.col("running") + F.col("completed") + F.col("failed")
    return counted.select("pending", "running", "completed", "failed", total.alias("total"))


def queue_by(jobs: DataFrame, column: str) -> DataFrame:
    return jobs.groupBy(column).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "completed", "failed")]
    )


def validation_performance(jobs: DataFrame) -> DataFrame:
    """Mean run time, success share of finished jobs."""
    finished = F.count_if(F.col("status").isin("completed", "failed"))
    ok = F.count_if(F.col("status") == "completed")
    return jobs.agg(
        F.avg(_seconds("completed_at", "started_at")).alias("avg_seconds"),
        scores.ratio(ok * 100, finished).alias("success_pct"),
        finished.alias("finished"),
    )


def retry_distribution(jobs: DataFrame) -> DataFrame:
    return count_by(jobs, "retry_count", name="jobs")


def job_metrics(jobs: DataFrame) -> DataFrame:
    ok = F.count_if(F.col("status") == "completed")
    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        ok.alias("completed_jobs"),
        F.count_if(F.col("status") == "failed").alias("failed_jobs"),
        scores.ratio(ok, F.count(F.lit(1))).alias("success_rate"),
    )


def job_progress(tasks: DataFrame) -> DataFrame:
    """Per job: tasks completed and failed, finished share of the job's own tasks."""
    done = F.count_if(F.col("status") == "completed")
    failed = F.count_if(F.col("status") == "failed")
    total = F.count(F.lit(1))
    return tasks.groupBy("job_id").agg(
        total.alias("total"),
        done.alias("completed"),
        failed.alias("failed"),
        scores.ratio((done + failed) * 100, total).alias("percentage"),
    )


def directory_stats(records: DataFrame) -> DataFrame:
    """Counts by state, by taxonomy, by status and overall, in one pass.

    Grouping sets, so the records are exchanged once.
    """
    grouped = records.groupingSets(
        [["address_state"], ["primary_taxonomy"], ["validation_status"], []],
        "address_state", "primary_taxonomy", "validation_status",
    ).agg(
        F.grouping_id().alias("_g"),
        F.count(F.lit(1)).alias("n"),
        F.avg("overall_confidence").alias("avg_confidence"),
    )
    kind = (
        F.when(F.col("_g") == 3, "state").when(F.col("_g") == 5, "taxonomy")
        .when(F.col("_g") == 6, "status").otherwise("all")
    )
    label = F.coalesce("address_state", "primary_taxonomy", "validation_status")
    return grouped.select(kind.alias("kind"), label.alias("label"), "n", "avg_confidence")


def validation_rate(results: DataFrame, as_of: str, at: str = "created_at", seconds: int = 3600) -> DataFrame:
    end = F.lit(as_of).cast("timestamp")
    recent = (F.col(at) >= end - F.expr(f"make_dt_interval(0, 0, 0, {seconds})")) & (F.col(at) <= end)
    return results.where(recent).agg(
        F.count(F.lit(1)).alias("recent"),
        (F.count(F.lit(1)) / F.lit(float(seconds))).alias("per_second"),
    )


def high_confidence_pct(results: DataFrame) -> DataFrame:
    high = F.count_if(F.col("overall_confidence") >= K.HIGH)
    return results.agg(scores.ratio(high * 100, F.count(F.lit(1))).alias("high_confidence_pct"))


def manual_review_length(results: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    end = F.lit(as_of).cast("timestamp")
    waiting = (F.col("validation_status") == "warning") & (
        F.col("created_at") >= end - F.expr(f"make_dt_interval({days})")
    )
    return results.where(waiting).agg(F.count(F.lit(1)).alias("queue_length"))


def quality_score(results: DataFrame, records: DataFrame) -> DataFrame:
    """High-confidence results per record; may exceed 1.  Two one-row aggregates."""
    high = results.agg(F.count_if(F.col("overall_confidence") >= K.HIGH).alias("high"))
    total = records.agg(F.count(F.lit(1)).alias("records"))
    return side_by_side(high, total).select(
        "high", "records", scores.ratio(F.col("high"), F.col("records")).alias("quality_score")
    )


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row results as one row: stacked and reduced, so no join is needed."""
    whole = rows[0]
    for row in rows[1:]:
        whole = whole.unionByName(row, allowMissingColumns=True)
    return whole.agg(*[F.max(c).alias(c) for c in whole.columns])


def flagged_count(records: DataFrame, code: str, column: str = "flag_codes") -> DataFrame:
    return records.agg(F.count_if(F.array_contains(F.col(column), code)).alias("flagged"))


def confidence_bands(results: DataFrame) -> DataFrame:
    band = scores.confidence_band("overall_confidence").alias("band")
    return results.groupBy("validation_status", band).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, bounds: list[float], *by: str) -> DataFrame:
    """Cumulative counts at each bound and at +Inf, with sum and count.

    All buckets are counted in one pass; the aggregate row is then unpivoted.
    """
    v = F.col(value)
    counts = [F.count_if(v <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    row = df.groupBy(*by).agg(
        *counts, F.count(v).alias("observations"), F.sum(v).alias("total")
    )
    buckets = F.array(
        *[
            F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("cumulative"))
            for i, b in enumerate(bounds)
        ],
        F.struct(F.lit(float("inf")).alias("le"), F.col("observations").alias("cumulative")),
    )
    return row.select(*by, F.explode(buckets).alias("b"), "observations", "total").select(
        *by, "b.le", "b.cumulative", "observations", "total"
    )


def histogram_quantile(df: DataFrame, value: str, bounds: list[float], q: float, *by: str) -> DataFrame:
    """Quantile estimated from bucket counts by linear interpolation.

    A rank beyond the last bound answers that bound, as there is nothing to
    interpolate towards.
    """
    v = F.col(value)
    counts = [F.count_if(v <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    row = df.groupBy(*by).agg(*counts, F.count(v).alias("observations"))
    rank = F.col("observations") * F.lit(q)
    answer = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low = F.lit(0.0 if i == 0 else float(bounds[i - 1]))
        below = F.lit(0) if i == 0 else F.col(f"_b{i - 1}")
        inside = F.col(f"_b{i}") - below
        step = scores.ratio(rank - below, inside)
        answer = F.when(F.col(f"_b{i}") >= rank, low + (F.lit(float(bounds[i])) - low) * step).otherwise(answer)
    return row.select(
        *by, "observations", F.when(F.col("observations") > 0, answer).alias("quantile")
    )


def exact_quantiles(df: DataFrame, value: str, qs: list[float], *by: str, parts: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, for groups of any size.

    Rows are counted per group and value first, on the map side already.  The counts are
    cut into ranges of group and value, whatever shares groups have, and written; what
    stands before a range is the sum of its group's ranges before it, so a running count
    inside a range tells every value's rank.  No step holds a group, and rows are joined
    with nothing: only their counts meet the sums of their range.
    """
    by_or_one = [F.col(c) for c in by] or [F.lit(1)]
    group = F.struct(*by_or_one).alias("_g")  # in a struct null equals null
    counts = df.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("_v")).groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_n"))
    number = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = written(counts.repartitionByRange(number, "_g", "_v").withColumn("_p", F.spark_partition_id()), "values")
    sums = ranges.groupBy("_g", "_p").agg(F.sum("_n").alias("_s"))
    ahead = Window.partitionBy("_g").orderBy("_p")  # as many rows as there are ranges
    sums = sums.select(
        F.col("_g").alias("_h"), F.col("_p").alias("_q"),
        (F.sum("_s").over(ahead) - F.col("_s")).alias("_before"), F.sum("_s").over(Window.partitionBy("_g")).alias("_total"),
    )
    placed = ranges.join(sums, (F.col("_g") == F.col("_h")) & (F.col("_p") == F.col("_q")))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("_g", "_p").orderBy("_v"))
    ordered = placed.withColumn("_upto", upto)

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") > rank, F.col("_v")))

    rank = [F.lit(float(q)) * (F.col("_total") - 1) for q in qs]
    ends = [c for i, r in enumerate(rank) for c in (at(F.floor(r)).alias(f"_a{i}"), at(F.ceil(r)).alias(f"_b{i}"))]
    picked = ordered.groupBy("_g").agg(*ends, F.max("_total").alias("_total"))
    exact = [
        (F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (r - F.floor(r))).alias(f"p{int(q * 100)}")
        for i, (q, r) in enumerate(zip(qs, rank))
    ]
    return picked.select(*[F.col(f"_g.{c}").alias(c) for c in by], *exact)


def approx_quantiles(df: DataFrame, value: str, qs: list[float], *by: str, accuracy: int = 10000) -> DataFrame:
    return df.groupBy(*by).agg(
        *[F.percentile_approx(F.col(value), q, accuracy).alias(f"p{int(q * 100)}") for q in qs]
    )


def labelled_counter(df: DataFrame, *labels: str) -> DataFrame:
    return count_by(df, *labels, name="total")


def service_ratios(log: DataFrame, *by: str) -> DataFrame:
    """Cache hit share, mean duration and error share of a request log."""
    return log.groupBy(*by).agg(
        scores.ratio(
            F.count_if(F.col("cache") == "hit") * 100, F.count_if(F.col("cache").isin("hit", "miss"))
        ).alias("cache_hit_pct"),
        scores.ratio(F.sum("duration_seconds"), F.count("duration_seconds")).alias("avg_duration"),
        scores.ratio(F.count_if(F.col("status") == "error"), F.count(F.lit(1))).alias("error_rate"),
    )


def failure_rate(jobs: DataFrame) -> DataFrame:
    failed = F.count_if(F.col("status") == "failed")
    return jobs.agg(scores.ratio(failed, F.count(F.lit(1))).alias("failure_rate"))


def dashboard_metrics(records: DataFrame, results: DataFrame, jobs: DataFrame, log: DataFrame, as_of: str) -> DataFrame:
    """The key-figure row: one aggregate per table, four rows made one."""
    end = F.lit(as_of).cast("timestamp")
    hour = F.expr("make_dt_interval(0, 1)")
    week = F.expr("make_dt_interval(7)")
    of_results = results.agg(
        F.count(F.lit(1)).alias("total_validations"),
        (F.count_if((F.col("created_at") >= end - hour) & (F.col("created_at") <= end)) / F.lit(3600.0)).alias(
            "validations_per_second"
        ),
        scores.ratio(F.count_if(F.col("overall_confidence") >= K.HIGH) * 100, F.count(F.lit(1))).alias(
            "high_confidence_percentage"
        ),
        F.count_if((F.col("validation_status") == "warning") & (F.col("created_at") >= end - week)).alias(
            "manual_review_queue_length"
        ),
        F.count_if(F.col("overall_confidence") >= K.HIGH).alias("_high"),
    )
    of_records = records.agg(
        F.count(F.lit(1)).alias("_records"),
        F.count_if(F.array_contains("flag_codes", "COMPLIANCE_VIOLATION")).alias("compliance_violations"),
    )
    of_jobs = jobs.agg(
        F.avg(_seconds("completed_at", "started_at")).alias("avg_validation_latency"),
        F.count_if(F.col("status") == "running").alias("active_workers"),
        F.count_if(F.col("status") == "failed").alias("failed_jobs"),
    )
    of_log = log.agg(
        F.count(F.lit(1)).alias("api_requests_total"),
        F.count_if(F.col("status") == "error").alias("external_api_errors"),
        scores.ratio(F.count_if(F.col("cache") == "hit") * 100, F.count("cache")).alias("cache_hit_rate"),
        scores.ratio(F.sum("duration_seconds"), F.count("duration_seconds")).alias("external_api_avg_duration"),
    )
    row = side_by_side(of_results, of_records, of_jobs, of_log)
    health = scores.health_score("manual_review_queue_length", "active_workers", "failed_jobs")
    return (
        row.withColumn("data_quality_score", scores.ratio(F.col("_high"), F.col("_records")))
        .withColumn("_health", health)
        .withColumn("health_score", F.col("_health.score"))
        .withColumn("health_status", F.col("_health.status"))
        .drop("_high", "_records", "_health")
    )


def alert_summary(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("resolved_at").isNull()).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def alert_history(alerts: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    end = F.lit(as_of).cast("timestamp")
    since = end - F.expr(f"make_dt_interval(0, {hours})")
    kept = alerts.where((F.col("fired_at") >= since) & (F.col("fired_at") <= end))
    return kept.orderBy(F.col("fired_at").desc(), "rule")


def resolve_alerts(alerts: DataFrame, resolved: DataFrame, at: str) -> DataFrame:
    """Set the end time of the alerts listed (alert_id) that are still active."""
    hit = alerts.join(resolved.select("alert_id", F.lit(True).alias("_hit")), "alert_id", "left")
    closing = F.col("_hit") & F.col("resolved_at").isNull()
    stamp = F.when(closing, F.lit(at).cast(alerts.schema["resolved_at"].dataType)).otherwise(F.col("resolved_at"))
    return hit.withColumn("resolved_at", stamp).drop("_hit")


def accuracy_by_source(results: DataFrame) -> DataFrame:
    return results.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        scores.ratio(F.count_if(F.col("status") == "valid"), F.count(F.lit(1))).alias("accuracy"),
    )


def count_by_confidence_range(records: DataFrame) -> DataFrame:
    """High, medium and low counts with their share; the share is over three rows."""
    counted = records.groupBy(scores.confidence_range("overall_confidence").alias("range")).agg(
        F.count(F.lit(1)).alias("n")
    )
    everything = Window.partitionBy(F.lit(1))
    return counted.withColumn("pct", F.col("n") * 100 / F.sum("n").over(everything))


def reviewer_workload(queue: DataFrame, as_of: str) -> DataFrame:
    """Per reviewer: assigned, completed today, mean handling time in minutes."""
    today = F.date_format(F.lit(as_of).cast("timestamp"), "yyyy-MM-dd")
    return queue.where(is_present("assigned_to")).groupBy("assigned_to").agg(
        F.count_if(F.col("completed_at").isNull()).alias("assigned"),
        F.count_if(_day("completed_at") == today).alias("completed_today"),
        (F.avg(_seconds("completed_at", "assigned_at")) / 60).alias("avg_minutes"),
    )


def idempotency_metrics(keys: DataFrame, as_of: str) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    status = F.when(F.col("expires_at") < now, "expired").otherwise(F.coalesce("status", F.lit("pending")))
    return keys.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def ingest_summary(rows: DataFrame) -> DataFrame:
    """Counts of a row-checked input (``errors`` array): read, valid, rejected, error texts; and its warnings."""
    counts = rows.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(F.size("errors") == 0).alias("valid_rows"),
        F.count_if(F.size("errors") > 0).alias("rejected_rows"),
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("error_count"),
    )
    none = F.when(F.col("valid_rows") == 0, F.lit("No valid provider records found in CSV"))
    some = F.when(
        F.col("valid_rows") < F.col("rows_read"),
        F.format_string("Only %d out of %d rows were processed successfully", "valid_rows", "rows_read"),
    )
    return counts.withColumn("warnings", F.array_compact(F.array(none, some)))


def ingest_errors(rows: DataFrame, row_id: str = "provider_id") -> DataFrame:
    """Every error of every rejected row: the row's id and the text."""
    return rows.select(row_id, F.explode("errors").alias("error"))


def document_confidence(pages: DataFrame, fields: DataFrame) -> DataFrame:
    """Per document: confidence of its text by length, of its fields by mean, and of both.

    ``pages`` has doc_id and text, ``fields`` doc_id and confidence.
    """
    by_text = pages.groupBy("doc_id").agg(F.sum(F.length("text")).alias("_size")).select(
        "doc_id",
        F.when(F.col("_size") > 100, 0.8).when(F.col("_size") > 50, 0.6).otherwise(0.4).alias("text_confidence"),
    )
    by_field = fields.groupBy("doc_id").agg(F.avg("confidence").alias("field_confidence"))
    joined = by_text.join(by_field, "doc_id", "full")
    t, f = F.coalesce("text_confidence", F.lit(0.0)), F.coalesce("field_confidence", F.lit(0.0))
    whole = F.when((t > 0) & (f > 0), (t + f) / 2).when(f > 0, f).otherwise(t)
    return joined.select(
        "doc_id", t.alias("text_confidence"), scores.stable(f).alias("field_confidence"),
        scores.stable(whole).alias("confidence"),
    )


def rate_usage(log: DataFrame, as_of: str, seconds: int = 60) -> DataFrame:
    """Requests of the trailing span per connector, as a share of its minute limit."""
    end = F.lit(as_of).cast("timestamp")
    start = end - F.expr(f"make_dt_interval(0, 0, 0, {seconds})")
    recent = log.where((F.col("requested_at") > start) & (F.col("requested_at") <= end))
    limits = {c: float(per_minute) for c, (_, per_minute) in K.CONNECTOR_LIMITS.items()}
    limit = scores.weight_of("connector", limits, 0.0)
    return recent.groupBy("connector").agg(F.count(F.lit(1)).alias("requests")).withColumn(
        "used_pct", scores.ratio(F.col("requests") * 100, limit)
    )
