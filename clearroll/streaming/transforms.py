"""Stream transforms; event time is always a column of the data."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.audit import high_risk
from .ordered import INSTANT, in_order

LATE = "10 minutes"


def _timed(df: DataFrame, at: str, late: str) -> DataFrame:
    """Event time as a zoned timestamp, with a watermark."""
    return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def validation_rate_stream(events: DataFrame, at: str, span: str = "1 minute", late: str = LATE, by: list[str] = ()) -> DataFrame:
    """Events per tumbling window; rows later than the watermark are dropped."""
    return (
        _timed(events, at, late)
        .groupBy(F.window(at, span).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")
    )


def request_limit_stream(
    log: DataFrame, key: str, at: str, limit: int, span: str = "60 seconds", slide: str = "10 seconds", late: str = LATE
) -> DataFrame:
    """Sliding windows in which a key made more requests than its limit."""
    return (
        _timed(log, at, late)
        .groupBy(F.window(at, span, slide).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("requests"))
        .where(F.col("requests") > limit)
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "requests")
    )


def unique_requests(requests: DataFrame, key: str, at: str, ttl: str = "24 hours") -> DataFrame:
    """The first request of each key; repeats within the time to live are dropped."""
    timed = _timed(requests, at, ttl)
    return timed.dropDuplicatesWithinWatermark([key]) if timed.isStreaming else timed.dropDuplicates([key])


def retryable_requests(
    requests: DataFrame,
    key: str,
    at: str,
    status: str = "status",
    ttl_seconds: int = 86400,
    late: str = LATE,
    block: str = "10 minutes",
) -> DataFrame:
    """Requests let through: new keys, expired keys, and keys whose last attempt failed.

    The state of a key is the outcome and expiry of its last accepted request, and ends with
    it.  Requests are decided in order of time, a block of time at once when the watermark
    has passed its end, whatever files and batches they come in; one request counts per key
    and instant (the first by status).  Requests later than the watermark are dropped.
    """
    columns = requests.columns
    ttl = ttl_seconds * 1_000_000

    def decide(held: tuple | None, rows: pd.DataFrame) -> tuple[tuple | None, list[bool]]:
        outcome, expires = held if held else (None, None)
        accepted = []
        for when, own in zip(rows[INSTANT].tolist(), rows[status].tolist()):
            fresh = expires is None or when > expires or outcome == "failed"
            accepted.append(fresh)
            if fresh:
                outcome, expires = own, when + ttl
        return (outcome, expires), accepted

    timed = _timed(requests, at, late)
    return in_order(timed, key, at, [status], decide, "outcome string, until long", block).select(*columns)


def alert_stream(breaches: DataFrame, at: str = "tick", late: str = "0 seconds", block: str = "1 minute") -> DataFrame:
    """Alerts with a cooldown per rule: rule, severity, fired_at.

    ``breaches`` has rule, severity, minutes, breached and the time of the tick.  Ticks are
    decided in order of time, a block at once when the watermark has passed its end; a
    rule's state is when it last fired, and ends with the cooldown.  Ticks later than the
    watermark are dropped: they fire nothing and move no cooldown.  A tick without minutes,
    see :func:`closing_tick`, only moves the watermark on.
    """

    def decide(held: tuple | None, rows: pd.DataFrame) -> tuple[tuple | None, list[bool]]:
        until = held[1] if held else None
        fired = []
        for when, minutes in zip(rows[INSTANT].tolist(), rows["minutes"].tolist()):
            fires = until is None or when >= until
            fired.append(fires)
            if fires:
                until = when + int(minutes) * 60_000_000
        return (None, until), fired

    # the condition on the time of the tick keeps the filter behind the watermark, which closing ticks must reach
    counts = F.when(F.col(at).isNotNull(), F.col("minutes").isNotNull())
    ticks = _timed(breaches.where("breached"), at, late).where(counts).select("rule", "severity", F.col("minutes").cast("long").alias("minutes"), at)
    done = in_order(ticks, "rule", at, ["severity"], decide, "outcome string, until long", block)
    return done.select("rule", "severity", F.col(at).alias("fired_at"))


def closing_tick(breaches: DataFrame, at: str = "tick", after: str = "1 day") -> DataFrame:
    """A row for :func:`alert_stream` after all others: where no more ticks come, it closes the last block."""
    last = breaches.where("breached").agg((F.max(at) + F.expr(f"INTERVAL {after}")).alias(at)).where(F.col(at).isNotNull())
    blank = {f.name: F.lit(None).cast(f.dataType) for f in breaches.schema.fields}
    return last.select(*[F.col(at) if c == at else F.lit(True).alias(c) if c == "breached" else v.alias(c) for c, v in blank.items()])


def high_risk_stream(log: DataFrame) -> DataFrame:
    """Audit events of high or critical risk, for an alert sink; no state."""
    return high_risk(log)


def session_stream(log: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Sessions per key: spans of events no further apart than the gap."""
    return (
        _timed(log, at, late)
        .groupBy(F.session_window(at, gap).alias("s"), key)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")
    )


def job_progress_stream(tasks: DataFrame) -> DataFrame:
    """Running totals per job, for update mode: completed, failed, percentage of seen tasks."""
    done = F.count_if(F.col("status") == "completed")
    failed = F.count_if(F.col("status") == "failed")
    return tasks.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"),
        done.alias("completed"),
        failed.alias("failed"),
        ((done + failed) * 100.0 / F.count(F.lit(1))).alias("percentage"),
    )
