"""Structured Streaming forms of rates, limits, alerts, sessions and ingestion.

Each transform takes and returns a DataFrame and works on a batch DataFrame as well,
where watermarks have no effect; that is how the streams are tested.
"""

from .ingest import retry_failed, retry_stream, validate_arrivals
from .run import drain, latest_updates, stream_table
from .transforms import (
    alert_stream,
    closing_tick,
    high_risk_stream,
    job_progress_stream,
    request_limit_stream,
    retryable_requests,
    session_stream,
    unique_requests,
    validation_rate_stream,
)

__all__ = [
    "alert_stream", "closing_tick", "drain", "high_risk_stream", "job_progress_stream", "latest_updates",
    "request_limit_stream", "retry_failed", "retry_stream", "retryable_requests", "session_stream",
    "stream_table", "unique_requests", "validate_arrivals", "validation_rate_stream",
]
