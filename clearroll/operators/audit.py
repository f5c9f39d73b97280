"""Audit trail, access control and masking of personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import privacy, scores


def with_risk(log: DataFrame) -> DataFrame:
    return log.withColumn("risk_level", scores.risk_of("action"))


def with_partitions(log: DataFrame, at: str = "logged_at") -> DataFrame:
    """The derived partition columns of an audit row."""
    return log.withColumns({"date": F.date_format(at, "yyyy-MM-dd"), "hour": F.hour(at)})


def high_risk(log: DataFrame) -> DataFrame:
    return with_risk(log).where(F.col("risk_level").isin("high", "critical"))


def user_activity(log: DataFrame, as_of: str, days: int = 30, user_id: str | None = None) -> DataFrame:
    """One row per user over the last days: totals, per action, per risk, addresses.

    All users in one pass.  Rows are counted per (user, action, address) first; the
    maps that are collected afterwards have one entry per action or risk level.
    """
    end = F.lit(as_of).cast("timestamp")
    recent = log.where(
        (F.col("logged_at") >= end - F.expr(f"make_dt_interval({days})")) & (F.col("logged_at") <= end)
    )
    if user_id is not None:
        recent = recent.where(F.col("user_id") == user_id)
    counted = recent.groupBy("user_id", "action", "ip_address").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("success").alias("ok"),
        F.min("logged_at").alias("first"),
        F.max("logged_at").alias("last"),
    )
    by_action = counted.groupBy("user_id", "action").agg(
        F.sum("n").alias("n"), F.sum("ok").alias("ok"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    totals = by_action.groupBy("user_id").agg(
        F.sum("n").alias("total_actions"),
        F.sum("ok").alias("successful_actions"),
        F.min("first").alias("first_activity"),
        F.max("last").alias("last_activity"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("action", "n")))).alias("action_counts"),
        *[
            F.coalesce(F.sum(F.when(scores.risk_of("action") == level, F.col("n"))), F.lit(0)).alias(f"{level}_risk")
            for level in K.RISK_ACTIONS
        ],
    )
    addresses = counted.where(F.col("ip_address").isNotNull()).select("user_id", "ip_address").distinct()
    distinct = addresses.groupBy("user_id").agg(F.count(F.lit(1)).alias("unique_ips"))
    joined = totals.join(distinct, "user_id", "left")
    return joined.withColumns(
        {
            "unique_ips": F.coalesce("unique_ips", F.lit(0)),
            "failed_actions": F.col("total_actions") - F.col("successful_actions"),
            "success_rate": scores.ratio(F.col("successful_actions"), F.col("total_actions")),
        }
    )


def user_addresses(log: DataFrame) -> DataFrame:
    """Every address each user came from; rows, as a user may have any number."""
    return log.where(F.col("ip_address").isNotNull()).select("user_id", "ip_address").distinct()


def pii_config(fields: dict[str, tuple] | None = None) -> dict[str, tuple]:
    return dict(fields or K.PII_FIELDS)


def add_pii_field(name: str, kind: str, level: str, permission: str, per_hour: int, fields=None) -> dict[str, tuple]:
    return {**pii_config(fields), name: (kind, level, permission, per_hour)}


def remove_pii_field(name: str, fields=None) -> dict[str, tuple]:
    return {n: v for n, v in pii_config(fields).items() if n != name}


def pii_fields_of_level(level: str, fields=None) -> list[str]:
    return [n for n, v in pii_config(fields).items() if v[1] == level]


def mask_record(df: DataFrame, permissions: list[str] = (), privileged: bool = False, fields=None) -> DataFrame:
    """Every configured column masked, unless the reader may see it."""
    if privileged:
        return df
    hidden = {
        name: privacy.mask(kind, name)
        for name, (kind, _, permission, _) in pii_config(fields).items()
        if name in df.columns and permission not in permissions
    }
    return df.withColumns(hidden) if hidden else df


def mask_for_readers(df: DataFrame, permissions: str = "permissions", fields=None) -> DataFrame:
    """Like :func:`mask_record`, with the reader's permissions in a column of each row."""
    masked = {}
    for name, (kind, _, permission, _) in pii_config(fields).items():
        if name in df.columns:
            may = F.coalesce(F.array_contains(F.col(permissions), permission), F.lit(False))
            masked[name] = F.when(may, F.col(name).cast("string")).otherwise(privacy.mask(kind, name))
    return df.withColumns(masked) if masked else df


def _of_field(index: int, fields) -> Column:
    return scores.label_of("field_name", {n: str(v[index]) for n, v in pii_config(fields).items()}, None)


def access_allowed(log: DataFrame, fields=None) -> DataFrame:
    """``allowed`` per access by role, reason and the field's sensitivity.

    The policy is a CASE over five roles; a field that is not personal is open.
    """
    level = _of_field(1, fields)
    verdict = F.lit(False)
    for role, (reasons, levels) in K.ACCESS_POLICIES.items():
        if reasons:
            allowed = F.col("reason").isin(*reasons) & level.isin(*levels)
            verdict = F.when(F.col("user_role") == role, allowed).otherwise(verdict)
    return log.withColumn("sensitivity", level).withColumn(
        "allowed", F.when(level.isNull(), F.lit(True)).otherwise(F.coalesce(verdict, F.lit(False)))
    )


def audit_reveals(log: DataFrame, permissions: dict[str, list[str]], fields=None) -> DataFrame:
    """Outcome of every reveal request: granted, or why not.

    The hourly limit counts granted-by-permission requests of one user and field in
    one clock hour, in order of time and id.  The order matters only up to the limit,
    so per (user, field, hour) just the first ``limit`` requests are looked for; that
    cut is made before the shuffle, and a hot hour is never gathered in one task.
    """
    permission = _of_field(2, fields)
    limit = _of_field(3, fields).cast("bigint")
    may = F.lit(False)
    for role, granted in permissions.items():
        may = F.when(
            F.col("user_role") == role, permission.isin(*granted) if granted else F.lit(False)
        ).otherwise(may)
    asked = log.withColumns(
        {"_limit": limit, "_may": F.coalesce(may, F.lit(False)), "_personal": permission.isNotNull()}
    ).withColumn("_hour", F.date_trunc("hour", "accessed_at"))
    counted = asked.where(F.col("_personal") & F.col("_may"))
    highest = max(v[3] for v in pii_config(fields).values())
    order = Window.partitionBy("user_id", "field_name", "_hour").orderBy("accessed_at", "access_id")
    first = (
        counted.select("access_id", "user_id", "field_name", "_hour", "accessed_at", "_limit")
        .withColumn("_nth", F.row_number().over(order))
        .where(F.col("_nth") <= highest)
        .where(F.col("_nth") <= F.col("_limit"))
        .select("access_id", F.lit(True).alias("_within"))
    )
    joined = asked.join(first, "access_id", "left")
    error = (
        F.when(~F.col("_personal"), F.lit(None).cast("string"))
        .when(~F.col("_may"), F.lit("Insufficient permissions"))
        .when(F.col("_within").isNull(), F.lit("Access frequency limit exceeded"))
    )
    return joined.withColumns({"success": error.isNull(), "error_message": error}).drop(
        "_limit", "_may", "_personal", "_hour", "_within"
    )
