"""Keyed look-ups that stay correct and even under skew.

A reference table answers with at most one row per key.  Two things go wrong at
scale: records without a key all hash to one partition, and one popular key can
carry a third of the records.  Both are handled here, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 256
HOT_SPREAD = 64
SAMPLE = 0.001
SAMPLE_HITS = 32


def one_per_key(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: the smallest by ``order`` (all other columns by default).

    An aggregate, so repeats are dropped on the map side already.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    first = order or rest
    ranked = F.struct(*[F.col(c) for c in first], *[F.col(c) for c in rest if c not in first])
    best = df.groupBy(*keys).agg(F.min(ranked).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def hot_keys(df: DataFrame, key: str, sample: float = SAMPLE, hits: int = SAMPLE_HITS, row_id: str | None = None) -> DataFrame:
    """At most :data:`HOT_KEYS` keys that dominate a column.

    Only the decision where to salt comes from the sample; no row is dropped, and
    a key that is missed is merely joined unsalted.  The sample is chosen by a hash of
    ``row_id``, so every evaluation of it finds the same keys.
    """
    chosen = F.pmod(F.xxhash64(row_id or key, F.lit(17)), F.lit(1_000_000)) < int(sample * 1_000_000)
    probe = df.select(key) if sample >= 1 else df.where(chosen).select(key)
    return (
        probe.where(F.col(key).isNotNull())
        .groupBy(key)
        .count()
        .where(F.col("count") >= hits)
        .orderBy(F.desc("count"), key)
        .limit(HOT_KEYS)
        .select(key)
    )


def hot_values(
    df: DataFrame, keys: dict[str, Column], row_id: str, sample: float = SAMPLE, hits: int = SAMPLE_HITS
) -> dict[str, list[str]]:
    """For each named key of the rows, at most :data:`HOT_KEYS` values that dominate it, from one pass over a sample.

    This runs a job: it reads the key columns of a sample that a hash of ``row_id`` chooses
    and brings at most :data:`HOT_KEYS` values per key to the driver.  Several look-ups from
    the same rows share it, so none has to run what stands before it to find its hot keys.
    """
    chosen = F.pmod(F.xxhash64(row_id, F.lit(17)), F.lit(1_000_000)) < int(sample * 1_000_000)
    probe = df if sample >= 1 else df.where(chosen)
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), key.cast("string").alias("key")) for name, key in keys.items()])
    counted = probe.select(F.inline(pairs)).where("key IS NOT NULL").groupBy("name", "key").count()
    found: dict[str, list[str]] = {name: [] for name in keys}
    for r in counted.where(F.col("count") >= hits).orderBy(F.desc("count"), "name", "key").limit(HOT_KEYS * len(keys)).collect():
        if len(found[r["name"]]) < HOT_KEYS:
            found[r["name"]].append(r["key"])
    return found


def attach(
    left: DataFrame,
    right: DataFrame,
    left_key: Column,
    right_key: Column,
    alias: str,
    row_id: str,
    unique: bool = False,
    sample: float = SAMPLE,
    hits: int = SAMPLE_HITS,
    hot: list[str] | None = None,
) -> DataFrame:
    """``left`` with a struct column ``alias``: the matching right row, or NULL.

    Keys are single string Columns (build composite keys with ``concat_ws``).
    Rows of ``left`` without a key get a key of their own that matches nothing, so
    they spread over all partitions.

    ``unique`` states that ``right`` has one row per key: then this is a plain
    left join of two exchanges, which adaptive execution splits where it is
    skewed.  Otherwise ``right`` is reduced to one row per key first, and the hot
    keys of ``left`` are salted over :data:`HOT_SPREAD` tasks.  ``hot`` names them (see
    :func:`hot_values`); where it is empty nothing is salted, and the exchange that reduces
    ``right`` is also the join's.  Without ``hot`` they are found in ``left`` itself, by a
    set that is broadcast: it has at most :data:`HOT_KEYS` rows by construction.
    """
    own = F.concat(F.lit("\x01"), F.col(row_id).cast("string"))
    keyed = left.withColumn("_key", left_key.cast("string"))
    payload = right.select(
        right_key.cast("string").alias("_rkey"), F.struct(*[F.col(c) for c in right.columns]).alias(alias)
    ).where(F.col("_rkey").isNotNull())
    if unique:
        spread = keyed.withColumn("_key", F.coalesce("_key", own))
        return spread.join(payload, F.col("_key") == F.col("_rkey"), "left").drop("_key", "_rkey")

    reduced = payload.groupBy("_rkey").agg(F.min(alias).alias(alias))
    if hot is not None:
        spread = keyed.withColumn("_key", F.coalesce("_key", own))
        if not hot:
            return spread.join(reduced, F.col("_key") == F.col("_rkey"), "left").drop("_key", "_rkey")
        salt = F.pmod(F.xxhash64(row_id), F.lit(HOT_SPREAD)).cast("int")
        spread = spread.withColumn("_salt", F.when(F.col("_key").isin(hot), salt).otherwise(0))
        salts = F.when(F.col("_rkey").isin(hot), F.sequence(F.lit(0), F.lit(HOT_SPREAD - 1))).otherwise(F.array(F.lit(0)))
        copies = reduced.withColumn("_rsalt", F.explode(salts))
        return spread.join(
            copies, (F.col("_key") == F.col("_rkey")) & (F.col("_salt") == F.col("_rsalt")), "left"
        ).drop("_key", "_rkey", "_salt", "_rsalt")

    hot = hot_keys(keyed, "_key", sample, hits, row_id).withColumnRenamed("_key", "_hot")
    salted = (
        keyed.join(F.broadcast(hot), F.col("_key") == F.col("_hot"), "left")
        .withColumn(
            "_salt",
            F.when(
                F.col("_hot").isNotNull(),
                F.pmod(F.xxhash64(row_id), F.lit(HOT_SPREAD)).cast("int"),
            ).otherwise(F.lit(0)),
        )
        .withColumn("_key", F.coalesce("_key", own))
        .drop("_hot")
    )
    spread = F.broadcast(
        hot.select("_hot", F.explode(F.sequence(F.lit(0), F.lit(HOT_SPREAD - 1))).alias("_rsalt"))
    )
    copies = (
        reduced.join(spread, F.col("_rkey") == F.col("_hot"), "left")
        .withColumn("_rsalt", F.coalesce("_rsalt", F.lit(0)))
        .drop("_hot")
    )
    return salted.join(
        copies, (F.col("_key") == F.col("_rkey")) & (F.col("_salt") == F.col("_rsalt")), "left"
    ).drop("_key", "_rkey", "_salt", "_rsalt")


def attach_by_id(left: DataFrame, right: DataFrame, alias: str, row_id: str, unique: bool = False) -> DataFrame:
    """``left`` with the right row of the same id, both keyed by that id, as a struct.

    ``right`` is reduced to one row per id, unless ``unique`` states that it is keyed; the
    reduced rows are partitioned as the join needs them.  Several such joins in a row share one exchange of ``left``, as all of them need it
    partitioned by the same column.
    """
    payload = right.select(
        F.col(row_id).alias("_rkey"), F.struct(*[F.col(c) for c in right.columns]).alias(alias)
    )
    if not unique:
        payload = payload.groupBy("_rkey").agg(F.min(alias).alias(alias))
    return left.join(payload, F.col(row_id) == F.col("_rkey"), "left").drop("_rkey")
