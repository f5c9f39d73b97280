"""Spreading review work evenly over reviewers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import weight_of

PRIORITY = {"urgent": 0.0, "high": 1.0, "medium": 2.0, "low": 3.0}


def numbered(df: DataFrame, major: list[list[str]], at: str, spread: str) -> DataFrame:
    """``df`` with ``position``: a gap-free number by ``major``, then ``at``, then md5 of ``spread``.

    ``major`` is a list of levels of columns, coarse to fine (priority and day, then
    minute, say).  No task ever sees the whole table, nor one hot value: rows are counted per
    (levels, ``at``, first two hex digits of the md5), the counts are added up level by
    level, each level's running totals staying inside one value of the level above, and
    rows are numbered inside their smallest cell.
    """
    hashed = df.withColumn("_hash", F.md5(F.col(spread).cast("string"))).withColumn("_hex", F.left("_hash", F.lit(2)))
    levels = [sum(major[: i + 1], []) for i in range(len(major))] + [sum(major, []) + [at, "_hex"]]
    cells = hashed.groupBy(*levels[-1]).agg(F.count(F.lit(1)).alias("_n"))
    offsets = None
    for i, keys in enumerate(levels):
        above = levels[i - 1] if i else []
        own = cells.groupBy(*keys).agg(F.sum("_n").alias("_m"))
        order = Window.partitionBy(*(above or [F.lit(1)])).orderBy(*[k for k in keys if k not in above])
        own = own.withColumn(f"_o{i}", F.sum("_m").over(order) - F.col("_m")).drop("_m")
        offsets = own if offsets is None else own.join(offsets, above)
    whole = sum((F.col(f"_o{i}") for i in range(len(levels))), F.lit(0))
    offsets = offsets.select(*levels[-1], whole.alias("_offset"))
    in_cell = Window.partitionBy(*levels[-1]).orderBy("_hash", spread)
    ranked = hashed.withColumn("_rank", F.row_number().over(in_cell))
    return ranked.join(offsets, levels[-1]).withColumn("position", F.col("_offset") + F.col("_rank") - 1).drop(
        "_hash", "_hex", "_rank", "_offset"
    )


def assign_balanced(queue: DataFrame, reviewers: list[str], item: str = "job_id", at: str = "created_at") -> DataFrame:
    """Round robin over reviewers by priority, then by age."""
    ready = queue.withColumns(
        {
            "_p": weight_of("priority", PRIORITY, 2.0).cast("int"),
            "_at": F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(0)),
        }
    ).withColumns({"_day": F.floor(F.col("_at") / 86_400_000_000), "_minute": F.floor(F.col("_at") / 60_000_000)})
    names = F.array(*[F.lit(r) for r in reviewers])
    turn = F.pmod(F.col("position"), F.lit(len(reviewers))).cast("int")
    return numbered(ready, [["_p", "_day"], ["_minute"]], "_at", item).withColumn(
        "assigned_to", F.element_at(names, turn + 1)
    ).drop("_p", "_day", "_minute", "_at")
