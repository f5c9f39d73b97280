"""The table of named queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...sources.derived import table, view, with_views


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str


QUERIES: dict[str, Query] = {}


class Tables:
    """Derived views and input tables of one folder, by attribute name."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return view(self._spark, self._folder, name)

    def raw(self, name: str) -> DataFrame:
        return table(self._spark, self._folder, name)

    def wide(self, df: DataFrame, key: str) -> DataFrame:
        """A scan spread over all cores, for row-local work that is heavy per row.

        Splits do not tell how rows lie: a row group is read by one task, however many splits
        its file has, so the rows are exchanged whatever their number.  ``df`` must be a scan with
        projections only.
        """
        return df.repartition(max(self._spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()), key)

    @property
    def spark(self) -> SparkSession:
        return self._spark


def query(name: str, covers: str, views: str = "", sql: str | None = None):
    """Register a query: ``fn(tables) -> DataFrame`` and the SQL it must equal.

    ``views`` names the derived relations the SQL uses.
    """

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, folder))

        text = None
        if sql is not None:
            text = (with_views(*views.split()) if views else "") + sql
        QUERIES[name] = Query(run, text, covers)
        return fn

    return register


def r6(c: str | Column) -> Column:
    """Six digits; the nudge keeps exact halves from depending on how an engine rounds."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1e-9), 6)


def ts(c: str | Column) -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss")


def joined_list(c: str | Column, sep: str = "; ") -> Column:
    return F.array_join(F.col(c) if isinstance(c, str) else c, sep)
