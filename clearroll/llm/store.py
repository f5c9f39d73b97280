"""Written intermediate tables, free column names and per-row Arrow stages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where the session names none and everything runs in one local process (tests), a
    temporary folder is set; on a cluster without a shared folder this raises.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="llm-shared-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read again: a lost executor costs no rerun of what led to it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(taken: Iterable[str], base: str) -> str:
    """``base``, with underscores added until no column of ``taken`` has that name in any case."""
    names = {n.lower() for n in taken}
    while base.lower() in names:
        base += "_"
    return base


def per_text(
    df: DataFrame,
    text: str,
    fields: list[tuple[str, str]],
    work: Callable[[], Callable[[list], list[list]]],
    keep: list[str] | None = None,
    encode: bool = True,
) -> DataFrame:
    """Columns computed from a text column, row by row, in Arrow batches.

    ``work()`` is called once per task and gives a function from a list of texts (UTF-8
    ``bytes`` if ``encode``, else ``str``; ``None`` for null) to one list per field.
    ``keep`` are the columns carried along (default: all).  A field whose name the input
    has already gets underscores; look its name up by position.
    """
    keep = df.columns if keep is None else keep
    names = []
    for name, _ in fields:
        names.append(fresh([*keep, *names], name))
    source = F.col(f"`{text}`").cast("string")
    held = fresh([*keep, *names], "_text")
    kept = df.select(*[F.col(f"`{c}`") for c in keep], (source.cast("binary") if encode else source).alias(held))
    kinds = [T._parse_datatype_string(kind) for _, kind in fields]
    schema = T.StructType([*kept.schema.fields[:-1], *[T.StructField(n, k) for n, k in zip(names, kinds)]])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(k) for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = work()
        for batch in batches:
            found = scan(batch.column(batch.num_columns - 1).to_pylist())
            columns = [*batch.columns[:-1], *[pa.array(v, type=t) for v, t in zip(found, arrow)]]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *names])

    return kept.mapInArrow(run, schema)
