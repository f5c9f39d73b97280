"""Comparing the members of blocks in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(members: DataFrame, key: list[str], spread: Column, chunk: int) -> DataFrame:
    """``members`` dealt into cells ``(*key, _i, _j)`` that together hold every pair of a block.

    A block of at most ``chunk`` members is one cell.  A larger one is cut into numbered
    pieces by a hash of ``spread``, and each pair of pieces is a cell of its own, so no task
    holds more than about two pieces at once, however large the block; ``_side`` is a
    member's piece.  Blocks of one member are left out.
    """
    sizes = members.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")
    pieces = F.ceil(F.col("_n") / chunk).cast("int")
    own = members.join(sizes, key).withColumn("_m", pieces).drop("_n")
    own = own.withColumn("_side", F.when(F.col("_m") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64(spread, F.lit(7)), F.col("_m")).cast("int")))
    own = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    return own.withColumn("_i", F.least("_side", "_other")).withColumn("_j", F.greatest("_side", "_other")).drop("_other", "_m")


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Arrays by name; lists of one length become rows of a matrix, binaries stay objects."""
    out = {}
    for name, column in zip(batch.schema.names, batch.columns):
        if pa.types.is_list(column.type):
            out[name] = np.asarray(column.flatten()).reshape(len(column), -1)
        else:
            out[name] = column.to_numpy(zero_copy_only=False)
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Columns, starts and ends of the groups of a partition sorted by ``key``; no group is torn between two batches."""
    held = None

    def edges(rows):
        change = np.zeros(len(rows[key[0]]), bool)
        for c in key:
            change[1:] |= rows[c][1:] != rows[c][:-1]
        starts = np.concatenate([[0], np.flatnonzero(change)])
        return starts, np.concatenate([starts[1:], [len(change)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        new = _columns(batch)
        held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
        starts, ends = edges(held)
        if len(starts) > 1:  # the last group may go on
            cut = starts[-1]
            yield {c: v[:cut] for c, v in held.items()}, starts[:-1], ends[:-1]
            held = {c: v[cut:] for c, v in held.items()}
    if held is not None:
        yield held, *edges(held)


def reached(near: np.ndarray) -> np.ndarray:
    """The smallest index each row of a symmetric matrix reaches through its true cells, itself included."""
    n = len(near)
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(near, label[None, :], n).min(axis=1))
        if (least == label).all():
            return label
        label = least
