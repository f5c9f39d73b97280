"""Keyed decisions in order of event time, whatever order rows arrive in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Event time in microseconds, beside the columns of a row.
INSTANT = "_instant"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Decide = Callable[[tuple | None, pd.DataFrame], tuple[tuple | None, list[bool]]]


#: Rows of a key that are taken in, and about how many are held in one pile.
TAKEN, PILE = 100_000, 10_000


class InOrder(StatefulProcessor):
    """Holds the rows of a key in piles of whole blocks of time and decides a block when the watermark has passed it.

    ``held`` maps the end of the first block of a pile to its rows, one per instant; a pile goes
    on to where the next begins, and is cut at the ends of blocks when it has grown too large.
    A key with few rows is one pile, so it costs a few calls to the state store, not some for
    every row.  A timer stands at the end of the first block held.  ``last`` is what the decisions
    so far leave behind, ``(outcome, until)``, and is cleared by a timer at the end of the block ``until`` is in.
    Memory is that of :data:`TAKEN` rows of input, of one pile and of one block.
    """

    def __init__(self, decide: Decide, names: list[str], order: list[str], block_us: int, state: str, at: str | None = None):
        self.decide, self.names, self.order, self.block_us, self.state = decide, names, order, block_us, state
        self.at = at  # told by INSTANT already, not held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.state)
        self.held = handle.getMapState("held", "ends long", "rows binary")

    def once(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The first row of every instant, in order of time."""
        if (np.diff(rows[INSTANT].to_numpy()) > 0).all():
            return rows
        return rows.sort_values([INSTANT, *self.order], kind="stable").drop_duplicates(INSTANT)

    def ends(self, rows: pd.DataFrame) -> np.ndarray:
        return (rows[INSTANT].to_numpy().astype("int64") // self.block_us + 1) * self.block_us

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        firsts, taken, size = None, [], 0
        for chunk in rows:
            chunk.columns = self.names  # names that are no Python identifiers do not come through
            if self.at:
                chunk = chunk.drop(columns=self.at)
            if chunk[INSTANT].dtype != "int64":  # floats where the batch, maybe for other keys, holds rows without a time
                chunk = chunk[chunk[INSTANT].notna()].astype({INSTANT: "int64"})
            if not len(chunk):
                continue
            taken.append(chunk)
            size += len(chunk)
            if size >= TAKEN:
                firsts, taken, size = self.hold(firsts, taken), [], 0
        if taken:
            self.hold(firsts, taken)
        yield from ()

    def hold(self, firsts: list[int] | None, taken: list[pd.DataFrame]) -> list[int]:
        """Rows put into the piles of their blocks; ``firsts`` are where the piles begin, in order."""
        known = self.firsts() if firsts is None else firsts
        rows = self.once(pd.concat(taken) if len(taken) > 1 else taken[0])
        ends = self.ends(rows)
        begins = list(known)
        if not begins or ends[0] < begins[0]:
            begins = [int(ends[0])] + begins[1:]
            self.handle.registerTimer(begins[0] // 1000)
        after = []
        cuts = [0, *np.searchsorted(ends, begins[1:]).tolist(), len(rows)]
        for i, begin in enumerate(begins):
            part = rows.iloc[cuts[i] : cuts[i + 1]]
            if not len(part):
                after.append(begin)
                continue
            if i < len(known):
                part = self.once(pd.concat([_rows_of(self.held.getValue((known[i],))[0]), part]))
                if known[i] != begin:
                    self.held.removeKey((known[i],))
            after.extend(self.put(begin, part))
        return after

    def firsts(self) -> list[int]:
        return sorted(int(end) for (end,) in self.held.keys())

    def put(self, begin: int, rows: pd.DataFrame) -> list[int]:
        """The rows of a pile written, in several piles where they are many; returns where these begin."""
        begins, starts = [begin], [0]
        if len(rows) > PILE:
            ends = self.ends(rows)
            for at in np.flatnonzero(np.diff(ends)) + 1:
                if at - starts[-1] >= PILE // 2:
                    begins.append(int(ends[at]))
                    starts.append(int(at))
        for own, low, high in zip(begins, starts, [*starts[1:], len(rows)]):
            self.held.updateValue((own,), (_bytes_of(rows.iloc[low:high]),))
        return begins

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # blocks whose timers would come later in this batch are decided at once
        now = expiredTimerInfo.getExpiryTimeInMs()
        if timerValues is not None:
            now = max(now, timerValues.getCurrentWatermarkInMs() - 1)
        now *= 1000
        last = before = self.last.get() if self.last.exists() else None
        firsts = self.firsts()
        left = [begin for begin in firsts if begin > now]
        for begin in firsts[: len(firsts) - len(left)]:
            rows = self.once(_rows_of(self.held.getValue((begin,))[0]))
            self.held.removeKey((begin,))
            due = int(np.searchsorted(self.ends(rows), now, side="right"))
            ready, rest = rows.iloc[:due], rows.iloc[due:]
            if len(ready):
                outcome, accepted = self.decide(last, ready)
                if any(accepted):
                    last = outcome
                    yield ready[accepted]
            if len(rest):
                left = self.put(int(self.ends(rest)[0]), rest) + left
        if left and left[0] not in firsts[:1]:
            self.handle.registerTimer(left[0] // 1000)
        # what has ended before the next undecided block begins holds nothing back any more
        if last is not None and last[1] < now // self.block_us * self.block_us:
            if before is not None:
                self.last.clear()
        elif last is not before:
            self.last.update(last)
            self.handle.registerTimer((last[1] // self.block_us + 1) * self.block_us // 1000)

    def close(self) -> None:
        pass


def _bytes_of(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _rows_of(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_all().to_pandas()


def in_order(stream: DataFrame, key: str, at: str, order: list[str], decide: Decide, state: str, block: str) -> DataFrame:
    """The rows of a watermarked ``stream`` that ``decide`` accepts, with :data:`INSTANT`.

    ``decide(last, rows)`` gets the rows of a key and block in order of time, one per
    instant (the first by ``order``), and what it left behind before; it returns
    ``(outcome, until)`` and which rows are accepted.  ``block`` is a whole number of
    milliseconds at least.  Needs the state store of Spark that has timers in order, which is set here.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    block_us = spark.sql(f"SELECT unix_micros(timestamp '1970-01-01 00:00:00 UTC' + INTERVAL {block})").first()[0]
    timed = stream.withColumn(INSTANT, F.unix_micros(F.col(at)))
    out = StructType([f for f in timed.schema.fields if f.name != at])
    work = InOrder(decide, timed.columns, order, block_us, state, at)
    done = timed.groupBy(key).transformWithStateInPandas(work, out, "Append", "EventTime")
    return done.withColumn(at, F.timestamp_micros(INSTANT)).select(*timed.columns)
