"""Mixing sources to target weights: length counts, a bounded knapsack per source, seeded picks."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import per_text, saved

#: Hash bits that cut the documents of one source and length into pieces ranked on their own.
BITS = 12
#: The knapsack settles the last so many words, or twice the longest document if that is more.
SETTLE = 1 << 16


def sizes(docs: DataFrame, seed: int) -> DataFrame:
    """``doc_id, key, size, h, bucket``: words of ASCII white space splitting; keys sort as sources do, null last."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.xxhash64("doc_id", F.lit(seed)).alias("h"), "text")
    counted = per_text(base, "text", [("size", "long")], lambda: lambda texts: [[len(t.split()) if t else 0 for t in texts]], ["doc_id", "key", "h"])
    return counted.withColumn("bucket", F.shiftrightunsigned("h", 64 - BITS).cast("int"))


def targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``key, source_size, target``, one row per source.

    Sources are numbered over ranges of their order, so any number of them will do.  A
    common level times the weight is each source's share; sources it would lift above
    ``cap`` times their size stop there and the level rises for the others, in as many
    one-row aggregates as it takes.
    """
    sums = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    ranged = saved(sums.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "sources")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1 + F.col("before")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranged.join(offsets, "part").select("key", "source_size", F.get(cycle, F.pmod(place, F.lit(len(weights))).cast("int")).alias("weight"))
    weighed = saved(weighed, "weights").withColumn("most", F.col("source_size") * cap)

    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, last = 0.0, -1.0
    while level != last:
        full = F.col("most") <= F.lit(level) * F.col("weight")
        taken, open_weight = weighed.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        last = level
        if open_weight:
            level = max(level, (share * total - (taken or 0.0)) / open_weight)
    return weighed.select("key", "source_size", F.least("most", F.lit(level) * F.col("weight")).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many documents of each length to take, ``counts`` at most, for a total as near below ``budget`` as can be.

    Every length gives its share of the budget, rounded down.  Single documents in a seeded
    order bring what is left below ``SETTLE``; the rest is a bounded knapsack, solved exactly
    over the counts that remain.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    take = np.array([int(n) * budget // total for n in counts], np.int64)
    take[lengths == 0] = 0
    rest = budget - int((lengths * take).sum())
    order = [int(i) for i in np.flatnonzero(lengths > 0)]
    random.Random(seed).shuffle(order)
    limit = max(SETTLE, 2 * int(lengths.max()))
    for i in order:
        if rest <= limit:
            break
        if take[i] < counts[i] and lengths[i] <= rest:
            take[i] += 1
            rest -= int(lengths[i])
    items = []
    for i in order:
        left, step = min(int(counts[i] - take[i]), rest // int(lengths[i])), 1
        while left > 0:
            k = min(step, left)
            items.append((i, k, k * int(lengths[i])))
            left, step = left - k, step * 2
    reached, mask, by = 1, (1 << (rest + 1)) - 1, np.full(rest + 1, -1, np.int64)
    for at, (_, _, words) in enumerate(items):
        if reached >> rest & 1:
            break
        new = (reached << words) & mask & ~reached
        if new:
            raw = np.frombuffer(new.to_bytes(rest // 8 + 1, "little"), np.uint8)
            by[np.flatnonzero(np.unpackbits(raw, bitorder="little"))] = at
            reached |= new
    at = reached.bit_length() - 1
    while at > 0:
        i, k, words = items[by[at]]
        take[i] += k
        at -= words
    return take


def _plans(seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                pairs = np.array(sorted((s["size"], s["n"]) for s in row.counts), np.int64).reshape(-1, 2)
                budget = int(row.target + 0.5)
                every = budget >= row.source_size
                take = fit(pairs[:, 0], pairs[:, 1], budget - row.source_size if every else budget, seed)
                yield pd.DataFrame({"key": row.key, "size": pairs[:, 0], "once": int(every), "extra": take, "source_size": row.source_size, "target": row.target})

    return run


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 20260101
) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` per row of ``docs(doc_id, text, source)``.

    ``copies`` (0, 1 or 2) is how often the mix takes the document, ``taken`` the words that
    makes.  Within a source and length, documents are taken in the order of a seeded hash of
    doc_id; rows repeating a doc_id are documents of their own.  Null texts have size 0, a
    null source is one source and comes last.  An empty table gives no rows.
    """
    if cap > 2:
        raise ValueError("a document is taken twice at most")
    sized = saved(sizes(docs, seed), "sizes")
    aims = targets(sized, weights, share, cap)
    counted = sized.groupBy("key", "size").agg(F.count("*").alias("n"))
    counted = counted.groupBy("key").agg(F.collect_list(F.struct("size", "n")).alias("counts")).join(aims, "key")
    plan = counted.mapInPandas(_plans(seed), "key string, size long, once int, extra long, source_size long, target double")
    plan = saved(plan, "plan")

    pieces = sized.groupBy("key", "size", "bucket").agg(F.count("*").alias("m"))
    earlier = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("m").over(earlier), F.lit(0))).join(plan, ["key", "size"])
    pieces = pieces.withColumn("part", F.greatest(F.lit(0), F.least("m", F.col("extra") - F.col("before"))))
    rank = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("h", "doc_id"))
    picked = sized.join(pieces.drop("m", "before", "extra"), ["key", "size", "bucket"]).withColumn("rank", rank)
    copies = F.col("once") + (F.col("rank") <= F.col("part")).cast("int")
    return picked.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
