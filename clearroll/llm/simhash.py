"""SimHash near-duplicates: pigeonhole blocks over fingerprints, Hamming verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import cells, reached, whole_groups
from .components import components
from .store import per_text, saved

#: Members a cell takes from one piece of a block.
CHUNK = 512
#: Groups up to this size give all their links, larger ones a spanning set.
SMALL = 24


def shingle_bits(words: list[bytes], width: int) -> int:
    """The fingerprint of a word list: bit i is set if more than half of the shingle hashes set it."""
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    total, n = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, 8192):
        part = [words[at + k : at + k + min(8192, n - at)] for k in range(width)]
        h = np.fromiter((digest(join(s), 42) for s in zip(*part)), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, width: int = 3) -> DataFrame:
    """``keep`` columns and ``fp0``, the 64-bit fingerprint of shingles of ``width`` words.

    A-Z are lower-cased and words split at ASCII white space.  Null and wordless texts have
    fingerprint zero.
    """

    def work():
        return lambda texts: [[signed(shingle_bits(t.lower().split() if t else [], width)) for t in texts]]

    return per_text(docs, text, [("fp0", "long")], work, keep)


def block_masks(radius: int, blocks: int) -> list[int]:
    """Bit masks of the block sets one of which two fingerprints within ``radius`` bits share.

    64 bits are cut into ``blocks`` runs; ``radius`` differing bits spoil ``radius`` of them at most.
    """
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def links(points: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Edges ``(a, b)`` between the fingerprints of ``points(fp0)`` that differ in ``radius`` bits or fewer.

    The edges connect what all links connect: groups of up to ``SMALL`` give every link,
    larger ones each member's link to the smallest member it reaches inside its cell, so no
    group emits all its pairs.
    """
    masks = [signed(m) for m in block_masks(radius, blocks)]
    # a block's number and bits as one hash: rows stay short, and a chance collision only adds pairs to verify
    keys = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp0").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)]))
    dealt = cells(points.select("fp0", keys.alias("k")), ["k"], F.col("fp0"), CHUNK)
    group = ["k", "_i", "_j"]
    # by node inside a group, so that the cells of a crowd name the same smallest members and their edges coincide
    dealt = dealt.select(*group, F.col("fp0").alias("node")).repartition(*group).sortWithinPartitions(*group, "node")

    def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count((x ^ y).view(np.uint64))  # of a signed number it would count the absolute value's bits

    def close(rows: dict, a, b):
        return apart(rows["node"][a], rows["node"][b]) <= radius

    def compare(rows: dict, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, node = len(rows["node"]), rows["node"]
        size = np.repeat(ends - starts, ends - starts)
        left = np.arange(n)
        until = np.repeat(ends, ends - starts)
        for lag in range(1, SMALL):
            a = left[(size <= SMALL) & (left + lag < until)]
            if not len(a):
                break
            hit = a[close(rows, a, a + lag)]
            yield node[hit], node[hit + lag]
        for s, e in zip(starts, ends):
            if e - s > SMALL:
                at = np.arange(s, e)
                near = close(rows, at[:, None], at[None, :])
                yield node[at], node[s + reached(near)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, ends in whole_groups(batches, group):
            for a, b in compare(rows, starts, ends):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").where("a <> b")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2, blocks: int = 4
) -> DataFrame:
    """``doc_id, fingerprint (16 hex digits), component_id`` per row of ``docs``.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the smallest
    doc_id reachable (null only where no row of the group has an id).  Equal fingerprints
    are one point whatever their number.  Repeated rows are returned as often as they occur;
    an empty table gives no rows.
    """
    prints = fingerprints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", ["doc_id"], width)
    prints = saved(prints, "prints")
    points = saved(prints.groupBy("fp0").agg(F.min("doc_id").alias("first")).withColumn("node", F.col("fp0")), "points")
    found = components(links(points, radius, blocks))
    named = points.join(found, "node").select("node", "component", "first")
    smallest = named.groupBy("component").agg(F.min("first").alias("least"))
    linked = named.join(smallest, "component").select("node", "least")
    label = F.when(F.col("least").isNotNull(), F.col("least")).otherwise(F.col("first")).alias("component_id")
    labels = saved(points.join(linked, "node", "left").select("node", label), "labels")
    # two plain exchanges, so that a fingerprint of very many copies can be split
    own = prints.withColumn("node", F.col("fp0")).join(labels, "node")
    return own.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")
