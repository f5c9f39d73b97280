"""Embedding near-duplicates: cross-polytope hashing after Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import cells, reached, whole_groups
from .components import components
from .store import saved

#: Hash functions per table, tables, and buckets a vector is put into per table.
HASHES, TABLES, PROBES = 3, 6, 6
#: Corners of each hash that the probes are combined from.
CORNERS = 4
COSINE = 0.9
#: Members a cell takes from one piece of a bucket.
CHUNK = 512


def rotated(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of every row; the width is a power of two."""
    n, width, half = len(x), x.shape[1], 1
    while half < width:
        y = x.reshape(n, -1, 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return x


def buckets(x: np.ndarray, hashes: int, tables: int, probes: int, seed: int = 11) -> np.ndarray:
    """``tables * probes`` bucket numbers per row of ``x``.

    A hash is the nearest corner ``+-e_i`` after three rounds of random signs and a Hadamard
    transform; a table joins ``hashes`` of them.  A row's probes are its corner combinations
    of least cost, the sum of how much shorter each coordinate is than the longest one.
    """
    n, dim = x.shape
    width = 1 << max(2, (dim - 1).bit_length())
    unit = np.zeros((n, width), np.float32)
    unit[:, :dim] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    rng = np.random.default_rng(seed + width)
    combos = np.array(list(product(range(min(CORNERS, width)), repeat=hashes)))
    out = np.zeros((n, tables * probes), np.int64)
    lines = np.arange(n)[:, None]
    for t in range(tables):
        cost, code = np.zeros((n, len(combos)), np.float32), np.full((n, len(combos)), t + 1, np.int64)
        for k in range(hashes):
            y = unit
            for _ in range(3):
                y = rotated(y * rng.choice(np.array([-1, 1], np.float32), width)) / np.float32(np.sqrt(width))
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, :CORNERS]
            far = size[lines, top]
            corner = top * 2 + (y[lines, top] > 0)
            cost += (far[:, :1] - far)[:, combos[:, k]]
            code = code * (2 * width + 1) + corner[:, combos[:, k]]
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        out[:, t * probes : (t + 1) * probes] = code[lines, best]
    return (out * 1_000_003 + dim) & 0x7FFFFFFFFFFFFFFF


def shared_before(codes: np.ndarray, code: int) -> np.ndarray:
    """Which pairs of rows of ``codes`` share a value less than ``code``."""
    n = len(codes)
    low = np.where(codes < code, codes, -1)
    values, counts = np.unique(low[low >= 0], return_counts=True)
    values = values[counts > 1]
    found = np.zeros((n, n), bool)
    for at in range(0, len(values), 2048):
        part = values[at : at + 2048]
        place = np.minimum(np.searchsorted(part, low), len(part) - 1)
        row, column = np.nonzero(part[place] == low)
        seen = np.zeros((n, len(part)), np.float32)
        seen[row, place[row, column]] = 1
        found |= seen @ seen.T > 0
    return found


def near_vectors(
    vectors: DataFrame,
    cosine: float = COSINE,
    hashes: int = HASHES,
    tables: int = TABLES,
    probes: int = PROBES,
    chunk: int = CHUNK,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors(vec_id, embedding)``.

    Rows link where their cosine in double precision is ``cosine`` or more, if they meet in
    a bucket.  Equal vectors are one point with a weight, so copies cost nothing; buckets
    are compared in cells of bounded size, and a pair counts in the first bucket it shares,
    so links are added up without a list of them.  Null, zero and non-finite vectors link
    with nothing, vectors of another length neither.  ``component_id`` is the smallest
    vec_id reachable; rows repeating a vec_id are vectors of their own; an empty table
    gives no rows.
    """
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    dtype = np.float32 if kind == "float" else np.float64
    element = "float" if kind == "float" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("embedding"))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(whole & F.exists("embedding", lambda x: x != 0), F.lit(False))
    same = rows.where(good).groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    points = saved(same.withColumn("node", F.monotonically_increasing_id()), "vectors")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, lengths = batch.column(2), np.asarray(batch.column(2).value_lengths())
            codes = np.zeros((batch.num_rows, tables * probes), np.int64)
            raw = [None] * batch.num_rows
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                x = np.asarray(lists.take(pa.array(at)).flatten()).reshape(len(at), length)
                codes[at] = buckets(x.astype(np.float64), hashes, tables, probes)
                for i, v in zip(at, x):
                    raw[i] = v.tobytes()
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1]), pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary()), listed], names=["node", "weight", "vec", "codes"])

    hashed_points = points.select("node", "weight", "embedding").mapInArrow(hashed, "node long, weight long, vec binary, codes array<long>")
    hashed_points = saved(hashed_points, "hashed")
    dealt = cells(hashed_points.select("node", F.explode("codes").alias("code")), ["code"], F.col("node"), chunk)
    group = ["code", "_i", "_j"]
    dealt = dealt.join(hashed_points, "node").select(*group, "_side", "node", "weight", "vec", "codes")
    dealt = dealt.repartition(*group).sortWithinPartitions(*group)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, ends in whole_groups(batches, group):
            a, b, links = [], [], []
            for s, e in zip(starts, ends):
                if e - s < 2:
                    continue
                x = np.frombuffer(b"".join(rows["vec"][s:e]), dtype).reshape(e - s, -1).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                near = x @ x.T >= cosine
                np.fill_diagonal(near, False)
                if rows["_i"][s] != rows["_j"][s]:  # pairs inside a piece have a cell of their own
                    side = rows["_side"][s:e]
                    near &= side[:, None] != side[None, :]
                own = near.any(axis=1)
                if not own.any():
                    continue
                keep = np.flatnonzero(own)
                near = near[np.ix_(keep, keep)] & ~shared_before(rows["codes"][s:e][keep], rows["code"][s])
                node, weight = rows["node"][s:e][keep], rows["weight"][s:e][keep]
                count, least = near @ weight, reached(near)
                told = count > 0
                a.append(node[told]), b.append(node[least[told]]), links.append(count[told])
            if a:
                arrays = [pa.array(np.concatenate(v).astype(np.int64)) for v in (a, b, links)]
                yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "links"])

    found = saved(dealt.mapInArrow(compare, "a long, b long, links long"), "links")
    group_of = components(found.select("a", "b"))
    first = points.select("node", "first")
    named = first.join(group_of, "node")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    known = points.join(named.join(least, "component").select("node", "least"), "node", "left")
    known = known.join(found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")), "node", "left")
    known = saved(
        known.select(
            F.xxhash64("embedding").alias("h"),
            F.col("embedding").alias("same"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("least", "first").alias("component_id"),
        ),
        "known",
    )
    held = rows.withColumn("h", F.when(good, F.xxhash64("embedding")))
    out = held.where("h IS NOT NULL").join(known, ["h"]).where(F.col("embedding") == F.col("same")).select("vec_id", "n_links", "component_id")
    alone = held.where("h IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = out.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
