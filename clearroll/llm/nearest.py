"""Nearest vectors by vantage-point trees, one per shard, with triangle-inequality pruning."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import saved

#: Distinct vectors a shard's tree holds at most, and a leaf of it.
SHARD, LEAF = 8192, 128
#: Shards the outer tree tells apart at most, and vectors it is fitted on; larger shards are cut into pieces by a hash.
REGIONS, SAMPLE = 1024, 20_000
#: A branch is left out where its least possible distance times this exceeds the distance of the k-th found; 1 is exact.
FACTOR = 1.5
#: Distinct query vectors that one copy of a shard's tree answers.
ASKED = 20_000
_SLACK = 1e-9


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` over a power of two, so that squares neither overflow nor vanish; no digit changes."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    return np.ldexp(x, -exponent)


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Chords between the unit rows of ``x`` and the unit vector ``y``; the angle's order, and a metric."""
    return np.sqrt(np.maximum(((x - y) ** 2).sum(axis=1), 0.0))


def grow(unit: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> tuple:
    """A tree over ``rows``: ``(rows,)`` or ``(vantage, [((least, most), child), ...])`` by distance from the vantage point."""
    if len(rows) <= leaf:
        return (rows,)
    vantage = unit[rows[rng.integers(len(rows))]]
    far = distance(unit[rows], vantage)
    order = np.argsort(far, kind="stable")
    halves = order[: len(order) // 2], order[len(order) // 2 :]
    return vantage, [((far[h[0]], far[h[-1]]), grow(unit, rows[h], leaf, rng)) for h in halves]


def bound(d: float, span: tuple[float, float]) -> float:
    """The least distance from a query at ``d`` from a vantage point to anything within ``span`` of it."""
    return max(span[0] - d, d - span[1], 0.0)


class Shard:
    """A vantage-point tree over distinct vectors, each with the smallest ids that carry it."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], leaf: int = LEAF):
        self.vectors, self.ids = scaled(vectors), ids
        self.norm = np.sqrt((self.vectors**2).sum(axis=1))
        self.tree = grow(self.vectors / self.norm[:, None], np.arange(len(vectors)), leaf, np.random.default_rng(len(vectors)))

    def nearest(self, query: np.ndarray, k: int, factor: float, least: float) -> list[tuple[float, int]]:
        """The ``k`` nearest ``(-cosine, id)`` found, nearest first, ties by id; vectors below the cosine ``least`` are not looked for."""
        own = scaled(query[None])[0]
        norm = np.sqrt((own**2).sum())
        unit, found, floor = own / norm, [], least
        waiting, count = [(0.0, 0, self.tree)], 0
        while waiting:
            low, _, node = heappop(waiting)
            if low * factor > np.sqrt(max(0.0, 2 - 2 * floor)) + _SLACK:
                break  # the others are no nearer
            if len(node) == 2:
                d = float(distance(node[0][None], unit)[0])
                for span, child in node[1]:
                    count += 1
                    heappush(waiting, (max(low, bound(d, span)), count, child))
                continue
            rows = node[0]
            score = (self.vectors[rows] * own).sum(axis=1) / (self.norm[rows] * norm)
            for i in np.flatnonzero(score >= floor).tolist():
                found += [(-float(score[i]), v) for v in self.ids[rows[i]]]
            found = sorted(found)[:k]
            if len(found) == k:
                floor = max(floor, -found[-1][0])
        return found


def regions(sample: np.ndarray, parts: int) -> tuple:
    """The outer tree: the sample's space cut into at most ``parts`` regions, leaves numbered from 0."""
    unit = scaled(sample)
    unit = unit / np.sqrt((unit**2).sum(axis=1))[:, None]
    rng, number = np.random.default_rng(3), iter(range(parts))

    def cut(rows: np.ndarray, parts: int) -> tuple:
        if parts < 2 or len(rows) < 4:
            return (next(number),)
        vantage = unit[rows[rng.integers(len(rows))]]
        far = distance(unit[rows], vantage)
        middle = float(np.median(far))
        inner = far <= middle
        if inner.all():
            return (next(number),)
        return vantage, middle, cut(rows[inner], parts // 2), cut(rows[~inner], parts - parts // 2)

    return cut(np.arange(len(sample)), parts)


def regions_of(tree: tuple | None, x: np.ndarray) -> np.ndarray:
    """The region of every row of ``x``."""
    out = np.zeros(len(x), np.int32)
    if tree is None or len(tree) == 1:
        return out
    unit = scaled(x)
    unit /= np.sqrt((unit**2).sum(axis=1))[:, None]
    waiting = [(tree, np.arange(len(x)))]
    while waiting:
        node, rows = waiting.pop()
        if len(node) == 1:
            out[rows] = node[0]
        elif len(rows):
            inner = distance(unit[rows], node[0]) <= node[1]
            waiting += [(node[2], rows[inner]), (node[3], rows[~inner])]
    return out


def regions_near(tree: tuple | None, x: np.ndarray, reach: float) -> list[int]:
    """Regions that hold anything within ``reach`` of the vector ``x``, by the triangle inequality."""
    if tree is None or len(tree) == 1:
        return [0]
    unit = scaled(x[None])[0]
    unit = unit / np.sqrt((unit**2).sum())
    out, waiting = [], [tree]
    while waiting:
        node = waiting.pop()
        if len(node) == 1:
            out.append(node[0])
            continue
        d = float(distance(node[0][None], unit)[0])
        if d - node[1] <= reach:
            waiting.append(node[2])
        if node[1] - d <= reach:
            waiting.append(node[3])
    return out


def _searched(points: DataFrame, asks: DataFrame, k: int, factor: float, shard: int, leaf: int) -> DataFrame:
    """``node, vec_id, score, last`` of the nearest of every ask ``(region, node, vec, least)`` in its region's shards.

    A region's shards are pieces of at most about ``shard`` vectors; ``last`` is the k-th
    score of a piece.  Where many ask one region, its pieces are copied, so that no task
    answers more than about :data:`ASKED`.
    """
    sizes = points.groupBy("region").agg(F.count("*").alias("_n"))
    many = asks.groupBy("region").agg(F.count("*").alias("_q"))
    sizes = sizes.join(many, "region").select(
        "region", F.ceil(F.col("_n") / shard).cast("int").alias("_pieces"), F.ceil(F.col("_q") / ASKED).cast("int").alias("_copies")
    )
    deal = lambda c, n: F.pmod(F.xxhash64(F.col(c), F.lit(5)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = points.join(sizes, "region").withColumn("_copy", each("_copies")).select(
        "region", deal("node", "_pieces").alias("piece"), "_copy", F.lit(0).alias("kind"), "node", "vec", "ids", F.lit(None).cast("double").alias("least")
    )
    asked = asks.join(sizes, "region").withColumn("piece", each("_pieces")).select(
        "region", "piece", deal("node", "_copies").alias("_copy"), F.lit(1).alias("kind"), "node", "vec", F.lit(None).cast("array<long>").alias("ids"), "least"
    )
    key = ["region", "piece", "_copy"]
    both = held.unionByName(asked).repartition(*key).sortWithinPartitions(*key, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vectors, ids, tree = None, [], [], None
        for batch in batches:
            out = []
            keys = zip(*[batch.column(i).to_pylist() for i in range(4)])
            for (*at, kind), node, vec, own, least in zip(keys, *[batch.column(i).to_pylist() for i in range(4, 8)]):
                if at != now:
                    now, vectors, ids, tree = at, [], [], None
                if not kind:
                    vectors.append(np.frombuffer(vec))
                    ids.append(own)
                    continue
                if tree is None:
                    if not vectors:
                        continue
                    tree = Shard(np.stack(vectors), ids, leaf)
                found = tree.nearest(np.frombuffer(vec), k, factor, -2.0 if least is None else least)
                last = -found[-1][0] if len(found) == k else None
                out += [(node, v, -s, last) for s, v in found]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["node", "vec_id", "score", "last"])

    return both.mapInArrow(run, "node long, vec_id long, score double, last double")


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    factor: float = FACTOR,
    shard: int = SHARD,
    leaf: int = LEAF,
) -> DataFrame:
    """``query_id, rank (from 1), vec_id, score``: the ``k`` rows of ``vectors(vec_id, embedding)`` nearest to each row of ``queries``.

    Nearness is the cosine in double precision, ties go to the smaller vec_id, and rows with
    the query's own vec_id are left out.  Vectors that are null, zero or hold null or
    non-finite components, and rows without an id, take no part; vectors of another length
    are no candidates.  Repeated rows count once; a query with fewer candidates gets them
    all; empty tables give no rows.  ``factor`` 1 is exact, more prunes more.

    Equal vectors are one point with its ``k + 1`` smallest ids.  Points are dealt to the
    regions of an outer tree, fitted on a bounded sample, and each region's shards get a tree
    of their own.  A query searches its own region first; the distance of its k-th then
    rules out regions by the triangle inequality, and it visits those that are left.
    """
    spark = vectors.sparkSession
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(whole & F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(good)
    ranked = clean(vectors).distinct().withColumn("_r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id")))
    same = ranked.where(F.col("_r") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = saved(same, "vectors")
    counts = {r.width: r.n for r in points.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(64).collect()}
    total = max(1, sum(counts.values()))
    chosen = points.where(F.pmod(F.xxhash64("embedding", F.lit(23)), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / total) * (1 << 30))))
    rows = [r.embedding for r in chosen.select("embedding").limit(2 * SAMPLE).collect()] if total > shard else []
    outer = {}
    for width, n in counts.items():
        own = np.array([r for r in rows if len(r) == width])
        if n > shard and len(own):
            outer[width] = regions(own, int(min(REGIONS, -(-n // shard))))
    shared = spark.sparkContext.broadcast(outer)  # at most REGIONS vectors for each of 64 lengths

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, widths = batch.column(0), np.asarray(batch.column(0).value_lengths())
            raw, region = [None] * batch.num_rows, np.zeros(batch.num_rows, np.int64)
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                x = np.asarray(lists.take(pa.array(at)).flatten(), float).reshape(len(at), width)
                region[at] = regions_of(shared.value.get(width), x) + width * REGIONS
                for i, v in zip(at, x):
                    raw[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(region), pa.array(raw, pa.binary()), *batch.columns[1:]], names=["region", "vec", *batch.schema.names[1:]])

    points = saved(points.mapInArrow(placed, "region long, vec binary, ids array<long>").withColumn("node", F.monotonically_increasing_id()), "points")
    # a query's vector as bytes names it; one that no row of vectors carries gets a node below zero
    named = clean(queries).mapInArrow(_as_bytes, "vec_id long, vec binary").distinct()
    kinds = named.select("vec").distinct().mapInArrow(lambda batches: _placed_bytes(batches, shared.value), "vec binary, region long")
    asks = saved(kinds.withColumn("node", F.monotonically_increasing_id()), "asks")

    first = saved(_searched(points, asks.withColumn("least", F.lit(None).cast("double")), k + 1, factor, shard, leaf), "near")
    known = first.groupBy("node").agg(F.max("last").alias("least"))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for vec, own, node, least in zip(*[c.to_pylist() for c in batch.columns]):
                x = np.frombuffer(vec)
                reach = (2.0 if least is None else float(np.sqrt(max(0.0, 2 - 2 * least)))) / factor + _SLACK
                tree = shared.value.get(len(x))
                out += [(len(x) * REGIONS + r, node, vec, least) for r in regions_near(tree, x, reach) if len(x) * REGIONS + r != own]
            types = (pa.int64(), pa.int64(), pa.binary(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["region", "node", "vec", "least"])

    others = asks.join(known, "node", "left").select("vec", "region", "node", "least").mapInArrow(visits, "region long, node long, vec binary, least double")
    found = first.unionByName(_searched(points, saved(others, "visits"), k + 1, factor, shard, leaf)) if outer else first
    best = found.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "vec_id"))).where(F.col("_r") <= k + 1)
    lists = best.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("near"))
    answers = asks.select("node", "vec").join(lists, "node")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = named.withColumnRenamed("vec_id", "query_id").join(answers, "vec").select("query_id", F.posexplode(others).alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [np.array(v, float).tobytes() for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["vec_id", "vec"])


def _placed_bytes(batches: Iterator[pa.RecordBatch], outer: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        region = []
        for raw in batch.column(0).to_pylist():
            x = np.frombuffer(raw)
            region.append(int(regions_of(outer.get(len(x)), x[None])[0]) + len(x) * REGIONS)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(region, pa.int64())], names=["vec", "region"])
