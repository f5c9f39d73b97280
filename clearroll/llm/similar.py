"""Near copies by shingle similarity: SimHash blocks and MinHash bands propose pairs, exact Jaccard similarity decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import reached, whole_groups
from .components import components
from .embeddings import shared_before
from .simhash import block_masks, signed
from .store import fresh, per_text, saved

#: Words of a shingle, and the least shingle similarity of near copies.
SHINGLE, LEAST = 5, (4, 5)
#: SimHash: fingerprints within ``RADIUS`` bits share two of ``BLOCKS`` runs of bits.
RADIUS, BLOCKS = 2, 4
#: MinHash: two documents meet where all ``ROWS`` minima of one of ``BANDS`` bands agree; at similarity s
#: they miss each other with probability (1 - s**ROWS)**BANDS, 3e-6 at 0.8, whatever their length.
BANDS, ROWS = 24, 4
#: Minima of ``BANDS * ROWS`` that must agree in their last eight bits before shingles are compared; fewer do at 0.8 with probability 5e-8.
AGREE = 56
#: Members and shingles a cell takes from one piece of a group.
CHUNK, SHINGLES = 512, 1 << 20

_MIX = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a text (all its words where it has fewer); A-Z count as a-z."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    rows = zip(*[words[k:] for k in range(min(SHINGLE, len(words)))])
    return np.unique(np.fromiter((digest(join(s), 42) for s in rows), np.uint64))


def node_of(own: np.ndarray) -> int:
    """One number per shingle set: a hash of it."""
    return xxhash.xxh64_intdigest(own.tobytes(), 42) - (1 << 63)


def minima(own: np.ndarray) -> np.ndarray:
    """``BANDS * ROWS`` MinHash values of a shingle set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(own), 4096):
        h = own[at : at + 4096, None] * _MIX
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        least = np.minimum(least, h.min(axis=0))
    return least


def fingerprint(own: np.ndarray) -> int:
    """The SimHash of a shingle set: bit i is set if more than half of the hashes set it."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(own), 8192):
        part = own[at : at + 8192].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return signed(int.from_bytes(np.packbits(total * 2 > len(own), bitorder="little").tobytes(), "little"))


def sketched(text: bytes | None) -> tuple[int, int, int, bytes, list[int]]:
    """``(node, number of shingles, fingerprint, last bytes of the minima, band hashes)`` of a text; without words the last two are empty."""
    own = shingle_set(text)
    if not len(own):
        return node_of(own), 0, 0, b"", []
    least = minima(own)
    bands = [xxhash.xxh64_intdigest(row.tobytes(), i) >> 1 for i, row in enumerate(least.reshape(BANDS, ROWS))]
    return node_of(own), len(own), fingerprint(own), (least & np.uint64(255)).astype(np.uint8).tobytes(), bands


#: Fields of :func:`sketched`.
SKETCH = [("node", "long"), ("n", "long"), ("fp", "long"), ("sig", "binary"), ("bands", "array<long>")]


def spanning(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Index pairs at a similarity of ``LEAST`` or more that connect all that such pairs connect."""
    n = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    free = np.ones(len(sets), bool)
    for seed in range(len(sets)):
        if not free[seed]:
            continue
        free[seed], reach = False, [seed]
        while reach and free.any():
            x = reach.pop()
            own = sets[x]
            where = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            both = np.bincount(owner[own[where] == flat], minlength=len(sets))
            for y in np.flatnonzero(free & (both * LEAST[1] >= (n[x] + n - both) * LEAST[0])).tolist():
                free[y] = False
                reach.append(y)
                yield x, y


def candidates(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Groups ``(g, node)`` of ``points(node, n, fp, sig, bands)`` that hold every pair the sketches cannot tell from near copies.

    Points meet by the blocks of their SimHash, where the Hamming distance is verified, and
    by the bands of their MinHash.  A pair is looked at in the first key it shares, and goes
    on if its sizes allow the similarity and enough minima agree; pairs that only share a
    template do not.  A crowded key is dealt into cells of pairs of pieces, each of about
    ``chunk`` members and ``SHINGLES`` shingles at most.  A group is what such pairs connect
    inside one cell.
    """
    masks = [signed(m) for m in block_masks(RADIUS, BLOCKS)]
    blocks = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))).bitwiseAND(F.lit((1 << 63) - 1)) for i, m in enumerate(masks)])
    points = points.where("n > 0").withColumn("blocks", blocks)
    keyed = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("k")))
    keys = F.concat(keyed(0, F.col("blocks")), keyed(1, F.col("bands")))
    members = points.select("node", "n", F.inline(keys))
    pieces = F.greatest(F.ceil(F.col("_c") / chunk), F.ceil(F.col("_n") / SHINGLES)).cast("int").alias("_m")
    sizes = members.groupBy("kind", "k").agg(F.count("*").alias("_c"), F.sum("n").alias("_n")).where("_c > 1").select("kind", "k", pieces)
    own = members.drop("n").join(sizes, ["kind", "k"]).withColumn("_side", F.pmod(F.xxhash64("node", F.lit(7)), F.col("_m")).cast("int"))
    own = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    dealt = own.select("kind", "k", F.least("_side", "_other").alias("_i"), F.greatest("_side", "_other").alias("_j"), "_side", "node")
    group = ["kind", "k", "_i", "_j"]
    held = points.select("node", "n", "fp", "sig", "blocks", "bands")
    dealt = dealt.join(held, "node").select(*group, "_side", "node", "n", "fp", "sig", "blocks", "bands").repartition(*group).sortWithinPartitions(*group, "node")

    def near(rows: dict, s: int, e: int) -> np.ndarray:
        """Which pairs of a cell go on."""
        n, fp = rows["n"][s:e], rows["fp"][s:e]
        fit = np.minimum(n[:, None], n[None, :]) * LEAST[1] >= np.maximum(n[:, None], n[None, :]) * LEAST[0]
        if rows["_i"][s] != rows["_j"][s]:  # pairs inside a piece have a cell of their own
            side = rows["_side"][s:e]
            fit &= side[:, None] != side[None, :]
        close = np.bitwise_count((fp[:, None] ^ fp[None, :]).view(np.uint64)) <= RADIUS
        first = rows["kind"][s] == 0
        fit &= close if first else ~close
        np.fill_diagonal(fit, False)
        left = np.flatnonzero(fit.any(axis=1))
        if len(left):
            fit[np.ix_(left, left)] &= ~shared_before(rows["blocks" if first else "bands"][s:e][left], rows["k"][s])
            left = np.flatnonzero(fit.any(axis=1))
        if len(left):
            sig = np.frombuffer(b"".join(rows["sig"][s:e][left]), np.uint8).reshape(len(left), -1)
            fit[np.ix_(left, left)] &= agreeing(sig) >= AGREE
        return fit

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, ends in whole_groups(batches, group):
            found = [[], []]
            for s, e in zip(starts.tolist(), ends.tolist()):
                fit = near(rows, s, e) if e - s > 1 else np.zeros((1, 1), bool)
                told = np.flatnonzero(fit.any(axis=1))
                if len(told):
                    label = reached(fit[np.ix_(told, told)])
                    cell = f"{rows['kind'][s]}:{rows['k'][s]}:{rows['_i'][s]}:{rows['_j'][s]}:"
                    names = {k: xxhash.xxh64_intdigest(f"{cell}{k}") - (1 << 63) for k in np.unique(label).tolist()}
                    found[0] += [names[k] for k in label.tolist()]
                    found[1] += rows["node"][s:e][told].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in found], names=["g", "node"])

    return dealt.mapInArrow(compare, "g long, node long")


def agreeing(sig: np.ndarray) -> np.ndarray:
    """In how many columns each two rows agree."""
    if len(sig) <= 32:
        return (sig[:, None] == sig[None, :]).sum(axis=2)
    same = np.zeros((len(sig), len(sig)), np.int16)
    for c in np.ascontiguousarray(sig.T):
        same += c[:, None] == c[None, :]
    return same


def links(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect what the near copies within the groups ``(g, node)`` connect, by their whole shingle sets ``(node, own)``."""
    dealt = groups.join(sets, "node").select("g", "node", "own").repartition("g").sortWithinPartitions("g", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, ends in whole_groups(batches, ["g"]):
            for s, e in zip(starts, ends):
                found = list(spanning([np.frombuffer(x, np.uint64) for x in rows["own"][s:e]]))
                if found:
                    a, b = rows["node"][s + np.array(found)].T
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies, that with the smallest doc_id.

    Near copies share ``LEAST`` of their five-word shingles; a group is what they connect.
    Rows are told apart by doc_id and text, so different texts under one id, or none, are
    judged each; a row without an id stays only where no row of its group has one.  Texts
    without words are copies of each other.
    """
    ids = fresh(docs.columns, "_id")
    key = fresh([*docs.columns, ids], "_key")
    own_id, own_key = F.col(f"`{doc_id}`").cast("long"), F.xxhash64(F.col(f"`{text}`").cast("string"))

    def sketch():
        return lambda texts: [list(column) for column in zip(*map(sketched, texts))] if texts else [[] for _ in SKETCH]

    def whole():
        return lambda texts: [[shingle_set(t).tobytes() for t in texts]]

    held = docs.select(own_id.alias("doc_id"), own_key.alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    prints = saved(per_text(held, "text", SKETCH, sketch, ["doc_id", "key"]), "prints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    points = saved(prints.groupBy("node").agg(F.min(first).alias("first"), *[F.first(c).alias(c) for c, _ in SKETCH[1:]]), "points")
    groups = saved(candidates(points), "groups")
    # one text of each point that has candidates, found by its hash
    asked = points.join(groups.select("node").distinct(), "node").select("node", F.col("first.key").alias("key"))
    texts = held.select("key", "text").join(asked, "key").dropDuplicates(["node"])
    sets = saved(per_text(texts, "text", [("own", "binary")], whole, ["node"]), "sets")
    found = components(links(groups, sets))
    named = points.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "first")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    labels = saved(named.join(least, "component").select("node", "least"), "labels")
    rows = prints.groupBy("node", "doc_id", "key").agg(F.count("*").alias("n")).join(labels, "node")
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("key") == F.col("least.key"))
    judged = saved(rows.select(F.col("doc_id").alias(ids), F.col("key").alias(key), "n", stays.alias("stays")), "judged")
    gone = judged.where("NOT stays").select(ids, key)
    kept = docs.join(gone, (own_key == gone[key]) & own_id.eqNullSafe(gone[ids]), "left_anti")
    if judged.where("stays AND n > 1").take(1):
        kept = kept.withColumns({ids: own_id, key: own_key}).dropDuplicates([ids, key]).drop(ids, key)
    return kept
