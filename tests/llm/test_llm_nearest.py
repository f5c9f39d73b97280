"""Nearest vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearroll.llm import nearest
from clearroll.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<double>, score string, node int"


def brute(rows, asked, k):
    """Nearest of every query by a plain cosine, ties to the smaller id."""
    clean = lambda r: r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
    held = sorted({(i, tuple(v)) for i, v, *_ in rows if clean((i, v))})
    out = {}
    for q, v in sorted({(i, tuple(v)) for i, v, *_ in asked if clean((i, v))}):
        a = np.array(v)
        a = a / np.abs(a).max()
        scored = []
        for i, w in held:
            if i != q and len(w) == len(v):
                b = np.array(w) / np.abs(w).max()
                scored.append((-float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), i))
        out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in scored)[:k]]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS)


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def clustered(seed, n, dim):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(12, size=n)] + rng.normal(size=(n, dim)) * 0.3
    return [(i, [float(a) for a in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize("shard,leaf", [(100_000, 16), (64, 8)])
def test_factor_one_is_exact(spark, shard, leaf):
    rows = clustered(1, 700, 9)
    rows += [(1000 + i, rows[3][1]) for i in range(30)]  # copies
    rows += [(2000, [2 * a for a in rows[5][1]]), (2001, rows[8][1]), (2001, rows[8][1]), (2050, [1e200 * a for a in rows[50][1]]), (-50, [1e-200 * a for a in rows[7][1]])]
    rows += [(3000, None), (3050, []), (3100, [0.0] * 9), (3150, [float("nan")] * 9), (3200, [None] + [1.0] * 8), (None, rows[1][1]), (3250, [float("inf")] * 9)]
    rows += [(4000, [1.0, 2.0]), (4001, [2.0, 1.0])]
    asked = [r for r in rows if r[0] is not None and r[0] % 50 == 0] + [(1003, rows[3][1])]
    got = answers(nearest.nearest(table(spark, rows), table(spark, asked), 5, 1.0, shard, leaf))
    want = brute(rows, asked, 5)
    assert set(got) == set(want) and want[4000] == [(4001, pytest.approx(0.8))]
    for q, near in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in near], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in near], atol=1e-12)


def test_query_reaches_its_recall(spark, folder):
    held = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in held.collect()]
    want = brute(rows, [r for r in rows if r[0] % 50 == 0], 5)
    frame = QUERIES["op13_nearest_vectors"](spark, folder)
    assert frame.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got = answers(frame)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_relaxed_pruning_keeps_recall_and_saves_work(monkeypatch):
    rows = clustered(4, 4000, 16)
    x = np.array([v for _, v in rows])
    tree = nearest.Shard(x, [[i] for i, _ in rows], 32)
    work = {1.0: 0, 1.5: 0, 3.0: 0}
    hits = dict.fromkeys(work, 0)
    for factor in work:
        for q in range(0, 4000, 40):
            own = x[q] / np.linalg.norm(x[q])
            true = np.argsort(-(x @ own / np.linalg.norm(x, axis=1)), kind="stable")[:6]
            calls = []
            monkeypatch.setattr(nearest, "heappop", lambda heap, pop=nearest.heappop: calls.append(1) or pop(heap))
            got = tree.nearest(x[q], 6, factor, -2.0)
            monkeypatch.undo()
            work[factor] += len(calls)
            hits[factor] += len({i for _, i in got} & set(true.tolist()))
    assert hits[1.0] == 600 and hits[1.5] >= 540
    assert work[3.0] < work[1.5] < work[1.0]


def test_empty_tables_and_few_candidates(spark):
    none = table(spark, [])
    two = table(spark, [(50, [1.0, 0.0]), (51, [1.0, 1.0])])
    assert nearest.nearest(none, none).count() == 0 and nearest.nearest(two, none).count() == 0
    assert nearest.nearest(none, two).count() == 0
    got = nearest.nearest(two, two.where(F.col("vec_id") == 50)).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(50, 1, 51)]
