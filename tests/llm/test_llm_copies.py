"""Near copies of texts and vectors, components and cells against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clearroll.llm import cells, components, embeddings, simhash

DOCS = "doc_id long, text string, fp0 string, node int, component_id long"


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_components_of_chains_stars_and_random_edges(spark):
    rng = random.Random(4)
    chain = list(range(100, 160))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(1000, 1000 + i) for i in range(1, 300)]
    edges += [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(90)] + [(5, 5)]
    want = union([e for e in edges if e[0] != e[1]], {n for a, b in edges if a != b for n in (a, b)})
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {tuple(r) for r in got.collect()} == set(want.items())
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_equals_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeÄß") for _ in range(rng.randint(1, 7)))
    texts = [" ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 9, 80, 300]))) for _ in range(40)]
    for t in texts[:25]:
        w = t.split()
        if len(w) > 20:
            w[rng.randrange(len(w))] = "changed"
        texts.append("\t".join(w) if rng.random() < 0.5 else " ".join(w).upper())
    texts += [None, "", " \n\x0b ", texts[3], texts[3], "long " * 30_000]
    rows = [(i * 3 % 101, t, "x", 1, 7) for i, t in enumerate(texts)] + [(None, texts[5], None, None, None), (0, texts[0], "x", 1, 7)]
    prints = [(i, brute_print(t)) for i, t, *_ in rows]
    pairs = [(a, b) for _, a in prints for _, b in prints if (a ^ b).bit_count() <= 2]
    group = union(pairs, {p for _, p in prints})
    least = {}
    for i, p in prints:
        if i is not None:
            least[group[p]] = min(i, least.get(group[p], i))
    want = sorted((str(i), format(p, "016x"), least.get(group[p])) for i, p in prints)
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == want
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("radius,blocks", [(2, 4), (6, 9)])
def test_links_in_crowded_blocks(spark, monkeypatch, radius, blocks):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    monkeypatch.setattr(simhash, "SMALL", 6)
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, radius))) for b in base for _ in range(70)}
    fps |= {rng.getrandbits(64) for _ in range(40)}
    pairs = [(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= radius]
    want = union(pairs, fps)
    points = spark.createDataFrame([(simhash.signed(f), simhash.signed(f)) for f in fps], "node long, fp0 long")
    edges = simhash.links(points, radius, blocks)
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 64 for r in edges.take(5))
    found = {r.node: r.component for r in components.components(edges).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(found.get(simhash.signed(f), ("alone", f)), set()).add(want[f])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_cells_hold_every_pair_once_and_stay_small(spark):
    rows = [(k, i) for k, n in ((1, 1), (2, 5), (3, 130)) for i in range(n)]
    dealt = cells.cells(spark.createDataFrame(rows, "key int, m long"), ["key"], F.col("m"), 20).collect()
    held = {}
    for r in dealt:
        held.setdefault((r.key, r._i, r._j), []).append((r.m, r._side))
    seen = {}
    for (key, i, j), members in held.items():
        assert len(members) < 80
        for a, sa in members:
            for b, sb in members:
                if a < b and (i == j or sa != sb):
                    seen[key, a, b] = seen.get((key, a, b), 0) + 1
    assert set(seen.values()) == {1} and len(seen) == 5 * 4 // 2 + 130 * 129 // 2


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 20))
    vectors = [b + rng.normal(size=20) * s for b in base for s in (0, 0, 0.05, 0.1, 0.2, 0.4, 0.6)]
    rows = [(i, [float(x) for x in v], "z") for i, v in enumerate(vectors)]
    rows += [(900, None, "z"), (901, [0.0] * 20, "z"), (902, [float("nan")] * 20, None), (903, [1.0] * 19 + [None], "z"), (904, [float("inf")] + [0.0] * 19, "z")]
    rows += [(905, [], "z"), (906, rows[0][1][:7], "z"), (3, rows[0][1], "z"), (None, rows[1][1], "z")]
    schema = "vec_id long, embedding array<double>, links string"
    good = [i for i, r in enumerate(rows) if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links, pairs = {i: 0 for i in range(len(rows))}, []
    for a in good:
        for b in good:
            if a != b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.9:
                    links[a] += 1
                    pairs.append((a, b))
    group, least = union(pairs, range(len(rows))), {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[group[i]] = min(r[0], least.get(group[i], r[0]))
    want = sorted((str(r[0]), links[i], least[group[i]], r[0] == least[group[i]]) for i, r in enumerate(rows))
    for chunk in (512, 5):  # cells of whole buckets, and of pieces
        got = embeddings.near_vectors(spark.createDataFrame(rows, schema), chunk=chunk)
        assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got.collect()) == want
    assert embeddings.near_vectors(spark.createDataFrame([], schema)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    for dim in (48, 64):
        a = rng.normal(size=(1500, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        r = rng.normal(size=a.shape)
        r -= (r * a).sum(axis=1, keepdims=True) * a
        r /= np.linalg.norm(r, axis=1, keepdims=True)
        near, sizes = 0.9 * a + np.sqrt(1 - 0.81) * r, (embeddings.HASHES, embeddings.TABLES, embeddings.PROBES)
        x, y, z = (embeddings.buckets(v, *sizes).tolist() for v in (a, near, r))
        assert np.mean([bool(set(p) & set(q)) for p, q in zip(x, y)]) >= 0.95
        assert np.mean([bool(set(p) & set(q)) for p, q in zip(x, z)]) <= 0.02


def test_rotation_is_orthogonal():
    x = np.random.default_rng(0).normal(size=(5, 32))
    y = embeddings.rotated(x) / np.sqrt(32)
    assert np.allclose((x * x).sum(axis=1), (y * y).sum(axis=1))
    assert np.allclose(embeddings.rotated(y) / np.sqrt(32), x)
