"""Near copies of the pipeline against brute-force shingle similarity, by document length."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clearroll.llm import similar
from test_llm_copies import union

DOCS = "doc_id long, text string"


def similarity(a, b):
    a, b = (x.lower().split() for x in (a, b))
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("words,edits", [(30, 1), (60, 1), (100, 2), (300, 5)])
def test_near_copies_of_any_length(spark, words, edits):
    rng = random.Random(words)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = []
    for _ in range(60):
        w = rng.choices(vocabulary, k=words)
        texts.append(" ".join(w))
        for k in (edits, edits * 4):  # about 0.8 or more, and well below
            v = list(w)
            for at in rng.sample(range(words), k) if k > edits else [rng.choice((0, 1, words - 1, rng.randrange(words))) for _ in range(k)]:
                v[at] = rng.choice(vocabulary)
            texts.append(" ".join(v))
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    pairs = [(a, b) for a in range(len(texts)) for b in range(a // 3 * 3, a) if similarity(texts[a], texts[b]) >= 0.8]
    assert len(pairs) >= 15
    group = union(pairs, range(len(texts)))
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert got == {d for d in group if group[d] == d}


def test_crowds_chains_and_odd_rows(spark):
    rng = random.Random(5)
    base = [str(rng.random()) for _ in range(120)]
    crowd = []
    for i in range(400):  # more than one cell; neighbours alike, ends not
        w = list(base)
        w[: i // 4] = [f"x{k}" for k in range(i // 4)]
        crowd.append((1000 + i, " ".join(w) + " "))
    other = [str(rng.random()) for _ in range(40)]
    odd = [(7, " ".join(other)), (7, "one two three"), (None, "ONE two\tthree"), (None, " ".join(other[::-1])), (None, " ".join(other[::-1]))]
    odd += [(8, None), (9, ""), (3, "one two three four"), (3, "one two three four"), (2, "one two three five")]
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(crowd + odd, DOCS), "").collect()
    want = [crowd[0], odd[0], odd[1], odd[3], odd[5], odd[7], odd[9]]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_benchmark_items_under_null_and_repeated_ids(spark, folder):
    item = spark.read.parquet(f"{folder}/benchmark.parquet").where("length(text) > 60").first().text
    rows = [(None, f"before {item} after"), (None, "nothing here"), (1, f"{item} more"), (1, "a text of its own"), (2, None)]
    got = corpus_pipeline.benchmark_free(spark, spark.createDataFrame(rows, DOCS), folder).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [rows[1], rows[3], rows[4]]))


def sketches(spark, texts):
    rows = [tuple(similar.sketched(t.encode())) for t in texts]
    return spark.createDataFrame(rows, "node long, n long, fp long, sig binary, bands array<long>")


def measured(groups):
    """Pairs of texts whose shingles may be compared."""
    return groups.groupBy("g").agg((F.count("*") * (F.count("*") - 1) / 2).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def test_a_template_costs_in_proportion(spark):
    work = []
    for count in (1000, 4000):
        rng = random.Random(count)
        template = [str(rng.random()) for _ in range(100)]
        texts = []
        for i in range(count):
            own = [str(rng.random()) for _ in range(100)]
            texts.append(" ".join(template + own))
            if i % 20 == 0:
                own[50] = "changed"
                texts.append(" ".join(template + own))
        groups = similar.candidates(sketches(spark, texts))
        work.append(measured(groups))
        assert work[-1] >= count // 20  # every changed text meets its source
    assert work[1] < 6 * work[0] and work[1] < 4000


def test_each_pair_is_looked_at_in_one_cell(spark):
    rng = random.Random(2)
    base = [str(rng.random()) for _ in range(200)]
    texts = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        texts.append(" ".join(w))
    points = sketches(spark, texts)
    for chunk in (512, 20):
        groups = similar.candidates(points, chunk).collect()
        held = {}
        for r in groups:
            held.setdefault(r.g, set()).add(r.node)
        assert max(map(len, held.values())) <= (150 if chunk == 512 else 80)
        pairs = {(a, b) for g in held.values() for a in g for b in g if a < b}
        nodes = {similar.sketched(t.encode())[0]: t for t in texts}
        near = {(a, b) for a in nodes for b in nodes if a < b and similarity(nodes[a], nodes[b]) >= 0.8}
        assert near <= pairs


@pytest.mark.parametrize("words", [16, 30, 100, 400])
def test_recall_of_sketches_by_length(words):
    """Pairs at 0.8 or little more all meet in a block or band and agree in enough minima."""
    rng = random.Random(words)
    told = 0
    while told < 60:
        w = [str(rng.randrange(10**6)) for _ in range(words)]
        v = list(w)
        for at in rng.sample(range(words), max(1, words // 45)) if words > 40 else [rng.choice((0, words - 1))]:
            v[at] = "changed"
        if 0.8 <= similarity(" ".join(w), " ".join(v)) < 0.95:
            told += 1
            a, b = (similar.sketched(" ".join(x).encode()) for x in (w, v))
            agree = int((np.frombuffer(a[3], np.uint8) == np.frombuffer(b[3], np.uint8)).sum())
            close = ((a[2] ^ b[2]) & (2**64 - 1)).bit_count() <= similar.RADIUS
            assert agree >= similar.AGREE and (close or set(a[4]) & set(b[4]))
