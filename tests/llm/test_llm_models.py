"""Language spans, quality and toxicity: paths and gradients against brute force, held-out accuracy, odd tables."""

import math
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from clearroll.llm import charwords, langid, quality, toxicity

SMALL, MIDDLE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
ODD = [(1, None), (2, ""), (3, "12 34 !!"), (4, "The and of it"), (4, "The and of it"), (None, "und die der"), (5, "wort " * 40_000), (10, "ещё слово")]


def test_words_and_grams():
    known = charwords.tables()
    w = charwords.Words(["Ab c!", None, "éX1y"], known)
    assert [(s, e) for s, e in zip(w.start, w.end)] == [(0, 2), (3, 4), (7, 9), (10, 11)]
    assert w.text.tolist() == [0, 0, 2, 2] and w.first.tolist() == [0, 2, 2, 4] and w.offset.tolist() == [0, 6, 7, 12]
    h = charwords.Words(["ab AB ba a b"], known).hashes()
    assert h[0] == h[1] != h[2] and len(set(h.tolist())) == 4
    at, where, found = charwords.Words(["xab", "ab", "zzab ab"], known).grams(12, (2, 3))
    by = {}
    for k, i in enumerate(where):
        by[k] = [f[i : (where[k + 1] if k + 1 < len(where) else len(at))].tolist() for f in found]
    assert by[1] == by[3] and by[0] != by[1]
    assert sorted(i for p in charwords.chunks(["a" * 5, "b", None, "c" * 9], 6) for i in p) == [0, 1, 2, 3]


def test_best_path_is_the_best_of_all_paths():
    rng = np.random.default_rng(1)
    first = np.array([0, 5, 5, 6, 11])
    scores = rng.normal(0, 2, (11, 3))
    got = langid.best_path(scores, first, 1.5)
    for a, b in zip(first, first[1:]):
        value = lambda p: sum(scores[a + i, s] for i, s in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: E731,B023
        if b > a:
            assert np.isclose(value(got[a:b]), max(value(p) for p in product(range(3), repeat=b - a)))


def test_language_of_held_out_and_odd_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97
    crc = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("h")).collect()
    import zlib

    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in crc)
    model = langid.fit(docs)
    odd = spark.createDataFrame([(*r, "x") for r in ODD], "doc_id long, text string, spans string")
    got = {(r.doc_id, r.text and r.text[:9]): r for r in langid.label(odd, model).collect()}
    assert got[1, None].lang_pred == got[2, ""].lang_pred == got[3, "12 34 !!"].lang_pred == langid.UNKNOWN
    assert got[4, "The and o"].lang_pred == "en" and got[None, "und die d"].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got[5, "wort wort"].spans_) >= 1
    mixed = docs.where("lang = 'fr' AND n_chars > 900").first().text[:600] + " " + docs.where("lang = 'de' AND n_chars > 900").first().text[:600]
    spans = langid.label(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first().spans
    assert {"fr", "de"} <= {s.lang for s in spans} and spans[0].start <= 1 and abs(spans[-1].end - len(mixed)) < 20
    assert langid.label(odd, None).where("lang_pred <> 'und'").count() == 0
    empty = docs.limit(0)
    assert langid.identify(empty).count() == 0 and langid.fit(empty) is None


def test_scripts_narrow_candidates(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("привет мир слово дело", "ru"), ("hello world of words", "en")] * 12)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = langid.label(spark.createDataFrame([(1, "zzz qqq"), (2, "жжж щщщ")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["en", "ru"]


def test_discriminant_equals_densities():
    rng = np.random.default_rng(3)
    x = [rng.normal(c, 1 + c, (200, 4)) @ rng.normal(size=(4, 4)) for c in (0, 1)]
    found = {c: (float(len(v)), v.sum(axis=0), v.T @ v) for c, v in enumerate(x)}
    model, both = quality.discriminant(found, 0.2, 1e-3), np.concatenate(x)
    scale, mean = both.std(axis=0), both.mean(axis=0)
    covs = [np.cov(((v - mean) / scale).T, bias=True) for v in x]
    pooled, points = (covs[0] + covs[1]) / 2, rng.normal(size=(9, 4)) * 3
    logs = []
    for c in (0, 1):
        s = 0.8 * covs[c] + 0.2 * pooled + 1e-3 * np.eye(4)
        d = (points - mean) / scale - ((x[c] - mean) / scale).mean(axis=0)
        logs.append(-0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(s), d) - 0.5 * np.log(np.linalg.det(s)) + np.log(model["prior"][c]))
    assert np.allclose(quality.chances(model, points), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_statistics_of_single_texts_do_not_depend_on_company():
    known = charwords.tables()
    texts = ["Ab ab AB!! 12", "", "x", "one two three one two three one two three", None, "é\n\nÜ $$$"]
    together = quality.statistics(texts, known)
    assert np.allclose(together, np.vstack([quality.statistics([t], known) for t in texts]))
    assert (together[1] == 0).all() and (together[4] == 0).all() and together[3][11] > 0.5 and np.isfinite(together).all()
    assert np.isclose(together[0][10], np.sqrt(1 / 3))


def test_quality_of_held_out_and_odd_texts(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.score(docs, labels).join(labels, "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] >= 0.93
    odd = spark.createDataFrame([(*r, "x") for r in ODD], "doc_id long, text string, score string")
    for known in (labels, labels.limit(0), labels.unionByName(labels).withColumn("quality", F.lit(None).cast("int"))):
        got = quality.score(odd, known).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.score(odd.limit(0), labels).count() == 0


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(2)
    words = charwords.Words(["one two three four", "five", "six seven " * 30], charwords.tables())
    p = {k: v.astype(np.float64) for k, v in toxicity.fresh_network(rng.normal(size=1 << toxicity.BITS), rng.normal(size=len(toxicity.SIZES) << toxicity.BITS)).items()}
    data, y = toxicity.inputs(words), np.array([1, 0, 1])
    start, length = words.first[:-1], np.minimum(toxicity.WINDOW, np.diff(words.first))

    def loss():
        logit = toxicity.forward(p, toxicity.word_values(p, *data), start, length)
        return (np.log1p(np.exp(logit)) - y * logit).sum()

    x = toxicity.word_values(p, *data)
    logit, kept = toxicity.forward(p, x, start, length, True)
    g = toxicity.gradients(p, x, *data, kept, 1 / (1 + np.exp(-logit)) - y)
    for name, v in p.items():
        flat, slope = v.reshape(-1), np.asarray(g[name]).reshape(-1)
        for i in {int(np.abs(slope).argmax()), int(rng.integers(len(flat)))}:
            held, step = flat[i], 1e-3
            flat[i] = held + step
            up = loss()
            flat[i] = held - step
            down = loss()
            flat[i] = held
            assert np.isclose((up - down) / 2 / step, slope[i], rtol=0.03, atol=2e-3), (name, i)


def test_windows_overlap_and_cover():
    n = np.array([0, 1, toxicity.WINDOW, toxicity.WINDOW + 1, 333])
    first = np.concatenate([[0], np.cumsum(n)])
    text, start, length = toxicity.windows(first)
    for k in range(len(n)):
        own = text == k
        covered = {w for s, m in zip(start[own], length[own]) for w in range(s, s + m)}
        assert covered == set(range(first[k], first[k + 1]))
        assert all(b - a == toxicity.STRIDE for a, b in zip(start[own], start[own][1:]))


def test_summary():
    got = toxicity.summary(np.array([1.0, 3.0, -2.0]), np.array([0, 0, 2]), 3)
    assert got[0][:2].tolist() == [3.0, 1.0] and got[1].tolist() == [0] * 5 and got[2][:2].tolist() == [-2.0, -2.0]


def plain_logit(p, x):
    """The logit of one window, step by step and value by value."""
    H = toxicity.HIDDEN
    sig = lambda v: 1 / (1 + math.exp(-v))
    states = [[] for _ in x]
    for d in "fb":
        h = [0.0] * H
        side = [None] * len(x)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            gx = [sum(x[t][i] * p[f"W{d}"][i][j] for i in range(len(x[t]))) + p[f"c{d}"][j] for j in range(3 * H)]
            gh = [sum(h[i] * p[f"U{d}"][i][j] for i in range(H)) for j in range(3 * H)]
            r = [sig(gx[j] + gh[j]) for j in range(H)]
            z = [sig(gx[H + j] + gh[H + j]) for j in range(H)]
            new = [math.tanh(gx[2 * H + j] + r[j] * gh[2 * H + j]) for j in range(H)]
            h = [(1 - z[j]) * new[j] + z[j] * h[j] for j in range(H)]
            side[t] = h
        states = [a + b for a, b in zip(states, side)]
    told = [sum(math.tanh(sum(s[i] * p["A"][i][j] for i in range(2 * H))) * p["v"][j] for j in range(2 * H)) for s in states]
    share = [math.exp(v - max(told)) for v in told]
    mean = [sum(a * s[j] for a, s in zip(share, states)) / sum(share) for j in range(2 * H)]
    return sum(mean[j] * p["w"][j] for j in range(2 * H)) + p["b"][0]


def test_summaries_equal_plain_loops_over_every_window():
    rng = np.random.default_rng(9)
    p = {k: v.astype(np.float64) for k, v in toxicity.fresh_network(rng.normal(size=1 << toxicity.BITS), rng.normal(size=len(toxicity.SIZES) << toxicity.BITS)).items()}
    p["b"] = np.array([0.3])
    texts = [" ".join(f"w{rng.integers(50)}é" for _ in range(n)) for n in (1, 2, 39, 40, 41, 60, 61, 130)] + ["", "123 !"]
    got = toxicity.summaries(p, texts, charwords.tables())
    for text, row in zip(texts, got):
        own = charwords.Words([text], charwords.tables())
        n, logits = len(own.start), []
        x = toxicity.word_values(p, *toxicity.inputs(own)).tolist() if n else []
        at = 0
        while n:
            logits.append(plain_logit(p, x[at : at + toxicity.WINDOW]))
            at += toxicity.STRIDE
            if at - toxicity.STRIDE + toxicity.WINDOW >= n:
                break
        if not logits:
            assert row.tolist() == [0.0] * 5
            continue
        clipped = sorted((min(12, max(-12, v)) for v in logits), reverse=True)
        want = [clipped[0], clipped[min(1, len(clipped) - 1)], math.log(sum(map(math.exp, clipped)) / len(clipped)), math.log1p(len(clipped)), 1.0]
        assert np.allclose(row, want, atol=1e-6), text


def test_toxicity_of_held_out_and_odd_texts(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    marked = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = toxicity.score(marked, labels).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.8 and n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) >= 0.85
    odd = spark.createDataFrame([(*r, "x") for r in ODD], "doc_id long, text string, score string")
    found = toxicity.score(odd, labels.limit(0)).collect()
    assert len(found) == len(ODD) and {r.score for r in found} == {0.0}
    assert toxicity.score(odd.limit(0), labels).count() == 0
    few = spark.createDataFrame([(i, i % 2) for i in range(200, 280)], "doc_id long, toxic int")
    more = spark.createDataFrame([*ODD, *[(i, "awful words here" if i % 2 else "fine words there") for i in range(200, 280)]], "doc_id long, text string")
    scored = toxicity.score(more, few).collect()
    assert len(scored) == len(ODD) + 80 and all(0 <= r.score <= 1 for r in scored)
    assert all(r.predicted == r.doc_id % 2 for r in scored if r.doc_id and r.doc_id >= 200)
