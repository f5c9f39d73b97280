"""Toxicity: a bidirectional gated recurrent network with attention over all windows of a text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .charwords import Words, chunks, tables
from .langid import held_out, sampled
from .quality import one_label
from .store import per_text, saved

#: Hash buckets (bits) of words and of letter n-grams, and the n-gram sizes.
BITS, SIZES = 15, (3, 5)
#: Values per input and per direction of the network; words per window and between window starts.
DIM, HIDDEN, WINDOW, STRIDE = 8, 8, 40, 20
#: Labelled documents that are learned from, at most about so many; half train the network, half its document score.
SAMPLE = 12_000
#: Windows of a training document: so many likeliest ones, and one by chance if it is not toxic.
LIKELIEST = 2
EPOCHS, BATCH, RATE, SEED = 6, 128, 0.01, 3
#: Standard errors below which a bucket says nothing about the class.
NOISE = 3.0
THRESHOLD = 0.5


def inputs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, n-gram buckets and the word each n-gram is of."""
    word = (words.hashes() >> np.uint64(64 - BITS)).astype(np.int64)
    at, where, found = words.grams(BITS, SIZES)
    of = np.repeat(np.arange(len(where)), np.diff(np.append(where, len(at))))
    return word, np.stack(found, axis=1), of


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and length of every window: one each ``STRIDE`` words until the text is covered."""
    n = np.diff(first)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = first[:-1][text] + place * STRIDE
    return text, start, np.minimum(WINDOW, first[1:][text] - start)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fresh_network(word: np.ndarray, gram: np.ndarray, seed: int = SEED) -> dict:
    """Parameters before training; the first input value of each bucket is what its counts say."""
    rng = np.random.default_rng(seed)
    p = {"word": rng.normal(0, 0.02, (len(word), DIM)), "gram": rng.normal(0, 0.02, (len(gram), DIM))}
    p["word"][:, 0], p["gram"][:, 0] = word, gram
    for d in "fb":
        p[f"W{d}"] = rng.normal(0, 0.3, (DIM, 3 * HIDDEN))
        p[f"U{d}"] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
        p[f"c{d}"] = np.zeros(3 * HIDDEN)
    p |= {"A": rng.normal(0, 0.3, (2 * HIDDEN, 2 * HIDDEN)), "v": rng.normal(0, 0.3, 2 * HIDDEN), "w": rng.normal(0, 0.3, 2 * HIDDEN), "b": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def word_values(p: dict, word: np.ndarray, gram: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The network's input for every word: its word value and half the sum of its n-gram values."""
    starts = np.flatnonzero(np.diff(np.concatenate([[-1], of])))
    grams = p["gram"][gram[:, 0]]
    for j in range(1, gram.shape[1]):
        grams += p["gram"][gram[:, j]]
    return p["word"][word] + 0.5 * np.add.reduceat(grams, starts, axis=0)


def run_gates(gx, U, mask, backward, keep=False):
    """States of one direction over ``gx(windows, steps, 3 * HIDDEN)``; with ``keep``, what its gradient needs as well."""
    n, steps, H = gx.shape[0], gx.shape[1], HIDDEN
    h, out, tape = np.zeros((n, H), np.float32), np.zeros((n, steps, H), np.float32), []
    for t in reversed(range(steps)) if backward else range(steps):
        g, gh = gx[:, t], h @ U
        rz = _sigmoid(g[:, : 2 * H] + gh[:, : 2 * H])
        r, z = rz[:, :H], rz[:, H:]
        new = np.tanh(g[:, 2 * H :] + r * gh[:, 2 * H :])
        m = mask[:, t, None]
        if keep:
            tape.append((t, h, r, z, new, gh[:, 2 * H :]))
        h = np.where(m, new + z * (h - new), h)
        out[:, t] = h
    return (out, tape) if keep else out


def forward(p: dict, x: np.ndarray, start: np.ndarray, length: np.ndarray, keep: bool = False):
    """Logits of the windows at ``start`` over word inputs ``x``: both directions, then attention over their states."""
    steps = np.arange(WINDOW)
    mask = steps < length[:, None]
    at = np.minimum(start[:, None] + steps, len(x) - 1)
    sides, tapes = [], []
    for d in "fb":
        gx = (x @ p[f"W{d}"] + p[f"c{d}"])[at]
        got = run_gates(gx, p[f"U{d}"], mask, d == "b", keep)
        sides.append(got[0] if keep else got)
        tapes.append(got[1] if keep else None)
    h = np.concatenate(sides, axis=2)
    u = np.tanh(h @ p["A"])
    s = np.where(mask, u @ p["v"], -1e9)
    a = np.exp(s - s.max(axis=1, keepdims=True))
    a /= a.sum(axis=1, keepdims=True)
    c = np.einsum("nt,nth->nh", a, h)
    logit = c @ p["w"] + p["b"][0]
    return (logit, (mask, at, h, u, a, c, tapes)) if keep else logit


def gradients(p: dict, x, word, gram, of, kept, slope) -> dict:
    """Gradients of all parameters from ``slope``, the loss's derivative in each logit."""
    mask, at, h, u, a, c, tapes = kept
    H = HIDDEN
    g = {"w": c.T @ slope, "b": np.array([slope.sum()])}
    dc = slope[:, None] * p["w"]
    da = np.einsum("nh,nth->nt", dc, h)
    ds = a * (da - (a * da).sum(axis=1, keepdims=True))
    g["v"] = np.einsum("nt,nth->h", ds, u)
    pre = ds[:, :, None] * p["v"] * (1 - u * u)
    g["A"] = np.einsum("nti,ntj->ij", h, pre)
    dh_all = a[:, :, None] * dc[:, None, :] + pre @ p["A"].T
    dx = np.zeros_like(x)
    for side, d in enumerate("fb"):
        U, dU, dh = p[f"U{d}"], np.zeros_like(p[f"U{d}"]), np.zeros((len(h), H), np.float32)
        dgx = np.zeros((*mask.shape, 3 * H), np.float32)
        for t, before, r, z, new, ghn in reversed(tapes[side]):
            dh = dh + dh_all[:, t, side * H : side * H + H]
            m = mask[:, t, None]
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (before - new) * z * (1 - z)
            dr = dn * ghn * r * (1 - r)
            dg = np.where(m, np.concatenate([dr, dz, dn], axis=1), 0)
            dgh = np.where(m, np.concatenate([dr, dz, dn * r], axis=1), 0)
            dU += before.T @ dgh
            dgx[:, t] = dg
            dh = np.where(m, dh * z, dh) + dgh @ U.T
        flat, rows = dgx.reshape(-1, 3 * H), at.ravel()
        g[f"U{d}"], g[f"c{d}"], g[f"W{d}"] = dU, flat.sum(axis=0), x[rows].T @ flat
        back = flat @ p[f"W{d}"].T
        for k in range(DIM):
            dx[:, k] += np.bincount(rows, back[:, k], len(x))
    g["word"] = np.stack([np.bincount(word, dx[:, k], len(p["word"])) for k in range(DIM)], axis=1)
    half = 0.5 * dx[of]
    g["gram"] = sum(np.stack([np.bincount(gram[:, j], half[:, k], len(p["gram"])) for k in range(DIM)], axis=1) for j in range(gram.shape[1]))
    return g


def train(texts: list[str], y: np.ndarray, word: np.ndarray, gram: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """The network fitted to windows (one text each) and labels, classes weighed alike, by Adam."""
    p, rng = fresh_network(word, gram, seed), np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    known, step = tables(), 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            words = Words([texts[i] for i in rows], known)
            have = np.diff(words.first) > 0
            if not have.any():
                continue
            data = inputs(words)
            x = word_values(p, *data)
            start, length = words.first[:-1][have], np.minimum(WINDOW, np.diff(words.first)[have])
            logit, kept = forward(p, x, start, length, True)
            slope = ((_sigmoid(logit) - y[rows][have]) * weight[rows][have] / len(rows)).astype(np.float32)
            g, step = gradients(p, x, *data, kept, slope), step + 1
            rate = RATE * (1 - 0.8 * epoch / epochs)
            for k, v in p.items():
                m, s = moments[k]
                d = g[k].astype(np.float32)
                m += 0.1 * (d - m)
                s += 0.01 * (d * d - s)
                slow = 0.2 if k in ("word", "gram") else 1.0
                v -= np.float32(slow * rate) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return p


def bucket_weights(counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """What each bucket says: log of how many standard errors its toxic documents exceed chance by, beyond noise."""
    total = counts.sum(axis=1)
    rate = docs[1] / max(1, docs.sum())
    error = np.sqrt(np.maximum(total * rate * (1 - rate), 1e-9))
    z = np.where(total > 0, (counts[:, 1] - total * rate) / error, 0)
    return np.sign(z) * np.log1p(np.maximum(0, np.abs(z) - NOISE))


def evidence(words: Words, word_weight: np.ndarray, gram_weight: np.ndarray) -> np.ndarray:
    """A word's weight and the sum of its n-grams' weights."""
    word, gram, of = inputs(words)
    return word_weight[word] + np.bincount(of, gram_weight[gram].sum(axis=1), len(word))


def summary(logits: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Per text: highest logit, second highest, log of the mean odds, log number of windows, whether it has any."""
    out = np.zeros((n, 5))
    if len(logits):
        order = np.lexsort((-logits, text))
        t, v = text[order], np.clip(logits[order], -12, 12)
        head = np.flatnonzero(np.diff(np.concatenate([[-1], t])))
        out[t[head], 0] = v[head]
        out[t[head], 1] = v[head]
        more = head[(head + 1 < len(t))]
        more = more[t[np.minimum(more + 1, len(t) - 1)] == t[more]]
        out[t[more], 1] = v[more + 1]
        count = np.bincount(text, minlength=n)
        odds = np.bincount(text, np.exp(np.clip(logits, -12, 12)), n)
        out[:, 2] = np.where(count > 0, np.log(np.maximum(odds, 1e-9) / np.maximum(count, 1)), 0)
        out[:, 3], out[:, 4] = np.log1p(count), count > 0
    return out


def summaries(p: dict, texts: list[str | None], known) -> np.ndarray:
    """:func:`summary` of every whole text, all its overlapping windows scored."""
    out = np.zeros((len(texts), 5))
    for piece in chunks(texts, 1 << 19):
        words = Words([texts[i] for i in piece], known)
        if not len(words.start):
            continue
        x = word_values(p, *inputs(words))
        text, start, length = windows(words.first)
        logits = np.concatenate([forward(p, x, start[a : a + 2048], length[a : a + 2048]) for a in range(0, len(start), 2048)])
        out[piece] = summary(logits, text, len(piece))
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and coefficients (intercept last) of a ridge logistic regression, by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    beta, penal = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(30):
        q = _sigmoid(z @ beta)
        step = np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + penal, z.T @ (y - q) - penal @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, beta


def fit(rows: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Network and document score learned from ``rows(doc_id, text, y)``; none where a class is missing.

    Counts of buckets per class are summed on executors; windows of half of the sample, at
    most three a document, come to the driver to train on; the other half, scored by the
    network on executors, fits how windows make a document's score.
    """
    context = rows.sparkSession.sparkContext
    chosen = saved(sampled(rows, sample).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(2)).cast("int")), "sample")
    size = 1 << BITS

    def count(batches):
        known, total = tables(), np.zeros((size * (1 + len(SIZES)), 2), np.int64)
        docs = np.zeros(2, np.int64)
        for batch in batches:
            texts, y = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for piece in chunks(texts):
                words = Words([texts[i] for i in piece], known)
                label = y[piece]
                docs += np.bincount(label, minlength=2)
                if not len(words.start):
                    continue
                word, gram, of = inputs(words)
                for j, bucket in enumerate([word, *gram.T]):
                    text = words.text if j == 0 else words.text[of]
                    pair = np.unique(text * (size * len(SIZES)) + bucket)
                    t, b = pair // (size * len(SIZES)), pair % (size * len(SIZES))
                    np.add.at(total, (b + (size if j else 0), label[t]), 1)
        flat = np.concatenate([total.ravel(), docs])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "n"])

    sums = chosen.select("text", "y").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(2 * size * (1 + len(SIZES)) + 2, np.int64)
    flat[sums["at"].to_numpy()] = sums["n"].to_numpy()
    docs, counts = flat[-2:], flat[:-2].reshape(-1, 2)
    if docs.min() < 4:
        return None
    weights = context.broadcast((bucket_weights(counts[:size], docs), bucket_weights(counts[size:], docs)))

    def likely(batches):
        known, (word_weight, gram_weight) = tables(), weights.value
        for batch in batches:
            ids, texts, y = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out, label = [], []
            for piece in chunks(texts):
                words = Words([texts[i] for i in piece], known)
                if not len(words.start):
                    continue
                e = np.concatenate([[0], np.cumsum(evidence(words, word_weight, gram_weight))])
                text, start, length = windows(words.first)
                value = e[start + length] - e[start]
                first = np.searchsorted(text, np.arange(len(piece) + 1))
                for k, i in enumerate(piece):
                    own = np.arange(first[k], first[k + 1])
                    if not len(own):
                        continue
                    picked = own[np.argsort(-value[own], kind="stable")[:LIKELIEST]]
                    if not y[i]:
                        picked = np.append(picked, own[(ids[i] * 7919) % len(own)])
                    for w in np.unique(picked):
                        a, b = words.start[start[w]], words.end[start[w] + length[w] - 1]
                        out.append(texts[i][a - words.offset[k] : b - words.offset[k]])
                        label.append(y[i])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(label, pa.int32())], names=["text", "y"])

    learned = chosen.where("part = 0").select("doc_id", "text", "y").mapInArrow(likely, "text string, y int").orderBy("y", "text").toPandas()
    if learned["y"].nunique() < 2:
        return None
    p = train(learned["text"].tolist(), learned["y"].to_numpy(), *weights.value)
    network = context.broadcast(p)

    def judged(batches):
        known = tables()
        for batch in batches:
            s = summaries(network.value, batch.column(0).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([*[pa.array(s[:, k]) for k in range(5)], batch.column(1)], names=[*"abcde", "y"])

    rest = chosen.where("part = 1").select("text", "y").mapInArrow(judged, "a double, b double, c double, d double, e double, y int").orderBy(*"abcdey").toPandas()
    if rest["y"].nunique() < 2:
        return None
    return {"network": p, "document": logistic(rest[list("abcde")].to_numpy(), rest["y"].to_numpy())}


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``.

    Learns from a bounded sample of labelled documents of ``labels(doc_id, toxic)`` that are
    not held out; scores see the text alone.  Null and wordless texts have no window and get
    the score that goes with none.  Where nothing could be learned every score is the
    share of toxic labels, or 0 without labels.  Repeated rows are scored each.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = one_label(labels, "toxic")
    rows = base.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).join(known, "doc_id")
    model = fit(rows, sample)
    prior = (known.where(~held_out(F.col("doc_id"))).agg(F.avg("y")).first()[0] or 0.0) if model is None else 0.0
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        letters, model = tables(), shared.value

        def scan(texts):
            if model is None:
                return [[prior] * len(texts)]
            mean, scale, beta = model["document"]
            x = (summaries(model["network"], texts, letters) - mean) / scale
            return [_sigmoid(x @ beta[:-1] + beta[-1]).tolist()]

        return scan

    found = per_text(base, "text", [("score", "double")], work, ["doc_id"], encode=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
