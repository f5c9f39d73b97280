"""Quality scores: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .charwords import Words, chunks, mixed, tables
from .langid import held_out
from .store import per_text, saved

STATISTICS = [
    "log characters", "log words", "mean word length", "spread of word lengths", "upper-case letters", "digits",
    "symbols", "punctuation", "white space", "line feeds", "distinct words", "repeated word triples", "short words",
]
#: Weight of the pooled covariance in a class's own, and what is added to every variance.
SHRINK, RIDGE = 0.1, 1e-3
THRESHOLD = 0.3


def statistics(texts: list[str | None], known) -> np.ndarray:
    """One row of :data:`STATISTICS` per text: logs of counts, square roots of shares, so that each is nearer a bell."""
    out = np.zeros((len(texts), len(STATISTICS)))
    if not texts:
        return out
    words = Words(texts, known)
    raw, begin = words.raw, words.offset[:-1]
    per_text = lambda mask: np.add.reduceat(mask.astype(np.int64), begin).astype(float)
    letter, lower = known
    n = np.diff(words.offset) - 1.0
    chars = np.maximum(n, 1)
    is_letter = words.x > 0
    digit = (raw >= 48) & (raw <= 57)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    mark = np.isin(raw, np.frombuffer(".,;:?'\"-()".encode("utf-32-le"), np.uint32))
    count = np.diff(words.first).astype(float)
    some = np.maximum(count, 1)
    length = (words.end - words.start).astype(float)
    of = lambda values: np.bincount(words.text, values, len(texts))
    mean = of(length) / some
    spread = np.sqrt(np.maximum(of(length * length) / some - mean * mean, 0))
    letters = per_text(is_letter)
    h = words.hashes()
    share = lambda a, b: np.sqrt(np.clip(a / np.maximum(b, 1), 0, 1))

    def distinct(values, text):
        order = np.lexsort((values, text))
        v, t = values[order], text[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
        return np.bincount(t[new], minlength=len(texts)).astype(float)

    triple = mixed(h[:-2] * np.uint64(3) + mixed(h[1:-1] + np.uint64(1)) * np.uint64(5) + h[2:]) if len(h) > 2 else h[:0]
    inside = words.text[:-2] == words.text[2:] if len(h) > 2 else np.zeros(0, bool)
    triples = np.maximum(count - 2, 0)
    out[:, 0], out[:, 1] = np.log1p(n), np.log1p(count)
    out[:, 2], out[:, 3] = np.log1p(mean), np.log1p(spread)
    out[:, 4] = share(per_text(is_letter & (lower[raw] != raw)), letters)
    out[:, 5] = share(per_text(digit), chars)
    out[:, 6] = share(per_text(~(is_letter | digit | space | mark)), chars)
    out[:, 7] = share(per_text(mark), chars)
    out[:, 8] = share(per_text(space) - 1, chars)
    out[:, 9] = share(per_text(raw == 10) - 1, chars)
    out[:, 10] = share(distinct(h, words.text), count)
    out[:, 11] = share(triples - distinct(triple[inside], words.text[:-2][inside]), triples) if len(h) > 2 else 0
    out[:, 12] = share(of(length <= 3), count)
    return out


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, f``: the statistics of every whole text of ``docs(doc_id, text)``; null is an empty text."""

    def work():
        known = tables()

        def scan(texts):
            found = np.zeros((len(texts), len(STATISTICS)))
            for piece in chunks(texts):
                found[piece] = statistics([texts[i] for i in piece], known)
            return [list(found)]

        return scan

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return per_text(base, "text", [("f", "array<double>")], work, ["doc_id"], encode=False)


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """``doc_id, y``: one label per document; where rows disagree, 1 if half or more say so."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    return rows.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))


def moments(rows: DataFrame, size: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of ``f`` per class of ``rows(y, f)``, added up on executors."""

    def part(batches):
        total = np.zeros((2, 1 + size + size * size))
        for batch in batches:
            y = batch.column(0).to_numpy()
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, size)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "v"])

    sums = rows.select("y", "f").mapInArrow(part, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(2 * (1 + size + size * size))
    for at, v in sums:
        flat[at] = v
    return {c: (t[0], t[1 : 1 + size], t[1 + size :].reshape(size, size)) for c, t in enumerate(flat.reshape(2, -1))}


def discriminant(found: dict, shrink: float = SHRINK, ridge: float = RIDGE) -> dict:
    """Means, Cholesky factors and log terms per class, on standardised statistics, as plain values.

    A class covariance is drawn towards the pooled one; a class without rows leaves only the
    prior, counted with one row more per class.
    """
    n = found[0][0] + found[1][0]
    prior = [(found[c][0] + 1) / (n + 2) for c in (0, 1)]
    model = {"prior": prior, "classes": None}
    if min(found[0][0], found[1][0]) < 2:
        return model
    mean = (found[0][1] + found[1][1]) / n
    scale = np.sqrt(np.maximum(np.diag(found[0][2] + found[1][2]) / n - mean**2, 1e-12))
    means, covs = [], []
    for c in (0, 1):
        k, s, ss = found[c]
        m = s / k
        covs.append((ss / k - np.outer(m, m)) / np.outer(scale, scale))
        means.append((m - mean) / scale)
    pooled = (covs[0] * found[0][0] + covs[1] * found[1][0]) / n
    classes = []
    for c in (0, 1):
        cov = (1 - shrink) * covs[c] + shrink * pooled + ridge * np.eye(len(mean))
        factor = np.linalg.cholesky(cov)
        classes.append((means[c], np.linalg.inv(factor), float(-np.log(np.diag(factor)).sum() + np.log(prior[c]))))
    return model | {"mean": mean, "scale": scale, "classes": classes}


def chances(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of class 1: the difference of the classes' Mahalanobis log densities, squashed."""
    if model["classes"] is None:
        return np.full(len(x), model["prior"][1])
    z = (x - model["mean"]) / model["scale"]
    logs = [term - 0.5 * (((z - m) @ inverse.T) ** 2).sum(axis=1) for m, inverse, term in model["classes"]]
    return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``.

    Learns from all labelled documents of ``labels(doc_id, quality)`` that are not held
    out: their class moments are sums, so nothing is sampled.  Repeated rows are scored
    each; without labels every score is one half; an empty table gives no rows.
    """
    found = saved(measured(docs), "statistics")
    known = found.where(~held_out(F.col("doc_id"))).join(one_label(labels, "quality"), "doc_id")
    model = docs.sparkSession.sparkContext.broadcast(discriminant(moments(known, len(STATISTICS))))

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chances(model.value, x))], names=["doc_id", "score"])

    scored = found.select("doc_id", "f").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
