"""Language spans: script ranges narrow candidates, Viterbi over per-word scores labels words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .charwords import Words, chunks, tables
from .store import per_text

#: Hash buckets (bits) and sizes of the letter n-grams a word is scored by.
BITS, SIZES = 15, (2, 3, 4)
#: Labelled documents the model is fitted on, at most about so many.
SAMPLE = 20_000
#: Log-likelihood a change of language between words costs.
SWITCH = 8.0
#: Share of a language's letters a script needs to be one of its scripts.
SCRIPT_SHARE = 0.005
UNKNOWN = "und"

#: First code points of the script ranges, ascending; each range ends where the next begins.
RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other Indic"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x1400, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"),
    (0x2C80, "Other"), (0x3040, "Kana"), (0x3130, "Hangul"), (0x3190, "Kana"), (0x3400, "Han"),
    (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"),
    (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"),
]
SCRIPTS = sorted({name for _, name in RANGES})
_FIRST = np.array([a for a, _ in RANGES], np.int64)
_SCRIPT = np.array([SCRIPTS.index(name) for _, name in RANGES], np.int64)


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0.  Null ids: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sampled(rows: DataFrame, most: int, seed: int = 5) -> DataFrame:
    """About ``most`` of ``rows(doc_id, ...)``, all where there are fewer, chosen by a hash of doc_id."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * most / n))


def modelled(languages: list[str], counts: np.ndarray, letters: np.ndarray) -> dict:
    """Languages, log-probabilities per bucket and language, and which scripts a language uses.

    Plain values, as a broadcast is unpickled where the package may be missing.
    """
    by_size = counts.reshape(len(SIZES), 1 << BITS, len(languages)).astype(np.float64)
    smooth = by_size + 0.1
    log = np.log(smooth / smooth.sum(axis=1, keepdims=True)).reshape(-1, len(languages)).astype(np.float32)
    log -= log.mean(axis=1, keepdims=True)
    share = letters / np.maximum(letters.sum(axis=0, keepdims=True), 1)
    allowed = share >= SCRIPT_SHARE
    return {"languages": languages, "log": log, "allowed": allowed | ~allowed.any(axis=1, keepdims=True)}


def word_scores(model: dict, words: Words) -> np.ndarray:
    """Log-likelihood of every word per language; languages that do not use its script are out."""
    if not len(words.start):
        return np.zeros((0, len(model["languages"])), np.float32)
    _, where, found = words.grams(BITS, SIZES)
    total = model["log"][found[0]]
    for h in found[1:]:
        total += model["log"][h]
    scores = np.add.reduceat(total, where, axis=0)
    script = _SCRIPT[np.searchsorted(_FIRST, words.x[words.start].astype(np.int64), "right") - 1]
    return np.where(model["allowed"][script], scores, scores - 1e4)


def best_path(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best label of every word: per text, the labels whose scores less ``switch`` per change are highest.

    All texts go forward in step, the longest first, so each step works on those still running.
    """
    n_words = np.diff(first)
    order = np.argsort(-n_words, kind="stable")
    start, length = first[:-1][order], n_words[order]
    path = np.zeros(len(scores), np.int64)
    running = int((length > 0).sum())
    if not running or scores.shape[1] < 2:
        return path
    start, length = start[:running], length[:running]
    labels = np.arange(scores.shape[1], dtype=np.int16)
    came = np.zeros(scores.shape, np.int16)
    value = scores[start].copy()
    active = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), "right")
    lane = np.arange(running)
    for t in range(1, int(length[0])):
        n = active[t]
        at, v = start[:n] + t, value[:n]
        top = v.argmax(axis=1)
        jump = v[lane[:n], top][:, None] - switch
        moved = jump > v
        came[at] = np.where(moved, top[:, None], labels)
        value[:n] = np.where(moved, jump, v) + scores[at]
    state = value.argmax(axis=1)
    for t in range(int(length[0]) - 1, -1, -1):
        n = active[t]
        at = start[:n] + t
        path[at] = state[:n]
        if t:
            state[:n] = came[at, state[:n]]
    return path


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The model of ``docs(doc_id, text, lang)`` whose id is not held out and whose language is known.

    Fitted on at most about ``sample`` documents; tasks send bucket counts, which are summed
    on executors.  What reaches the driver is languages x buckets, however long the table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not languages:
        return None
    chosen = sampled(rows, sample).where(F.col("text").isNotNull())
    place = {name: i for i, name in enumerate(languages)}
    buckets = len(SIZES) << BITS

    def count(batches):
        letters = tables()
        counts = np.zeros((buckets + len(SCRIPTS)) * len(languages), np.int64)
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                for piece in chunks(own):
                    words = Words([own[i] for i in piece], letters)
                    _, _, found = words.grams(BITS, SIZES)
                    for h in found:
                        counts[: buckets * len(languages)] += np.bincount(h * len(languages) + place[lang], minlength=buckets * len(languages))
                    x = words.x[words.x > 0].astype(np.int64)
                    script = _SCRIPT[np.searchsorted(_FIRST, x, "right") - 1]
                    counts[buckets * len(languages) :] += np.bincount(script * len(languages) + place[lang], minlength=len(SCRIPTS) * len(languages))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])

    parts = chosen.select("text", "lang").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((buckets + len(SCRIPTS)) * len(languages), np.int64)
    counts[parts["at"].to_numpy()] = parts["n"].to_numpy()
    split = buckets * len(languages)
    return modelled(languages, counts[:split], counts[split:].reshape(len(SCRIPTS), len(languages)))


def label(docs: DataFrame, model: dict | None, text: str = "text", keep: list[str] | None = None, switch: float = SWITCH) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` and ``spans(lang, start, end)`` of every row.

    ``lang_pred`` labels most letters; ``score`` is its share of the letters, times how much
    likelier its words are than under the next language.  Texts that are null or have no
    letters, and all texts where nothing could be learned, are ``und`` with score 0.
    Offsets are code points, ends exclusive.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        known, table = shared.value, tables()

        def scan(texts):
            pred, score, spans = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            if known is None:
                return [pred, score, spans]
            n_lang = len(known["languages"])
            for piece in chunks(texts, max(1 << 16, (1 << 22) // max(4, n_lang))):
                words = Words([texts[i] for i in piece], table)
                if not len(words.start):
                    continue
                scores = word_scores(known, words)
                path = best_path(scores, words.first, switch)
                letters = np.bincount(words.text * n_lang + path, weights=words.end - words.start, minlength=len(piece) * n_lang).reshape(-1, n_lang)
                best = letters.argmax(axis=1)
                own = path == best[words.text]
                sums = np.zeros((len(piece), n_lang))
                np.add.at(sums, words.text[own], scores[own])
                change = np.ones(len(path), bool)
                change[1:] = (path[1:] != path[:-1]) | (words.text[1:] != words.text[:-1])
                heads = np.flatnonzero(change)
                tails = np.concatenate([heads[1:], [len(path)]]) - 1
                for k in range(len(piece)):
                    total = letters[k].sum()
                    if not total:
                        continue
                    i, b = piece[k], best[k]
                    pred[i] = known["languages"][b]
                    likelier = 1.0 / np.exp(np.clip(sums[k] - sums[k][b], -700, 0)).sum()
                    score[i] = float(min(1.0, letters[k][b] / total * likelier))
                base = words.offset[words.text[heads]]
                for h, t, o in zip(heads, tails, base):
                    spans[piece[words.text[h]]].append({"lang": known["languages"][path[h]], "start": int(words.start[h] - o), "end": int(words.end[t] - o)})
            return [pred, score, spans]

        return scan

    fields = [("lang_pred", "string"), ("score", "double"), ("spans", "array<struct<lang:string,start:int,end:int>>")]
    return per_text(docs, text, fields, work, keep, encode=False)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, n_spans`` of every row of ``docs(doc_id, text, lang)``.

    Learns from rows that are not held out only; predictions see the text alone.  Rows
    repeating a doc_id are labelled each; an empty table gives no rows.
    """
    found = label(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, sample), keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
