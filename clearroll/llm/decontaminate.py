"""Benchmark decontamination: passages against an inverted index of test items, by block-max WAND."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved

K1, B = 1.2, 0.75
#: Share of an item's score against itself that a passage must reach to be verified.
RETRIEVE = 0.6
#: Words of a shingle; share of an item's shingles a document must hold; least share of its question and of its answer.
SHINGLE, OVERLAP, PART = 5, 0.8, 0.5
#: Items per block of the index.
BLOCK = 8
#: Block maxima added up at once.
AT_ONCE = 2_000_000
#: Characters of items that one index takes; more items are searched in several passes.
ITEM_CHARS = 8 << 20

WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles(words: list[str]) -> set[tuple]:
    """Five-word shingles; the whole sequence where it is shorter."""
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words up to its last question mark and after it; without one, all but the last sentence and the last."""
    cut = text.rfind("?") + 1
    if not cut or not words_of(text[cut:]):
        ends = [m.end() for m in _SENTENCE.finditer(text) if words_of(text[m.end() :])]
        cut = ends[-1] if ends else 0
    return words_of(text[:cut]), words_of(text[cut:])


def build(items: list[tuple], statistics: tuple[int, float, dict[str, int]] | None = None) -> dict:
    """The index of ``(item_id, text)``, as plain values: terms, and postings per class of item length.

    A class holds items of up to twice the length of the class before; its passages are
    twice as long as its longest items can be and overlap by half, so every item lies whole
    in one.  Impacts are BM25 term scores over the item's score against itself.
    ``statistics`` are the number of items, their mean length and how many hold a term;
    without them, those of ``items``.  A block of many items gets those of all.
    """
    worded = [(item, text, words_of(text)) for item, text in items if text]
    worded = [x for x in worded if x[2]]
    if statistics is None:
        statistics = len(worded), sum(len(w) for _, _, w in worded) / max(1, len(worded)), Counter(t for _, _, w in worded for t in set(w))
    total, mean, seen = statistics
    own = sorted({t for _, _, w in worded for t in w})
    idf = {t: math.log(1 + (total - seen[t] + 0.5) / (seen[t] + 0.5)) for t in own}
    terms = {t: i + 1 for i, t in enumerate(own)}
    grouped = defaultdict(list)
    for x in worded:
        grouped[max(3, (len(x[2]) - 1).bit_length())].append(x)
    classes = []
    for bits, members in sorted(grouped.items()):
        postings = defaultdict(list)
        for n, (_, _, w) in enumerate(members):
            tf = Counter(w)
            scores = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for t, f in tf.items()}
            whole = sum(scores.values())
            for t, s in scores.items():
                postings[terms[t]].append((n, s / whole))
        most, lists = np.zeros(len(terms) + 1), {}
        # the blocks of term t and their largest impacts are entries first[t] to first[t + 1]
        first, blocks, tops = np.zeros(len(terms) + 2, np.int64), [], []
        for t in range(1, len(terms) + 1):
            entries, top = postings.get(t, ()), {}
            for n, s in entries:
                top[n // BLOCK] = max(top.get(n // BLOCK, 0.0), s)
            if entries:
                most[t] = max(top.values())
                lists[t] = ([n for n, _ in entries], [s for _, s in entries])
            blocks += top
            tops += top.values()
            first[t + 1] = len(blocks)
        part = {"first": first, "blocks": np.array(blocks, np.int64), "tops": np.array(tops, float), "count": (len(members) - 1) // BLOCK + 1}
        classes.append(part | {"lists": lists, "most": most, "items": members, "step": 1 << bits})
    return {"terms": terms, "classes": classes}


def blocks_above(index: dict, passage: np.ndarray, terms: np.ndarray, least: float) -> list[tuple[int, int]]:
    """``(passage, block)`` where the block maxima of the passage's terms add up to ``least``; the others are skipped whole.

    ``passage`` ascends, ``terms`` are distinct within one.  Works through some millions of maxima at a time.
    """
    many = index["first"][terms + 1] - index["first"][terms]
    found, ends = [], np.cumsum(many)
    if not len(passage):
        return []
    edges = np.concatenate([[0], np.flatnonzero(passage[1:] != passage[:-1]) + 1, [len(passage)]])
    k = 0
    while k < len(edges) - 1:
        done = ends[edges[k] - 1] if edges[k] else 0
        stop = max(k + 1, int(np.searchsorted(ends[edges[1:] - 1], done + AT_ONCE, "right")))
        rows = slice(edges[k], edges[stop])
        n = many[rows]
        at = np.repeat(index["first"][terms[rows]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat(passage[rows], n) * index["count"] + index["blocks"][at]
        keys, inverse = np.unique(key, return_inverse=True)
        bounds = np.bincount(inverse, index["tops"][at], len(keys))
        found += [divmod(x, index["count"]) for x in keys[bounds >= least - 1e-9].tolist()]
        k = stop
    return found


def block_max_wand(index: dict, terms: list[int], least: float) -> list[tuple[int, float]]:
    """All items of a class whose impacts over ``terms`` reach ``least``.

    Blocks whose maxima stay below are skipped whole, the others are searched by WAND, with
    the block's own maxima as bounds.
    """
    own = np.array([t for t in terms if t in index["lists"]], np.int64)
    found = []
    for _, block in blocks_above(index, np.zeros(len(own), np.int64), own, least):
        found += in_block(index, own.tolist(), block, least)
    return found


def in_block(index: dict, terms: list[int], block: int, least: float) -> list[tuple[int, float]]:
    """Items of one block whose impacts over ``terms`` reach ``least``, by WAND."""
    return _wand(index["lists"], [t for t in terms if t in index["lists"]], block * BLOCK, block * BLOCK + BLOCK, least)


def _wand(lists: dict, terms: list[int], lo: int, hi: int, least: float) -> list[tuple[int, float]]:
    found, cursors = [], []
    for t in terms:
        items, impacts = lists[t]
        a, b = bisect_left(items, lo), bisect_left(items, hi)
        if a < b:
            cursors.append([items[a], a, b, max(impacts[a:b]), items, impacts])
    while cursors:
        cursors.sort(key=itemgetter(0))
        bound, pivot = 0.0, None
        for c in cursors:
            bound += c[3]
            if bound >= least:
                pivot = c[0]
                break
        if pivot is None:
            break
        move = pivot
        if cursors[0][0] == pivot:
            score = sum(c[5][c[1]] for c in cursors if c[0] == pivot)
            if score >= least:
                found.append((pivot, score))
            move = pivot + 1
        for c in cursors:
            if c[0] < move:
                c[1] = bisect_left(c[4], move, c[1], c[2])
                c[0] = c[4][c[1]] if c[1] < c[2] else hi
        cursors = [c for c in cursors if c[0] < hi]
    return found


def passages(index: dict, words: list[str]) -> list[tuple[dict, int, list[int], list[int]]]:
    """``(class, first word, terms, blocks)`` of the passages and the blocks of items they could reach.

    Passages are two steps long and begin at every step.  The bound of a passage counts
    each of its terms once: a repeated word counts where it first stands in the passage.
    First each term's largest impact is added up, then, where that is enough, its largest in every block.
    """
    n, out = len(words), []
    ids = np.fromiter(map(index["terms"].get, words, repeat(0)), np.int32, n)
    at = np.flatnonzero(ids)
    if not len(at):
        return out
    own = ids[at]
    order = np.argsort(own, kind="stable")
    before = np.full(len(at), -1, np.int64)
    same = own[order[1:]] == own[order[:-1]]
    before[order[1:][same]] = at[order[:-1][same]]
    for part in index["classes"]:
        step = part["step"]
        most = part["most"][own]
        held = np.flatnonzero(most)  # the others are in no item of the class
        block = at[held] // step
        blocks = (n + step - 1) // step
        first, second = before[held] < block * step, before[held] < (block - 1) * step
        bound = np.bincount(block, most[held] * first, blocks + 1)[:blocks] + np.bincount(block, most[held] * second, blocks + 1)[1 : blocks + 1]
        enough = bound >= RETRIEVE - 1e-9
        if not enough.any():
            continue
        near = np.zeros(blocks + 1, bool)
        near[:blocks] = enough
        one, two = first & near[block], second & near[block - 1] & (block > 0)
        passage = np.concatenate([block[one], block[two] - 1])
        terms = np.concatenate([own[held][one], own[held][two]])
        order = np.argsort(passage, kind="stable")
        passage, terms = passage[order], terms[order]
        reached: dict[int, list[int]] = defaultdict(list)
        for k, b in blocks_above(part, passage, terms, RETRIEVE):
            reached[k].append(b)
        for k, found in reached.items():
            lo, hi = np.searchsorted(passage, (k, k + 1))
            out.append((part, k * step, terms[lo:hi].tolist(), found))
    return out


def leaks(index: dict, text: str | None) -> list[tuple]:
    """``(item_id, score, overlap, question overlap, answer overlap)`` of the items a text holds, the best passage of each."""
    words, best = words_of(text), {}
    for part, start, terms, blocks in passages(index, words):
        for n, score in [hit for b in blocks for hit in in_block(part, terms, b, RETRIEVE)]:
            item, item_text, item_words = part["items"][n]
            lo, hi = max(0, start - part["step"]), start + 3 * part["step"]
            shared = [_share(p, words[lo:hi]) for p in (item_words, *question_and_answer(item_text))]
            if shared[0] >= OVERLAP and min(shared[1:]) >= PART:
                best[part["step"], n] = max(best.get((part["step"], n), (item, 0.0)), (item, score, *shared), key=lambda x: x[1:])
    return list(best.values())


def _share(part: list[str], near: list[str]) -> float:
    """Share of a part's shingles that stand in ``near``; an empty part is held by any, a short one is looked for as it is."""
    own = shingles(part)
    if not own:
        return 1.0
    k = min(SHINGLE, len(part))
    return len(own & {tuple(near[i : i + k]) for i in range(len(near) - k + 1)}) / len(own)


FIELDS = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"


def item_blocks(items: DataFrame, item_chars: int = ITEM_CHARS) -> Iterator[tuple[list[tuple], tuple]]:
    """The items in blocks of about ``item_chars`` characters each, dealt by a hash, with the statistics of all items.

    Every block is collected by itself, with the number of items that hold each of its own terms.
    """
    clean = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")

    def worded(batches):
        for batch in batches:
            own = [words_of(t) for t in batch.column(1).to_pylist()]
            columns = [*batch.columns, pa.array([sorted(set(w)) for w in own], pa.list_(pa.string())), pa.array([len(w) for w in own], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "text", "terms", "size"])

    held = saved(clean.mapInArrow(worded, "item_id long, text string, terms array<string>, size long").where("size > 0"), "items")
    chars, total, mean = held.agg(F.sum(F.length("text")), F.count("*"), F.avg("size")).first()
    n = max(1, math.ceil((chars or 0) / item_chars))
    dealt = held.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))
    seen = dealt.select("block", F.explode("terms").alias("term")).groupBy("term", "block").agg(F.count("*").alias("n"))
    every = seen.groupBy("term").agg(F.sum("n").alias("n"))
    counts = saved(seen.select("term", "block").join(every, "term"), "terms")
    for k in range(n):
        rows = [tuple(r) for r in dealt.where(F.col("block") == k).select("item_id", "text").collect()]
        known = {r["term"]: r["n"] for r in counts.where(F.col("block") == k).select("term", "n").collect()}
        if rows:
            yield rows, (total, mean, known)


def find_leaks(docs: DataFrame, items: DataFrame, item_chars: int = ITEM_CHARS) -> DataFrame:
    """One row per document of ``docs(doc_id, text)`` and item of ``items(item_id, text)`` it holds.

    Every passage of every document is a BM25 query to the index of items; all items at
    ``RETRIEVE`` or more of their own score are verified: ``OVERLAP`` of their five-word
    shingles, and ``PART`` of their question's and of their answer's, must stand there.
    Items are indexed in blocks of a bounded size, so the broadcast does not grow with
    them; each block is one pass, and as term statistics are those of all items, scores and
    what is found do not depend on ``item_chars``.  Null and wordless texts and items match nothing; rows
    repeating a document or an item are matched each.
    """
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = []
    for block, statistics in item_blocks(items, item_chars):
        shared = context.broadcast(build(block, statistics))

        def search(batches, shared=shared):
            index = shared.value
            for batch in batches:
                rows = [(d, *found) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for found in leaks(index, t)]
                kinds = [pa.int64()] * 2 + [pa.float64()] * 4
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[f.split()[0] for f in FIELDS.split(", ")])

        parts.append(texts.mapInArrow(search, FIELDS))
    return reduce(DataFrame.unionByName, parts) if parts else texts.sparkSession.createDataFrame([], FIELDS)
