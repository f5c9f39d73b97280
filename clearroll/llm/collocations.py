"""Phrase collocations: prefix-free parsing into a dictionary of chunks, n-grams counted once per distinct chunk."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import saved

#: Longest phrase in words, and words that neighbouring chunks share (every phrase starts inside one chunk and ends in it).
LONGEST = 4
OVERLAP = LONGEST - 1
#: One window of ``OVERLAP`` tokens in so many ends a chunk.
EVERY = 48
#: Least occurrences of a candidate, percentage at which a longer candidate covers it, results per language.
LEAST, COVERED, TOP = 30, 80, 2000
SCALE = 2_000_000
#: Bits of the filter of frequent pairs; a filter that fills up lets more through, and nothing is lost.
BITS = 27
#: Distinct phrases and words a task keeps before it hands them on, and characters it works through at once.
HELD, CHARS = 1_000_000, 4 << 20

#: Bytes with A-Z lower-cased, tabs as spaces and piece ends as " \n ".
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else c for c in range(256))
_END = b"\n"
_TAIL = [_END] * OVERLAP
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: bytes) -> list[bytes]:
    """Words of a text and ``\\n`` where a piece ends, with as many ends behind the last word as chunks overlap."""
    return [*filter(None, text.translate(_LOWER).replace(b"\n", b" \n ").split(b" ")), *_TAIL]


def chunks(texts: list[list[bytes]]) -> Iterator[tuple[int, bytes]]:
    """The parse of token sequences, as ``(text, chunk)``: chunks end at a triggering window and share it with the next one.

    What triggers is a matter of the window's own tokens, so equal passages are cut alike
    wherever they stand.  Tokens are hashed as polynomials of their bytes, all at once.
    """
    joined = [b" ".join(own) + b" " for own in texts]
    flat = np.frombuffer(b"".join(joined), np.uint8)
    stops = np.flatnonzero(flat == 32)  # one behind every token
    if not len(stops):
        return
    powers = np.full(len(flat), _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * powers)])
    starts = np.concatenate([[0], stops[:-1] + 1])
    # the power of a token's place is divided out: what is odd has an inverse
    back = np.full(len(flat), pow(int(_BASE), -1, 1 << 64), np.uint64)
    back[0] = 1
    h = (sums[stops] - sums[starts]) * np.cumprod(back)[starts]
    h ^= h >> np.uint64(29)
    n = len(stops)
    window = np.zeros(n - OVERLAP + 1, np.uint64)
    for k in range(OVERLAP):
        window = window * np.uint64(0x9E3779B97F4A7C15) + h[k : n - OVERLAP + 1 + k]
    window = (window ^ (window >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    cut = (window >> np.uint64(33)) % np.uint64(EVERY) == 0
    cut = np.append(cut, np.zeros(OVERLAP - 1, bool))
    ends = np.cumsum([len(own) for own in texts])
    for k in range(1, OVERLAP + 1):
        cut[ends - k] = False  # the ends behind a text begin no chunk
    at = begin = 0
    for number, (text, end) in enumerate(zip(joined, ends.tolist())):
        if end - at > OVERLAP:
            inner = np.flatnonzero(cut[at + 1 : end]) + at + 1
            first = [0, *(starts[inner] - begin).tolist()]
            last = [*(stops[inner + OVERLAP - 1] - begin).tolist(), len(text) - 1]
            for a, b in zip(first, last):
                yield number, text[a:b]
        at, begin = end, begin + len(text)


def parsed(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The dictionary ``lang, chunk, times`` of the texts; null languages are ``und``."""
    held = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(langs, texts):
            found = list(chunks(texts))
            columns = [pa.array([langs[n] for n, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "chunk"])

        for batch in batches:
            langs, texts, size = [], [], 0
            for own, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = raw.as_py()
                langs.append(own)
                texts.append(tokens_of(raw))
                size += len(raw)
                if size > CHARS:
                    yield told(langs, texts)
                    langs, texts, size = [], [], 0
            yield told(langs, texts)

    return held.where("text IS NOT NULL").mapInArrow(parse, "lang string, chunk string").groupBy("lang", "chunk").agg(F.count("*").alias("times"))


def hash_long(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """XXH64 of every number's eight bytes, as Spark's ``xxhash64`` takes it of a long."""
    p = [np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
    turned = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
    h = (seed + p[4] + np.uint64(8)) ^ (turned(x * p[1], 31) * p[0])
    h = turned(h, 27) * p[0] + p[3]
    h = (h ^ (h >> np.uint64(33))) * p[1]
    h = (h ^ (h >> np.uint64(29))) * p[2]
    return h ^ (h >> np.uint64(32))


def hashes(lang: str, words: list[np.ndarray]) -> np.ndarray:
    """A hash per phrase whose k-th word has the hash ``words[k]``; :func:`frequent_bits` has the same in SQL."""
    with np.errstate(over="ignore"):
        acc = np.array([xxhash.xxh64_intdigest(lang.encode(), 42)], np.uint64)
        for own in words:
            acc = hash_long(own, hash_long(acc, np.uint64(42)))
    return acc


def frequent_bits(counts: DataFrame) -> np.ndarray:
    """A filter of ``2 ** BITS`` bits, 16 MB whatever the input, with those of ``counts(lang, phrase)`` set."""
    h = F.aggregate(F.split("phrase", " "), F.xxhash64("lang"), lambda acc, w: F.xxhash64(acc, F.xxhash64(w)))
    placed = counts.select(h.bitwiseAND(F.lit((1 << BITS) - 1)).alias("at"))
    rows = placed.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out


class Words(dict):
    """A number for every word asked for, from 0; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def count_phrases(dictionary: DataFrame, sizes: tuple[int, ...], pairs: np.ndarray | None = None) -> DataFrame:
    """``lang, phrase, f`` of all phrases of so many words, each distinct chunk counted once with its frequency.

    A chunk counts the phrases that start before its last ``OVERLAP`` tokens; those belong to
    the next.  With the filter ``pairs``, a phrase is counted only if each two neighbouring
    words of it may be a frequent pair, as no frequent phrase holds an infrequent one.
    Chunks are worked through some megabytes at a time, words as numbers.
    """
    shared = None if pairs is None else dictionary.sparkSession.sparkContext.broadcast(pairs)

    def frequent(lang: str, words: list[np.ndarray]) -> np.ndarray:
        at = (hashes(lang, words) & np.uint64((1 << BITS) - 1)).astype(np.int64)
        return (shared.value[at >> 6] >> (at & 63) & 1).astype(bool)

    def count(lang: str, chunks: list[bytes], times: list[int], numbers: Words, word_hashes: list[int]) -> Iterator[tuple[bytes, int]]:
        tokens = b" ".join(chunks).split(b" ")
        ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
        lengths = np.fromiter((c.count(b" ") + 1 for c in chunks), np.int64, len(chunks))
        weight, ends = np.repeat(times, lengths), np.cumsum(lengths)
        own = np.ones(len(ids), bool)
        for k in range(1, OVERLAP + 1):
            own[ends - k] = False
        word = ids > 0
        if shared is not None:
            known = list(numbers)
            word_hashes += [xxhash.xxh64_intdigest(w, 42) for w in known[len(word_hashes) :]]
            h = np.array(word_hashes, np.uint64)
            pairs = np.zeros(len(ids), bool)
            at = np.flatnonzero(word[:-1] & word[1:])
            pairs[at] = frequent(lang, [h[ids[at]], h[ids[at + 1]]])
        for size in sizes:
            n = len(ids) - size + 1
            use = own[:n].copy()
            for k in range(size):
                use &= word[k : n + k]
            if shared is not None:
                for k in range(size - 1):
                    use &= pairs[k : n + k]
            starts = np.flatnonzero(use)
            if not len(starts):
                continue
            group = ids[starts]
            for k in range(1, size):
                group = group << 32 | ids[starts + k]
                if k < size - 1:
                    _, group = np.unique(group, return_inverse=True)
            order = np.argsort(group, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], group[order[1:]] != group[order[:-1]]]))
            first, sums = order[edges], np.add.reduceat(weight[starts][order], edges)
            for at, f in zip(starts[first].tolist(), sums.tolist()):
                yield b" ".join(tokens[at : at + size]), f

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, dict[bytes, int]] = {}
        waiting: dict[str, tuple[list[bytes], list[int]]] = {}
        numbers, word_hashes = Words(), []

        def worked() -> Iterator[pa.RecordBatch]:
            for lang, (chunks, times) in waiting.items():
                total = totals.setdefault(lang, defaultdict(int))
                for phrase, n in count(lang, chunks, times, numbers, word_hashes):
                    total[phrase] += n
            waiting.clear()
            if len(numbers) > HELD:
                numbers.clear()
                numbers[_END] = 0
                word_hashes.clear()
            if sum(map(len, totals.values())) > HELD:
                yield told()

        def told():
            columns = [
                pa.array([lang for lang, total in totals.items() for _ in total], pa.string()),
                pa.array([p for total in totals.values() for p in total], pa.string()),
                pa.array([n for total in totals.values() for n in total.values()], pa.int64()),
            ]
            totals.clear()
            return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "f"])

        held = 0
        for batch in batches:
            for lang, chunk, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = waiting.setdefault(lang, ([], []))
                own[0].append(chunk)
                own[1].append(n)
                held += len(chunk)
                if held > CHARS:
                    yield from worked()
                    held = 0
        yield from worked()
        yield told()

    held = dictionary.select("lang", F.col("chunk").cast("binary"), "times")
    # a task has added up what it could, so its rows go to their partition as they are
    counted = held.mapInArrow(run, "lang string, phrase string, f long").repartition("lang", "phrase")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, covered: int = COVERED, top: int = TOP
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to 4 words.

    A-Z are lower-cased, texts end pieces at ``.,;:!?`` and line ends, and words at spaces and
    tabs.  A candidate occurs ``least`` times or more (``a``); cut into its first words (``l``
    occurrences) and the rest (``r``) its score is ``floor(2000000 * a / (l + r))``, at the
    lowest-scoring cut, the first of such.  Candidates inside a longer one that occurs at least
    ``covered`` percent as often are left out.  ``n`` counts the language's words.  Null texts
    are empty, a null language is ``und``, repeated rows count each, an empty table gives no rows.

    Words and pairs are counted first.  A longer phrase with an infrequent pair in it cannot
    be frequent, so a filter of the frequent pairs, of a fixed size, lets the others out.  Only
    the filter reaches the driver.
    """
    dictionary = saved(parsed(docs, text, lang), "chunks")
    several = F.instr("phrase", " ") > 0
    short = saved(count_phrases(dictionary, (1, 2)).where((F.col("f") >= least) | ~several), "short")
    every = short.where(~several)
    frequent = short.where(F.col("f") >= least)
    filtered = frequent_bits(frequent.where(several))
    longer = count_phrases(dictionary, tuple(range(3, LONGEST + 1)), filtered).where(F.col("f") >= least)
    frequent = frequent.unionByName(saved(longer, "longer"))
    words = F.split("phrase", " ")
    candidates = frequent.where(several)

    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    halves = candidates.select("lang", "phrase", F.col("f").alias("a"), words.alias("words")).select("*", cut)
    halves = halves.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("rest"),
    )
    named = lambda part, f: frequent.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    both = halves.join(named("first", "l"), ["lang", "first"]).join(named("rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    both = both.withColumn("score", F.expr(f"cast(cast({SCALE} as decimal(18,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)"))
    weakest = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inside = candidates.select("lang", F.col("f").alias("longer"), words.alias("w")).where(F.size("w") > 2)
    spans = F.expr("flatten(transform(sequence(2, size(w) - 1), k -> transform(sequence(1, size(w) - k + 1), i -> array_join(slice(w, i, k), ' '))))")
    inside = inside.select("lang", "longer", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = weakest.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * wide("longer") < F.lit(covered) * wide("a")))

    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = saved(kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top), "ranked")
    sums = every.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(sums, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )


#: The same in DuckDB, by all n-grams of all pieces.
SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL
), sequences AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM sequences, (SELECT unnest([1, 2, 3, 4]) AS k) sizes
), counted AS (
    SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), candidates AS (
    SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND f >= 30
), cuts AS (
    SELECT lang, size, phrase, a, w, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), scored AS (
    SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * c.a // (x.f::HUGEINT + y.f) AS BIGINT) AS score
    FROM cuts c
    JOIN counted x ON x.lang = c.lang AND x.phrase = c.first AND x.k = c.k
    JOIN counted y ON y.lang = c.lang AND y.phrase = c.rest AND y.k = c.size - c.k
), weakest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT *, unnest(range(1, size - k + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS k FROM candidates))
    GROUP BY ALL
), kept AS (
    SELECT w.* FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase
    WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * w.a
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
), sums AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang
)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sums ON sums.lang = ranked.lang WHERE rank <= 2000
"""
