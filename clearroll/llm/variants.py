"""Spelling variants: words one edit apart, by a sorted scan that reuses banded edit-matrix rows, and the forms they follow."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import whole_groups
from .store import saved

#: Shortest word, least occurrences of a word, and how much more frequent a form must be.
SHORTEST, LEAST, RATIO = 5, 3, 2
#: One (document, run) in so many loses a code point.
EVERY = 97
#: Words a group is scanned with; larger groups are divided further.
GROUP = 4096
#: Rests up to which a row of the edit matrix is worked out one by one, not as arrays.
FEW = 32
#: Distinct words a task counts before it hands them on.
HELD = 400_000

#: Latin-1 bytes: A-Z lower-cased, other letters kept, the rest blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs_of(text: str) -> list[bytes]:
    """Maximal letter runs as Latin-1, A-Z lower-cased; what Latin-1 lacks is no letter here."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def words_of(doc_id: int | None, text: str, total: dict[bytes, int]) -> None:
    """Adds the words of one text to ``total``; every run that its hash picks loses a code point."""
    counts = Counter(runs_of(text))
    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for w, n in counts.items():
        h = crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
        if not h % EVERY:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
        total[w] += n


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """``word, n`` of all words of ``shortest`` or more code points and ``least`` or more occurrences."""
    held = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = defaultdict(int)

        def told():
            words = [w for w in total if len(w) >= shortest]
            out = [pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array([total[w] for w in words], pa.int64())]
            total.clear()
            return pa.RecordBatch.from_arrays(out, names=["word", "n"])

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                words_of(i.as_py(), t.as_py(), total)
                if len(total) > HELD:
                    yield told()
        yield told()

    return held.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def halves(words: DataFrame, shortest: int) -> DataFrame:
    """``words(word, n)`` under the halves they keep after one edit: ``key, short, extends, rest, word, n``.

    Of two words one edit apart, the shorter of length L, either the first L // 2 code points
    agree or the last L - L // 2 do, and in the second case not the first ones too.  ``rest``
    is what is left beside the shared half, ``short`` its length in the shorter word.
    """
    size = F.length("word")
    both = words.withColumn("short", F.explode(F.array(size, size - 1))).where(F.col("short") >= shortest)
    return _divided(both.select(F.lit("").alias("key"), "short", F.lit(False).alias("extends"), F.col("word").alias("rest"), "word", "n"))


def _divided(members: DataFrame) -> DataFrame:
    """Every member under the first and the last half of its ``rest``; a group's key tells its whole path."""
    half, size = F.floor(F.col("short") / 2).cast("int"), F.length("rest")
    tail = F.col("short") - half

    def side(name, shared, rest, short, extends):
        return F.struct(
            F.concat_ws("|", "key", F.concat(F.lit(name), F.col("short").cast("string"), F.lit(":"), shared)).alias("key"),
            short.alias("short"),
            extends.alias("extends"),
            rest.alias("rest"),
        )

    first = side("<", F.col("rest").substr(F.lit(1), half), F.col("rest").substr(half + 1, size), tail, F.col("extends"))
    last = side(">", F.col("rest").substr(size - tail + 1, size), F.col("rest").substr(F.lit(1), size - tail), half, F.lit(True))
    return members.select(F.explode(F.array(first, last)).alias("s"), "word", "n").select("s.*", "word", "n")


def near_pairs(rests: list[str], short: int, extends: bool) -> Iterator[tuple[int, int]]:
    """Index pairs ``a < b`` of the sorted ``rests`` one edit apart, the shorter of length ``short``.

    The list is scanned once.  Each prefix has a row of the edit matrix against every later
    rest that is still within one edit of it, three cells wide; an entry reuses the rows of the
    prefix it shares with the one before.  Where no rest is left at some prefix, all entries
    that begin with it are skipped.  With ``extends``, a rest that continues another is no
    pair: those share their first half too.
    """
    n = len(rests)
    lengths = np.array([len(r) for r in rests], np.int32)
    padded = [f"\0\0{r}\0\0\0\0" for r in rests]
    # line j + 2 holds code point j of every rest; beyond a rest's end and before its start nothing equals
    codes = np.zeros((int(lengths.max()) + 4, n), np.uint32) if n > FEW else None
    for i, r in enumerate(rests if n > FEW else ()):
        codes[2 : 2 + len(r), i] = np.frombuffer(r.encode("utf-32-le"), np.uint32)
    # rows[d]: who is left at depth d, and the distances to their prefixes of d - 1, d and d + 1 code points
    if n > FEW:
        rows = [(np.arange(n), np.full(n, 2, np.int8), np.zeros(n, np.int8), np.ones(n, np.int8))]
    else:
        rows = [[(i, 2, 0, 1) for i in range(n)]]

    def many(row: tuple, d: int, x: str, at: int) -> tuple | list:
        who, low, same, high = row
        c = ord(x)
        low = np.minimum(low + (codes[d][who] != c), same + 1)
        same = np.minimum(np.minimum(same + (codes[d + 1][who] != c), high + 1), low + 1)
        high = np.minimum(high + (codes[d + 2][who] != c), same + 1)
        left = np.flatnonzero((np.minimum(np.minimum(low, same), high) <= 1) & (who > at))
        cells = who[left], *[np.minimum(v[left], 2).astype(np.int8) for v in (low, same, high)]
        return cells if len(left) > FEW else list(zip(*[v.tolist() for v in cells]))

    def few(row: list, d: int, x: str, at: int) -> list:
        out = []
        for i, low, same, high in row:
            if i > at:
                r = padded[i]
                low = min(low + (r[d] != x), same + 1)
                same = min(same + (r[d + 1] != x), high + 1, low + 1)
                high = min(high + (r[d + 2] != x), same + 1)
                if low < 2 or same < 2 or high < 2:
                    out.append((i, low, same, high))
        return out

    before, at = "", 0
    while at < n:
        item = rests[at]
        shared = 0
        while shared < min(len(item), len(before)) and item[shared] == before[shared]:
            shared += 1
        del rows[shared + 1 :]
        skip = None
        for d in range(len(rows), len(item) + 1):
            row = rows[-1]
            row = few(row, d, item[d - 1], at) if isinstance(row, list) else many(row, d, item[d - 1], at)
            if isinstance(row, list) and not row:
                skip = d
                break
            rows.append(row)
        if skip is not None:
            at = bisect_right(rests, item[:skip] + "\U0010ffff", at)
            before = item[: skip - 1]  # the rows beyond are gone
            continue
        before, row = item, rows[-1]
        for i, *cells in row if isinstance(row, list) else zip(*[v.tolist() for v in row]):
            gap = len(rests[i]) - len(item) + 1
            if i > at and 0 <= gap <= 2 and cells[gap] == 1 and min(len(rests[i]), len(item)) == short:
                if not (extends and rests[i].startswith(item)):
                    yield at, i
        at += 1


def near_words(words: DataFrame, shortest: int = SHORTEST, group: int = GROUP) -> DataFrame:
    """``word, n_near, near_n, near``: how many words of ``words(word, n)`` are one edit away, and the most frequent of them.

    Words meet in groups that share half of what one edit leaves, so a pair is found in
    exactly one group.  Groups of more than ``group`` are divided again by the halves of
    what is left, until that is one code point.
    """
    members, found = saved(halves(words, shortest), "halves"), []
    while True:
        sizes = members.groupBy("key").agg(F.count("*").alias("_n"), F.max("short").alias("_s"))
        large = (F.col("_n") > group) & (F.col("_s") > 1)
        sizes = saved(sizes.where("_n > 1"), "sizes")
        found.append(members.join(sizes.where(~large).select("key"), "key"))
        if not sizes.where(large).take(1):
            break
        again = sizes.where(large).select("key")
        members = saved(_divided(members.join(again, "key")), "halves")
    dealt = found[0]
    for more in found[1:]:
        dealt = dealt.unionByName(more)
    dealt = dealt.repartition("key").sortWithinPartitions("key", "rest", "word")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, ends in whole_groups(batches, ["key"]):
            out = []
            for s, e in zip(starts.tolist(), ends.tolist()):
                words, n = rows["word"][s:e], rows["n"][s:e]
                for a, b in near_pairs(rows["rest"][s:e].tolist(), int(rows["short"][s]), bool(rows["extends"][s])):
                    out.append((words[a], int(n[b]), words[b]))
                    out.append((words[b], int(n[a]), words[a]))
            best: dict[str, list] = {}
            for w, n, other in out:
                held = best.setdefault(w, [0, -n, other])
                held[0] += 1
                held[1:] = min(held[1:], [-n, other])
            columns = [pa.array(list(best), pa.string()), *[pa.array([v[i] for v in best.values()], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "less", "near"])

    pairs = dealt.mapInArrow(scan, "word string, n_near long, less long, near string")
    best = F.min(F.struct("less", "near"))
    return pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame, rounds: int = 40) -> DataFrame:
    """``word, root`` of every word of ``forms(word, form)``: where its forms end.

    A form is more frequent than its word, so the way never turns back; every round
    doubles the steps taken.  Raises if ``rounds`` do not do.
    """
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = saved(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if not moved.where("moved").take(1):
            return now
    raise RuntimeError(f"forms did not end within {rounds} rounds")


def variants(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shortest: int = SHORTEST,
    least: int = LEAST,
    ratio: int = RATIO,
    group: int = GROUP,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the texts.

    A word's form is its most frequent near word (ties: the smallest in code-point order) if
    that occurs ``ratio`` times as often, else null; its root is where forms lead, itself if
    nowhere.  Near words differ by one inserted, deleted or replaced code point.  Null texts
    have no words, null ids count as empty in the hash, rows that repeat count each, an
    empty table gives no rows.
    """
    words = saved(vocabulary(docs, doc_id, text, shortest, least), "words")
    near = saved(near_words(words, shortest, group), "near")
    strong = F.col("near_n") >= F.col("n") * ratio
    named = words.join(near, "word", "left").select(
        "word", F.when(strong, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("near_n")).alias("form_n")
    )
    named = saved(named, "forms")
    ends = roots(named.where("form IS NOT NULL"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
