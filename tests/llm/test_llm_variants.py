"""Spelling variants against brute force."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from clearroll.llm import variants
from clearroll.llm.queries import QUERIES

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """One inserted, deleted or replaced code point apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, shortest=5):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= 3}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    out, form = {}, {}
    for w, n in words.items():
        others = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = len(others)
    rows = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, words[w], out[w], words[form[w]] if form[w] else None))
    return sorted(rows)


def got(df):
    assert df.columns[:6] == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r)[:6] for r in df.collect())


def edited(rng, w, letters):
    k = rng.randrange(len(w) + 1)
    return rng.choice([w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + w[k + 1 :]])


@pytest.mark.parametrize("group", [4096, 12])
def test_variants_equal_brute_force(spark, group):
    rng = random.Random(group)
    letters = "abAZä×÷ÿÄ"
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([4, 5, 6, 9, 14]))) for _ in range(40)] + ["aaaaaa", "ababab", "abababa", "q" * 300]
    words = base * 4
    for _ in range(900):
        words.append(edited(rng, rng.choice(words), letters))
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(40)]
    texts += ["a-b" * 50, "ŸĀstraße1straße straße", "\U0001f600straBe€straBe,straBe", None, "", texts[0], "W" * 20_000 + " " + "v" * 20_000]
    rows = [(i % 45, t, "x", 1, 2) for i, t in enumerate(texts)] + [(None, texts[1], None, None, None), (0, texts[0], "x", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int, root int")
    want = brute(rows)
    assert len(want) > 200 and sum(r[1] is not None and r[1] != r[2] for r in want) > 3
    assert got(variants.variants(docs, group=group)) == want


def test_scan_finds_each_pair_in_one_group(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.choice([5, 6, 7, 8]))) for _ in range(1500)})
    pairs = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if abs(len(a) - len(b)) < 2 and near(a, b)}
    groups = {}
    for r in variants.halves(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), 5).collect():
        groups.setdefault((r.key, r.short, r.extends), []).append((r.rest, r.word))
    found = Counter()
    for (_, short, extends), members in groups.items():
        members.sort()
        for a, b in variants.near_pairs([m[0] for m in members], short, extends):
            found[tuple(sorted((members[a][1], members[b][1])))] += 1
    assert set(found) == pairs and set(found.values()) == {1}


def test_scan_skips_what_no_rest_is_near(monkeypatch):
    rests = sorted(f"{a}{b}{'x' * 5}{c:03d}" for a in "abcdefghij" for b in "klmnopqrst" for c in range(30))
    # one of each beginning is near nothing, so whole ranges are left out once their first entries are dead
    rests += sorted({f"z{i:04d}{'y' * (i % 3)}{i % 7}" + "w" * (4 - i % 3) for i in range(400)})
    jumps, plain = [], variants.bisect_right

    def counted(rests, key, at):
        jumps.append(plain(rests, key, at) - at)
        return at + jumps[-1]

    monkeypatch.setattr(variants, "bisect_right", counted)
    pairs = list(variants.near_pairs(rests, len(rests[0]), False))
    assert sorted(pairs) == [(a, b) for a in range(len(rests)) for b in range(a + 1, len(rests)) if near(rests[a], rests[b])]
    assert len(jumps) > 100 and max(jumps) >= 1


def test_query_equals_brute_force_on_its_table(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    frame = QUERIES["op12_spelling_variants"](spark, folder)
    assert [t for _, t in frame.dtypes[:6]] == ["string"] * 3 + ["bigint"] * 3
    assert got(frame) == brute(rows)


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants.variants(none).count() == 0
    assert variants.variants(spark.createDataFrame([(1, None), (2, "one two")], none.schema)).count() == 0
