"""Collocations against brute force and their SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clearroll.llm import collocations
from clearroll.llm.queries import ORACLE, QUERIES
from oracle import compare, connect

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, phrase string, rank int, a string"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, top=2000):
    """Rows of ``(lang, text)`` counted n-gram by n-gram."""
    counts, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= 30}
        rows = []
        for p, a in held.items():
            inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if any(100 * b >= 80 * a and inside(q) for q, b in held.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -s))
    return sorted(out)


def got(df):
    assert df.columns == COLUMNS and [t for _, t in df.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5
    return sorted(tuple(r) for r in df.collect())


def texts(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "ÄB", "äb", "of", "new", "york", "n\x00l", "e f", "\x1c", "a-b", "😀", "z"]
    held = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 5))) for _ in range(12)]
    seps = [" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\r\n", ";", "\x0b", "?!"]
    for _ in range(160):
        out = []
        for _ in range(rng.randint(0, 90)):
            out += [rng.choice(held) if rng.random() < 0.6 else rng.choice(vocabulary), rng.choice(seps)]
        yield "".join(out)


@pytest.mark.parametrize("seed,every,held", [(1, 24, 400_000), (2, 3, 50)])
def test_collocations_equal_brute_force(spark, monkeypatch, seed, every, held):
    monkeypatch.setattr(collocations, "EVERY", every)
    monkeypatch.setattr(collocations, "HELD", held)
    rng = random.Random(seed)
    rows = [(i, t, rng.choice(["en", "fr", None, "und", ""])) for i, t in enumerate(texts(seed))]
    rows += [(900, None, "en"), (901, "", "de"), (902, "ab " * 20_000, "long"), (903, "x y." * 40, "xy"), (3, rows[3][1], rows[3][2]), (None, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame([(*r, "p", 1, "q") for r in rows], DOCS)
    want = brute([(r[2], r[1]) for r in rows])
    assert len(want) > 40 and {r[0] for r in want} >= {"en", "fr", "und", "xy", "long"}
    assert got(collocations.collocations(docs)) == want


def test_sql_on_odd_rows(spark):
    rows = [(i, t, ["en", None][i % 2]) for i, t in enumerate(texts(5))] + [(1000, None, "en"), (1001, "", "zz")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    rows = [(i, t.replace("\x00", "") if t else t, lang) for i, t, lang in rows]
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert sorted(con.execute(ORACLE["op11_collocations"]).fetchall()) == brute([(r[2], r[1]) for r in rows])


def test_query_equals_sql(spark, folder):
    folder = folder.replace("0.001", "0.01")
    assert compare(QUERIES["op11_collocations"](spark, folder), connect(folder), ORACLE["op11_collocations"]) is None


def test_top_and_ties(spark):
    rows = [(1, "b a. c a. b d. " * 30, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert got(collocations.collocations(docs, top=2)) == brute([(r[2], r[1]) for r in rows], 2)
    assert [r.phrase for r in collocations.collocations(docs, top=2).orderBy("rank").collect()] == ["b d", "c a"]


def test_parse_is_prefix_free_and_counts_each_start_once():
    rng = random.Random(8)
    shared = " ".join(f"w{rng.randrange(50)}" for _ in range(400))
    tokens = [collocations.tokens_of(f"{rng.random()} {shared} {rng.random()}.".encode()) for _ in range(3)]
    parses = [[c for _, c in collocations.chunks([t])] for t in tokens]
    for t, parse in zip(tokens, parses):
        starts = []
        for c in parse:
            c = c.split(b" ")
            starts += c[: len(c) - collocations.OVERLAP]
        assert starts + t[-collocations.OVERLAP :] == t
    together = [[], [], []]
    for n, c in collocations.chunks(tokens):
        together[n].append(c)
    assert together == parses
    assert len(set(parses[0]) & set(parses[1]) & set(parses[2])) >= len(parses[0]) - 4
    flat = {c for p in parses for c in p}
    assert not any(a != b and b.startswith(a + b" ") and not a.endswith(b"\n") for a in flat for b in flat)


def test_filter_holds_every_frequent_part(spark):
    rows = [("en", f"w{i} é{i}", 1) for i in range(500)]
    bits = collocations.frequent_bits(spark.createDataFrame(rows, "lang string, phrase string, f long"))
    words = np.array([[xxhash.xxh64_intdigest(w.encode(), 42) for w in p.split(" ")] for _, p, _ in rows], np.uint64)
    at = (collocations.hashes("en", list(words.T)) & np.uint64((1 << collocations.BITS) - 1)).astype(np.int64)
    assert all(int(bits[k >> 6]) >> (int(k) & 63) & 1 for k in at.tolist())
    assert sum(int(x).bit_count() for x in bits.view(np.uint64)) == len(set(at.tolist()))


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(none).count() == 0
    rare = none.unionByName(spark.createDataFrame([(1, "a b c", "en"), (2, None, None)], none.schema))
    assert collocations.collocations(rare).count() == 0 and rare.where(F.col("lang").isNull()).count() == 1
