"""Mixing, chat windows, decontamination and the pipeline against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clearroll.llm import chat, decontaminate, langid, mixing, secret_scan
from clearroll.llm.queries import ORACLE, QUERIES
from test_llm_copies import union

DOCS = "doc_id long, text string, source string, size string, target int, _leaked int"


def levels(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets by resharing the excess until none is above, source by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, fixed = share * sum(sizes.values()), {}
    while True:
        free = {s: weight[s] for s in names if s not in fixed}
        aims = {s: left * w / sum(free.values()) for s, w in free.items()} if free else {}
        over = {s for s in aims if aims[s] >= cap * sizes[s]}
        if not over:
            return aims | fixed
        for s in over:
            fixed[s] = cap * sizes[s]
            left -= fixed[s]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_meets_targets(spark, seed):
    rng = random.Random(seed)
    sources = ["a", "b", "ä", "B", None, "c", "😀", "￿"]
    rows = [(i, " ".join("w" * rng.randint(0, 30)) if rng.random() < 0.9 else None, rng.choice(sources[: 3 + seed * 2 - 1]), "x", 1, 1) for i in range(400)]
    rows += [(9, rows[9][1], rows[9][2], "x", 1, 1)] * 5 + [(None, "a b c", "a", "x", 1, 1), (500, "v " * 300, "b", "x", 1, 1)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len((text or "").split())
    aims = levels(sizes)
    by_source = {round(v, 6): s for s, v in aims.items()}
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(r[0]), len((r[1] or "").split())) for r in rows)
    ids = {(r[0]): r[2] for r in rows}
    for r in got:
        source = ids[r.doc_id]
        assert np.isclose(r.target, aims[source]) and r.source_size == sizes[source]
        assert r.copies in (0, 1, 2) and r.taken == r["size"] * r.copies <= 2 * r["size"]
        taken[source] += r.taken
    assert by_source and all(abs(taken[s] - aims[s]) <= 1.0 for s in aims), (dict(taken), aims)
    again = mixing.mix(spark.createDataFrame(rows[::-1], DOCS).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, None, "x", 1, 1), (2, "", "a", "x", 1, 1)], DOCS)
    assert [(r["size"], r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2


def test_fit_is_exact_where_a_sum_exists():
    rng = np.random.default_rng(4)
    for _ in range(60):
        lengths = np.unique(rng.integers(0, 40, rng.integers(1, 6)))
        counts = rng.integers(1, 5, len(lengths))
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        budget = int(rng.integers(0, max(sums) + 2))
        take = mixing.fit(lengths, counts, budget, 1)
        total = int((take * lengths).sum())
        assert (take <= counts).all() and (take >= 0).all() and total <= max(budget, 0)
        base = np.array([int(c) * budget // max(1, int((lengths * counts).sum())) for c in counts])
        if budget < (lengths * counts).sum() and not base.any():
            assert total == max(s for s in sums if s <= budget)
    long = np.arange(1, 4000)
    take = mixing.fit(long, np.full(3999, 3), 9_000_001, 1)
    assert int((take * long).sum()) == 9_000_001 and take.max() <= 3


TURNS = "conv_id long, turn long, role string, text string, span int, k string"


def conversations():
    rng = random.Random(3)
    pieces = ["</s>", "[INST]", "[/INST]", "<|turn|>", "<|text|>", "<|end|>", "<\\s>", "[\\\\INST]", "<<SYS>>", "<", "\\", "word", " ", "\n", "é😀", "<s>", "<<s>"]
    rows = []
    for c in range(40):
        for t in range(rng.choice([1, 2, 3, 9, 150])):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "tool", "system", "<|end|>x"])
            text = "".join(rng.choice(pieces) for _ in range(rng.choice([0, 3, 20, 300])))
            rows.append((c, t, role, text, 1, "k"))
    rows += [(100, 0, "system", "only", 1, "k"), (101, None, None, None, 1, "k"), (None, 1, "assistant", "x", 1, "k"), (None, 0, "user", "y", 1, "k")]
    rows += [(102, 1, "assistant", "same", 1, "k")] * 3 + [(103, 5, "user", "w " * 60_000, 1, "k"), (103, 6, "assistant", "", 1, "k"), (-7, -3, "user", "n", 1, "k")]
    return rows


def order(row):
    return (row[1] is not None, row[1] or 0, row[2] or "", row[3] or "")


@pytest.mark.parametrize("budget,history", [(1024, 192), (60, 16), (8, 4)])
def test_chats_read_back(spark, budget, history):
    rows = conversations()
    windows = chat.format_chats(spark.createDataFrame(rows, TURNS), budget, history).cache()
    read, conv = {}, defaultdict(list)
    for r in chat.read_back(windows).collect():
        read[r.conv_id, r.span] = r
    for r in rows:
        conv[r[0]].append(r)
    for c, turns in conv.items():
        turns.sort(key=order)
        own = [read[k] for k in sorted((k for k in read if k[0] == c), key=lambda k: k[1])]
        assert [(t.role, t.text) for w in own for t in w.turns] == [(r[2] or "", r[3] or "") for r in turns]
        assert [x for w in own for x in w.losses] == [r[3] or "" for r in turns if r[2] == "assistant"]
    marker = re.compile(r"<\|turn\|>")
    for w in windows.collect():
        parts = marker.split(w.text)[1:]
        assert len(parts) > w.repeated
        lead = conv[w.conv_id][0]
        if lead[2] == "system":  # every window of the conversation opens with it
            assert parts[0].startswith("system<|text|>")
        if len(parts) - max(w.repeated, lead[2] == "system") > 1 and not (lead[2] == "system" and len(lead[3] or "") > budget / 4):
            assert w.tokens <= budget or budget < 20
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_sql_on_odd_rows(spark):
    rows = conversations() + [(-1, 0, "user", "</s>[INST] ok [/INST]", 1, "k"), (-1, 1, "assistant", "</s>[INST] ok [/INST]", 1, "k")]
    got = chat.digests(chat.format_chats(spark.createDataFrame(rows, TURNS))).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows[:-2]])
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(ORACLE["op7_chat_format"]).fetchall()))
    one = [r for r in got if r.conv_id == 102][0]
    assert one.loss_chars == 12 and one.loss_sha256 == hashlib.sha256(b"samesamesame").hexdigest()


def brute_leaks(text, items):
    words, out = decontaminate.words_of(text), set()
    for item, t in items:
        w = decontaminate.words_of(t)
        if not w:
            continue
        k = min(5, len(w))
        own = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        if len(own & {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}) >= 0.8 * len(own):
            out.add(item)
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary[:30] if rng.random() < 0.4 else vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([3, 6, 15, 40, 90])) + ("? " if i % 2 else ". ") + say(rng.randint(1, 9))) for i in range(60)]
    items += [(60, None), (61, ""), (None, say(12)), (5, items[5][1])]
    docs = []
    for i in range(150):
        parts = [say(rng.choice([0, 5, 60, 300]))]
        for _ in range(rng.choice([0, 0, 1, 3])):
            w = rng.choice([t for _, t in items if t]).split()
            if rng.random() < 0.3 and len(w) > 30:
                w[len(w) // 2] = "other"
            parts += [" ".join(w).upper() if rng.random() < 0.3 else "\n".join(w), say(30)]
        docs.append((i, " ".join(parts), 1.0))
    docs += [(200, None, 1.0), (201, "", None), (202, docs[3][1], 1.0), (202, docs[3][1], 1.0), (203, "the " * 50_000 + (items[4][1]), 1.0)]
    held = spark.createDataFrame(docs, "doc_id long, text string, score double")
    want = sorted({(d, str(i)) for d, t, _ in docs for i in brute_leaks(t, items)})
    rows = []
    for most in (1 << 23, 900, 200):  # one index, and several
        found = decontaminate.find_leaks(held, spark.createDataFrame(items, "item_id long, text string"), most).collect()
        assert sorted({(r.doc_id, str(r.item_id)) for r in found}) == want
        assert all(r.score >= decontaminate.RETRIEVE for r in found)
        rows.append(sorted(str((r.doc_id, r.item_id, round(r.score, 9), r.overlap, r.question_overlap, r.answer_overlap)) for r in found))
    assert rows[0] == rows[1] == rows[2]  # scores are those of all items, however many an index holds
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(held, none).count() == 0 and decontaminate.find_leaks(held.limit(0), none).count() == 0


def test_wand_equals_exhaustive_scores():
    rng = random.Random(2)
    items = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.randint(20, 32)))) for i in range(120)]
    index = decontaminate.build(items)
    for part in index["classes"]:
        for _ in range(150):
            terms = rng.sample(sorted(index["terms"].values()), rng.randint(1, 30))
            score = defaultdict(float)
            for t in terms:
                for n, s in zip(*part["lists"].get(t, ([], []))):
                    score[n] += s
            for least in (0.2, 0.5):
                got = dict(decontaminate.block_max_wand(part, terms, least))
                assert set(got) == {n for n, s in score.items() if s >= least} or any(abs(s - least) < 1e-9 for s in score.values())


def test_pipeline_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    pred = {r.doc_id: r for r in langid.label(docs, langid.fit(docs), keep=["doc_id"]).collect()}
    rows = {d: r for d, r in rows.items() if pred[d].lang_pred != "und" and pred[d].score >= corpus_pipeline.LANGUAGE_SCORE}
    shingled = {}
    for d, r in rows.items():
        w = (r.text or "").encode().lower().split()
        shingled[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    close = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    group = union([(a, b) for a in shingled for b in shingled if a < b and close(shingled[a], shingled[b])], shingled)
    assert len({group[d] for d in group}) < len(group)
    free = corpus_pipeline.near_copies(spark, docs.where(F.col("doc_id").isin(list(rows))), folder)
    assert {r.doc_id for r in free.select("doc_id").collect()} == {d for d in rows if group[d] == d}
    rows = {d: r for d, r in rows.items() if group[d] == d}
    rows = {d: r for d, r in rows.items() if not brute_leaks(r.text, items)}
    texts = {d: secret_scan.redacted(r.text) for d, r in rows.items()}
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
    assert {r.doc_id: r.text for r in kept.collect()} == texts
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) <= set(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for d, r in rows.items():
        sizes[r.source] += len(texts[d].split())
    aims = levels(sizes)
    for d, r in got.items():
        assert (r.text, r.source, r.lang, r.n_chars) == (texts[d], rows[d].source, rows[d].lang, len(texts[d]))
        assert r.copies in (1, 2) and r.taken == r.copies * len(texts[d].split()) and np.isclose(r.target, aims[r.source])
        taken[r.source] += r.taken
    full = {s for s in aims if aims[s] >= 2 * sizes[s]}
    assert all(taken[s] == aims[s] for s in full) and all(taken[s] <= aims[s] + 1 for s in aims)
    assert sum(taken.values()) >= 0.9 * sum(aims.values())


def test_stages_keep_columns_and_take_odd_tables(spark, folder):
    text = spark.read.parquet(f"{folder}/documents.parquet").where("n_chars > 800").first().text
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp0 string, copies int, _gone int"
    odd = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, text, "en", "a", 1), (3, text, "en", "a", 1), (4, text, None, None, 1), (None, text, "en", "b", 1)]
    held = spark.createDataFrame([(*r, "x", 5, 6) for r in odd], schema)
    for rows in (held, held.limit(0)):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            want = docs.columns if name != "source mix" else [*docs.columns, "copies_", "taken", "target"]
            assert out.columns == want and out.count() <= docs.count()
            docs = out
    kept = corpus_pipeline.near_copies(spark, held.where("doc_id > 2"), folder)
    assert [r.doc_id for r in kept.collect()] == [3]
    assert [s for s, _ in corpus_pipeline.STAGES][0] == "language ID" and "pipeline" not in QUERIES
    assert held.where(F.col("doc_id") == 3).count() == 2
