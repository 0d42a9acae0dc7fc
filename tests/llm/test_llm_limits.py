"""What the operators did wrong at their limits: many languages, rare scripts, items without an id, repeated rows; and models
against plain versions."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from netfathom.llm import decontamination, language_id, packing, quality_classifier, shared
from netfathom.llm.quality_classifier import STYLES


def test_more_than_127_languages(spark):
    rnd = random.Random(3)
    stems = [["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(6)] for _ in range(200)]
    texts = [(k, " ".join(rnd.choice(stems[k]) for _ in range(60)), f"l{k:03}") for k in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, language_id.learn(docs)).collect()}
    assert got == {k: lang for k, _, lang in texts}
    label = language_id.viterbi(np.eye(200, dtype=np.float32)[[150, 150, 199]] * 100, np.array([0, 3]), 1.0)
    assert label.tolist() == [150, 150, 199]


def test_letters_of_any_plane(spark):
    rows = spark.createDataFrame([(1, "\U00030000\U00030001 \U00031350", "han"), (2, "abc def", "lat"), (3, "\U0001d7d9 12", "lat")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(rows, language_id.learn(rows)).collect()}
    assert got == {1: "han", 2: "lat", 3: "und"}


def test_word_scores_against_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null")
    model = language_id.learn(docs)
    rows = docs.select("text", "lang").collect()
    size = 1 << language_id.BITS

    def slots(word):
        data = word.encode().lower()
        x = [0, 0, *data]
        for i in range(len(data)):
            v = (x[i + 2] * 0x9E3779B1 + x[i + 1] * 0x85EBCA6B + x[i] * 0xC2B2AE35) % 2**32
            yield (((v ^ (v >> 15)) * 0x2C1B3C6D) % 2**32) >> (32 - language_id.BITS)

    counts = {lang: Counter() for lang in model.langs}
    for r in rows:
        for word in re.findall(r"[^\x20\x09-\x0D]+", r["text"]):
            if any(c.isalpha() for c in word):
                counts[r["lang"]].update(slots(word))
    log = {lang: [math.log((c[s] + 0.5) / (sum(c.values()) + 0.5 * size)) for s in range(size)] for lang, c in counts.items()}
    mean = [sum(x) / len(log) for x in zip(*log.values())]
    for lang, own in zip(model.langs, model.log):
        assert np.allclose(own, np.array(log[lang]) - np.array(mean), atol=2e-4)
    # a text of one word gets the language of the best score, with all its letters
    words = sorted({w for r in rows[:30] for w in r["text"].split() if w.isalpha()})[:200]
    got = [r["lang_pred"] for r in language_id.identify(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string").coalesce(1), model).orderBy("doc_id").collect()]
    for w, lang in zip(words, got):
        scores = {x: sum(log[x][s] for s in slots(w)) for x in model.langs}
        assert scores[lang] >= max(scores.values()) - 1e-2, (w, lang, scores)


def test_items_without_an_id_hit_words(spark):
    benchmark = spark.createDataFrame([(None, "one two three four five six seven eight nine ten eleven", 1), (7, "alpha beta", 1), (None, "alpha beta", 1), (None, "gamma", 1)], "item_id long, text string, words int")
    docs = spark.createDataFrame([(1, "x one two three four five six seven eight nine ten y"), (2, "alpha beta gamma"), (3, "nothing"), (4, "gamma")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in decontamination.contamination(docs, benchmark).collect()}
    assert got == {1: (10, 0, [], True), 2: (3, 1, ["7"], True), 3: (0, 0, [], False), 4: (1, 0, [], True)}
    assert {r["doc_id"] for r in decontamination.decontaminate(docs, benchmark).collect()} == {3}


def test_tables_of_a_large_benchmark_stay_small():
    rnd = random.Random(1)
    rows = [(str(i), " ".join(f"w{rnd.randrange(10**6)}" for _ in range(2500))) for i in range(100)]
    text = sum(len(t) for _, t in rows)
    tracemalloc.start()
    tables = decontamination.Tables(rows, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(p.start) for p in tables.by_length) > 240_000
    assert peak < 60 * text, peak / text  # bytes a byte of text


def test_repeated_rows_are_dealt_to_all_groups(spark):
    docs = spark.createDataFrame([(1, "the same text")] * 3000, "doc_id long, text string").repartition(3)
    rows = packing.pack(docs, group_pieces=300).collect()
    groups = Counter(r["sequence_id"] >> 32 for r in rows)
    assert len(rows) == 3000 and len(groups) == 10 and max(groups.values()) < 500
    by = Counter(r["sequence_id"] for r in rows)
    per = 2048 // rows[0]["length"]
    assert max(by.values()) <= per and len(by) <= 3000 / per + 11


def examples():
    rng = np.random.default_rng(5)
    out = []
    for _ in range(90):
        grade = int(rng.integers(0, 3))
        words = {int(w) for w in rng.integers(100, 140, 12)} | {int(w) for w in rng.integers(10 * grade + 1, 10 * grade + 6, 3)}
        out.append((grade, rng.normal(grade / 3, 0.5, STYLES).astype(np.float32).tobytes(), np.array(sorted(words), np.uint64).tobytes()))
    return out


def test_ordinal_gradient():
    rng = np.random.default_rng(0)
    n, k = 40, 7
    grades, style = np.arange(n) % 4, rng.normal(size=(n, STYLES))
    doc, index = np.repeat(np.arange(n), 3), rng.integers(0, k, 3 * n)
    loss, thresholds = quality_classifier.ordinal_loss(grades, style, doc, index, k, 0.01)
    x = rng.normal(0, 0.3, k + STYLES + 3)
    assert (np.diff(thresholds(x)) > 0).all()
    value, g = loss(x)
    # the same value, written plainly
    w, s, t = x[:k], x[k : k + STYLES], thresholds(x)
    below = lambda i, c: 0.0 if c < 0 else 1.0 if c >= 3 else 1 / (1 + math.exp(style[i] @ s + sum(w[j] for j in index[doc == i]) - t[c]))
    plain = -sum(math.log(below(i, c) - below(i, c - 1)) for i, c in enumerate(grades)) / n + 0.005 * ((w @ w) + (s @ s))
    assert value == pytest.approx(plain)
    for j in range(len(x)):
        e = np.zeros(len(x))
        e[j] = 1e-6
        assert (loss(x + e)[0] - loss(x - e)[0]) / 2e-6 == pytest.approx(g[j], abs=1e-6)


def test_grades_against_a_plain_version(spark):
    model = quality_classifier.fit(examples(), telling=1.0)
    assert len(model.slots) > 5 and len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    by = {0: [], 1: [], 2: []}
    for grade, style, words in examples():
        x = np.frombuffer(style, np.float32).astype(float) @ model.style + sum(dict(zip(model.slots.tolist(), model.weights)).get(int(w), 0.0) for w in np.frombuffer(words, np.uint64))
        got = model.score(np.frombuffer(style, np.float32)[None], np.frombuffer(words, np.uint64), np.zeros(len(words) // 8, int))
        assert got[0] == pytest.approx(x)
        tails = [1 / (1 + math.exp(t - x)) for t in model.thresholds]
        assert model.tails(got)[0].tolist() == pytest.approx(tails)
        by[grade].append(sum(tails))
    assert np.mean(by[0]) < np.mean(by[1]) < np.mean(by[2])


def test_whole_scoring_against_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality_classifier.learn(docs, quality_classifier.grades_of(labels))
    some = docs.orderBy("doc_id").limit(10)
    got = {r["doc_id"]: r for r in quality_classifier.grade(some, model).collect()}
    weights = dict(zip(model.slots.tolist(), model.weights))
    for r in some.collect():
        block = next(iter(quality_classifier.features(pa.array([r["text"]]))))
        hashed = {int(w) for w in block[3]}
        assert len(hashed) == len({w.encode().lower() for w in re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", r["text"])})
        text = r["text"]
        per = max(1, len(re.findall(r"[^\x20\x09-\x0D]+", text)))
        words = re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", text)
        letters = len(re.findall("[A-Za-z]", text))
        style = [len(re.findall(r"[#*$%&<>]", text)) / per, text.count("!") / per, text.count("|") / per, len(re.findall("[A-Z]", text)) / max(1, letters), 1 - len(hashed) / max(1, len(words)) ** 0.85, math.log1p(len(words)) / 8]
        x = sum(a * b for a, b in zip(np.clip(style, -2, 2), model.style)) + sum(weights.get(w, 0.0) for w in hashed)
        tails = [1 / (1 + math.exp(t - x)) for t in model.thresholds]
        mine = got[r["doc_id"]]
        assert mine["score"] == pytest.approx(x, abs=1e-4) and mine["expected_grade"] == pytest.approx(sum(tails), abs=1e-4) and mine["p_top"] == pytest.approx(tails[-1], abs=1e-4)
        assert mine["selected"] == (mine["p_top"] >= 0.5)


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(shared, "HUB_EDGES", 3)
    rnd = random.Random(6)
    edges = [(0, k) for k in range(1, 60)] + [(100, 100 + k) for k in range(1, 9)] + [(108, 200), (200, 201), (59, 300)] + [(rnd.randrange(400, 460), rnd.randrange(400, 460)) for _ in range(50)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root
