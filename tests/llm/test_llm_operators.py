"""The operators on small tables with nulls, empty and long texts, ties, repeats and odd columns, against brute force."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netfathom.llm import chat_format, decontamination, jaccard_join, language_id, packing, pii, quality_classifier, quality_rules, shared, token_counts, url_filters

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, cls long, h string, `_other` int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30000))


def lower(x):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), x or "")


def some_texts():
    rnd = random.Random(1)
    base = [" ".join(rnd.choice(["alpha", "Beta", "gamma", "dé", "eps", "z"]) + str(rnd.randrange(40)) for _ in range(60)) for _ in range(6)]
    near = [" ".join(w if rnd.random() > 0.02 else "new" for w in t.split()) for t in base for _ in range(6)]
    odd = [None, "", "  \n\t", "one", "one two", "ONE two", "one", "a b c d", "a  b\nc\td", LONG, LONG + " tail", "x@y.example.com 10.0.0.1", "漢字 かな 漢字", "\u0000 nul"]
    return base + near + base[:2] + odd


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, None, None, 1, "h", 0) for i, t in enumerate(some_texts())], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def text_of(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def brute_components(texts, k, percent):
    sets, inverted = {}, defaultdict(list)
    for i, x in texts.items():
        w = WORD.findall(lower(x))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        for g in sets[i]:
            inverted[g].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in inverted[g]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k, percent, group, members", [(4, 85, 2_000_000, 512), (5, 80, 2_000_000, 512), (4, 85, 100, 512), (4, 85, 2_000_000, 3)])
def test_jaccard_components(docs, k, percent, group, members):
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(docs, k, percent, sketch_bits=16, group_shingles=group, group_members=members).collect()}
    assert got == brute_components(text_of(docs), k, percent)


@pytest.mark.parametrize("members", [512, 20])
def test_jaccard_of_a_hot_group(spark, members):
    """Near copies at all distances from each other around one text, so that many members are not linked with the leader."""
    rnd = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(w if rnd.random() > share else f"x{rnd.randrange(9)}" for w in base[: rnd.choice([100, 110, 120])]) for share in (0.0, 0.01, 0.02, 0.03, 0.05, 0.08) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(frame, 4, 85, group_members=members).collect()}
    want = brute_components(dict(enumerate(texts)), 4, 85)
    assert got == want and len({c for _, c in want.values()}) > 20


def test_jaccard_keeps_one(docs, none):
    want = {i for i, (_, c) in brute_components(text_of(docs), 5, 80).items() if i == c}
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want
    assert jaccard_join.jaccard_components(none).count() == 0


def test_signature_bounds_the_intersection():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64) * np.uint64(2)) for _ in range(2))
        b = np.unique(np.r_[b, a[: rng.integers(0, len(a) + 1)]])
        sign = lambda s: np.bincount((s >> np.uint64(64 - max(3, (len(s) - 1).bit_length()))).astype(np.int64), minlength=1 << max(3, (len(s) - 1).bit_length())).astype(np.uint8).tobytes()
        assert jaccard_join.most_shared(sign(a), sign(b)) >= len(np.intersect1d(a, b))


def test_components_of_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (100, 101)]
    got = {r["node"]: r["root"] for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 102: 100}


def test_contamination(spark, docs, none):
    texts = text_of(docs)
    rows = [("a", " ".join(texts[0].split()[5:30])), ("b", "ONE, two"), ("c", None), (None, "one"), ("d", "!!"), ("a", "漢字"), ("e", LONG[:400])]
    bench = spark.createDataFrame(rows, "item_id string, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, x in rows:
        w = word.findall(lower(x))
        m = min(10, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[j : j + m])] |= {i} - {None}  # a row without an id hits words, but is no item
    want = {}
    for d, x in texts.items():
        w, hit, items = word.findall(lower(x)), set(), set()
        for m in {len(p) for p in windows}:
            for j in range(len(w) - m + 1):
                if (own := windows.get(tuple(w[j : j + m]))) is not None:
                    hit |= set(range(j, j + m))
                    items |= own
        want[d] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    for portion in (decontamination.PORTION_BYTES, 300):
        got = {r[0]: tuple(r)[1:6] for r in decontamination.contamination(docs, bench, portion_bytes=portion).collect()}
        assert got == want
    assert {r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()} == {d for d, v in want.items() if not v[4]}
    assert decontamination.contamination(none, bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    digits = lambda m: sum(c.isdigit() for c in m.group())
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(t) if 13 <= digits(m) <= 19 and pii.luhn(re.sub(r"\D", "", m.group()))]
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= digits(m) <= 15]


def test_base_spans_against_patterns():
    rnd = random.Random(3)
    for _ in range(20000):
        t = "".join(rnd.choice("012.+-@ab é()%  ") for _ in range(rnd.randint(0, 50)))
        assert sorted(pii.base_spans(t)) == sorted(brute_spans(t)), t


def test_pii_finds_and_redacts(spark, none):
    rows = [(1, "write to bob.smith@mail7.example.com or +1 (017) 555-7713 é 4111 1111 1111 1111"), (2, None), (3, ""), (4, "no data"), (1, "10.0.0.1 and 10.0.0.999"), (5, "1" * 50000 + "@" + "a" * 50000)]
    frame = spark.createDataFrame([(i, t, None, None, None, 1, "h", 0) for i, t in rows], DOCS)
    network = pii.learn(spark.read.parquet(f"{SF}/documents.parquet"), sample=20)
    got = pii.find(frame, network).collect()
    for (i, t), r in zip(rows, got):
        base = pii.base_spans(t or "")
        assert r["doc_id"] == i and r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert {f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))
    first = pii.redact(frame, network).first()
    assert "[EMAIL]" in first["text"] and "[PHONE]" in first["text"] and "4111" not in first["text"]
    assert pii.find(none, None).count() == 0 and pii.learn(none) is None
    assert pii.redact(none, network).columns == none.columns


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = pii.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    chars, tags = rng.integers(1, pii.CODES, (3, 9)), rng.integers(0, pii.TAGS, (3, 9))
    _, g = net.gradients(chars, tags)
    for k, v in net.p.items():
        at = (int(chars[0, 0]), 2) if k == "E" else tuple(n - 2 for n in v.shape)
        old, e = v[at], 1e-5
        v[at] = old + e
        up = net.gradients(chars, tags)[0]
        v[at] = old - e
        down = net.gradients(chars, tags)[0]
        v[at] = old
        assert abs((up - down) / 2 / e - g[k][at]) < 2e-3


def test_line_rules(spark, docs, none):
    more = ["Good line one here.\nGood line one here.\nHome | About | Contact | More\n" + "Plain words go on and on. " * 12, "la la la " * 30, "A clean text. " * 3 + " ".join(f"w{i}" for i in range(60)) + "."]
    frame = docs.union(spark.createDataFrame([(1000 + i, t, None, None, None, 1, "h", 0) for i, t in enumerate(more)], DOCS))
    for r in quality_rules.line_rules(frame).join(frame.select(F.col("doc_id").alias("d"), "text"), F.col("doc_id") == F.col("d")).collect():
        x = r["text"] or ""
        w = WORD.findall(x)
        grams = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        cover = {j + o for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for o in range(3)}
        seen, dup = set(), 0
        for line in x.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(cover))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
        if r["doc_id"] == 1000:
            assert "Home" not in r["cleaned"]
    assert quality_rules.line_rules(none).count() == 0


def test_rules_keep_good_and_drop_poor(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_rules.line_rules(spark.read.parquet(f"{sf}/documents.parquet"), with_text=False).join(labels, "doc_id").where("not base_failed")
    share = {r["quality"]: r["k"] for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.97 and share[0] < 0.1


def test_languages(spark, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn(docs.where(~language_id.held_out(docs["doc_id"])))
    out = language_id.identify(docs.where(language_id.held_out(docs["doc_id"])), model, with_spans=False, keep=[docs["lang"]])
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (4, LONG)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.identify(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["score"] > 0
    assert language_id.identify(none, language_id.learn(docs.limit(0))).count() == 0
    assert language_id.identify(odd, language_id.learn(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_viterbi_against_brute_force():
    def brute(s, switch):
        v, back = s[0].copy(), []
        for t in range(1, len(s)):
            m = v[:, None] - switch * (1 - np.eye(s.shape[1]))
            back.append(m.argmax(0))
            v = m.max(0) + s[t]
        path = [v.argmax()]
        for b in back[::-1]:
            path.append(b[path[-1]])
        return path[::-1]

    for seed in range(60):
        rng = np.random.default_rng(seed)
        at = np.r_[0, np.cumsum(rng.integers(0, 25, 9))]
        s = rng.normal(0, 3, (at[-1], 3)).astype(np.float32) + np.float32([1.5, 0, 0])
        for f in (language_id.viterbi, language_id.label_words):
            label = f(s, at, 6.0)
            assert all((label[a:b] == brute(s[a:b], 6.0)).all() for a, b in zip(at, at[1:]) if b > a)


def odd_texts():
    rnd = random.Random(5)
    alphabet = "  \n\t'stremvld aàßé漢字😀x10९.,!▁　\xa0<s>|"
    own = ["", "a", " ", "  x", "<|endoftext|>hi", "a<|endoftext|>", "it's", "'s't 're don't", "x'", "\n\n", "a  \n b", "▁▁▁" * 20, "aaaa" * 50, "<0x41>", LONG[:20000]]
    return own + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]


def test_token_counts_equal_the_library(spark, none):
    import sentencepiece

    texts = odd_texts()
    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    got = np.concatenate([t for _, _, t in token_counts.count_tokens(pa.array(texts), token_counts.default_model())])
    assert got.tolist() == [len(x) for x in model.encode(texts, num_threads=1)]
    rows = token_counts.token_counts(spark.createDataFrame([(1, None), (2, "é a")], "doc_id long, text string")).collect()
    assert (rows[0]["n_bytes"], rows[0]["n_tokens"], rows[1]["n_bytes"]) == (0, 0, 4)
    assert token_counts.token_counts(none).count() == 0


def test_packing_is_whole_and_tight(spark, docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = text_of(docs) | {5000 + i: t for i, t in enumerate(odd_texts())}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    rows = packing.pack(frame, group_pieces=300).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for d, own in pieces.items():
        ids, at = tokenizer.encode(texts[d] or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    used = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        used += at
    assert used > 0.9 * 2048 * (len(sequences) - 8)
    assert packing.pack(none).count() == 0


def test_first_fit_decreasing_against_a_scan():
    rnd = random.Random(2)
    lengths = np.array([rnd.randint(1, 100) for _ in range(300)])
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room, want = [], {}
    for i in sorted(range(300), key=lambda i: (-lengths[i], i)):
        k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if k == len(room):
            room.append(100)
        want[i] = (k, 100 - room[k])
        room[k] -= lengths[i]
    assert [(b, o) for b, o in zip(bins.tolist(), offsets.tolist())] == [want[i] for i in range(300)]


def test_quality_classifier(spark, none):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = quality_classifier.grades_of(labels).where("doc_id % 4 = 0")
    model = quality_classifier.learn(docs, quality_classifier.grades_of(labels).where("doc_id % 4 <> 0"))
    assert (np.diff(model.thresholds) > 0).all()
    share = {r["grade"]: r["s"] for r in quality_classifier.grade(docs, model).join(held, "doc_id").groupBy("grade").agg(F.avg(F.col("selected").cast("int")).alias("s")).collect()}
    assert share[2] > 0.98 and share[1] < 0.08 and share[0] < 0.15
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "fine words here"), (3, "fine words here")], "doc_id long, text string")
    assert [r["selected"] for r in quality_classifier.grade(odd, model).orderBy("doc_id").collect()][:2] == [False, False]
    untrained = quality_classifier.learn(none, labels.select("doc_id", F.lit(None).cast("int").alias("grade")))
    assert quality_classifier.grade(odd, untrained).where("selected").count() == 2
    assert quality_classifier.select(none, labels).columns == none.columns


def test_url_rules_and_propagation(spark):
    html = '<a href="https://b.bad.net/x">x</a> <a href=/local>y</a>'
    rows = [(1, "https://A.example.org/es/1?q", None), (2, "http://x.org/en", ""), (3, "http://c.com/de/x", ""), (4, "no url", None), (5, None, None), (6, "http://linker.net/p#f", html), (7, "http://b.bad.net", ""), (8, "http://example.org/en/12", ""), (8, "http://example.org/en/12", ""), (9, "http://lonely.io", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = url_filters.rule_table(spark, [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("block", "bad.net", "")])
    got = {r["page_id"]: r for r in url_filters.filter_urls(pages, rules).collect()}
    assert url_filters.filter_urls(pages, rules).count() == 10
    told = {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()}
    assert told[1] == ("a.example.org", "/es/1", "example.org/es/", "block") and told[2] == ("x.org", "/en", "org/", "allow")
    assert told[4] == told[5] == ("", "", None, "allow") and told[7] == ("b.bad.net", "", "bad.net", "block")
    assert told[6] == ("linker.net", "/p", None, "block")  # it links to a blocked host
    assert told[8][2:] == ("example.org/en/1", "block") and told[9][3] == "allow"
    assert url_filters.filter_urls(pages.limit(0), rules).count() == 0


def test_the_training_sample_has_labels(spark):
    rows = [(i, "copied in 2020") for i in range(400)] + [(1000 + i, f"room {i}") for i in range(400)] + [(2000 + i, f"write to u{i}@example.org") for i in range(6)] * 2
    texts = pii.training_sample(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), sample=20)
    assert len(set(texts)) == len(texts) == 6 + 5 and sum("@" in t for t in texts) == 6
    many = [(i, f"write to u{i}@example.org") for i in range(100)] + rows
    texts = pii.training_sample(spark.createDataFrame(many, "doc_id long, text string"), sample=20)
    assert len(set(texts)) == 20 and sum("@" in t for t in texts) == 15


def test_chats_are_linked_and_checked(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", '{"tool_calls": [{"name":"add","id":"c1","arguments":{"b":2.50,"a":1}},{"id":"c2","name":"add","arguments":{"a":"$c1","z":1}}]}'),
        (1, 2, "tool", '{"content":{"y":1,"x":[1, 2]},"tool_call_id":"c2"}'),
        (1, 3, "tool", '{"tool_call_id":"c1","content":"ok"}'),
        (1, 4, "tool", '{"tool_call_id":"zz","content":1}'),
        (1, 5, None, None),
        (2, 0, "assistant", "{bad json"),
        (2, 1, "assistant", '{"tool_calls":[{"id":"q","name":"nope","arguments":{}}]}'),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tools = chat_format.parameter_table(spark, {"add": {"a": ("integer", True), "b": ("number", False)}})
    got = {(r["conv_id"], r["turn"]): r for r in chat_format.format_chats(frame, tools).collect()}
    assert got[1, 1]["message"] == '{"role":"assistant","tool_calls":[{"arguments":{"a":1,"b":2.5},"id":"c1","name":"add"},{"arguments":{"a":"$c1","z":1},"id":"c2","name":"add"}]}'
    assert got[1, 2]["message"] == '{"content":{"x":[1,2],"y":1},"role":"tool","tool_call_id":"c2"}'
    assert (got[1, 1]["n_calls"], got[1, 1]["n_errors"], got[1, 4]["n_errors"], got[1, 4]["linked"]) == (2, 2, 1, False)
    order = sorted((k for k in got if k[0] == 1), key=lambda k: tuple(got[k][c] for c in ("order_turn", "order_depth", "order_step")))
    assert order.index((1, 3)) < order.index((1, 2))
    assert got[1, 5]["message"] == '{"content":"","role":"user"}' and got[2, 1]["n_errors"] == 1
    assert chat_format.format_chats(frame.limit(0), tools).count() == 0


def test_long_chains_cycles_and_calls_without_identifier(spark):
    def calls(*xs):
        return json.dumps({"tool_calls": [{"id": i, "name": "f", "arguments": {"a": a}} for i, a in xs]})

    chain = [(f"c{i}", f"$c{i - 1}" if i else "x") for i in range(24)]
    rows = [(1, 0, "assistant", calls(*reversed(chain)))] + [(1, 1 + i, "tool", json.dumps({"tool_call_id": f"c{i}", "content": i})) for i in range(24)]
    knot = [("after", "$u"), ("u", "$v"), ("v", "$u"), ("free", "x")]
    rows += [(2, 0, "assistant", calls(*knot))] + [(2, 1 + k, "tool", json.dumps({"tool_call_id": i, "content": 0})) for k, (i, _) in enumerate(knot)]
    rows += [(3, 0, "assistant", '{"tool_calls":[{"name":"f","arguments":{"b":1}},{"id":"d","name":"f","arguments":{"a":"x"}}]}'), (3, 1, "assistant", '{"tool_calls":[{"id":"d","name":"f","arguments":{"b":1}}]}')]
    got = {(r["conv_id"], r["turn"]): r for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chat_format.parameter_table(spark, {"f": {"a": ("string", True)}})).collect()}
    assert [got[1, 1 + i]["order_depth"] for i in range(24)] == list(range(24)) and got[1, 0]["n_errors"] == 0
    assert [got[2, 1 + k]["order_depth"] for k in range(4)] == [2, 1, 1, 0]
    assert (got[3, 0]["n_calls"], got[3, 0]["n_errors"], got[3, 1]["n_calls"], got[3, 1]["n_errors"]) == (2, 3, 1, 3)


def test_copies_go_by_rows_and_not_by_ids(spark):
    a, b, c = ("one two three four five six seven eight", "red green blue white black grey pink brown", "now here is a text that has no id")
    rows = [(1, a), (1, a), (2, a), (2, b), (None, a), (None, c), (None, c), (3, None), (3, None), (4, "")]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, a), (2, b), (None, c), (3, None), (3, None), (4, "")], key=repr)


# ---- tool calls against a plain version ---------------------------------------------------------------------------------


def plain_chats(rows, tools):
    """n_errors, depth and linked of messages (conv, turn, role, text), told apart by their place; cycles only of two calls."""
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool}
    calls, first = [], {}
    for m in sorted({r for r in rows if r[2] == "assistant" and (r[3] or "").startswith('{"tool_calls"')}, key=lambda r: (str(r[0]), r[1])):
        for place, c in enumerate(json.loads(m[3])["tool_calls"]):
            args = c.get("arguments") or {}
            own = tools.get(c.get("name") or "")
            bad = 1 if own is None else sum(need if p not in args else not isinstance(args[p], kinds[k]) or isinstance(args[p], bool) and k != "boolean" for p, (k, need) in own.items()) + sum(p not in own for p in args)
            is_first = c.get("id") is not None and (m[0], c["id"]) not in first
            calls.append([m, place, c.get("id"), args, bad + (not is_first), is_first])
            if is_first:
                first[m[0], c["id"]] = calls[-1]
    needs = {k: {x for x in re.findall(r'"\$([^"]+)"', json.dumps(v[3])) if x != k[1] and (k[0], x) in first} for k, v in first.items()}
    depth, waiting = {}, dict(needs)
    while waiting:
        ready = {k for k, n in waiting.items() if all((k[0], x) in depth for x in n)}
        if ready:
            depth |= {k: 1 + max((depth[k[0], x] for x in needs[k]), default=-1) for k in ready}
        else:
            for k in [k for k, n in waiting.items() if any(k[1] in waiting.get((k[0], x), ()) for x in n)]:
                depth[k] = 1 + max((d for (c, _), d in depth.items() if c == k[0] and (c, _) not in waiting), default=-1)
                first[k][4] += 1
                ready.add(k)
        waiting = {k: n for k, n in waiting.items() if k not in ready}
    out = []
    for m in rows:
        own = [c for c in calls if c[0] == m]
        if own:
            out.append((m, sum(c[4] for c in own), max([depth[m[0], c[2]] for c in own if c[5]], default=0), None))
        elif m[2] == "tool" and (m[3] or "").startswith("{"):
            at = first.get((m[0], json.loads(m[3])["tool_call_id"]))
            out.append((m, int(at is None), depth[m[0], at[2]] if at else 0, at is not None))
        else:
            out.append((m, 0, 0, None))
    return out


def test_chats_against_a_plain_version(spark):
    rnd = random.Random(5)
    tools = {"search": {"query": ("string", True), "limit": ("integer", False)}, "sum": {"x": ("number", True), "flag": ("boolean", False)}}
    rows = []
    for conv in (1, 2, 3, None):
        for turn in range(12):
            calls = []
            for _ in range(rnd.randrange(1, 4)):
                name = rnd.choice(["search", "sum", "other"])
                args = {"query": rnd.choice(["q", 5, f"$c{rnd.randrange(turn + 1)}" if turn else "q"])} if name == "search" else {"x": rnd.choice([1, 2.5, "no", f"$c{rnd.randrange(turn + 1)}"])}
                if rnd.random() < 0.3:
                    args[rnd.choice(["limit", "flag", "more"])] = rnd.choice([3, True, "x"])
                call = {"id": rnd.choice([f"c{turn}", f"c{turn}-{rnd.randrange(99)}", None]), "name": name, "arguments": rnd.choice([args, args, args, None])}
                calls.append({k: v for k, v in call.items() if k != "id" or v is not None})
            rows.append((conv, 2 * turn, "assistant", json.dumps({"tool_calls": calls})))
            rows.append((conv, 2 * turn + 1, "tool", json.dumps({"tool_call_id": rnd.choice([f"c{turn}", "none"]), "content": {"b": 1, "a": [1.0]}})))
    rows += [(4, 0, "assistant", json.dumps({"tool_calls": [{"id": i, "name": "search", "arguments": {"query": n}} for i, n in (("p", "$q"), ("q", "$p"), ("r", "$q"), ("s", "x"))]}))]
    rows += [(5, k, "assistant", json.dumps({"tool_calls": [{"id": f"k{k}", "name": "search", "arguments": {"query": f"$k{k - 1}"}}]})) for k in range(25)]  # a chain, deeper than any other
    rows += rows[:3] + [(1, 99, None, None), (1, 99, "assistant", "{no json"), (6, 0, "user", LONG)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, _c int, errors string").repartition(3)
    got = chat_format.format_chats(frame, chat_format.parameter_table(spark, tools)).collect()
    want = Counter((str(m[0]), m[1], m[2] or "user", e, d, k) for m, e, d, k in plain_chats(rows, tools))
    assert Counter((str(r["conv_id"]), r["turn"], r["role"], r["n_errors"], r["depth"], r["linked"]) for r in got) == want
    place = {(r["conv_id"], r["call_id"]): (r["order_turn"], r["order_depth"], r["order_step"]) for r in got if r["linked"]}
    assert all((t, d, k) > (t, 0, 0) for t, d, k in place.values()) and max(r["depth"] for r in got) == 24


# ---- the host graph against a plain version -----------------------------------------------------------------------------


def plain_ranks(pages, seeds, damping=0.85, rounds=200):
    links, menus = defaultdict(set), defaultdict(set)
    for k, (host, html) in enumerate(pages):
        if host:
            for d in set(re.findall(url_filters.LINK, html or "")):
                links[host, d.lower()].add(k)
            for p in set(re.findall(url_filters.MENU, html or "")):
                menus[host, p].add(k)
    links = {k: len(v) for k, v in links.items() if k[0] != k[1]}
    menus = {k: len(v) for k, v in menus.items() if len({h for h, p in menus if p == k[1]}) > 1}
    step = {True: defaultdict(float), False: defaultdict(float)}
    for ahead in step:
        total = Counter()
        for (a, b), w in links.items():
            total[a if ahead else b] += w
        for (h, _), w in menus.items():
            total[h] += w
        for (a, b), w in links.items():
            step[ahead][(a, b) if ahead else (b, a)] += w / total[a if ahead else b]
        for (h, p), w in menus.items():
            for (g, q), v in menus.items():
                if q == p:
                    step[ahead][h, g] += w / total[h] * v / sum(x for (_, r), x in menus.items() if r == p)
    whole = sum(a + b for a, b in seeds.values())
    out = []
    for ahead in (True, False):
        base = {h: (a if ahead else b) / whole for h, (a, b) in seeds.items()}
        rank = dict(base)
        for _ in range(rounds):
            new = defaultdict(float, {h: (1 - damping) * x for h, x in base.items()})
            for (a, b), x in step[ahead].items():
                new[b] += damping * x * rank.get(a, 0)
            rank = new
        out.append(rank)
    return out


def test_host_graph_against_a_plain_version(spark, none):
    rnd = random.Random(9)
    hosts = [f"h{i}.{t}" for i in range(6) for t in ("com", "net", "org")]
    rows = []
    for k in range(300):
        h = rnd.choice(hosts[:3] if k % 3 else hosts)  # hosts with more than their share
        html = "".join(f'<a href="/m{rnd.choice([int(h[1]), rnd.randrange(8)])}">x</a>' for _ in range(3)) + (f'<a href="http://{rnd.choice(hosts).upper()}/q">' if k % 4 == 0 else "") + (f"see https://{rnd.choice(hosts)}?a" if k % 7 == 0 else "")
        rows.append((k, f"https://{h}/{rnd.choice(['good', 'bad', 'x'])}/{k}?u=http://no.com", html))
    rows += [(900, None, None), (901, "no scheme", "<a href='//h0.com/'>"), (902, "HTTP://H1.COM", None), (902, "HTTP://H1.COM", None), (903, "http://" + "a." * 20000 + "com/" + "p" * 100000, None), (None, "https://h0.org/good/", None)]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, pages int").repartition(3)
    rules = [("allow", "com", "/good"), ("block", "com", "/bad"), ("allow", "h0.com", "/bad"), ("block", "h0.com", "/bad"), ("block", "h1.com", "/good/2")]
    got = url_filters.filter_urls(pages, url_filters.rule_table(spark, rules), tolerance=1e-12).collect()
    place = lambda u: (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if (m := re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")) else ("", "")
    told, seeds = {}, defaultdict(lambda: [0, 0])
    for k, u, _ in rows:
        h, p = place(u)
        fits = sorted((-len(rh + rp), rh + rp, v) for v, rh, rp in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp))
        told[k, u] = (h, p, *(fits[0][1:] if fits else (None, None)))
        if fits:
            seeds[h][fits[0][2] == "block"] += 1
    trust, distrust = plain_ranks([(place(u)[0], html) for _, u, html in rows], seeds)
    odds = 1.2 * sum(b for _, b in seeds.values()) / sum(a for a, _ in seeds.values())
    want = Counter((k, h, p, r, v or ("block" if distrust.get(h, 0) > odds * trust.get(h, 0) else "allow")) for k, u, _ in rows for h, p, r, v in [told[k, u]])
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == want
    assert all(abs(r["trust"] - trust.get(r["host"], 0)) < 1e-9 and abs(r["distrust"] - distrust.get(r["host"], 0)) < 1e-9 for r in got if r["host"])
    open_ = {(r["host"][-3:], r["verdict"]) for r in got if r["rule"] is None}
    assert {("net", "allow"), ("net", "block")} <= open_ or {("org", "allow"), ("org", "block")} <= open_ or {("com", "allow"), ("com", "block")} <= open_
    assert url_filters.filter_urls(pages.limit(0), url_filters.rule_table(spark, rules)).count() == 0 and url_filters.filter_urls(pages.limit(5), url_filters.rule_table(spark, [])).where("verdict = 'block'").count() == 0


# ---- others ------------------------------------------------------------------------------------------------------------------


def test_tokens_of_unbroken_runs():
    import sentencepiece

    rnd = random.Random(2)
    path = token_counts.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    runs = ["a" * 1_000_000, "ab" * 200_000, "".join(rnd.choice("ABCabc0189+/") for _ in range(300_000)), "".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(100_000)), "".join(rnd.choice(["the", "of", "entre", "ung"]) for _ in range(60_000)), " " * 99_999]
    runs += ["".join(rnd.choice(rnd.choice(["ab", "eEtT", "thero", "01", "_-", "aé"])) for _ in range(rnd.randrange(200, 2000))) for _ in range(60)]
    got = np.concatenate([t for _, _, t in token_counts.count_tokens(pa.array(runs), path)])
    assert got.tolist() == [len(x) for x in library.encode(runs)]


def test_decoding_is_the_best_path_and_reconciling_keeps_the_base():
    import itertools

    rng = np.random.default_rng(4)
    net = pii.Network(2)
    net.p["T"] = rng.normal(0, 1, net.p["T"].shape).astype(np.float32)
    chars = rng.integers(1, pii.CODES, (3, 4))
    tags, sure = net.decode(chars)
    e, _ = net.emissions(chars)
    for n in range(3):
        score = {path: sum(e[n, t, k] for t, k in enumerate(path)) + sum(net.p["T"][a, b] for a, b in zip(path, path[1:])) for path in itertools.product(range(pii.TAGS), repeat=4)}
        z = sum(np.exp(v) for v in score.values())
        assert tuple(tags[n]) == max(score, key=score.get)
        assert all(abs(sure[n, t] - sum(np.exp(v) for p, v in score.items() if p[t] == tags[n, t]) / z) < 1e-3 for t in range(4))
    rnd = random.Random(1)
    for _ in range(300):
        text = "".join(rnd.choice("0123456789@a.") for _ in range(60))
        base = [(k, a, a + 9) for k, a in [(rnd.randrange(4), rnd.randrange(0, 50)) for _ in range(2)]]
        found = [(rnd.randrange(4), a, a + rnd.randrange(5, 25), rnd.randrange(1, 3), rnd.random()) for a in (rnd.randrange(0, 40) for _ in range(6))]
        out = pii.reconcile(base, found, text)
        added = [s for s in out if s not in base]
        assert set(base) <= set(out) and all(b <= c or d <= a for i, (_, a, b) in enumerate(added) for _, c, d in [*base, *added[:i]])
        # what was left out is unsure, of no shape, or overlaps something at least as strong that stays
        for k, a, b, n, p in found:
            if (k, a, b) not in out and p >= pii.MIN_MARGIN and pii.shaped(k, text[a:b]):
                assert any(c < b and a < d for _, c, d in base) or any(c < b and a < d and (m, q) >= (n, p) for j, c, d, m, q in found if (j, c, d) in out)


def test_windows_are_decoded_as_one_by_one():
    net = pii.Network(3)
    net.p["o"][1:] += 1.5  # tags come up often
    texts = ["no digits at all", "7 " * 70, "x" * 200 + "ann@example.org" + " y" * 90, ""]
    found = pii._decoded(net, texts, most=2)
    for text, own in zip(texts, found):
        want = defaultdict(list)
        c = pii.codes(text)
        for lo in range(0, max(1, len(c)), pii.STEP):
            part = c[lo : lo + pii.WINDOW]
            if not (((part >= 48) & (part < 58)) | (part == 64)).any():
                continue
            w = np.zeros(pii.WINDOW, np.int64)
            w[: len(part)] = part
            tags, sure = (x[0] for x in net.decode(w[None]))
            at = 0
            while at < pii.WINDOW:
                if tags[at] == 0:
                    at += 1
                    continue
                end = at + 1
                while end < pii.WINDOW and tags[end] != 0 and tags[end] % 2 == 0 and (tags[end] - 1) // 2 == (tags[at] - 1) // 2:
                    end += 1
                if not (at == 0 and lo > 0) and end < pii.WINDOW and w[end - 1] > 0:
                    want[(tags[at] - 1) // 2, lo + at, lo + end].append(sure[at:end].mean())
                at = end
        assert {s[:3]: s[3] for s in own} == {k: len(v) for k, v in want.items()}
        assert all(abs(s[4] - np.mean(want[s[:3]])) < 1e-4 for s in own)


def test_kept_lines_against_plain_rules(spark):
    rnd = random.Random(8)
    words = ["alpha", "beta", "GAMMA", "délta", "x|", "***", "no!", "end.", "fin;", "wo?"]
    banner = "Rights of this text are kept by all."
    texts = ["\n".join([banner] * (rnd.random() < 0.5) + [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 30))) + rnd.choice([".", "", "é", "|"]) for _ in range(rnd.randrange(3, 9))]) for _ in range(120)]
    texts += [None, "", " \n ", "one", texts[0], LONG, "a\n\nb"]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, line int").repartition(3)
    lines = {t: [(x, WORD.findall(x)) for x in t.split("\n") if WORD.findall(x)] for t in texts if t}
    often = Counter(b for own in lines.values() for b in {re.search(r"[^\x20\x09-\x0D](?s:.*[^\x20\x09-\x0D])?", x)[0] for x, w in own if len(w) <= 15})
    have = sum(any(len(w) <= 15 for _, w in own) for own in lines.values())
    common = {b for b, n in often.items() if n >= max(20, 0.001 * have)}
    assert common == {banner}
    for r in quality_rules.line_rules(frame).collect():
        seen, stay, whole, kept = set(), 0, 0, []
        for x, w in lines.get(texts[r["doc_id"]], []):
            n, count = len(w), lambda p: len(re.findall(p, x))  # noqa: B023
            later = x in seen
            seen.add(x)
            fails = n >= 3 and not re.search(r"[.!?:;\"')\]]$|[^\x00-\x7F]$", w[-1]) or count("!") >= 2 and count("!") * 4 > n or count(r"[#*$%&|<>]") * 4 > n or count("[A-Z]") >= 10 and count("[A-Z]") > 2 * count("[a-z]")
            fails = fails or count(r"[|<>]") >= 2 and count(r"[|<>]") * 6 >= n or later and n >= 3 or n <= 15 and x.strip(" \t\n\r\x0b\x0c") in common
            whole, stay = whole + len(x), stay + (not fails) * len(x)
            kept += [] if fails else [x]
        assert r["cleaned"] == "\n".join(kept) and r["kept"] == (not r["base_failed"] and 100 * stay >= 50 * whole) and abs(r["share_left"] - (stay / whole if whole else 0)) < 1e-9, texts[r["doc_id"]]


def test_odd_columns_and_repeated_ids(spark):
    rows = [(1, "a good text of words " * 9, "x"), (1, "a good text of words " * 9, "x"), (1, "another text " * 20, "y"), (None, None, "z"), (2, "bad " * 60, "x"), (3, LONG, "x")]
    odd = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], "doc_id long, text string, __items string, _carried int, _grade int, _key int, _mark int, place int, _m int")
    bench = spark.createDataFrame([("i", "another text another text another text another text another text")], "item_id string, text string")
    clean = decontamination.decontaminate(odd, bench)
    assert clean.columns == odd.columns and sorted(map(repr, clean.collect())) == sorted(repr(r) for r in odd.collect() if "another" not in (r["text"] or ""))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality_classifier.select(odd, labels).columns == odd.columns
    assert quality_classifier.grade(odd, quality_classifier.learn(odd, quality_classifier.grades_of(labels), sample_words=3)).count() == len(rows)
    assert jaccard_join.keep_one(odd).columns == odd.columns and jaccard_join.keep_one(odd).count() == 5
    for out in (pii.redact(odd, None), language_id.identify(odd, language_id.learn(odd.withColumn("lang", F.lit(None).cast("string"))), with_spans=False), token_counts.token_counts(odd), packing.pack(odd)):
        assert out.count() >= len(rows)
    assert language_id.identify(odd, language_id.learn(odd.limit(0).withColumn("lang", F.lit("a"))), with_spans=False).where("lang_pred <> 'und'").count() == 0
