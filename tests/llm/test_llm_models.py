"""Katz scoring, divergence of sources and spelling variants, against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from netfathom.llm import divergence as dv
from netfathom.llm import katz, spelling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, `_chunk` int"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def some_rows():
    rnd = random.Random(4)
    vocabulary = ["station", "stations", "statiom", "Station", "signaling", "signalling", "signaing", "überlast", "überlasst", "éclairage", "éclaitage", "the", "of", "a", "naïvement", "naïvment", "x"]
    weights = [40, 5, 1, 9, 30, 4, 1, 12, 1, 20, 1, 60, 50, 40, 11, 1, 8]
    rows = []
    for i in range(240):
        text = " ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(0, 50)))
        rows.append((i, text, rnd.choice(["en", "fr", None]), rnd.choice(["s0", "s0", "s0", "s1", "s2", "ü", None])))
    rows += [(1, rows[1][1], "en", "s0"), (1, rows[1][1], "en", "s0"), (None, "signaling station", "en", "s9"), (900, None, None, None), (901, "", "xx", "s0"), (902, " \n\t ", "xx", "s1")]
    rows += [(903, " ".join(["station signaling the"] * 9000), "en", "s1"), (904, "z" * 50000 + " " + "z" * 49999 + "y", "fr", "s0"), (905, "z" * 50000, "fr", "s1"), (906, "漢字 × ÷÷÷÷÷÷÷÷ \u0000 station", "en", "ü")]
    return [(*r, 1, "w", 2, 3) for r in rows]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(some_rows(), DOCS).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD)) + [None]


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts):
        self.one, self.two = Counter(), Counter()
        for t in texts:
            last = 0
            for w in tokens_of(t):
                self.one[w] += 1
                self.two[last, w] += 1
                last = w
        self.n, self.v = sum(self.one.values()), len(self.one)
        of = [katz.good_turing([sum(1 for c in x.values() if c == r) for r in range(1, 7)]) for x in (self.one, self.two)]
        self.d = [lambda c, x=x: x[min(c, len(x) - 1)] for x in of]
        self.after, self.total = defaultdict(list), Counter()
        for (h, w), c in self.two.items():
            self.after[h].append(w)
            self.total[h] += c
        lost = sum((1 - self.d[0](c)) * c for c in self.one.values())
        self.below = self.n + (lost <= 0)
        self.unseen = (lost or 1) / self.below if self.n else 1.0

    def single(self, w):
        return self.d[0](self.one[w]) * self.one[w] / self.below if w in self.one else self.unseen

    def p(self, h, w):
        if h not in self.after:
            return self.single(w)
        lost = sum((1 - self.d[1](self.two[h, x])) * self.two[h, x] for x in self.after[h])
        below = self.total[h] + (lost <= 0)
        if (h, w) in self.two:
            return self.d[1](self.two[h, w]) * self.two[h, w] / below
        return (lost or 1) / below / (1 - sum(self.single(x) for x in self.after[h])) * self.single(w)

    def score(self, text):
        out, last, known = 0.0, 0, {}
        for w in tokens_of(text):
            if (last, w) not in known:
                known[last, w] = math.log10(self.p(last, w))
            out += known[last, w]
            last = w
        return out


def out_of(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


@pytest.mark.parametrize("frequent", [(1 << 20, 1 << 16, 1 << 18), (16, 8, 4), (3, 1, 1)])  # all evaluated at once, or most in buckets
def test_katz(docs, frequent, monkeypatch):
    for name, value in zip(("WORDS", "HISTORIES", "BIGRAMS"), frequent):
        monkeypatch.setattr(katz, name, value)
    monkeypatch.setattr(katz, "CHUNK_DOCS", 50)
    scored = katz.score(docs, katz.learn(docs.where(~katz.held_out(docs["doc_id"]))))
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in scored.collect())
    rows = some_rows()
    plain = Plain([r[1] for r in rows if not out_of(r[0])])
    assert len(got) == len(rows)
    want = []
    for r in rows:
        t = tokens_of(r[1])
        base = sum(math.log10((plain.one[w] + 0.5) / (plain.n + 0.5 * (plain.v + 1))) for w in t)
        want.append((r[0] is None, r[0], len(t), sum(w in plain.one for w in t), plain.n, base, plain.score(r[1])))
    for a, b in zip(got, sorted(want)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9), (a, b)


def test_katz_sums_to_one(docs):
    plain = Plain([r[1] for r in some_rows()])
    assert sum(map(plain.single, plain.one)) + plain.unseen == pytest.approx(1)
    for h in [0, "station", "the", "z" * 50000, "never"]:
        assert sum(plain.p(h, w) for w in plain.one) + plain.p(h, "not there") == pytest.approx(1)


def test_katz_without_training(docs, none):
    model = katz.learn(none)
    rows = katz.score(docs, model).collect()
    assert len(rows) == len(some_rows()) and all(r["score"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in rows)
    assert katz.score(none, katz.learn(docs)).count() == 0


def test_good_turing():
    d = katz.good_turing([1000, 300, 140, 80, 50, 35])
    assert len(d) == 7 and all(0 < x < 1 for x in d[1:6]) and d[6] == 1
    n = [1000, 300, 140, 80, 50, 35]
    assert sum((1 - d[r]) * r * n[r - 1] for r in range(1, 6)) == pytest.approx(n[0])  # discounts free the mass of the once seen
    assert list(katz.good_turing([0] * 6)[1:3]) == [1 / 2, 2 / 3]
    assert len(katz.good_turing([1000, 300, 140, 80, 0, 0])) == 5  # to a smaller count


def test_divergence(docs, none, monkeypatch):
    by_lang = defaultdict(list)
    for r in some_rows():
        by_lang[r[2] or ""].append((r[3] or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (r[1] or "").translate(FOLD))))
    want = set()

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    for lang, rows in by_lang.items():
        counts, df = defaultdict(Counter), Counter()
        for s, t in rows:
            counts[s].update(t)
            df.update(set(t))
        kept = [t for t in df if df[t] >= 10]
        whole = Counter()
        for s in counts:
            counts[s] = Counter({t: counts[s][t] for t in kept})
            whole.update(counts[s])

        def share(c):
            return {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            for part, values in (("pair", [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]), ("term", [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]])):
                ranked = sorted(values, key=lambda x: (-x[1], x[0].encode()))
                want |= {(lang, s, part, item, v, k) for k, (item, v) in enumerate(ranked, 1) if part == "pair" or k <= 10}
    for size in (1 << 20, 7):  # dense sums, or rows as they come, some postings at a time
        monkeypatch.setattr(dv, "SLICE", size)
        got = [tuple(r) for r in dv.divergence(docs).select("lang", "source", "part", "item", "value", "rank").collect()]
        assert len(got) == len(want) and set(got) == want
    assert dv.divergence(none).count() == 0


def test_share_is_exact():
    rnd = random.Random(2)
    for _ in range(2000):
        total, terms = rnd.randrange(1, 8 * 10**15), rnd.randrange(1, 10**9)
        n = rnd.randrange(0, total)
        assert int(dv.share(np.array([n]), np.array([total]), terms)[0]) == 1 + 10**9 * (n + 2) // (total + 2 * terms)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows):
    total = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}
    form, out = {}, {}
    for w, n in words.items():
        mates = [v for v in words if near(w, v)]
        best = min(mates, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
        out[w] = len(mates)
    result = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        result.add((w, form[w], root, words[w], out[w], words.get(form[w])))
    return result


@pytest.mark.parametrize("bits", [28, 3])  # a bitmap that drops nearly all, or nothing
def test_spelling(docs, none, bits, monkeypatch):
    if bits == 3:
        monkeypatch.setattr(spelling, "symbols", lambda n: 2)  # most reduced words collide
    got = [tuple(r) for r in spelling.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = variants(some_rows())
    assert len(got) == len(want) and set(got) == want
    assert any(x[1] and x[2] != x[1] for x in variants([(k, f"{w} " * n, 0, 0) for k, (w, n) in enumerate([("abcdefgh", 4), ("abcdefgi", 60), ("abcdefji", 900)])]))
    assert spelling.spelling_variants(none).count() == 0


def test_spelling_chain(spark, none):
    """Forms of forms, by many rows that lose no letter."""
    rows = [(i, w, None, None, 0, "", 0, 0) for w, n in [("abcdefgh", 3), ("abcdefgi", 60), ("abcdefji", 900)] for i in range(n)]
    got = [tuple(r) for r in spelling.spelling_variants(spark.createDataFrame(rows, DOCS)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert set(got) == variants(rows) and any(x[1] and x[2] != x[1] for x in got)
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(19)], "word string, form string")
    assert {r["root"] for r in spelling.roots(forms).collect()} == {"w19"}
    assert spelling.roots(forms.limit(0)).count() == 0


def test_reduced_neighbourhoods_are_full():
    import pyarrow as pa

    words = ["station", "überall", "a", "", "aab"]
    for a in (2, 4):
        made = spelling.Reduced(pa.array(words), a)
        got = defaultdict(set)
        for w, k in made.neighbours():
            for x, y in zip(w.tolist(), k.tolist()):
                got[x].add(y)
        first = np.cumsum([len(w) for w in words]) - [len(w) for w in words]
        for i, w in enumerate(words):
            own = made.symbol[first[i] : first[i] + len(w)].tolist()
            around = {tuple(own)} | {tuple(own[:j] + own[j + 1 :]) for j in range(len(own))}
            around |= {tuple(own[:j] + [c] + own[j + s :]) for c in range(1, a + 1) for s in (0, 1) for j in range(len(own) + 1) if j + s <= len(own)}
            keys = set()
            for x in around:
                h = sum(c * int(spelling.powers(16)[0][j]) for j, c in enumerate(x)) % 2**64
                keys.add(int(made.key(np.array([h], np.uint64), np.array([len(x)]))[0]))
            assert keys == got[i]
