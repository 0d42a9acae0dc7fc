"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text has one latent score, the sum of shared weights of its hashed words (each distinct word once) and of a few measures
of its style. Ordered thresholds cut the score into grades: P(grade <= g) = sigmoid(threshold[g] - score). From it follow
the expected grade and the tail probability of the top grade, by which documents are selected.

Fitted in numpy on a bounded sample of graded documents: ``SAMPLE`` ids by their hash, one text of each, and of these, in the
same order, as many as have ``SAMPLE_WORDS`` distinct words in all, so that the driver's part is bounded too. Only words
that tell grades apart get a weight, and only these are broadcast, at most those of the sample. Scoring covers all rows and
whole texts.

A null text, or one without words, gets grade 0 and is not selected. Grades of one document given repeatedly count as the
lowest; null grades are left out. Of several texts of one id the one of the least hash is graded. With fewer than two grades nothing can be learned, and all texts with words are
selected. Repeated rows score alike; other columns are ignored (``grade``) or kept (``select``); an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut
from .textblocks import ALNUM, NONSPACE, U64, blocks, mix, windows

SAMPLE = 10_000
SAMPLE_WORDS = 20_000_000
STYLES = 6
MARKS = 4


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _SHOUT, _BAR, _UPPER, _LETTER = _class(b"#*$%&<>"), _class(b"!"), _class(b"|"), _class(bytes(range(65, 91))), _class(bytes([*range(65, 91), *range(97, 123)]))


def features(column: pa.Array, marked: bool = False) -> Iterator[tuple]:
    """Rows, style measures, word counts, per distinct word of each text its hash and document, and the text's marks: the
    least hashes of its five-word windows in ``MARKS`` orders, of which copies share some."""
    for block in blocks(column):
        starts, ends, bounds = block.words(ALNUM)
        words = block.spans(block.hashed(True), starts, ends)
        doc = np.repeat(np.arange(block.n), np.diff(bounds))
        n = np.diff(bounds)
        of = lambda c: np.diff(np.r_[0, np.cumsum(c[block.data], dtype=np.int64)][block.at])
        _, _, plain = block.words(NONSPACE)
        per = np.maximum(1, np.diff(plain))
        key = mix(words + mix(doc.astype(U64) + U64(1)))
        order = np.argsort(key, kind="stable")
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[order][1:] != key[order][:-1]
        first = np.sort(order[fresh])
        distinct = np.bincount(doc[first], minlength=block.n)
        style = np.stack([of(_SYMBOL) / per, of(_SHOUT) / per, of(_BAR) / per, of(_UPPER) / np.maximum(1, of(_LETTER)), 1 - distinct / np.maximum(1, n) ** 0.85, np.log1p(n) / 8], 1)
        grams, at = windows(words, bounds, 5) if marked else (words[:0], bounds[:1])
        marks = np.zeros((block.n, MARKS if marked else 0), U64)
        for j in range(marks.shape[1]):
            marks[n > 0, j] = np.minimum.reduceat(mix(grams + U64(j)), at[:-1][n > 0]) if (n > 0).any() else 0
        yield block.rows, np.clip(style, -2, 2).astype(np.float32), n, words[first] >> U64(24), doc[first], marks


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, style, _, words, doc, marks in features(batch.column(0), marked=True):
            at = np.searchsorted(doc, np.arange(len(rows) + 1))
            own = [words[a:b].tobytes() for a, b in zip(at, at[1:])]
            yield pa.record_batch([batch.column(1).slice(rows.start, len(rows)), pa.array([s.tobytes() for s in style], pa.binary()), pa.array(own, pa.binary()), pa.array([x.tobytes() for x in marks], pa.binary()), batch.column(2).slice(rows.start, len(rows))], names=["grade", "style", "words", "marks", "place"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Model:
    """``slots`` (sorted) and ``weights`` of words, ``style`` weights, ``thresholds`` between grades."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, style: np.ndarray, thresholds: np.ndarray):
        self.slots, self.weights, self.style, self.thresholds = slots, weights, style, thresholds

    def score(self, style: np.ndarray, words: np.ndarray, doc: np.ndarray) -> np.ndarray:
        out = style.astype(np.float64) @ self.style
        if len(self.slots):
            at = np.minimum(np.searchsorted(self.slots, words), len(self.slots) - 1)
            hit = self.slots[at] == words
            out += np.bincount(doc[hit], weights=self.weights[at[hit]], minlength=len(style))
        return out

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= g) for each g from 1."""
        return _sigmoid(score[:, None] - self.thresholds[None])


def minimise(f, x: np.ndarray, rounds: int, memory: int = 12) -> np.ndarray:
    """Limited-memory quasi-Newton steps with backtracking; f gives value and gradient."""
    value, grad = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, used = grad.copy(), []
        for s, y in reversed(steps):
            used.append((s @ q) / (s @ y))
            q -= used[-1] * y
        if steps:
            s, y = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(used)):
            q += s * (a - (y @ q) / (s @ y))
        size, slope = 1.0, grad @ q
        while size > 1e-8:
            after, grad_after = f(x - size * q)
            if after <= value - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = -size * q, grad_after - grad
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y)]
        if value - after < 1e-9:
            return x - size * q
        x, value, grad = x - size * q, after, grad_after
    return x


def without_copies(examples: list[tuple[int, bytes, bytes, bytes]]) -> list[tuple[int, bytes, bytes]]:
    """Of examples (grade, style, words, marks), those that share no mark with an earlier one of their grade: the words of
    a group of copies would otherwise seem to tell grades apart."""
    seen, out = set(), []
    for grade, style, words, marks in examples:
        own = {(grade, j, marks[8 * j : 8 * j + 8]) for j in range(MARKS)}
        if not own & seen:
            out.append((grade, style, words))
        seen |= own
    return out


def ordinal_loss(grades: np.ndarray, style: np.ndarray, doc: np.ndarray, index: np.ndarray, k: int, l2: float):
    """The mean negative log likelihood and its gradient, as a function of k words' weights, the style weights, the first
    threshold and the logs of the gaps between thresholds; and the thresholds of those. Example ``doc[i]`` has word ``index[i]``."""
    top, n = int(grades.max()), len(grades)
    up, down = grades < top, grades > 0

    def thresholds(x: np.ndarray) -> np.ndarray:
        return x[k + STYLES] + np.r_[0, np.cumsum(np.exp(x[k + STYLES + 1 :]))]

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        s = style @ x[k : k + STYLES] + np.bincount(doc, weights=x[:k][index], minlength=n)
        edges = np.r_[-np.inf, thresholds(x), np.inf]
        low, high = np.zeros(n), np.ones(n)
        low[down] = _sigmoid(edges[grades[down]] - s[down])
        high[up] = _sigmoid(edges[grades[up] + 1] - s[up])
        p = np.maximum(high - low, 1e-12)
        r = (1 - low - high) / n
        by = np.zeros(top)
        np.add.at(by, grades[up], -(high * (1 - high) / p / n)[up])
        np.add.at(by, grades[down] - 1, (low * (1 - low) / p / n)[down])
        gaps = np.exp(x[k + STYLES + 1 :])
        g = np.r_[np.bincount(index, weights=r[doc], minlength=k), style.T @ r, by.sum(), [by[j + 1 :].sum() * gaps[j] for j in range(top - 1)]]
        g[: k + STYLES] += l2 * x[: k + STYLES]
        return float(-np.log(p).mean() + l2 / 2 * (x[: k + STYLES] ** 2).sum()), g

    return loss, thresholds


def fit(examples: list[tuple[int, bytes, bytes]], rounds: int = 300, l2: float = 2e-5, least: int = 4, telling: float = 4.0) -> Model:
    """The least mean negative log likelihood, with a ridge. Words enter if ``least`` examples have them and their mean
    grade is ``telling`` standard errors off the mean of all; others would only add up to noise in long texts."""
    none = np.zeros(0)
    grades = np.array([g for g, _, _ in examples], np.int64)
    if len(set(grades.tolist())) < 2:
        return Model(np.zeros(0, U64), none, np.zeros(STYLES), none)
    style = np.stack([np.frombuffer(s, np.float32) for _, s, _ in examples]).astype(np.float64)
    own = [np.frombuffer(w, U64) for _, _, w in examples]
    doc = np.repeat(np.arange(len(own)), [len(w) for w in own])
    slots, index, often = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    off = np.bincount(index, weights=(grades - grades.mean())[doc], minlength=len(slots)) / (grades.std() * np.sqrt(often))
    kept = (often >= least) & (np.abs(off) >= telling)
    doc, index = doc[kept[index]], (np.cumsum(kept) - 1)[index[kept[index]]]
    slots = slots[kept]
    top, k = int(grades.max()), len(slots)
    share = np.clip([(grades > g).mean() for g in range(top)], 0.002, 0.998)
    raw = -np.log(share / (1 - share))  # thresholds that fit the grades alone
    loss, thresholds = ordinal_loss(grades, style, doc, index, k, l2)
    x = minimise(loss, np.r_[np.zeros(k + STYLES), raw[0], np.log(np.maximum(1e-2, np.diff(raw)))], rounds)
    return Model(slots, x[:k], x[k : k + STYLES], thresholds(x))


def learn(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE, sample_words: int = SAMPLE_WORDS) -> Model:
    """From documents (doc_id, text) and grades (doc_id, grade)."""
    one = grades.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min(F.col("grade").cast("int")).alias("_grade"))
    some = one.withColumn("_order", F.xxhash64("doc_id")).orderBy("_order", "doc_id").limit(sample).withColumnRenamed("doc_id", "_graded")
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(some), F.col("doc_id") == F.col("_graded"))  # at most ``sample`` rows
    found = found.groupBy("_graded", "_grade", "_order").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = cut(found.select("text", "_grade", "_order").mapInArrow(_examples, "grade int, style binary, words binary, marks binary, place long"))
    run = F.sum(F.octet_length("words")).over(Window.orderBy("place", "marks").rowsBetween(Window.unboundedPreceding, 0))  # at most ``sample`` rows
    last = rows.select("place", run.alias("run")).where(F.col("run") <= 8 * sample_words).agg(F.max("place")).first()[0]
    if last is None:
        return fit([])
    return fit(without_copies(sorted((r[0], *map(bytes, r[1:4])) for r in rows.where(F.col("place") <= last).collect())))


def _scored(model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            score, expected, tail = [], [], []
            for rows, style, n, words, doc, _ in features(batch.column(1)):
                s = m.score(style, words, doc)
                tails = m.tails(s)
                some = n > 0
                score.append(np.where(some, s, 0.0))
                expected.append(np.where(some, tails.sum(1), 0.0))
                tail.append(np.where(some, tails[:, -1] if tails.shape[1] else 1.0, 0.0))
            if score:
                score, expected, tail = map(np.concatenate, (score, expected, tail))
                yield pa.record_batch([batch.column(0), pa.array(score), pa.array(expected), pa.array(tail), pa.array(tail >= least)], names=["doc_id", "score", "expected_grade", "p_top", "selected"])

    return run


def grade(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, score, expected_grade, p_top, selected) per row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model), least), f"doc_id {kind}, score double, expected_grade double, p_top double, selected boolean")


def grades_of(labels: DataFrame) -> DataFrame:
    """Grades from labels (doc_id, quality, toxic): 0 for toxic, 1 for poor, 2 for good ones. Toxic words may add up without
    bound, so the open end of the scale is theirs."""
    return labels.where("quality is not null and toxic is not null").select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade"))


def select(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that are selected, with all columns."""
    model = learn(docs, grades_of(labels))
    wide = docs.mapInArrow(_filtered(docs.sparkSession.sparkContext.broadcast(model), least, docs.columns.index("text")), docs.schema)
    return wide


def _filtered(model, least: float, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.record_batch([pa.array(range(batch.num_rows)), batch.column(text).cast(pa.string())], names=["doc_id", "text"])
            for told in _scored(model, least)(iter([rows])):
                yield batch.filter(told.column(4))

    return run
