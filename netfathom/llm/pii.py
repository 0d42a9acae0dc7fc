"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The patterns (e-mail, ip, card, phone) give the base spans of every whole text. The network is trained in numpy on
labelled spans: windows around the base spans and around other digits of a bounded sample of distinct texts (``SAMPLE``),
three quarters of which have base spans, with copies in which spans are rewritten in other common forms. At prediction, a
document is covered by overlapping windows of ``WINDOW`` characters every ``STEP``. A span counts only if it has the @ or the
digits that its kind needs (``shaped``), so windows without a digit or an @ cannot give any and are not decoded: nothing is
lost by that, but spelled-out addresses are no spans by choice. Nor does the network add spans that no window holds with
both ends inside, which is sure for those of up to ``WINDOW - STEP - 1`` characters. The spans are reconciled over the whole
document: base spans stay, and of the others those decoded by more windows, then more surely, win where spans overlap.

Offsets are code points, ends exclusive. Null texts are empty. Repeated rows are judged alike; texts without digits and @
have no spans; other columns are ignored (``find``) or kept (``redact``). Without any labelled span only patterns apply.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .textblocks import blocks

KINDS = ("email", "ip", "card", "phone")
WINDOW, STEP = 64, 32
SAMPLE = 160
HIDDEN, EMBED = 16, 12
TAGS = 1 + 2 * len(KINDS)  # outside, and begin and inside of each kind
MIN_MARGIN = 0.8
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_HOT = np.zeros(256, bool)
_HOT[[*range(48, 58), 64]] = True

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The patterns' matches, by kind and start; leftmost and not overlapping within a kind. Every pattern is matched in
    time linear in the text, so long runs of its characters do no harm."""
    out: list[Span] = []
    last = seen = 0
    at = text.find("@")
    while at >= 0:
        low = max(last, seen)
        left = at
        while left > low and (text[left - 1].isascii() and text[left - 1].isalnum() or text[left - 1] in "._%+-"):
            left -= 1
        m = _DOMAIN.match(text, at) if left < at else None
        if m:
            out.append((0, left, m.end()))
            last = m.end()
        seen = at + 1
        at = text.find("@", max(seen, last))
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, place = m.group().split("."), m.start()
        ends = np.cumsum([len(p) + 1 for p in parts]) + place - 1
        for k in range(0, len(parts) - 3, 4):
            start = place if k == 0 else int(ends[k - 1]) + 1
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts[k : k + 4]):
                out.append((1, start, int(ends[k + 3])))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def codes(text: str) -> np.ndarray:
    """Character classes that the network reads: ASCII as it is, other letters one class, the rest another; 0 pads."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < 128, np.maximum(points, 1), np.where(points < 0x2000, 128, 129)).astype(np.int64)


CODES = 130


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Embedding, one LSTM each way, emissions and CRF transitions."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(0, 1 / np.sqrt(shape[0]), shape)).astype(np.float32)
        self.p = {"E": draw(CODES, EMBED), "O": draw(2 * HIDDEN, TAGS), "o": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": draw(EMBED + HIDDEN, 4 * HIDDEN), f"b{d}": np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)}

    def _run(self, x: np.ndarray, d: str):
        """Hidden states over time (batch, time, hidden) of one direction, and what its gradient needs."""
        W, bias = self.p[f"W{d}"], self.p[f"b{d}"]
        n, steps = x.shape[:2]
        into = x @ W[:EMBED] + bias
        h = c = np.zeros((n, HIDDEN), np.float32)
        hs, kept = np.zeros((n, steps, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = into[:, t] + h @ W[EMBED:]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            kept.append((t, h, before, i, f, o, g, tc))
            h = o * tc
            hs[:, t] = h
        return hs, kept

    def emissions(self, chars: np.ndarray):
        x = self.p["E"][chars]
        (hf, kf), (hb, kb) = self._run(x, "f"), self._run(x, "b")
        both = np.concatenate([hf, hb], 2)
        return both @ self.p["O"] + self.p["o"], (x, both, kf, kb)

    def _forward(self, e: np.ndarray) -> np.ndarray:
        a = np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for t in range(1, e.shape[1]):
            s = a[:, t - 1][:, :, None] + self.p["T"][None]
            top = s.max(1)
            a[:, t] = e[:, t] + top + np.log(np.exp(s - top[:, None]).sum(1))
        return a

    def marginals(self, e: np.ndarray):
        """log Z, tag marginals, and the sums of pair marginals."""
        T, steps = self.p["T"], e.shape[1]
        a, b = self._forward(e), np.zeros_like(e)
        for t in range(steps - 2, -1, -1):
            s = T[None] + (e[:, t + 1] + b[:, t + 1])[:, None, :]
            top = s.max(2)
            b[:, t] = top + np.log(np.exp(s - top[:, :, None]).sum(2))
        top = a[:, -1].max(1)
        z = top + np.log(np.exp(a[:, -1] - top[:, None]).sum(1))
        p = np.exp(a + b - z[:, None, None])
        pairs = np.zeros_like(T)
        for t in range(1, steps):
            pairs += np.exp(a[:, t - 1][:, :, None] + T[None] + (e[:, t] + b[:, t])[:, None, :] - z[:, None, None]).sum(0)
        return z, p, pairs

    def gradients(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        n, steps = chars.shape
        e, (x, both, kf, kb) = self.emissions(chars)
        z, p, pairs = self.marginals(e)
        rows = np.arange(n)[:, None]
        gold = e[rows, np.arange(steps), tags].sum(1) + self.p["T"][tags[:, :-1], tags[:, 1:]].sum(1)
        de = p.copy()
        de[rows, np.arange(steps), tags] -= 1
        de /= n
        dT = pairs / n
        np.add.at(dT, (tags[:, :-1], tags[:, 1:]), -1 / n)
        g = {"T": dT, "O": np.einsum("nth,ntk->hk", both, de), "o": de.sum((0, 1))}
        dboth = de @ self.p["O"].T
        dx = np.zeros_like(x)
        for d, kept, dh_all in (("f", kf, dboth[:, :, :HIDDEN]), ("b", kb, dboth[:, :, HIDDEN:])):
            W = self.p[f"W{d}"]
            gW, gb = np.zeros_like(W), np.zeros_like(self.p[f"b{d}"])
            dh = dc = np.zeros((n, HIDDEN), np.float32)
            for t, h, before, i, f, o, c_in, tc in reversed(kept):
                dh = dh + dh_all[:, t]
                dc = dc + dh * o * (1 - tc**2)
                dz = np.concatenate([dc * c_in * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - c_in**2)], 1)
                gW[:EMBED] += x[:, t].T @ dz
                gW[EMBED:] += h.T @ dz
                gb += dz.sum(0)
                back = dz @ W.T
                dx[:, t] += back[:, :EMBED]
                dh, dc = back[:, EMBED:], dc * f
            g[f"W{d}"], g[f"b{d}"] = gW, gb
        g["E"] = np.zeros_like(self.p["E"])
        np.add.at(g["E"], chars.ravel(), dx.reshape(-1, EMBED))
        return float((z - gold).mean()), g

    def train(self, chars: np.ndarray, tags: np.ndarray, epochs: int = 12, batch: int = 48, rate: float = 0.025, seed: int = 3) -> float:
        """Adam; returns the last epoch's mean loss."""
        rng, k, loss = np.random.default_rng(seed), 0, []
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            loss, order = [], rng.permutation(len(chars))
            for lo in range(0, len(order), batch):
                k += 1
                value, g = self.gradients(chars[order[lo : lo + batch]], tags[order[lo : lo + batch]])
                loss.append(value)
                norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
                for name, v in g.items():
                    v = v * min(1, 5 / (norm + 1e-9))
                    m1[name] = 0.9 * m1[name] + 0.1 * v
                    m2[name] = 0.99 * m2[name] + 0.01 * v**2
                    step = rate / (1 + epoch / 4) * (m1[name] / (1 - 0.9**k)) / (np.sqrt(m2[name] / (1 - 0.99**k)) + 1e-8)
                    self.p[name] = (self.p[name] - step).astype(np.float32)
        return float(np.mean(loss))

    def decode(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each window, and each tag's marginal probability."""
        e, _ = self.emissions(chars)
        _, p, _ = self.marginals(e)
        T, (n, steps) = self.p["T"], chars.shape
        best, back = e[:, 0], np.zeros((n, steps, TAGS), np.int8)
        for t in range(1, steps):
            s = best[:, :, None] + T[None]
            back[:, t] = s.argmax(1)
            best = s.max(1) + e[:, t]
        tags = np.zeros((n, steps), np.int64)
        tags[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return tags, p[np.arange(n)[:, None], np.arange(steps), tags]


def tags_of(size: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for k, a, b in sorted(spans, reverse=True):  # of overlapping ones the first kind
        out[a:b] = 2 + 2 * k
        out[a] = 1 + 2 * k
    return out


def _rewritten(text: str, spans: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """The text with its spans in other common forms, and where they are now."""
    out, now, last = [], [], 0
    for k, a, b in sorted(spans, key=lambda s: s[1]):
        if a < last:
            continue
        own = "".join(str(rng.integers(10)) if c.isdigit() else c for c in text[a:b])
        form = rng.integers(4)
        if k == 0:
            own = (own, own.upper(), own.replace("@", " @ "), own.replace("@", "@ "))[form]
        if k == 1:
            own = (own, own.replace(".", " . "), own.replace(".", "[.]"), own.replace(".", ". "))[form]
        if k == 2:
            digits = own.replace(" ", "").replace("-", "")
            own = (digits, *(s.join(digits[i : i + 4] for i in range(0, len(digits), 4)) for s in " -"), own)[form]
        if k == 3:
            own = (own, re.sub(r"^\+[0-9]+ ?", "", own), re.sub(r"[()]", "", own).replace(" ", "-"), re.sub(r"[() -]", "", own))[form]
        out += [text[last:a], own]
        start = sum(map(len, out)) - len(own)
        now.append((k, start, start + len(own)))
        last = b
    return "".join([*out, text[last:]]), now


def training_windows(texts: list[str], seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    chars, tags = [], []
    for text in texts:
        spans = base_spans(text)
        others = [m.start() for m in _DIGIT.finditer(text) if not any(a <= m.start() < b for _, a, b in spans)]
        forms = [(text, spans)] + ([_rewritten(text, spans, rng)] if spans else [])
        for own, now in forms:
            c, t = codes(own), tags_of(len(own), now)
            for at in [a for _, a, _ in now[:6]] + [a for a in others[::7][:3] if a < len(c)]:
                for _ in range(2):
                    lo = max(0, at - int(rng.integers(4, WINDOW - 4)))
                    w, g = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
                    part, gold = c[lo : lo + WINDOW], t[lo : lo + WINDOW].copy()
                    w[: len(part)], g[: len(part)] = part, gold
                    chars.append(w)
                    tags.append(g)
    return np.array(chars).reshape(-1, WINDOW), np.array(tags).reshape(-1, WINDOW)


def _decoded(network: Network, texts: list[str], most: int = 512) -> list[list[tuple[int, int, int, int, float]]]:
    """Per text the spans of all its windows with a digit or an @: kind, start, end, windows, mean probability."""
    found: list[dict[Span, list[float]]] = [{} for _ in texts]
    waiting: list[tuple[int, int, np.ndarray]] = []

    def flush() -> None:
        if not waiting:
            return
        tags, sure = network.decode(np.stack([w for _, _, w in waiting]))
        for (doc, lo, w), t, p in zip(waiting, tags, sure):
            inside = np.flatnonzero(t)
            if not len(inside):
                continue
            cuts = np.flatnonzero(np.r_[True, (np.diff(inside) > 1) | (t[inside[1:]] % 2 == 1) | ((t[inside[1:]] - 1) // 2 != (t[inside[:-1]] - 1) // 2)])
            for a, b in zip(inside[cuts], np.r_[inside[cuts[1:] - 1], inside[-1]] + 1):
                at_edge = (a == 0 and lo > 0) or (b == WINDOW)
                if not at_edge and w[b - 1] > 0:
                    found[doc].setdefault((int(t[a] - 1) // 2, lo + int(a), lo + int(b)), []).append(float(p[a:b].mean()))
        waiting.clear()

    for doc, text in enumerate(texts):
        c = codes(text)
        hot = np.flatnonzero((c >= 48) & (c < 58) | (c == 64))
        cells = np.unique(np.concatenate([hot // STEP, np.maximum(0, hot // STEP - 1)]))
        for cell in cells.tolist():
            w = np.zeros(WINDOW, np.int64)
            part = c[cell * STEP : cell * STEP + WINDOW]
            w[: len(part)] = part
            waiting.append((doc, cell * STEP, w))
            if len(waiting) >= most:
                flush()
    flush()
    return [[(*s, len(p), float(np.mean(p))) for s, p in own.items()] for own in found]


def shaped(kind: int, body: str) -> bool:
    """Whether a text can be of a kind at all: each needs an @ or digits."""
    digits = sum(c.isdigit() and c.isascii() for c in body)
    return body.strip() == body and ("@" in body[1:-1], body.count(".") >= 3 and digits >= 4, digits >= 13, 7 <= digits <= 15)[kind]


def reconcile(base: list[Span], found: list[tuple[int, int, int, int, float]], text: str, least: float = MIN_MARGIN) -> list[Span]:
    """The base spans and, of the decoded ones, those that overlap none that stays."""
    taken = sorted((a, b) for _, a, b in base)
    added: list[Span] = []
    for k, a, b, _, p in sorted(found, key=lambda s: (-s[3], -s[4], s[1], s[2], s[0])):
        if p >= least and shaped(k, text[a:b]) and not any(x < b and a < y for x, y in taken):
            added.append((k, a, b))
            taken.append((a, b))
    return sorted([*base, *added])


def _spans_of(column: pa.Array, network: Network | None) -> Iterator[tuple[list[Span], list[Span], str | None]]:
    """Per text: base spans, all spans, and the text if it has any."""
    for block in blocks(column):
        hot = np.diff(np.r_[0, np.cumsum(_HOT[block.data], dtype=np.int64)][block.at]) > 0
        raw = block.data.tobytes()
        texts = {i: raw[block.at[i] : block.at[i + 1]].decode() for i in np.flatnonzero(hot).tolist()}
        found = dict(zip(texts, _decoded(network, list(texts.values())))) if network else {}
        for i in range(block.n):
            if i in texts:
                base = base_spans(texts[i])
                yield base, reconcile(base, found.get(i, []), texts[i]), texts[i]
            else:
                yield [], [], None


def _found(network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_spans_of(batch.column(1), network.value))
            counts = [pa.array([sum(s[0] == k for s in base) for base, _, _ in rows], pa.int64()) for k in range(len(KINDS))]
            sha = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _, _ in rows]
            yield pa.record_batch([batch.column(0), *counts, pa.array(sha, pa.string()), pa.array([joined(s) for _, s, _ in rows], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def _redacted(network, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, new = batch.column(text), []
            for row, (_, spans, body) in enumerate(_spans_of(old.cast(pa.string()), network.value)):
                if not spans:
                    new.append(old[row].as_py())
                    continue
                parts, last = [], 0
                for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if a >= last:
                        parts += [body[last:a], f"[{KINDS[k].upper()}]"]
                    last = max(last, b)
                new.append("".join([*parts, body[last:]]))
            columns = list(batch.columns)
            columns[text] = pa.array(new, old.type)
            yield pa.record_batch(columns, schema=batch.schema)

    return run


def _sampled(labelled: int, others: int):
    """Of (key, text) the least ``labelled`` keys of texts with base spans and the least ``others`` of those without.
    Patterns are matched only while a key can still be among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bool, list[int]] = {True: [], False: []}  # keys, negated, as heaps
        most, seen = {True: labelled, False: others}, {True: set(), False: set()}
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key in seen[True] or key in seen[False] or all(len(kept[c]) >= most[c] and (not most[c] or key > -kept[c][0]) for c in kept):
                    continue
                has = bool(base_spans(text.as_py()))
                if len(kept[has]) < most[has]:
                    heapq.heappush(kept[has], -key)
                elif most[has] and key < -kept[has][0]:
                    seen[has].discard(-heapq.heapreplace(kept[has], -key))
                else:
                    continue
                seen[has].add(key)
        rows = [(-k, has) for has in kept for k in kept[has]]
        yield pa.record_batch([pa.array([k for k, _ in rows], pa.int64()), pa.array([h for _, h in rows], pa.bool_())], names=["_taken", "_has"])

    return run


def training_sample(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """At most ``sample`` distinct texts of no more than 20000 characters, by a hash of the text: a quarter at most has a
    digit or an @ and no base span, the others have base spans."""
    some = docs.select(F.col("text").cast("string").alias("text")).where("text rlike '[0-9@]' and length(text) <= 20000").select(F.xxhash64("text").alias("_key"), "text")
    # keys alone are ordered, so that each task sends its first keys to the driver and not their texts
    others = sample // 4
    keys = cut(some.mapInArrow(_sampled(sample - others, others), "_taken long, _has boolean").distinct())
    taken = keys.where("_has").orderBy("_taken").limit(sample - others).union(keys.where("not _has").orderBy("_taken").limit(others)).select("_taken")
    rows = some.join(F.broadcast(taken), F.col("_key") == F.col("_taken")).dropDuplicates(["_key"]).select("_key", "text").collect()  # ``sample`` rows
    return [r["text"] for r in sorted(rows, key=lambda r: r["_key"])]


def learn(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network for the documents' labelled spans: trained on windows of ``training_sample``."""
    chars, tags = training_windows(training_sample(docs, sample))
    if not tags.any():
        return None
    network = Network()
    network.train(chars, tags)
    return network


def find(docs: DataFrame, network: Network | None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(network)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_found(shared), f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def redact(docs: DataFrame, network: Network | None) -> DataFrame:
    """The documents with each span replaced by its kind in brackets, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    return docs.mapInArrow(_redacted(shared, docs.columns.index("text")), docs.schema)
