"""N-gram Jaccard join that skips by set relations.

Documents are sets of hashed word shingles. Equal sets form a class, and the join runs on classes. Three relations keep it
from looking at all pairs:

* Index lists. A class puts only its prefix into the index: its first shingles by (frequency grade, hash). Each list is
  ordered by set size, and an entry's position bounds the size of any partner (``reach``). Blocks of a list in which no
  entry reaches a partner are skipped unread.
* Signatures. Pairs from short lists are dropped where counts of shingles by hash range show that they share too few;
  so most chance pairs go before any set is sent.
* Computed answers. What is left of a list follows its leader, the smallest set. A member x is compared with the leader
  L once; the difference D(x) = x ^ L holds the answer. For two members, x ^ y = D(x) ^ D(y), so all further answers
  come from the short differences and no full set is looked at again. Members linked with the leader are one component
  and are not compared with each other; only the others are, through an index of the differences.

Groups with too many shingles or members for one task are dealt out by salt. Their members that are not linked with the
leader, in chunks, meet every part: those at up to twice the distance of a link from the leader the whole group, the others
only each other, as the Jaccard distance is a metric.

The frequency sketch and the bitmaps of classes are sized by the data, up to a bound that is safe to broadcast. Beyond it
they tell less apart, which makes lists longer or sends more sets, but an entry of a list follows two leaders at most, so
candidates stay in proportion to the index.

Equality of shingles and sets is that of 64-bit hashes. Null or empty texts and texts without words have no shingles and
are linked with nothing. Repeated rows and ties in size are ordinary members. Other columns of ``docs`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, cut, width
from .textblocks import NONSPACE, U64, blocks, mix, windows

#: Least and most counters of the frequency sketch as powers of two, and bytes of text per counter.
SKETCH_BITS, MOST_SKETCH_BITS, SKETCH_BYTES = 22, 25, 1024
#: Entries of an index list up to which its pairs are told apart; longer lists follow leaders.
SMALL_LIST = 6
#: Least and most places of the bitmap that says which classes have a partner in some list, as powers of two; there are
#: eight places for a class, as far as the most allows.
MEMBER_BITS, MOST_MEMBER_BITS = 22, 28
#: Entries of a block of an index list.
LIST_BLOCK = 64
#: Shingles of a leader's members, and members, that one task holds; larger groups are dealt out.
GROUP_SHINGLES, GROUP_MEMBERS = 2_000_000, 512
#: Leaders of large groups that are broadcast; where there are more they are joined by a shuffle.
LARGE = 1_000_000
#: Classes of which a task remembers that it has sent them already.
SENT = 500_000
_PAGE = 1 << 16


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """Row, sorted distinct shingle hashes, and class (a hash of the set) of each text that has words."""
    for block in blocks(column):
        starts, ends, bounds = block.words(NONSPACE)
        grams, at = windows(block.spans(block.hashed(True), starts, ends), bounds, k)
        for i, row in enumerate(block.rows):
            if at[i] < at[i + 1]:
                own = np.unique(grams[at[i] : at[i + 1]])
                yield row, own, int((mix(own).sum() ^ U64(len(own))).view(np.int64))


def _fresh(sent: set[int], cls: int) -> bool:
    """Whether this task has not sent the class yet; what it forgets is only sent again."""
    if cls in sent:
        return False
    if len(sent) >= SENT:
        sent.clear()
    sent.add(cls)
    return True


def _scan(k: int, bits: int):
    """Each text's class, size and mark, and this task's part of the frequency sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sent = np.zeros(1 << bits, np.uint32), set()
        for batch in batches:
            ids = batch.column(0)
            n, cls = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for row, own, c in shingle_sets(batch.column(1), k):
                n[row], cls[row] = len(own), c
                if _fresh(sent, c):
                    np.add.at(counts, (own >> U64(64 - bits)).astype(np.int64), 1)
            yield pa.record_batch([ids, pa.array(n), pa.array(cls, mask=n == 0), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary()), batch.column(2)], names=["doc_id", "n", "cls", "page", "counts", "mark"])
        pages = [(i, p.astype(np.uint8 if p.max() < 256 else np.uint32)) for i, p in enumerate(counts.reshape(-1, _PAGE)) if p.any()]
        none = pa.nulls(len(pages), pa.int64())
        yield pa.record_batch([none, none, none, pa.array([i for i, _ in pages], pa.int32()), pa.array([b"%d" % p.itemsize + pa.compress(p.tobytes(), "zstd", asbytes=True) for _, p in pages], pa.binary()), none], names=["doc_id", "n", "cls", "page", "counts", "mark"])

    return run


def _counts(blob: bytes) -> np.ndarray:
    kind = np.uint8 if blob[:1] == b"1" else np.uint32
    return np.frombuffer(pa.decompress(blob[1:], _PAGE * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def _add_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for page, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            total.setdefault(page, np.zeros(_PAGE, np.uint64))
            total[page] += _counts(blob.as_py())
    grades = [np.minimum(255, 4 * np.log2(1.0 + v)).astype(np.uint8).tobytes() for v in total.values()]
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(grades, pa.binary())], names=["page", "grades"])


def _entries(k: int, percent: int, bits: int, grades):
    """The index entries of each class: prefix shingle, class, set size, position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            out: list[tuple[np.ndarray, int, int]] = []
            for _, own, c in shingle_sets(batch.column(0), k):
                if _fresh(sent, c):
                    size = len(own)
                    grade = grades.value[(own >> U64(64 - bits)).astype(np.int64)].astype(U64)
                    order = np.argsort((grade << U64(56)) | (own >> U64(8)), kind="stable")
                    out.append((own[order[: size + (-percent * size // 100) + 1]], c, size))
            if out:
                lens = np.array([len(h) for h, _, _ in out])
                pos = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
                yield pa.record_batch([pa.array(np.concatenate([h for h, _, _ in out]).view(np.int64)), pa.array(np.repeat([c for _, c, _ in out], lens)), pa.array(np.repeat([s for _, _, s in out], lens).astype(np.int32)), pa.array(pos.astype(np.int32))], names=["h", "cls", "n", "pos"])

    return run


def _small_lists(h, cls, n, reach, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one batch in the order (h, n, cls): which entries stand in lists of up to ``SMALL_LIST`` that begin and end in
    the batch, and the pairs (i, j) of these lists whose sizes and positions allow a link."""
    cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    length = np.diff(np.r_[cuts, len(h)])
    small = length <= SMALL_LIST
    small[[0, -1]] = False
    of = np.repeat(np.arange(len(cuts)), length)
    inside = small[of]
    left, right = [], []
    for d in range(1, SMALL_LIST):
        i = np.flatnonzero(inside[:-d] & (of[:-d] == of[d:])) if len(h) > d else cuts[:0]
        j = i + d
        fits = (percent * n[j] <= 100 * n[i]) & (n[j] <= reach[i]) & (n[i] <= reach[j])
        left.append(i[fits])
        right.append(j[fits])
    return inside, np.concatenate(left), np.concatenate(right)


_FOLLOW = "leader long, leader_n int, cls long, n int, grouped boolean"


def _follow_rows(rows: list[tuple], grouped: bool) -> pa.RecordBatch:
    lead, lead_n, own, n = zip(*rows) if rows else ((), (), (), ())
    return pa.record_batch([pa.array(lead, pa.int64()), pa.array(lead_n, pa.int32()), pa.array(own, pa.int64()), pa.array(n, pa.int32()), pa.array([grouped] * len(rows), pa.bool_())], names=[x.split()[0] for x in _FOLLOW.split(", ")])


def _followers(percent: int):
    """From entries in the order (h, n, cls): pairs of small lists (leader: the smaller set), and each entry of larger
    lists that may have a partner with the leaders it follows.

    Streams: of a larger list it keeps the leaders of the last two segments and the widest reach so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last, widest = None, None, -1
        segs: list[list] = []  # [leader, its size, size limit, largest size]
        for batch in batches:
            h, cls, n, pos = (batch.column(i).to_numpy() for i in range(4))
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])
            h, cls, n, pos = h[fresh], cls[fresh], n[fresh].astype(np.int64), pos[fresh]
            if not len(h):
                continue
            reach = (n - pos) * (100 + percent) // percent - n
            inside, i, j = _small_lists(h, cls, n, reach, percent)
            yield _follow_rows(list({*zip(cls[i].tolist(), n[i].tolist(), cls[j].tolist(), n[j].tolist())}), False)
            h, cls, n, reach = h[~inside], cls[~inside], n[~inside], reach[~inside]
            rows: list[tuple[int, int, int, int]] = []
            cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else h
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)]):
                if h[a] != here:
                    here, last, widest, segs = h[a], None, -1, []
                for lo in range(a, b, LIST_BLOCK):
                    hi = min(b, lo + LIST_BLOCK)
                    if widest < n[lo] and reach[lo:hi].max() < n[lo]:
                        continue  # no entry of the block reaches, or is reached by, a partner
                    for e in range(lo, hi):
                        c, size, r = int(cls[e]), int(n[e]), int(reach[e])
                        if c == last or widest < size and r < size:
                            continue
                        last, widest = c, max(widest, r)
                        if segs and size <= segs[-1][2]:
                            segs[-1][3] = size
                        else:
                            segs = [*segs[-1:], [c, size, size * 100 // percent, size]]
                        rows += [(lead, lead_n, c, size) for lead, lead_n, _, top in segs if lead != c and percent * size <= 100 * top]
            yield _follow_rows(list(set(rows)), True)

    return run


def _signatures(k: int, places):
    """Of each marked class how many shingles fall into each of about as many ranges of the hash as it has shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            rows = []
            for _, own, c in shingle_sets(batch.column(0), k):
                if _marked(places.value, c) and _fresh(sent, c):
                    bits = max(3, (len(own) - 1).bit_length())
                    counts = np.bincount((own >> U64(64 - bits)).astype(np.int64), minlength=1 << bits)
                    rows.append((c, counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""))
            if rows:
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["cls", "signature"])

    return run


def most_shared(a: bytes, b: bytes) -> int:
    """An upper bound of two sets' intersection from their signatures."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 1 << 62
    return int(np.minimum(x, y.reshape(len(x), -1).sum(1)).sum())


def _close(percent: int):
    """The pairs whose signatures allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r[:4] for r in zip(*(batch.column(i).to_pylist() for i in range(6))) if (100 + percent) * most_shared(r[4], r[5]) >= percent * (r[1] + r[3])]
            yield _follow_rows(rows, False)

    return run


def _sets(k: int, places):
    """The sets of the classes that follow some leader (and of a few others that share a place in the bitmap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            own_cls, own_set = [], []
            for _, own, c in shingle_sets(batch.column(0), k):
                if _marked(places.value, c) and _fresh(sent, c):
                    own_cls.append(c)
                    own_set.append(own.tobytes())
            if own_cls:
                yield pa.record_batch([pa.array(own_cls, pa.int64()), pa.array(own_set, pa.binary())], names=["cls", "items"])

    return run


class _Group:
    """Members of one leader, or of one part: what each has in D(x) and how to find those that share it."""

    def __init__(self, percent: int):
        self.percent, self.cls, self.n, self.diff = percent, [], [], []

    def add(self, cls: int, n: int, diff: np.ndarray) -> None:
        self.cls.append(cls)
        self.n.append(n)
        self.diff.append(diff)

    def links(self, asking: list[int]) -> Iterator[tuple[int, int]]:
        """A spanning set of the links between the asking members and all members."""
        if not asking or len(self.cls) < 2:
            return
        n, m = np.array(self.n), np.array([len(d) for d in self.diff])
        items, inv = np.unique(np.concatenate(self.diff), return_inverse=True)
        row = np.repeat(np.arange(len(m)), m)
        order = np.argsort(inv, kind="stable")
        posting, at = row[order], np.searchsorted(inv[order], np.arange(len(items) + 1))
        first = np.cumsum(m) - m
        root = list(range(len(m)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i in asking:
            mine = inv[first[i] : first[i] + m[i]]
            lens = at[mine + 1] - at[mine]
            flat = np.repeat(at[mine] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
            apart = m[i] + m - 2 * np.bincount(posting[flat], minlength=len(m))
            for j in np.flatnonzero((100 + self.percent) * apart <= (100 - self.percent) * (n[i] + n)).tolist():
                a, b = find(i), find(j)
                if a != b:
                    root[a] = b
                    yield self.cls[i], self.cls[j]


_LINKS = "a long, b long, leader long, part int, parts int, cls long, n long, linked boolean, near boolean, diff binary"


def _answers(percent: int):
    """From rows in the order (leader, part, leader first): links of groups in one part; members of other groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lead, lead_n, group, asking = None, None, 0, None, []
        for batch in batches:
            links, apart = [], []
            for leader, part, parts, cls, n, items in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5)):
                if (leader, part) != key:
                    if group:
                        links += group.links(asking)
                    key, lead, lead_n, group, asking = (leader, part), np.frombuffer(items.as_py(), U64), n, _Group(percent), []
                    diff = lead[:0]
                else:
                    own = np.frombuffer(items.as_py(), U64)
                    diff = np.setxor1d(own, lead, assume_unique=True)
                linked = (100 + percent) * len(diff) <= (100 - percent) * (n + lead_n)
                if linked and cls != leader:
                    links.append((leader, cls))
                if parts > 1:
                    if cls != leader or part == 0:
                        near = 100 * len(diff) <= (100 - percent) * (n + lead_n + len(diff))  # 2 |D| / (|x| + |L| + |D|) is the distance
                        apart.append((leader, part, parts, cls, n, linked, near, diff.tobytes()))
                else:
                    group.add(cls, n, diff)
                    if not linked:
                        asking.append(len(group.cls) - 1)
            yield _told(links, apart)
        if group:
            yield _told(list(group.links(asking)), [])

    return run


def _told(links: list, apart: list) -> pa.RecordBatch:
    rows = [(*x, *[None] * 8) for x in links] + [(None, None, *x) for x in apart]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in _LINKS.split(", ")])


def _parts(percent: int):
    """From rows in the order (leader, part, linked, chunk): links between the asking members of one chunk and those of one
    part, either the linked ones or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, asking = None, None, []
        for batch in batches:
            links: list = []
            for leader, part, side, chunk, cls, n, asks, diff in zip(*(batch.column(i).to_pylist() for i in range(7)), batch.column(7)):
                if (leader, part, side, chunk) != key:
                    if group:
                        links += group.links(asking)
                    key, group, asking = (leader, part, side, chunk), _Group(percent), []
                group.add(cls, n, np.frombuffer(diff.as_py(), U64))
                if asks:
                    asking.append(len(group.cls) - 1)
            if links:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])
        if group and (links := list(group.links(asking))):
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])

    return run


class _Places:
    def __init__(self, bits: int):
        self.bits, self.taken = bits, np.zeros(1 << bits >> 3, np.uint8)


def _marked(places: _Places, cls: int) -> bool:
    at = cls & ((1 << places.bits) - 1)
    return bool(places.taken[at >> 3] >> (at & 7) & 1)


def _page_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (page, at): the bitmap of each page."""
    taken: dict[int, np.ndarray] = {}
    for batch in batches:
        page, at = (batch.column(i).to_numpy() for i in range(2))
        for p in np.unique(page).tolist():
            taken.setdefault(p, np.zeros(_PAGE, np.uint8))[at[page == p]] = 1
    yield pa.record_batch([pa.array(list(taken), pa.int32()), pa.array([np.packbits(v, bitorder="little").tobytes() for v in taken.values()], pa.binary())], names=["page", "bits"])


def _places(classes: DataFrame):
    """A broadcast bitmap that marks the classes."""
    spark = classes.sparkSession
    many = classes.agg(F.count("*")).first()[0]
    places = _Places(min(MOST_MEMBER_BITS, max(MEMBER_BITS, (8 * many).bit_length())))
    slot = F.col(classes.columns[0]).bitwiseAND((1 << places.bits) - 1)
    own = classes.select(F.shiftright(slot, 16).cast("int").alias("page"), slot.bitwiseAND(_PAGE - 1).cast("int").alias("at")).distinct()
    for page, bits in own.repartition(width(spark), "page").mapInArrow(_page_bits, "page int, bits binary").collect():  # at most 2 ** MOST_MEMBER_BITS bits
        places.taken[page * (_PAGE >> 3) : (page + 1) * (_PAGE >> 3)] = np.frombuffer(bits, np.uint8)
    return spark.sparkContext.broadcast(places)


def _with_parts(follow: DataFrame, group_shingles: int, group_members: int) -> DataFrame:
    """Adds ``parts``, more than one for leaders of large groups, which are joined on by broadcast if they are few."""
    share = F.greatest(F.sum("n") / group_shingles, F.count("*") / group_members)
    large = cut(follow.groupBy("leader").agg(F.ceil(share).cast("int").alias("parts")).where("parts > 1"))
    return follow.join(F.broadcast(large) if large.limit(LARGE + 1).count() <= LARGE else large, "leader", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))


def _classes(docs: DataFrame, k: int = 5, percent: int = 80, sketch_bits: int | None = None, group_shingles: int = GROUP_SHINGLES, group_members: int = GROUP_MEMBERS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n, cls) per row of ``docs``, where mark is a hash of the text, and (cls, root, component_id) per
    class."""
    spark = docs.sparkSession
    text = docs.select(F.col("text").cast("string").alias("text"))
    if sketch_bits is None:
        size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        sketch_bits = min(MOST_SKETCH_BITS, max(SKETCH_BITS, (size // SKETCH_BYTES).bit_length()))
    scan = cut(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("mark")).mapInArrow(_scan(k, sketch_bits), "doc_id long, n long, cls long, page int, counts binary, mark long"))
    pages = scan.where("page is not null").select("page", "counts").repartition(width(spark), "page").mapInArrow(_add_pages, "page int, grades binary")
    grades = np.zeros(1 << sketch_bits, np.uint8)
    for page, own in pages.collect():  # at most 2 ** sketch_bits bytes
        grades[page * _PAGE : (page + 1) * _PAGE] = np.frombuffer(own, np.uint8)
    grades = spark.sparkContext.broadcast(grades)

    lists = text.mapInArrow(_entries(k, percent, sketch_bits, grades), "h long, cls long, n int, pos int").repartition(width(spark), "h").sortWithinPartitions("h", "n", "cls")
    follow = lists.mapInArrow(_followers(percent), _FOLLOW)
    follow = cut(follow.groupBy("leader", "leader_n", "cls", "n").agg(F.max("grouped").alias("grouped")))
    pairs = follow.where("not grouped")
    marked = _places(pairs.select("leader").union(pairs.select("cls")))
    signatures = cut(text.mapInArrow(_signatures(k, marked), "cls long, signature binary").dropDuplicates(["cls"]))
    pairs = pairs.join(signatures.withColumnRenamed("signature", "own"), "cls").join(signatures.select(F.col("cls").alias("leader"), "signature"), "leader")
    close = pairs.select("leader", "leader_n", "cls", "n", "own", "signature").mapInArrow(_close(percent), _FOLLOW)
    follow = follow.where("grouped").union(close).drop("grouped")
    follow = cut(follow.select("leader", "cls", "n").union(follow.select("leader", F.col("leader").alias("cls"), F.col("leader_n").alias("n")).distinct()))
    places = _places(follow.select("cls"))

    dealt = _with_parts(follow, group_shingles, group_members)
    own = F.array(F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("cls") == F.col("leader"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)))
    sets = text.mapInArrow(_sets(k, places), "cls long, items binary").dropDuplicates(["cls"])
    asked = dealt.join(sets, "cls").select("leader", "part", "parts", "cls", F.col("n").cast("long").alias("n"), "items")
    asked = asked.repartition(width(spark), "leader", "part").sortWithinPartitions("leader", "part", F.col("cls") != F.col("leader"))
    told = cut(asked.mapInArrow(_answers(percent), _LINKS))

    edges = told.where("a is not null").select("a", "b")
    apart = told.where("leader is not null")
    parts = F.sequence(F.lit(0), F.col("parts") - 1)
    unlinked = apart.where("not linked")
    chunks = unlinked.groupBy("leader").agg(F.ceil(F.greatest(F.sum("n") / group_shingles, F.count("*") / group_members)).cast("int").alias("chunks"))
    few = cut(chunks)
    few = F.broadcast(few) if few.limit(LARGE + 1).count() <= LARGE else few
    sides = F.explode(F.when(F.col("near"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))))
    asking = unlinked.join(few, "leader").select("leader", F.explode(parts).alias("part"), "near", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int").alias("chunk"), "cls", "n", "diff")
    asking = asking.select("leader", "part", sides.alias("linked"), "chunk", "cls", "n", F.lit(True).alias("asks"), "diff")
    members = apart.join(few, "leader").select("leader", "part", "linked", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "cls", "n", F.lit(False).alias("asks"), "diff")
    grid = asking.union(members).repartition(width(spark), "leader", "part", "linked", "chunk").sortWithinPartitions("leader", "part", "linked", "chunk")
    edges = edges.union(grid.mapInArrow(_parts(percent), "a long, b long"))

    roots = components(edges)
    sized = scan.where("page is null").select("doc_id", "mark", "n", "cls")
    least = sized.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"))
    named = least.join(roots, least["cls"] == roots["node"], "left").select("cls", "first", F.coalesce("root", "cls").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("cls", "root", "component_id")
    return sized, named


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, sketch_bits: int | None = None, group_shingles: int = GROUP_SHINGLES, group_members: int = GROUP_MEMBERS) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text).

    Two documents are linked when 100 * |intersection| >= percent * |union| of their distinct k-word shingles (A-Z
    lower-cased; fewer words make one shingle). component_id is the smallest doc_id reachable by links.
    """
    sized, named = _classes(docs, k, percent, sketch_bits, group_shingles, group_members)
    return sized.join(named, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all columns: that of the least (doc_id, hash of the text), ids that are null last.
    Of rows with the same id and text one stays; texts without shingles are copies of nothing, and all of them stay."""
    sized, named = _classes(docs, k, percent)
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    rows = cut(sized.where("cls is not null").join(named, "cls").groupBy("root", "doc_id", "mark").agg(F.count("*").alias("rows")))
    chosen = rows.groupBy("root").agg(F.min(F.struct(*[one.alias("one"), F.col("rows")])).alias("c")).select("c.one.doc_id", "c.one.mark", "c.rows")
    least = rows.join(chosen.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_m")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_m")), "left")
    others = least.where("_m is null").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_m"))
    marked = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_mark"))  # so no name clashes
    met = lambda keys: marked["_doc"].eqNullSafe(keys["_id"]) & (marked["_mark"] == keys["_m"])
    repeated = chosen.where("rows > 1").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_m"))
    single = marked.join(others.union(repeated), met(others), "left_anti").select("_row.*")
    if repeated.isEmpty():
        return single
    again = marked.join(repeated, met(repeated), "left_semi").dropDuplicates(["_doc", "_mark"]).select("_row.*")
    return single.union(again)
