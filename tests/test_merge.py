"""The adaptive merge against a plain walk over dictionaries."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from netfathom.functions import hexgrid
from netfathom.operators import merge

SEVERITY = {"LTE": 0, "ROUTE_LOSS": 4}


def parent_of(cell):
    signed = lambda v: v - (1 << 28) if v >= 1 << 27 else v
    res, q, r = cell >> 56 & 15, signed(cell >> 28 & (1 << 28) - 1), signed(cell & (1 << 28) - 1)
    dq, dr = hexgrid.CENTRE[(q + 3 * r) % 7]
    a, b = (2 * (q - dq) - (r - dr)) // 7, ((q - dq) + 3 * (r - dr)) // 7
    return hexgrid.TAG + (res - 1 << 56) + (a % (1 << 28) << 28) + b % (1 << 28)


def outcome(b):
    return "ROUTE_LOSS" if b["ok"] < 0.8 * b["ms"] else "LTE"


def interval(b):
    n = math.floor(b["ms"] ** 2 / b["sq"])
    p, z = b["ok"] / b["ms"], 1.96
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return max(0, mid - half), min(1, mid + half)


def add(bins):
    return {k: sum(b[k] for b in bins) for k in ("n", "ms", "sq", "ok", "units")} | {"who": set().union(*(b["who"] for b in bins))}


def walk(leaves, k, n, least):
    now, out = {c: b for c, b in leaves.items() if c[0] >> 56 & 15 == 10}, {}
    for res in range(10, 6, -1):
        groups, up = defaultdict(list), defaultdict(list)
        for (cell, plmn), b in now.items():
            groups[parent_of(cell)].append(((cell, plmn), b))
        for parent, kids in groups.items():
            whole = add([b for _, b in kids])
            ivs = [interval(b) for _, b in kids]
            if whole["units"] / 7 ** (11 - res) < least or len({c[1] for c, _ in kids}) > 1:
                rises = False
            elif any(len(b["who"]) < k or b["n"] < n for _, b in kids):
                rises = True
            else:
                same, meet = len({outcome(b) for _, b in kids}) == 1, max(i[0] for i in ivs) <= min(i[1] for i in ivs)
                rises = same and meet and not any(SEVERITY[outcome(b)] > SEVERITY[outcome(whole)] for _, b in kids)
            if rises:
                up[parent, kids[0][0][1]].append(whole)
            else:
                out |= dict(kids)
        for c, b in leaves.items():
            if c[0] >> 56 & 15 == res - 1:
                up[c].append(b)
        now = {c: add(bs) | {"units": min(sum(b["units"] for b in bs), 7 ** (11 - res))} for c, bs in up.items()}
    return out | now


def test_merge_against_a_plain_walk(spark):
    rnd = random.Random(8)
    leaves = {}
    for res, reach, count in ((10, 14, 260), (9, 5, 20), (8, 2, 4)):
        for _ in range(count):
            q, r = rnd.randint(-reach, reach), rnd.randint(-reach, reach)
            cell = hexgrid.TAG + (res << 56) + (q % (1 << 28) << 28) + r % (1 << 28)
            w = [rnd.randint(1000, 9000) for _ in range(rnd.randint(1, 12))]
            good = sum(x for x in w if rnd.random() < (0.95 if q < 3 else 0.6))
            plmn = "b" if q == r == 4 else "a"
            leaves[cell, plmn] = {"n": len(w), "ms": sum(w), "sq": sum(x * x for x in w), "ok": good, "units": 7 ** (10 - res), "who": set(rnd.sample("uvwxyz", rnd.randint(1, 5)))}
    rows = spark.createDataFrame([(*c, b["n"], b["ms"], b["sq"], b["ok"]) for c, b in leaves.items()], "cell long, plmn string, n long, ms long, ms_sq long, validated_ms long")
    people = spark.createDataFrame([(*c, d) for c, b in leaves.items() for d in b["who"]], "cell long, plmn string, device string")
    told = lambda b: b.withColumn("outcome", F.when(F.col("validated_ms") < 0.8 * F.col("ms"), "ROUTE_LOSS").otherwise("LTE"))
    got = {(r["cell"], r["plmn"]): (r["n"], r["ms"], r["outcome"]) for r in merge.adaptive_merge(rows, people, told, k=2, n=3).collect()}
    want = {c: (b["n"], b["ms"], outcome(b)) for c, b in walk(leaves, 2, 3, merge.MIN_COVERAGE).items()}
    assert got == want
    assert sum(v[0] for v in got.values()) == sum(b["n"] for b in leaves.values())


def p90(values):
    return sorted(values)[math.floor((len(values) - 1) * 0.9 + 0.5)] if values else None


def judged(b):
    if len(b["oks"]) >= 3 and p90(b["oks"]) > 1500:
        return "SLOW"
    return "ROUTE_LOSS" if b["ok"] < 0.8 * b["ms"] else "LTE"


def united(bins):
    """Bins as one, with all they hold."""
    out = add(bins) | {"leaves": sum(b["leaves"] for b in bins), "oks": [x for b in bins for x in b["oks"]], "first": min(b["first"] for b in bins), "last": max(b["last"] for b in bins)}
    out["sub"] = max(bins, key=lambda b: (b["ms"], b["n"], -b["sub"]))["sub"]
    times = defaultdict(int)
    for b in bins:
        if b["cause"]:
            times[b["cause"]] += b["ms"]
    out["cause"] = min(times, key=lambda k: (-times[k], k)) if times else 0
    out["share"] = times[out["cause"]] / out["ms"] if times else 0.0
    out["rsrp"] = defaultdict(int)
    for b in bins:
        for v, w in b["rsrp"].items():
            out["rsrp"][v] += w
    return out


def full_walk(leaves, k, n, least):
    there, folded = set(leaves), defaultdict(list)
    for (cell, plmn), b in leaves.items():
        host, up = cell, cell
        while up >> 56 & 15 > 6:
            up = parent_of(up)
            host = up if (up, plmn) in there else host
        folded[host, plmn].append(b)
    room = lambda c: 7 ** (10 - (c >> 56 & 15))
    native = {c: united(bs) | {"units": min(sum(b["units"] for b in bs), room(c[0]))} for c, bs in folded.items()}
    now, out = {c: b for c, b in native.items() if c[0] >> 56 & 15 == 10}, {}
    rank = {"LTE": 0, "SLOW": 3, "ROUTE_LOSS": 4}
    for res in range(10, 6, -1):
        groups, up = defaultdict(list), defaultdict(list)
        for (cell, plmn), b in now.items():
            groups[parent_of(cell)].append(((cell, plmn), b))
        for parent, kids in groups.items():
            whole, ivs = united([b for _, b in kids]), [interval(b) for _, b in kids]
            if whole["units"] / 7 ** (11 - res) < least or len({c[1] for c, _ in kids}) > 1:
                rises = False
            elif any(len(b["who"]) < k or b["n"] < n for _, b in kids):
                rises = True
            else:
                rises = len({judged(b) for _, b in kids}) == 1 and max(i[0] for i in ivs) <= min(i[1] for i in ivs) and not any(rank[judged(b)] > rank[judged(whole)] for _, b in kids)
            if rises:
                up[parent, kids[0][0][1]].append(whole)
            else:
                out |= dict(kids)
        for c, b in native.items():
            if c[0] >> 56 & 15 == res - 1:
                up[c].append(b)
        now = {c: united(bs) | {"units": min(sum(b["units"] for b in bs), 7 ** (11 - res))} for c, bs in up.items()}
    return out | now


def test_the_whole_accumulator_against_a_plain_walk(spark):
    rnd = random.Random(12)
    leaves, rows, sides = {}, [], []
    for res, reach, count in ((10, 14, 300), (9, 5, 14), (8, 2, 3)):
        for _ in range(count):
            q, r = rnd.randint(-reach, reach), rnd.randint(-reach, reach)
            cell = hexgrid.TAG + (res << 56) + (q % (1 << 28) << 28) + r % (1 << 28)
            plmn = "b" if q == 4 or res == 8 else "a"
            if (cell, plmn) in leaves:
                continue
            w = [rnd.randint(1000, 9000) for _ in range(rnd.randint(2, 12))]
            slow = q < -4
            leaves[cell, plmn] = {
                "n": len(w), "ms": sum(w), "sq": sum(x * x for x in w), "ok": sum(x for x in w if rnd.random() < (0.95 if q < 3 else 0.6)), "units": 7 ** (10 - res), "who": set(rnd.sample("uvwxyz", rnd.randint(2, 5))), "leaves": 1,
                "oks": [rnd.choice([100, 200, 4000 if slow else 300]) for _ in range(rnd.randint(0, 4))], "first": rnd.randrange(100), "last": rnd.randrange(100, 200), "sub": rnd.randrange(3), "cause": rnd.choice([0, 0, 1, 5, 6]), "rsrp": {rnd.randrange(-120, -80): x for x in w},
            }
    for (cell, plmn), b in leaves.items():
        rows.append((cell, plmn, b["n"], b["ms"], b["sq"], b["ok"], b["sub"], b["first"], b["last"], b["cause"]))
        values = [("member", d, 1) for d in b["who"]] + [("latency", str(x), 1) for x in b["oks"]] + [("rsrp", str(v), x) for v, x in b["rsrp"].items()] + [("rat", "LTE", b["ms"]), ("band", "B3", 1), ("serving", f"c{cell % 5}", 1)]
        sides += [(cell, plmn, *x) for x in values]
    frame = spark.createDataFrame(rows, "cell long, plmn string, n long, ms long, ms_sq long, validated_ms long, sub_id int, first_ms long, last_ms long, cause int")
    side = spark.createDataFrame(sides, "cell long, plmn string, measure string, value string, weight long").groupBy("cell", "plmn", "measure", "value").agg(F.sum("weight").alias("weight"))

    def outcome(b, s):
        slow = (F.col("ok_n") >= 3) & (F.col("p90_ms") > 1500)
        return merge.latencies_of(b, s).withColumn("outcome", F.when(slow, "SLOW").when(F.col("validated_ms") < 0.8 * F.col("ms"), "ROUTE_LOSS").otherwise("LTE"))

    published, kept = merge.merge_walk(frame, side, outcome, k=3, n=4)
    got = {(r["cell"], r["plmn"]): (r["n"], r["ms"], r["units"], r["leaf_count"], r["sub_id"], r["first_ms"], r["last_ms"], r["cause"], round(r["cause_share"], 9), r["outcome"], r["contributors"], r["ok_n"] or 0, r["p90_ms"], r["rsrp_p50"]) for r in merge.described(published, kept).collect()}
    want = {}
    for c, b in full_walk(leaves, 3, 4, merge.MIN_COVERAGE).items():
        run, half = 0, sum(b["rsrp"].values()) / 2
        for v in sorted(b["rsrp"]):
            run += b["rsrp"][v]
            if run >= half:
                break
        want[c] = (b["n"], b["ms"], b["units"], b["leaves"], b["sub"], b["first"], b["last"], b["cause"], round(b.get("share", 1.0 if b["cause"] else 0.0), 9), judged(b), len(b["who"]), len(b["oks"]), p90(b["oks"]), v)
    assert got == want
    assert len({c[0] >> 56 & 15 for c in got}) >= 3 and len({x[9] for x in got.values()}) == 3
