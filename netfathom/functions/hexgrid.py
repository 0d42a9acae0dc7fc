"""A hexagonal grid on the Mercator plane with resolutions 10 (finest) to 6, as column expressions.

A cell id is one 64-bit integer: a tag of four bits, four of the resolution, and two signed 28-bit lattice coordinates.
Each coarser level's lattice is spanned by 3a + b and -a + 2b of the finer one's basis (a, b), so seven cells make a parent.
Null coordinates give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
FINEST, COARSEST = 10, 6
EDGE_M = 65.9
EARTH_M = 6378137.0
TAG = -6917529027641081856
ROTATION = -0.333473172
#: What to take off (q, r) to reach the centre child, by (q + 3r) mod 7.
CENTRE = [(0, 0), (1, 0), (-1, 1), (0, 1), (0, -1), (1, -1), (-1, 0)]
NEIGHBOURS = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)]

MASK = (1 << 28) - 1


def basis(res: int) -> tuple[float, float, float, float]:
    """The lattice basis of a resolution as (ax, bx, ay, by)."""
    ax, bx, ay, by = EDGE_M * math.sqrt(3.0), EDGE_M * math.sqrt(3.0) / 2.0, 0.0, EDGE_M * 1.5
    for _ in range(FINEST - res):
        ax, bx, ay, by = 3 * ax - bx, ax + 2 * bx, 3 * ay - by, ay + 2 * by
    return ax, bx, ay, by


def _of_res(res, value) -> Column:
    """A value that depends on a resolution given as a number or a column."""
    if isinstance(res, int):
        return F.lit(value(res))
    out = F.lit(None)
    for r in range(COARSEST, FINEST + 1):
        out = F.when(res == r, F.lit(value(r))).otherwise(out)
    return out


def edge_m(res) -> Column:
    return _of_res(res, lambda r: EDGE_M * 7.0 ** ((FINEST - r) / 2.0))


def encode(res, q: Column, r: Column) -> Column:
    head = F.lit(TAG) if not isinstance(res, int) else F.lit(TAG + (res << 56))
    if not isinstance(res, int):
        head = head.bitwiseOR(F.shiftleft(res.cast("long"), 56))
    return head.bitwiseOR(F.shiftleft(q.cast("long").bitwiseAND(F.lit(MASK).cast("long")), 28)).bitwiseOR(r.cast("long").bitwiseAND(F.lit(MASK).cast("long")))


def _signed(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(MASK).cast("long"))
    return F.when(v >= 1 << 27, v - (1 << 28)).otherwise(v)


def res_of(cell: Column) -> Column:
    return F.shiftrightunsigned(cell, 56).bitwiseAND(15).cast("int")


def q_of(cell: Column) -> Column:
    return _signed(F.shiftrightunsigned(cell, 28))


def r_of(cell: Column) -> Column:
    return _signed(cell)


def label(cell: Column) -> Column:
    return F.concat(F.lit("h"), res_of(cell), F.lit(":"), q_of(cell), F.lit(":"), r_of(cell))


def _nearest(x: Column) -> Column:
    return F.floor(x + 0.5)


def lattice(lat: Column, lng: Column, res) -> tuple[Column, Column]:
    """A point's lattice coordinates (q, r), not rounded."""
    x = F.radians(lng) * EARTH_M
    phi = F.radians(F.greatest(F.lit(-85.05), F.least(F.lit(85.05), lat)))
    y = F.ln(F.tan(phi / 2 + math.pi / 4)) * EARTH_M
    ax, bx, ay, by = (_of_res(res, lambda r, i=i: basis(r)[i]) for i in range(4))
    det = ax * by - bx * ay
    return (by * x - bx * y) / det, (ax * y - ay * x) / det


def cell_at(qf: Column, rf: Column, res) -> Column:
    """The cell whose centre is nearest to lattice coordinates."""
    sf = -qf - rf
    q, s, r = _nearest(qf), _nearest(sf), _nearest(rf)
    dq, ds, dr = F.abs(q - qf), F.abs(s - sf), F.abs(r - rf)
    move_q = (dq > ds) & (dq > dr)
    return encode(res, F.when(move_q, -s - r).otherwise(q), F.when(move_q | (ds > dr), r).otherwise(-q - s))


def cell_of(lat: Column, lng: Column, res) -> Column:
    """The cell that holds a point. For a column that later steps name often, ``with_cell`` keeps plans smaller."""
    return cell_at(*lattice(lat, lng, res), res)


def with_cell(df, name: str, lat: Column, lng: Column, res):
    """``df`` with the cell of each point; the lattice coordinates are columns of their own on the way, worked out once."""
    q, r = lattice(lat, lng, res)
    return df.withColumns({"_q": q, "_r": r}).withColumn(name, cell_at(F.col("_q"), F.col("_r"), res)).drop("_q", "_r")


def _once(value: Column, f) -> Column:
    """f(value) with the value worked out once: as a plain expression it would be copied wherever f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _up(level: int):
    """The parent of a cell of that resolution; other cells stay."""

    def step(c: Column) -> Column:
        k = F.pmod(q_of(c) + 3 * r_of(c), F.lit(7))
        off = lambda i: F.get(F.array(*[F.lit(x[i]) for x in CENTRE]), k.cast("int"))
        q, r = q_of(c) - off(0), r_of(c) - off(1)
        return F.when(res_of(c) == level, encode(level - 1, ((2 * q - r) / 7).cast("long"), ((q + 3 * r) / 7).cast("long"))).otherwise(c)

    return step


def parent_from(cell: Column, level: int) -> Column:
    """The parent of a cell of resolution ``level``; the cell itself where it is of another."""
    return _once(cell, _up(level))


def parent(cell: Column, res: int) -> Column:
    """The cell's ancestor at a resolution; the cell itself where it is as coarse or coarser."""
    for level in range(FINEST, res, -1):
        cell = parent_from(cell, level)
    return cell


def neighbours(cell: Column) -> Column:
    return F.array(*[encode(res_of(cell), q_of(cell) + a, r_of(cell) + b) for a, b in NEIGHBOURS])


def _plane(cell: Column) -> tuple[Column, Column]:
    ax, bx, ay, by = (_of_res(res_of(cell), lambda r, i=i: basis(r)[i]) for i in range(4))
    return ax * q_of(cell) + bx * r_of(cell), ay * q_of(cell) + by * r_of(cell)


def _lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / EARTH_M)) - math.pi / 2)


def _lng(x: Column) -> Column:
    return F.degrees(x / EARTH_M)


def centre(cell: Column) -> Column:
    """struct(lat, lng)"""
    x, y = _plane(cell)
    return F.named_struct(F.lit("lat"), _lat(y), F.lit("lng"), _lng(x))


def boundary(cell: Column) -> Column:
    """The closed ring of seven struct(lng, lat)."""
    x, y = _plane(cell)
    turn, edge = (F.lit(FINEST) - res_of(cell)) * ROTATION, edge_m(res_of(cell))
    corner = lambda k: F.named_struct(F.lit("lng"), _lng(x + edge * F.cos(turn + math.radians(30 + 60 * k))), F.lit("lat"), _lat(y + edge * F.sin(turn + math.radians(30 + 60 * k))))
    return F.array(*[corner(k % 6) for k in range(7)])


def child_units(res: Column) -> Column:
    """Finest cells that a cell of a resolution covers."""
    return F.pow(F.lit(7.0), F.lit(FINEST) - res).cast("long")


def area_km2(res: Column, lat: Column) -> Column:
    edge = edge_m(res) * F.cos(F.radians(F.greatest(F.lit(-85.0), F.least(F.lit(85.0), lat))))
    return edge * edge * 2.598076 / 1e6


def res_for_accuracy(accuracy_m: Column, lat: Column) -> Column:
    """The finest resolution that an accuracy supports at a latitude; null if none does."""
    scale = F.greatest(F.cos(F.radians(F.greatest(F.lit(-85.0), F.least(F.lit(85.0), lat)))), F.lit(0.05))
    a = accuracy_m / scale
    return F.when(a <= 40, 10).when(a <= 120, 9).when(a <= 300, 8)


def bounds(df, cell: str):
    """One row: west, south, east, north of all cells' boundaries."""
    ring = df.select(F.explode(boundary(F.col(cell))).alias("p"))
    return ring.agg(F.min("p.lng").alias("west"), F.min("p.lat").alias("south"), F.max("p.lng").alias("east"), F.max("p.lat").alias("north"))
