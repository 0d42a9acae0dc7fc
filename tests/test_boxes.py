"""Boxes by tiles against all pairs."""

import random

from netfathom.operators import devices


def test_boxes_by_tiles_equal_all_pairs(spark):
    rnd = random.Random(4)
    boxes = [("world", -180.0, -90.0, 180.0, 90.0, 99), ("dot", 10.0, 10.0, 10.0, 10.0, 0), ("strip", -180.0, 1.0, 180.0, 1.001, 1), ("pacific", 170.0, -30.0, -165.0, 20.0, 2)]
    for k in range(60):
        w, s, size = rnd.uniform(-180, 180), rnd.uniform(-90, 89), rnd.choice([0.0001, 0.3, 2, 30, 120])
        e = w + size * rnd.random()
        boxes.append((f"b{k}", w, s, e - 360 if e > 180 else e, min(90.0, s + size * rnd.random()), 3 + k))
    points = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180), i) for i in range(300)] + [(10.0, 10.0, 1000), (None, 3.0, 1001), (90.0, 180.0, 1002), (-90.0, -180.0, 1003)]
    points += [(y, x, 2000 + 10 * i + j) for i, b in enumerate(boxes) for j, (x, y) in enumerate([(b[1], b[2]), (b[3], b[4]), (b[1], b[4])])]
    got = {r["id"]: r["name"] for r in devices.locate_boxes(spark.createDataFrame(points, "lat double, lng double, id long"), spark.createDataFrame(boxes, "name string, west double, south double, east double, north double, ordinal int"), "lat", "lng").collect()}
    for y, x, i in points:
        inside = [] if y is None else [b for b in boxes if b[2] <= y <= b[4] and (b[1] <= x <= b[3] if b[1] <= b[3] else x >= b[1] or x <= b[3])]
        assert got[i] == min(inside, key=lambda b: b[5], default=(None,))[0], (i, y, x)
    assert len(got) == len(points)
    none = spark.createDataFrame(boxes[:1], "name string, west double, south double, east double, north double, ordinal int").limit(0)
    assert devices.locate_boxes(spark.createDataFrame(points[:3], "lat double, lng double, id long"), none, "lat", "lng").where("name is null").count() == 3
