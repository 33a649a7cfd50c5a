import numpy as np

from tessera.operators.spatial import Quadtree, RTree, circles_around, great_circle_km, points_near


def brute(points, circles):
    out = []
    for p, lat, lon in points:
        for c, clat, clon, km in circles:
            ok = all(x is not None and x == x for x in (lat, lon, clat, clon, km)) and abs(lat) <= 90 and abs(lon) <= 180
            if ok and great_circle_km(lat, lon, clat, clon) <= km:
                out.append((p, c))
    return sorted(out)


def test_against_all_pairs_with_hot_places_date_line_and_poles(spark):
    rng = np.random.default_rng(1)
    points = [(f"p{i}", float(lat), float(lon)) for i, (lat, lon) in enumerate(zip(rng.uniform(-90, 90, 400), rng.uniform(-180, 180, 400), strict=True))]
    points += [(f"h{i}", 55.5, 41.5) for i in range(300)]
    points += [("x1", None, 1.0), ("x2", float("nan"), 1.0), ("x3", 0.0, 0.0), ("x4", 95.0, 0.0), ("x5", 0.0, 181.0), ("x6", 0.0, 180.0), ("x7", 0.0, -180.0), ("x8", 90.0, 12.0), ("x9", -90.0, 0.0)]
    circles = [(i, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180)), float(rng.uniform(10, 3000))) for i in range(40)]
    circles += [(100, 55.5, 41.6, 20.0), (101, 0.0, 179.9, 50.0), (102, 0.0, -180.0, 1.0), (103, 89.9, 5.0, 500.0), (104, None, 1.0, 5.0), (105, 0.0, 0.0, 0.0), (106, 1.0, 1.0, -1.0), (107, 0.0, 0.0, 30000.0), (108, 0.0, 180.0, 0.0)]
    p = spark.createDataFrame(points, "id string, lat double, lon double")
    c = spark.createDataFrame(circles, "c long, lat double, lon double, km double")
    got = circles_around(p, c, ("id", "lat", "lon"), ("c", "lat", "lon", "km"), points_a_leaf=50, circles_a_leaf=8)
    assert sorted((r[0], r[1]) for r in got.collect()) == brute(points, circles)


def test_repeats_empty_tables_and_self_join(spark):
    p = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 1.0), (None, 1.0, 1.0), ("b", 1.001, 1.0)], "id string, lat double, lon double")
    other = p.withColumnRenamed("id", "other")
    near = points_near(p, other, ("id", "lat", "lon"), ("other", "lat", "lon"), 1.0)
    assert sorted((r[0], r[1]) for r in near.collect()) == [("a", "a")] * 4 + [("a", "b")] * 2 + [("b", "a")] * 2 + [("b", "b")]
    assert points_near(p.limit(0), other, ("id", "lat", "lon"), ("other", "lat", "lon"), 1.0).count() == 0
    assert points_near(p, other.limit(0), ("id", "lat", "lon"), ("other", "lat", "lon"), 1.0).count() == 0


def test_tree_parts():
    rng = np.random.default_rng(2)
    lat, lon = rng.uniform(-90, 90, 2000), rng.uniform(-180, 180, 2000)
    tree = Quadtree(lat, lon, 50)
    leaf = tree.leaf(lat, lon)
    assert np.bincount(leaf, minlength=len(tree.start)).max() <= 50
    b = tree.box[leaf]
    assert ((b[:, 0] <= lat) & (lat <= b[:, 1]) & (b[:, 2] <= lon) & (lon <= b[:, 3])).all()
    low = rng.uniform(0, 1, (500, 2))
    boxes = np.stack([low[:, 0], low[:, 0] + 0.1, low[:, 1], low[:, 1] + 0.1], axis=1)
    y, x = rng.uniform(0, 1, 300), rng.uniform(0, 1, 300)
    inside = (boxes[None, :, 0] <= y[:, None]) & (y[:, None] <= boxes[None, :, 1]) & (boxes[None, :, 2] <= x[:, None]) & (x[:, None] <= boxes[None, :, 3])
    assert sorted(zip(*(a.tolist() for a in RTree(boxes).probe(y, x)), strict=True)) == sorted(zip(*(a.tolist() for a in np.nonzero(inside)), strict=True))
