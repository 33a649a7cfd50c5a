"""Points near other points or inside circles.

A bounded sample of the points shapes a quadtree whose leaves hold about equally many
points; a leaf too crowded to split further (many points at one place) is cut by salts. A
circle goes to every leaf that its bounding box touches, a point to its own leaf. In a
leaf the circles' boxes are packed into an R-tree, the points stream past it, and the
great-circle distance decides. A circle across the date line has two boxes; a pair counts
for the box that holds the point, which is its reference point, so no pair comes twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocks import block_join
from tessera.session import sampled

EARTH_KM = 6371.0
SAMPLE = 16_384
POINTS_A_LEAF = 20_000
CIRCLES_A_LEAF = 50_000
DEPTH = 15
FAN = 16
SALT_BITS = 12


def great_circle_km(lat1, lon1, lat2, lon2):
    """Haversine distance of arrays of degrees."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(np.asarray(lon2) - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def circle_boxes(lat: np.ndarray, lon: np.ndarray, km: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(circle number, [south, north, west, east]) of one or two boxes for each circle."""
    angle = km / EARTH_KM + 1e-9
    south, north = lat - np.degrees(angle), lat + np.degrees(angle)
    polar = (south <= -90) | (north >= 90) | (angle >= math.pi / 2)
    with np.errstate(invalid="ignore", divide="ignore"):
        half = np.degrees(np.arcsin(np.clip(np.sin(np.minimum(angle, math.pi / 2)) / np.maximum(np.cos(np.radians(lat)), 1e-12), -1, 1))) + 1e-9
    half = np.where(polar | (half >= 90), 180.0, half)
    # Longitudes of the centre count modulo 360; a box may be given whole or in two parts.
    west, east = lon - half, lon + half
    whole = half >= 180.0
    number = np.arange(len(lat))
    main = np.stack([np.maximum(south, -90), np.minimum(north, 90), np.where(whole, -180, np.maximum(west, -180)), np.where(whole, 180, np.minimum(east, 180))], axis=1)
    over_west, over_east = ~whole & (west < -180), ~whole & (east > 180)
    parts, owners = [main], [number]
    for over, lo, hi in ((over_west, west + 360, np.full_like(west, 180.0)), (over_east, np.full_like(west, -180.0), east - 360)):
        parts.append(np.stack([main[over, 0], main[over, 1], lo[over], hi[over]], axis=1))
        owners.append(number[over])
    # A centre at ±180 touches the meridian from both names of it.
    for edge, other in ((180.0, -180.0), (-180.0, 180.0)):
        at = ~whole & ~over_west & ~over_east & (lon == edge)
        parts.append(np.stack([main[at, 0], main[at, 1], np.full(at.sum(), other), np.full(at.sum(), other)], axis=1))
        owners.append(number[at])
    return np.concatenate(owners), np.concatenate(parts)


class Quadtree:
    """Leaves as ranges of Morton codes, shaped by a sample of points."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, capacity: int):
        codes = np.sort(self.code(lat, lon))
        starts: list[int] = []
        depths: list[int] = []
        counts: list[int] = []
        stack = [(0, 0)]
        while stack:
            start, depth = stack.pop()
            width = 4 ** (DEPTH - depth)
            n = int(np.searchsorted(codes, start + width) - np.searchsorted(codes, start))
            if n > capacity and depth < DEPTH:
                stack.extend((start + k * width // 4, depth + 1) for k in (3, 2, 1, 0))
            else:
                starts.append(start)
                depths.append(depth)
                counts.append(n)
        self.start = np.array(starts, np.int64)
        self.count = np.array(counts, np.int64)
        x, y, size = self._spread_back(self.start), self._spread_back(self.start >> 1), 2.0 ** (DEPTH - np.array(depths))
        cells = 2.0**DEPTH
        self.box = np.stack([y / cells * 180 - 90, (y + size) / cells * 180 - 90, x / cells * 360 - 180, (x + size) / cells * 360 - 180], axis=1)

    @staticmethod
    def code(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        top = 2**DEPTH
        x = np.clip((lon + 180) / 360 * top, 0, top - 1).astype(np.int64)
        y = np.clip((lat + 90) / 180 * top, 0, top - 1).astype(np.int64)
        out = np.zeros_like(x)
        for bit in range(DEPTH):
            out |= ((x >> bit) & 1) << (2 * bit) | ((y >> bit) & 1) << (2 * bit + 1)
        return out

    @staticmethod
    def _spread_back(code: np.ndarray) -> np.ndarray:
        out = np.zeros_like(code)
        for bit in range(DEPTH):
            out |= ((code >> (2 * bit)) & 1) << bit
        return out

    def leaf(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, self.code(lat, lon), side="right") - 1

    def touched(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(box number, leaf) for every leaf that a box touches."""
        who, where = [], []
        for lo in range(0, len(boxes), 512):
            b = boxes[lo : lo + 512, :, None]
            hit = (b[:, 0] <= self.box[:, 1]) & (b[:, 1] >= self.box[:, 0]) & (b[:, 2] <= self.box[:, 3]) & (b[:, 3] >= self.box[:, 2])
            i, j = np.nonzero(hit)
            who.append(i + lo)
            where.append(j)
        return (np.concatenate(who), np.concatenate(where)) if who else (np.zeros(0, np.int64),) * 2


class RTree:
    """Boxes packed bottom-up by sort-tile-recursive order; probed with arrays of points."""

    def __init__(self, boxes: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (boxes, children's start is i * FAN in the level below)
        order = self._tiles(boxes)
        self.order = order
        level = boxes[order]
        self.levels.append(level)
        while len(level) > FAN:
            at = np.arange(0, len(level), FAN)
            level = np.stack([f.reduceat(level[:, k], at) for k, f in enumerate((np.minimum, np.maximum, np.minimum, np.maximum))], axis=1)
            self.levels.append(level)

    @staticmethod
    def _tiles(boxes: np.ndarray) -> np.ndarray:
        mid_lat, mid_lon = boxes[:, 0] + boxes[:, 1], boxes[:, 2] + boxes[:, 3]
        slices = max(1, math.ceil(math.sqrt(len(boxes) / FAN)))
        by_lon = np.argsort(mid_lon, kind="stable")
        strip = np.empty(len(boxes), np.int64)
        strip[by_lon] = np.arange(len(boxes)) * slices // max(1, len(boxes))
        return np.lexsort((mid_lat, strip))

    def probe(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point number, box number) for every box that holds a point."""
        top = len(self.levels[-1])
        point, node = np.repeat(np.arange(len(lat)), top), np.tile(np.arange(top), len(lat))
        for depth in range(len(self.levels) - 1, -1, -1):
            b = self.levels[depth][node]
            y, x = lat[point], lon[point]
            keep = (b[:, 0] <= y) & (y <= b[:, 1]) & (b[:, 2] <= x) & (x <= b[:, 3])
            point, node = point[keep], node[keep]
            if depth:
                below = len(self.levels[depth - 1])
                point, node = np.repeat(point, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
                inside = node < below
                point, node = point[inside], node[inside]
        return point, self.order[node]


def _is_point(lat: str, lon: str):
    """Null, NaN and coordinates off the globe are no points."""
    a, b = F.col(lat), F.col(lon)
    return a.isNotNull() & b.isNotNull() & a.between(-90.0, 90.0) & b.between(-180.0, 180.0)


def circles_around(
    points: DataFrame,
    circles: DataFrame,
    point: tuple[str, str, str],
    circle: tuple[str, str, str, str],
    points_a_leaf: int = POINTS_A_LEAF,
    circles_a_leaf: int = CIRCLES_A_LEAF,
    sample: int = SAMPLE,
) -> DataFrame:
    """(point id, circle id, km) for every point inside a circle, its edge included.

    ``point`` names the id, latitude and longitude columns, ``circle`` the id, latitude,
    longitude and radius in km. Points or centres that are null, NaN or off the globe take
    no part, nor do null, NaN or negative radii, nor null ids. Every row counts: repeated
    ids give repeated pairs, so give one row per id where that isn't wanted. The two id
    columns may not share a name. Only about ``sample`` points and circles, drawn row by row,
    go to the driver; they shape the tree and don't touch the result.
    """
    pid, plat, plon = point
    cid, clat, clon, radius = circle
    if pid == cid:
        raise ValueError("the id columns need different names")
    spots = points.where(F.col(pid).isNotNull() & _is_point(plat, plon)).select(
        F.col(pid).alias("p"), F.col(plat).cast("double").alias("plat"), F.col(plon).cast("double").alias("plon")
    )
    rounds = circles.where(F.col(cid).isNotNull() & _is_point(clat, clon) & F.col(radius).between(0.0, 1e9)).select(
        F.col(cid).alias("c"), F.col(clat).cast("double").alias("clat"), F.col(clon).cast("double").alias("clon"), F.col(radius).cast("double").alias("km")
    )
    n_points, n_circles = spots.count(), rounds.count()
    shape = sampled(spots.select("plat", "plon"), n_points, sample).toPandas()
    some = sampled(rounds.select("clat", "clon", "km"), n_circles, sample).toPandas()
    tree = Quadtree(shape["plat"].to_numpy(), shape["plon"].to_numpy(), max(8, points_a_leaf * max(1, len(shape)) // max(1, n_points)))
    spread = lambda n, most: np.clip(np.ceil(n / most), 1, 2**SALT_BITS - 1).astype(np.int64)
    point_salts = spread(tree.count * (n_points / max(1, len(shape))), points_a_leaf)
    _, boxes = circle_boxes(*(some[c].to_numpy() for c in ("clat", "clon", "km")))
    touched = np.bincount(tree.touched(boxes)[1], minlength=len(tree.start))
    circle_salts = spread(touched * (n_circles / max(1, len(some))), circles_a_leaf)

    def block(leaf: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (leaf << (2 * SALT_BITS)) | (i << SALT_BITS) | j

    def repeat(leaf: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers, each as often as ``times`` says for its leaf, and the number of the repeat."""
        n = times[leaf]
        row = np.repeat(np.arange(len(leaf)), n)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)

    def place_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.leaf(b.column("plat").to_numpy(), b.column("plon").to_numpy())
            own = b.column("salt").to_numpy() % point_salts[leaf]
            row, i = repeat(leaf, circle_salts)
            yield pa.RecordBatch.from_arrays([pa.array(block(leaf[row], i, own[row])), *(b.column(c).take(pa.array(row)) for c in ("p", "plat", "plon"))], names=["block", "p", "plat", "plon"])

    def place_circles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, boxes = circle_boxes(*(b.column(c).to_numpy() for c in ("clat", "clon", "km")))
            which, leaf = tree.touched(boxes)
            own = b.column("salt").to_numpy()[owner[which]] % circle_salts[leaf]
            row, j = repeat(leaf, point_salts)
            which, leaf, own = which[row], leaf[row], own[row]
            back = pa.array(owner[which])
            yield pa.RecordBatch.from_arrays(
                [pa.array(block(leaf, own, j)), *(b.column(c).take(back) for c in ("c", "clat", "clon", "km")), *(pa.array(boxes[which, k]) for k in range(4))],
                names=["block", "c", "clat", "clon", "km", "south", "north", "west", "east"],
            )

    def pack(rows: pa.Table) -> tuple:
        get = lambda c: rows.column(c).to_numpy()
        return RTree(np.stack([get(c) for c in ("south", "north", "west", "east")], axis=1)), rows.column("c").combine_chunks(), get("clat"), get("clon"), get("km")

    def probe(index: tuple, rows: pa.RecordBatch) -> pa.RecordBatch:
        rtree, ids, clat, clon, km = index
        lat, lon = rows.column("plat").to_numpy(), rows.column("plon").to_numpy()
        p, c = rtree.probe(lat, lon)
        far = great_circle_km(lat[p], lon[p], clat[c], clon[c])
        keep = far <= km[c]
        return pa.RecordBatch.from_arrays([rows.column("p").take(pa.array(p[keep])), ids.take(pa.array(c[keep])), pa.array(far[keep])], names=["p", "c", "far"])

    kinds = dict(spots.dtypes) | dict(rounds.dtypes)
    salt = lambda key, lat, lon: F.pmod(F.xxhash64(F.lit(9), key, lat, lon), F.lit(1 << 30)).alias("salt")
    placed = spots.select("*", salt("p", "plat", "plon")).mapInArrow(place_points, f"block bigint, p {kinds['p']}, plat double, plon double")
    laid = rounds.select("*", salt("c", "clat", "clon")).mapInArrow(
        place_circles, f"block bigint, c {kinds['c']}, clat double, clon double, km double, south double, north double, west double, east double"
    )
    found = block_join(laid, placed, pack, probe, f"p {kinds['p']}, c {kinds['c']}, far double")
    return found.select(F.col("p").alias(pid), F.col("c").alias(cid), F.col("far").alias("km"))


def points_near(left: DataFrame, right: DataFrame, point: tuple[str, str, str], other: tuple[str, str, str], km: float, **how) -> DataFrame:
    """(left id, right id, km) for every pair of points at most ``km`` apart, as in circles_around."""
    radius = "__km"
    return circles_around(left, right.select(*other).withColumn(radius, F.lit(float(km))), point, (*other, radius), **how)
