"""Spark's gradient-boosted classifier, fitted to packed bins in one task instead of a job for every level of every tree."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import classification
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import shared_folder
from tessera.sources.tables import _path as file_at

#: Rows times features that one task takes; beyond it Spark's own fit runs, with the rows left where they are.
CELLS = 64_000_000
GROUP = 1024  # features whose bins together are no more are counted at once
FEW = 4096  # rows of a node that are counted feature by feature
EPSILON = float(np.finfo(float).eps)

_ROWS = "codes binary, labels binary, weights binary"
_NODE = "struct(id, prediction, impurity, array(weight, total, squares) as impurityStats, rawCount, gain, leftChild, rightChild, struct(featureIndex, leftCategoriesOrThreshold, -1 as numCategories) as split) as nodeData"
_TREE = "treeID int, id int, prediction double, impurity double, weight double, total double, squares double, rawCount long, gain double, leftChild int, rightChild int, featureIndex int, leftCategoriesOrThreshold array<double>"
_TYPES = [pa.int32()] * 2 + [pa.float64()] * 5 + [pa.int64(), pa.float64()] + [pa.int32()] * 3 + [pa.list_(pa.float64())]
_NAMES = [c.split()[0] for c in _TREE.split(", ")]


def thresholds(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` splits of a feature between neighbouring values, about equal weight between them: Spark's rule."""
    found, at = np.unique(values, return_inverse=True)
    between = (found[:-1] + found[1:]) / 2
    if len(between) and np.isnan(found[-1]):  # lies with the largest values, to the right of every split
        found, between, at = found[:-1], between[:-1], np.minimum(at, len(found) - 2)
    if len(between) <= most:
        return between
    upto = np.cumsum(np.bincount(at, weights=weights)).tolist()
    stride = upto[-1] / (most + 1)
    target, out = stride, []
    for i in range(1, len(upto)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(between[i - 1])
            target += stride
    return np.array(out)


class Boosting:
    """Trees of least squares on the residuals of the logistic loss, as ``GradientBoostedTrees`` of Spark grows them.

    ``codes`` (feature, row) are bins, ``bins`` their number by feature. A node's histograms
    are counted for its smaller child only; the other child's are what is left. Several
    features of few bins are counted as one and summed apart.
    """

    def __init__(self, codes: np.ndarray, bins: list[int], label: np.ndarray, weight: np.ndarray, depth: int) -> None:
        self.codes, self.weight, self.depth = codes, weight, depth
        self.sign = 2 * label - 1
        self.width = max(bins)
        self.able = np.arange(self.width - 1) < np.array(bins)[:, None] - 1
        values, counts = np.unique(weight, return_counts=True)
        self.usual = values[counts.argmax()]
        self.odd = weight != self.usual  # with balanced labels, the rarer one's rows
        self.groups: list[tuple[list[int], list[int], np.ndarray]] = []
        open_: list[list[int]] = []
        for f in sorted(range(len(bins)), key=lambda f: -bins[f]):
            into = next((g for g in open_ if np.prod([bins[x] for x in g]) * bins[f] <= GROUP), None)
            into.append(f) if into else open_.append([f])
        for g in open_:
            shape = [bins[f] for f in g]
            packed = np.zeros(codes.shape[1], np.int16 if np.prod(shape) < 32768 else np.int32)
            for f in g:
                packed *= bins[f]
                packed += codes[f]
            self.groups.append((g, shape, packed))

    def _few(self, rows: np.ndarray, values: np.ndarray | None) -> np.ndarray:
        n = len(self.codes)
        at = (self.codes[:, rows] + np.arange(0, n * self.width, self.width)[:, None]).ravel()
        return np.bincount(at, None if values is None else np.tile(values, n), n * self.width).reshape(n, self.width)

    def _counted(self, rows: np.ndarray | None, pull: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, weight, weighted residuals) by feature and bin; no ``rows`` are all rows."""
        own = pull if rows is None else pull[rows]
        if len(own) <= FEW:
            rows = np.arange(len(own)) if rows is None else rows
            count, total = self._few(rows, None), self._few(rows, own)
        else:
            count, total = np.zeros((2, len(self.codes), self.width))
            for g, shape, packed in self.groups:
                at = (packed if rows is None else packed[rows]).astype(np.intp)
                for out, cells in ((count, np.bincount(at, None, np.prod(shape))), (total, np.bincount(at, own, np.prod(shape)))):
                    cells = cells.reshape(shape)
                    for k, f in enumerate(g):
                        out[f, : shape[k]] = cells.sum(axis=tuple(j for j in range(len(g)) if j != k))
        weight = count * self.usual
        odd = np.flatnonzero(self.odd) if rows is None else rows[self.odd[rows]]
        for part in np.split(odd, range(FEW, len(odd), FEW)):
            weight += self._few(part, self.weight[part] - self.usual)
        return count, weight, total

    def _stats(self, rows: np.ndarray | None, pull: np.ndarray, residual: np.ndarray) -> tuple[float, float, float, float]:
        """(weight, weighted sum, weighted squares, impurity) of a node's residuals."""
        pick = slice(None) if rows is None else rows
        weight, own = float(self.weight[pick].sum()), pull[pick]
        total, squares = float(own.sum()), float(own @ residual[pick])
        return weight, total, squares, (squares - total * total / weight) / weight

    def _best(self, hist: tuple[np.ndarray, np.ndarray, np.ndarray], weight: float, total: float) -> tuple[float, int, int]:
        """(gain, feature, last bin to the left) of the first best split."""
        count, left, pull = (np.cumsum(h, axis=1) for h in hist)
        able = self.able & (count[:, :-1] > 0) & (count[:, :-1] < count[:, -1:])
        with np.errstate(divide="ignore", invalid="ignore"):
            right, rest = left[:, -1:] - left[:, :-1], pull[:, -1:] - pull[:, :-1]
            gain = np.where(able, (pull[:, :-1] ** 2 / left[:, :-1] + rest**2 / right - total * total / weight) / weight, -np.inf)
        at = int(gain.argmax())
        return float(gain.flat[at]), *divmod(at, self.width - 1)

    def tree(self, residual: np.ndarray) -> tuple[list[list], np.ndarray]:
        """Nodes in the order of their ids (stats, rows, gain, children, feature, bin), and each row's prediction."""
        pull, out, nodes = self.weight * residual, np.empty(len(residual)), []

        def grow(rows: np.ndarray | None, level: int, hist: tuple | None, stats: tuple) -> int:
            me = len(nodes)
            nodes.append([stats, len(residual) if rows is None else len(rows), -1.0, -1, -1, -1, -1])
            gain, f, last = self._best(hist, *stats[:2]) if hist else (0.0, -1, -1)
            if gain <= 0:
                out[slice(None) if rows is None else rows] = stats[1] / stats[0]
                return me
            goes = (self.codes[f] if rows is None else self.codes[f][rows]) <= last
            parts = [np.flatnonzero(goes), np.flatnonzero(~goes)] if rows is None else [rows[goes], rows[~goes]]
            ours = [self._stats(p, pull, residual) for p in parts]
            open_ = [level + 1 < self.depth and abs(s[3]) >= EPSILON for s in ours]
            hists: list = [None, None]
            if any(open_):
                less = int(len(parts[1]) < len(parts[0]))
                hists[less] = self._counted(parts[less], pull)
                if open_[1 - less]:
                    left = [a - b for a, b in zip(hist, hists[less], strict=True)]
                    hists[1 - less] = [np.where(left[0] > 0, x, 0) for x in left]
            hists = [h if o else None for h, o in zip(hists, open_, strict=True)]
            a = grow(parts[0], level + 1, hists[0], ours[0])
            b = grow(parts[1], level + 1, hists[1], ours[1])
            leaves = nodes[a][3] < 0 and nodes[b][3] < 0
            if leaves and nodes[a][0][1] / nodes[a][0][0] == nodes[b][0][1] / nodes[b][0][0]:
                del nodes[a:]  # leaves that say the same are one
            else:
                nodes[me][2:] = [gain, a, b, f, last]
            return me

        grow(None, 0, self._counted(None, pull) if self.depth and self.width > 1 else None, self._stats(None, pull, residual))
        return nodes, out

    def fit(self, trees: int, rate: float) -> Iterator[list[list]]:
        nodes, margin = self.tree(self.sign)
        yield nodes
        for _ in range(1, trees):
            nodes, step = self.tree(4 * self.sign / (1 + np.exp(2 * self.sign * margin)))
            margin += rate * step
            yield nodes


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class GBTClassifier(classification.GBTClassifier):
    """Spark's estimator with its parameters and its model, where one task holds the rows as bins of a byte.

    Splits lie between neighbouring values of at most ``maxBins``² or 10,000 rows, as Spark's
    do. What Spark's fit knows beyond that (samples of rows or features, validation, weights
    of 0) is left to it, as are more than ``CELLS`` cells.
    """

    def _fit_java(self, dataset: DataFrame):
        value = self.getOrDefault
        weight = F.col(value("weightCol")).cast("double") if self.isSet("weightCol") else F.lit(1.0)
        rows = dataset.select(vector_to_array(value("featuresCol")).alias("x"), F.col(value("labelCol")).cast("double").alias("y"), weight.alias("w"))
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"), F.count_if((F.col("y").isin(0, 1) & (F.col("w") > 0) & (F.col("w") < float("inf"))).eqNullSafe(F.lit(True))).alias("fine")).first()
        plain = value("subsamplingRate") == 1 and value("featureSubsetStrategy") in ("all", "1.0") and not self.isSet("validationIndicatorCol") and value("minInstancesPerNode") == 1 and value("minInfoGain") == 0 and value("minWeightFractionPerNode") == 0
        if not plain or value("maxBins") > 256 or not seen["n"] or seen["fine"] < seen["n"] or seen["n"] * seen["width"] > CELLS:
            return super()._fit_java(dataset)
        wanted = max(value("maxBins") ** 2, 10_000)
        sample = (rows if seen["n"] <= wanted else rows.sample(False, wanted / seen["n"], value("seed"))).select("x", "w").toArrow()
        x, w = (np.concatenate([_matrix(c) for c in sample["x"].chunks]) if sample.num_rows else np.empty((0, seen["width"]))), sample["w"].to_numpy()
        splits = {f: s for f in range(seen["width"]) if len(s := thresholds(x[:, f], w, min(value("maxBins"), seen["n"]) - 1))}
        if not splits:
            return super()._fit_java(dataset)
        return self._model(rows, splits, seen["width"])

    def _model(self, rows: DataFrame, splits: dict[int, np.ndarray], width: int):
        spark, trees, depth, rate = rows.sparkSession, self.getMaxIter(), self.getMaxDepth(), self.getStepSize()

        def binned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = _matrix(b["x"])
                    codes = np.stack([np.searchsorted(s, x[:, f]).astype(np.uint8) for f, s in splits.items()])
                    yield pa.record_batch([pa.array([v.tobytes()], pa.binary()) for v in (codes, b["y"].to_numpy(), b["w"].to_numpy())], ["codes", "labels", "weights"])

        def grown(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [[np.frombuffer(v.as_buffer(), kind) for v in b[c]] for b in batches for c, kind in (("codes", np.uint8), ("labels", float), ("weights", float))]
            codes = np.concatenate([v.reshape(len(splits), -1) for p in parts[::3] for v in p], axis=1)
            label, weight = (np.concatenate([v for p in parts[k::3] for v in p]) for k in (1, 2))
            del parts
            features = list(splits)
            boosting = Boosting(codes, [len(splits[f]) + 1 for f in features], label, weight, depth)
            for t, nodes in enumerate(boosting.fit(trees, rate)):
                out = [(t, i, s[1] / s[0], s[3], *s[:3], n, gain, a, b, features[f] if a > 0 else -1, [float(splits[features[f]][last])] if a > 0 else []) for i, (s, n, gain, a, b, f, last) in enumerate(nodes)]
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)

        # The model passes through the files that Spark's own models are saved as.
        path = f"{shared_folder(spark)}/gbt-{uuid.uuid4().hex}"
        about = lambda kind, uid, own, **more: json.dumps({"class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid, **own, **more})
        own = {"paramMap": {p.name: v for p, v in self._paramMap.items()}, "defaultParamMap": {p.name: v for p, v in self._defaultParamMap.items()}}
        tree = {"paramMap": {p: own["paramMap"].get(p, own["defaultParamMap"].get(p)) for p in ("featuresCol", "labelCol", "maxDepth", "seed")}, "defaultParamMap": {"impurity": "variance"}}
        try:
            rows.mapInArrow(binned, _ROWS).repartition(1).mapInArrow(grown, _TREE).selectExpr("treeID", _NODE).write.parquet(f"{path}/data")
            each = [(t, about("regression.DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", tree), rate if t else 1.0) for t in range(trees)]
            spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
            spark.createDataFrame([(about("classification.GBTClassificationModel", self.uid, own, numFeatures=width, numTrees=trees),)], "value string").coalesce(1).write.text(f"{path}/metadata")
            return spark._jvm.org.apache.spark.ml.classification.GBTClassificationModel.load(path)
        finally:
            where, system = file_at(spark, path)
            system.delete(where, True)
