"""Boosted trees of the classifier's method (M3), fitted by tasks that keep their rows and run side by side.

Spark ML runs some seven jobs a tree, each with its start, its shuffle and its rows read again.  Here the fit is one
barrier stage: a task a core holds its share of the rows as bin codes, and the tasks exchange histograms
level by level.  Every task sees the same sums in the same order, so all grow the same trees.

The method is that of ``GBTClassifier``: labels -1 and 1, the first tree on the labels, every other one on the residuals
4 y / (1 + exp(2 y F)), weighted variance as impurity, leaves are weighted means, no row or column sampling.  Thresholds are the
library's rule (midpoints between neighbours at equal strides of weight, all of them up to ``max_bins`` - 1) over **all**
rows; the library itself takes them from a sample beyond 10,000 rows.  Of splits that are equally good the first feature's
is taken.  The result is written in the library's format and loaded as its model.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark import BarrierTaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame

from tempest.operators import boosting as B
from tempest.session import run_folder

CHUNK_ROWS = 1 << 18
COLUMNS_AT_ONCE = 8
LONGEST_WAIT = 1800  # seconds without another task's word


def slots(spark) -> int:
    """Tasks that can run side by side; 0 where executors come and go, which a barrier stage does not allow."""
    if spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    sc = spark.sparkContext._jsc.sc()
    return sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())


# ------------------------------------------------------------------ exchange

class Gang:
    """The tasks of a stage: every one gets every one's arrays, through small files in a shared folder.

    Spark's own ``allGather`` answers once a second, which a fit of some thousand exchanges cannot wait for.  A file is there once
    it has its name; who has written the next one has read all of the last, so a task deletes its file before that.
    """

    def __init__(self, folder: str, me: int, tasks: int) -> None:
        self.system, self.path = fs.FileSystem.from_uri(folder)
        self.system.create_dir(self.path)
        self.me, self.tasks, self.round = me, tasks, 0

    def all(self, a: np.ndarray) -> list[np.ndarray]:
        mine = np.ascontiguousarray(a, float)
        if self.tasks == 1:
            return [mine]
        name = lambda r, task: f"{self.path}/{r}-{task}"
        with self.system.open_output_stream(f"{name(self.round, self.me)}.part") as f:
            f.write(mine.tobytes())
        self.system.move(f"{name(self.round, self.me)}.part", name(self.round, self.me))
        out = []
        for task in range(self.tasks):
            if task == self.me:
                out.append(mine)
                continue
            began, pause = time.monotonic(), 0.0005
            while True:
                try:
                    with self.system.open_input_file(name(self.round, task)) as f:
                        out.append(np.frombuffer(f.readall()).reshape(mine.shape))
                    break
                except FileNotFoundError:
                    if time.monotonic() - began > LONGEST_WAIT:
                        raise RuntimeError(f"no word from task {task} of the fit") from None
                    time.sleep(pause)
                    pause = min(2 * pause, 0.02)
        if self.round:
            self.system.delete_file(name(self.round - 1, self.me))
        self.round += 1
        return out

    def total(self, a: np.ndarray) -> np.ndarray:
        return np.sum(self.all(a), axis=0)


# ------------------------------------------------------------------ thresholds

def _order(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, np.int64(-(1 << 63)) - bits, bits)


def _value(order: np.ndarray) -> np.ndarray:
    return np.where(order < 0, np.int64(-(1 << 63)) - order, order).astype(np.int64).view(float)


def thresholds(columns: Sequence[tuple[np.ndarray, np.ndarray]], gang: Gang, most: int) -> list[np.ndarray]:
    """Thresholds of each column, of which every task has (values, distinct and in order; weights).

    The library's rule: walking the distinct values, a threshold lies before the first one at which the running weight
    moves away from the next multiple of the stride.  The multiples are found by bisection on the values' bits, and the
    neighbours by asking all tasks; nothing but these numbers is exchanged.
    """
    k, sums = len(columns), [np.concatenate([[0.0], np.cumsum(w)]) for _, w in columns]
    places = [_order(v) for v, _ in columns]
    low, high = np.int64(-(1 << 62) * 2 + 1), np.int64((1 << 62) - 1 + (1 << 62))

    def before(at: np.ndarray, side: str) -> np.ndarray:
        return gang.total(np.stack([s[np.searchsorted(p, a, side)] for s, p, a in zip(sums, places, at, strict=True)]))

    def neighbours(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per column the greatest value below and the least value above a place (infinite: none)."""
        mine = []
        for (v, _), p, a in zip(columns, places, at, strict=True):
            below, above = np.searchsorted(p, a, "left"), np.searchsorted(p, a, "right")
            mine.append((v[below - 1] if below else -np.inf, v[above] if above < len(v) else np.inf))
        got = np.stack(gang.all(np.array(mine).reshape(k, 2)))
        return got[:, :, 0].max(axis=0), got[:, :, 1].min(axis=0)

    whole = gang.total(np.array([s[-1] for s in sums]))
    stride = whole / (most + 1)
    # the least value v with weight(< v) + weight(<= v) > 2 j stride
    goal = 2 * np.arange(1, most + 1) * stride[:, None]
    lo, hi = np.full((k, most), low), np.full((k, most), high)
    for _ in range(64):
        mid = (lo & hi) + ((lo ^ hi) >> 1)
        far = before(mid, "left") + before(mid, "right") > goal
        lo, hi = np.where(far, lo, np.minimum(mid, high - 1) + 1), np.where(far, mid, hi)
    first = neighbours(np.full(k, low))[1]
    few, at = [[x] for x in first], first
    for _ in range(most + 1):  # the first values: if these are all, every gap has a threshold
        at = neighbours(np.where(np.isfinite(at), _order(at), high))[1]
        for values, x in zip(few, at, strict=True):
            values.append(x)
    out: list[list] = [[] for _ in range(k)]
    last = _order(np.where(np.isfinite(first), first, 0.0))
    for j in range(most):
        above = np.maximum(neighbours(last)[1], neighbours(hi[:, j] - 1)[1])
        nxt = np.where(np.isfinite(above), _order(above), high)
        below = neighbours(nxt)[0]
        for c in range(k):
            if nxt[c] < high:
                out[c].append((below[c] + _value(nxt[c:c + 1])[0]) / 2)
                last[c] = nxt[c]
            else:
                last[c] = high
    for c, values in enumerate(few):
        some = [x for x in values if np.isfinite(x)]
        if len(some) <= most + 1:
            out[c] = [(a + b) / 2 for a, b in zip(some, some[1:], strict=False)]
    return [np.array(x, float) for x in out]


# ------------------------------------------------------------------ the fit

def _rows(batches: Iterator[pa.RecordBatch], features: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(values by feature, labels, weights) of at most about ``CHUNK_ROWS`` rows."""
    some, n = [], 0
    for b in batches:
        if b.num_rows:
            some.append(b)
            n += b.num_rows
        if n >= CHUNK_ROWS:
            yield _arrays(some, features)
            some, n = [], 0
    if some:
        yield _arrays(some, features)


def _arrays(batches: list[pa.RecordBatch], features: Sequence[str]):
    t = pa.Table.from_batches(batches)
    if t["label"].null_count or t["weight"].null_count:
        raise ValueError("a row to learn from has no label or no weight")
    return np.stack([t[f].to_numpy().astype(float) for f in features]), t["label"].to_numpy().astype(np.uint8), t["weight"].to_numpy().astype(float)


def _edges(parts, gang: Gang, n_features: int, most: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for f in range(0, n_features, COLUMNS_AT_ONCE):
        columns = []
        for c in range(f, min(f + COLUMNS_AT_ONCE, n_features)):
            x, w = np.concatenate([p[0][c] for p in parts] or [np.zeros(0)]) + 0.0, np.concatenate([p[2] for p in parts] or [np.zeros(0)])
            x, w = x[np.isfinite(x)], w[np.isfinite(x)]
            values, at = np.unique(x, return_inverse=True)
            columns.append((values, np.bincount(at, w, len(values))))
        out += thresholds(columns, gang, most)
    return out


def _fit(features: Sequence[str], p: dict, folder: str, tasks: int):
    """Task function: the rows to (in the first task) the trees' nodes and the features' thresholds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        attempt = max(map(int, context.allGather(str(context.taskAttemptId()))))  # a stage that runs again has a folder of its own
        gang, n, parts = Gang(f"{folder}/{attempt}", context.partitionId(), tasks), 0, []
        for values, labels, weight in _rows(batches, features):
            n += len(labels)
            held = B.scratch(values.shape, float, n)
            held[:] = values
            parts.append((held, labels, weight))
        edges = _edges(parts, gang, len(features), p["max_bins"] - 1)
        chunks, least = [], np.inf
        while parts:
            values, labels, weight = parts.pop(0)
            codes = np.stack([np.searchsorted(e, v, "left") for e, v in zip(edges, values, strict=True)], axis=1).astype(np.uint8)
            c = B.Chunk([(0, codes, labels, np.zeros(len(labels), np.uint8))], n)
            c.h[:] = weight
            chunks.append(c)
            least = min(least, weight.min())
        least = min(float(x[0]) for x in gang.all(np.array([least])))
        for i, nodes in enumerate(boost(chunks, gang, edges, p | {"min_child_weight": least / 2})):
            if context.partitionId() == 0:
                yield pa.RecordBatch.from_pylist([{"tree": i, "nodes": json.dumps(nodes)}])

    return run


def boost(chunks: Sequence[B.Chunk], gang: Gang, edges: Sequence[np.ndarray], p: dict) -> Iterator[list[dict]]:
    """The trees, one after the other; ``h`` of the chunks are the rows' weights."""
    p = {"reg_alpha": 0.0, "reg_lambda": 0.0, "learning_rate": 1.0, "min_gain": 1e-9} | p
    widths, columns = [len(e) + 1 for e in edges], np.arange(len(edges))
    there = np.arange(B.BINS) < np.array(widths)[:, None]

    def total(a: np.ndarray) -> np.ndarray:
        if a.ndim != 4:
            return gang.total(a)
        out = np.zeros(a.shape)
        out[:, :, there] = gang.total(a[:, :, there])
        return out

    for t in range(p["max_iter"]):
        for c in chunks:
            sign = np.where(c.labels == 1, 1.0, -1.0)
            c.g[:] = -c.h * (4 * sign / (1 + np.exp(2 * sign * c.margin)) if t else sign)
        tree = B.grow_tree(chunks, p, columns, widths, total)
        size = len(tree.child)
        stats = np.zeros((4, size))  # of the leaves: weight, sum, sum of squares, rows
        for c in chunks:
            for out, of in zip(stats, (c.h, -c.g, c.g ** 2 / c.h, None), strict=True):
                out += np.bincount(c.node, of, size)
        stats = gang.total(stats)
        for i in range(size - 1, -1, -1):
            if tree.child[i]:
                stats[:, i] = stats[:, tree.child[i]] + stats[:, tree.child[i] + 1]
        mean = stats[1] / np.maximum(stats[0], 1e-300)
        for c in chunks:
            c.margin += (p["step"] if t else 1.0) * mean[c.node]
        yield listed(tree, mean, stats, edges)


def listed(tree: B.Tree, mean: np.ndarray, stats: np.ndarray, edges: Sequence[np.ndarray]) -> list[dict]:
    """The nodes in the library's order; two leaves with one prediction are one leaf."""
    gone = tree.child == 0
    for i in range(len(gone) - 1, -1, -1):
        left = tree.child[i]
        if left and gone[left] and gone[left + 1] and mean[left] == mean[left + 1]:
            gone[i] = True
    out: list[dict] = []

    def walk(i: int) -> int:
        w, total, squares, rows = stats[:, i].tolist()
        at, f = len(out), int(tree.feature[i])
        out.append({"id": at, "prediction": float(mean[i]), "impurity": max(0.0, (squares - total * total / w) / w) if w else 0.0,
                    "impurityStats": [w, total, squares], "rawCount": int(rows), "gain": -1.0, "leftChild": -1, "rightChild": -1, "split": (-1, [], -1)})
        if not gone[i]:
            out[at] |= {"gain": float(tree.gain[i] / w), "split": (f, [float(edges[f][tree.bin[i]])], -1)}
            out[at]["leftChild"] = walk(int(tree.child[i]))
            out[at]["rightChild"] = walk(int(tree.child[i]) + 1)
        return at

    walk(0)
    return out


NODES = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, leftChild: int,"
         " rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


def fit(rows: DataFrame, estimator: GBTClassifier, features: Sequence[str], tasks: int) -> GBTClassificationModel:
    """``estimator``'s model of ``rows`` (label, weight, features), by ``tasks`` tasks side by side."""
    spark, feats = rows.sparkSession, list(features)
    p = {"max_iter": estimator.getMaxIter(), "max_depth": estimator.getMaxDepth(), "step": estimator.getStepSize(), "max_bins": estimator.getMaxBins()}
    folder = run_folder(spark, "boosted")
    dealt = rows.select("label", "weight", *feats).repartition(tasks)
    trees = sorted((r["tree"], json.loads(r["nodes"])) for r in dealt.mapInArrow(_fit(feats, p, folder, tasks), "tree long, nodes string", barrier=True).collect())  # a model's size
    path = f"{folder}/model"
    said = {k.name: v for k, v in estimator._paramMap.items()}
    default = {k.name: v for k, v in estimator._defaultParamMap.items()}
    head = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    own = {"class": "org.apache.spark.ml.classification.GBTClassificationModel", **head, "uid": estimator.uid, "paramMap": said, "defaultParamMap": default,
           "numFeatures": len(feats), "numTrees": len(trees)}
    of_trees = {"featuresCol", "labelCol", "maxDepth", "seed", "weightCol", "predictionCol", "cacheNodeIds", "checkpointInterval", "impurity", "leafCol", "maxBins",
                "maxMemoryInMB", "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode"}
    one = {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", **head, "paramMap": {k: v for k, v in said.items() if k in of_trees},
           "defaultParamMap": {k: v for k, v in default.items() if k in of_trees}}
    spark.createDataFrame([(json.dumps(own),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame([(i, json.dumps(one | {"uid": f"dtr_{i}"}), p["step"] if i else 1.0) for i, _ in trees], "_1 int, _2 string, _3 double") \
        .coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(i, tuple(n.values())) for i, nodes in trees for n in nodes], NODES).coalesce(1).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)
