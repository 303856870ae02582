"""Boosted and extremely randomised trees, grown level by level (M4, M5).

A level is one Spark job: every task sums what its rows say about all candidate cuts of all open nodes, Spark adds the
sums of equal cuts, and one row per node and feature reaches the driver, which holds the trees.  Rows never move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.functions.ordering import hash_order
from tabloom.session import durable

#: Sums that one job keeps in a task at most; a level with more goes in several jobs.
MOST_CELLS = 1 << 20
#: Bytes of features and rows that are a task's share: a row costs time however few its features.
TASK_BYTES, TASK_ROWS = 4 << 20, 50_000
#: Rounds after which the margins are written anew, so a job applies few trees and a lost executor costs few.
REFRESH = 10


@dataclass
class Tree:
    """Nodes by number, the root first; a row goes to `left` + 1 if its feature is above the threshold."""

    feature: list[int] = field(default_factory=list)  # -1 in leaves
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    value: list[list[float]] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: list[float]) -> int:
        for column, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.value, value), (self.gain, 0.0)):
            column.append(v)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, threshold: float, gain: float, low: list[float], high: list[float]) -> tuple[int, int]:
        self.feature[node], self.threshold[node], self.gain[node] = feature, float(threshold), float(gain)
        self.left[node] = self.add(low)
        return self.left[node], self.add(high)

    def nodes_of(self, X: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        feature, threshold, left = np.array(self.feature), np.array(self.threshold), np.array(self.left)
        node = np.zeros(len(X), np.int64)
        rows = np.arange(len(X))
        while len(rows):
            rows = rows[feature[node[rows]] >= 0]
            at = node[rows]
            node[rows] = left[at] + (X[rows, feature[at]] > threshold[at])
        return node

    def values_of(self, X: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes_of(X)]


def total_of(trees: list[Tree], X: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = np.tile(np.asarray(start, float), (len(X), 1))
    for tree in trees:
        out += tree.values_of(X)
    return out


def uniform(*parts) -> float:
    """A number in [0, 1) from a hash of the parts: the same on every run and for every layout of the rows."""
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=8).digest()[:6], "big") / 2**48


# ---------------------------------------------------------------- fitted models

class TreeSum(Model):
    """Adds `prediction`, and for classes `probability`; trees add up (`logistic`, `softmax`, `identity`) or are averaged (`mean`)."""

    def __init__(self, trees: list[Tree], start: list[float], link: str, features: int) -> None:
        super().__init__()
        self.trees, self.start, self.link, self.features = trees, [float(s) for s in start], link, features

    @property
    def featureImportances(self) -> DenseVector:
        """The share of each feature in the gain of all cuts."""
        total = np.zeros(self.features)
        for tree in self.trees:
            for f, g in zip(tree.feature, tree.gain):
                if f >= 0:
                    total[f] += g
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def outputs(self, X: np.ndarray) -> np.ndarray:
        """Values or class probabilities of rows, one column per output."""
        raw = total_of(self.trees, X, self.start)
        if self.link == "mean":
            return raw / max(1, len(self.trees))
        if self.link == "logistic":
            p = 1 / (1 + np.exp(-raw[:, :1]))
            return np.hstack([1 - p, p])
        if self.link == "softmax":
            return _softmax(raw)
        return raw

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def outputs(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=object)
            return pd.Series(list(shared.value.outputs(np.stack(features.to_numpy()).astype(float))))

        rows = dataset.withColumn("_outputs", outputs(vector_to_array("features")))
        if len(self.start) == 1 and self.link != "logistic":
            return rows.withColumn("prediction", F.col("_outputs")[0]).drop("_outputs")
        best = (F.array_position("_outputs", F.array_max("_outputs")) - 1).cast("double")
        return rows.withColumn("prediction", best).withColumn("probability", array_to_vector("_outputs")).drop("_outputs")

    def save_rows(self, path: str) -> None:
        """One row per node."""
        spark = SparkSession.getActiveSession()
        rows = [(t, n, tree.feature[n], tree.threshold[n], tree.left[n], [float(v) for v in tree.value[n]], tree.gain[n])
                for t, tree in enumerate(self.trees) for n in range(len(tree.feature))]
        nodes = spark.createDataFrame(
            rows, "tree int, node int, feature int, threshold double, left int, value array<double>, gain double")
        nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(self.start, self.link, self.features)], "start array<double>, link string, features int").write.mode(
            "overwrite").parquet(f"{path}/model")

    @classmethod
    def load_rows(cls, spark: SparkSession, path: str) -> TreeSum:
        start, link, features = spark.read.parquet(f"{path}/model").first()
        trees: list[Tree] = []
        for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toLocalIterator():
            if r.tree == len(trees):
                trees.append(Tree())
            trees[-1].add(list(r.value))
            trees[-1].feature[-1], trees[-1].threshold[-1], trees[-1].left[-1], trees[-1].gain[-1] = r.feature, r.threshold, r.left, r.gain
        return cls(trees, list(start), link, features)


def _softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _tasks(rows: int, row_bytes: int) -> int:
    """Tasks of a level: one per TASK_BYTES of features or TASK_ROWS, because each costs more than its share of a small table."""
    return max(1, -(-rows * row_bytes // TASK_BYTES), -(-rows // TASK_ROWS))


def _dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """The rows in so many equal parts, also where they come in fewer."""
    return rows.coalesce(1) if tasks == 1 else rows.repartition(tasks)


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """Rows of equal length from a binary column."""
    _, ends, cells = column.buffers()
    first = int(np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset])
    return np.frombuffer(cells, dtype, len(column) * width, first).reshape(len(column), width)


def _params(owner: str, **kinds) -> dict:
    return {n: Param(Params._dummy(), n, owner, getattr(TypeConverters, k)) for n, k in kinds.items()}


# ---------------------------------------------------------------- boosting

def gradients(y: np.ndarray, margin: np.ndarray, classes: int | None) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of squared loss, log loss or softmax loss by margin, one column per output."""
    if classes is None:
        return margin - y[:, None], np.ones_like(margin)
    if classes == 2:
        p = 1 / (1 + np.exp(-margin))
        return p - y[:, None], p * (1 - p)
    p = _softmax(margin)
    return p - (y[:, None] == np.arange(classes)), p * (1 - p)


class Boosting(Estimator):
    """M5: second-order gradient boosting on quantile histograms.

    A node's cut has the greatest GL²/(HL + l2) + GR²/(HR + l2) - G²/(H + l2), a leaf the value -G/(H + l2) times the step.
    `first_order` weighs cuts by row counts instead of second derivatives.  `symmetric` trees use one cut for all nodes
    of a level.  All classes grow their trees together.  Rows are drawn by a hash of their content and the round,
    features by a hash of the round.
    """

    maxIter, stepSize, maxDepth, subsamplingRate, featureSubsetStrategy, l2, minWeight, minRows, bins = _params(
        "boosting", maxIter="toInt", stepSize="toFloat", maxDepth="toInt", subsamplingRate="toFloat",
        featureSubsetStrategy="toString", l2="toFloat", minWeight="toFloat", minRows="toInt", bins="toInt").values()

    def __init__(self, classes: int | None = None, symmetric: bool = False, first_order: bool = False, seed: int = 42, **values) -> None:
        super().__init__()
        self.classes, self.symmetric, self.first_order, self.seed = classes, symmetric, first_order, seed
        self._setDefault(maxIter=100, stepSize=0.1, maxDepth=6, subsamplingRate=1.0, featureSubsetStrategy="1.0", l2=1.0,
                         minWeight=0.0, minRows=1, bins=128)
        self._set(**values)

    def _fit(self, rows: DataFrame) -> TreeSum:
        get = self.getOrDefault
        plain = rows.select(vector_to_array("features").alias("f"), F.col("label").cast("double").alias("y"))
        start, width, n = self._start(plain)
        edges = quantile_edges(plain, width, min(256, get(self.bins)))
        state = durable(_dealt(_binned(plain, edges, start), _tasks(n, width)), "binned")
        trees: list[Tree] = []  # thresholds are bin numbers until the end
        recent: list[Tree] = []
        for r in range(get(self.maxIter)):
            grown = self._round(state, recent, start, r, edges)
            trees += grown
            recent += grown
            if len(recent) >= REFRESH * len(start) and r + 1 < get(self.maxIter):
                state, recent = durable(_moved(state, recent, len(edges), len(start)), "margins"), []
        for tree in trees:
            tree.threshold = [float(edges[f][int(t)]) if f >= 0 else 0.0 for f, t in zip(tree.feature, tree.threshold)]
        link = "identity" if self.classes is None else "logistic" if self.classes == 2 else "softmax"
        return TreeSum(trees, start, link, width)

    def _start(self, plain: DataFrame) -> tuple[list[float], int, int]:
        """Margins before the first round: the mean, the log odds, or the log shares of the classes."""
        k = self.classes
        counts = [F.avg(F.when(F.col("y") == c, 1.0).otherwise(0.0)) for c in range(k or 0)]
        n, mean, width, *shares = plain.agg(F.count("*"), F.avg("y"), F.max(F.size("f")), *counts).first()
        if not n:
            raise ValueError("no rows to fit")
        low = 1e-6
        if k is None:
            return [mean], width, n
        if k == 2:
            p = min(max(mean, low), 1 - low)
            return [float(np.log(p / (1 - p)))], width, n
        return [float(np.log(max(s, low))) for s in shares], width, n

    def _round(self, state: DataFrame, recent: list[Tree], start: list[float], r: int, edges: list[np.ndarray]) -> list[Tree]:
        get = self.getOrDefault
        step, l2, k = get(self.stepSize), get(self.l2), len(start)
        share = float(get(self.featureSubsetStrategy)) if get(self.featureSubsetStrategy) not in ("all", "auto") else 1.0
        order = sorted(range(len(edges)), key=lambda f: uniform(self.seed, "feature", r, f))
        chosen = sorted(f for f in order[: max(1, round(share * len(edges)))] if len(edges[f]))

        def leaf(c: int, g: float, h: float) -> list[float]:
            out = [0.0] * k
            out[c] = -step * g / (h + l2) if h + l2 > 0 else 0.0
            return out

        trees, open_ = [Tree() for _ in range(k)], [(c, 0) for c in range(k)]
        for c, tree in enumerate(trees):
            tree.add([0.0] * k)
        for depth in range(get(self.maxDepth)):
            best = self._cuts(state, recent, trees, open_, start, r, chosen, edges)
            if depth == 0:
                for c, node in open_:
                    if (c, node) in best:
                        trees[c].value[node] = leaf(c, *best[c, node]["whole"])
            fresh = []
            for c, node in open_:
                cut = best.get((c, node))
                if cut is None or cut["f"] is None:
                    continue
                fresh += [(c, x) for x in trees[c].split(node, cut["f"], cut["bin"], cut["gain"], leaf(c, *cut["low"]), leaf(c, *cut["high"]))]
            open_ = fresh
            if not open_:
                break
        return trees

    def _cuts(self, state, recent, trees, open_, start, r, chosen, edges) -> dict:
        """The cut of each open node: feature, bin, gain, and the sums on both sides."""
        get = self.getOrDefault
        cells = max(1, len(open_)) * (get(self.bins) + 1) * 3
        block = max(1, MOST_CELLS // cells)
        found: list[dict] = []
        for at in range(0, max(1, len(chosen)), block):
            found += self._best_of(state, recent, trees, open_, start, r, chosen[at: at + block], edges)
        best: dict = {}
        if self.symmetric:
            level: dict = {}
            for row in found:
                level[row["c"], row["f"], row["bin"]] = level.get((row["c"], row["f"], row["bin"]), 0.0) + max(row["gain"] or 0.0, 0.0)
            top = {}
            for (c, f, b), gain in sorted(level.items()):
                if gain > 1e-12 and gain > top.get(c, (0.0,))[0] * (1 + 1e-12):
                    top[c] = (gain, f, b)
            for row in found:
                mine = top.get(row["c"])
                whole = (row["g"], row["h"])
                if mine and (row["f"], row["bin"]) == mine[1:]:
                    low = (row["gl"], row["hl"])
                    best[row["c"], row["node"]] = {"f": mine[1], "bin": mine[2], "gain": max(row["gain"] or 0.0, 0.0), "low": low,
                                                   "high": (whole[0] - low[0], whole[1] - low[1]), "whole": whole}
                else:
                    best.setdefault((row["c"], row["node"]), {"f": None, "whole": whole})
            return best
        for row in sorted(found, key=lambda x: (x["c"], x["node"], x["f"])):
            at, whole = (row["c"], row["node"]), (row["g"], row["h"])
            mine = best.setdefault(at, {"f": None, "gain": 0.0, "whole": whole})
            # sums of the same rows may differ in their last bits; equal cuts go to the first feature
            if row["gain"] is not None and row["gain"] > max(mine["gain"] * (1 + 1e-10), 1e-12):
                best[at] = {"f": row["f"], "bin": row["bin"], "gain": row["gain"], "low": (row["gl"], row["hl"]),
                            "high": (whole[0] - row["gl"], whole[1] - row["hl"]), "whole": whole}
        return best

    def _best_of(self, state, recent, trees, open_, start, r, features, edges) -> list[dict]:
        """Per output, open node and feature its best cut; all cuts if trees are symmetric."""
        get = self.getOrDefault
        l2, width, k = get(self.l2), len(edges), len(start)
        classes, seed, rate = self.classes, self.seed, get(self.subsamplingRate)
        dense = self.symmetric  # one cut for all nodes needs the sums of nodes without rows in a bin, too
        slots = [{node: i for i, (c, node) in enumerate(open_) if c == out} for out in range(k)]
        sizes = [len(edges[f]) + 1 for f in features]
        shared = state.sparkSession.sparkContext.broadcast((recent, trees))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before, now = shared.value
            total = [np.zeros((len(open_) * n, 3)) for n in sizes]
            for batch in batches:
                key = batch.column(0).to_numpy()
                use = _drawn(key, seed, r, rate)
                if not use.any():
                    continue
                y = batch.column(1).to_numpy()[use]
                B = _matrix(batch.column(2), np.uint8, width)[use]
                margin = _matrix(batch.column(3), np.float64, k)[use] + total_of(before, B, [0.0] * k)
                g, h = gradients(y, margin, classes)
                for c in range(k):
                    if not slots[c]:
                        continue
                    table = np.full(len(now[c].feature), -1)
                    table[list(slots[c])] = list(slots[c].values())
                    slot = table[now[c].nodes_of(B)]
                    ok = slot >= 0
                    for i, f in enumerate(features):
                        at = slot[ok] * sizes[i] + B[ok, f]
                        for j, w in enumerate((g[ok, c], h[ok, c], None)):
                            total[i][:, j] += np.bincount(at, w, len(total[i]))
            for i, f in enumerate(features):
                cell = np.arange(len(total[i])) if dense else np.flatnonzero(total[i][:, 2])
                if len(cell):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((cell // sizes[i]).astype(np.int32)), pa.array(np.full(len(cell), f, np.int32)),
                         pa.array((cell % sizes[i]).astype(np.int32)), *(pa.array(total[i][cell, j]) for j in range(3))],
                        names=["slot", "f", "bin", "g", "h", "n"])

        cells = state.mapInArrow(sums, "slot int, f int, bin int, g double, h double, n double")
        weight = "n" if self.first_order else "h"
        score = lambda g, w: f"CASE WHEN {w} + {l2} > 0 THEN ({g}) * ({g}) / ({w} + {l2}) ELSE 0D END"
        few, light = get(self.minRows), get(self.minWeight)
        # dealt once by slot and feature: the sums, the running sums and the best cut need no other exchange;
        # one statement, because a job is short and building its plan call by call is not
        scored = f"""
            SELECT *, CASE WHEN nl >= {few} AND nt - nl >= {few} AND hl >= {light}D AND ht - hl >= {light}D
              THEN {score('gl', weight + 'l')} + {score('gt - gl', f'{weight}t - {weight}l')} - {score('gt', weight + 't')} END AS gain
            FROM (SELECT slot, f, bin, sum(g) OVER l AS gl, sum(h) OVER l AS hl, sum(n) OVER l AS nl,
                sum(g) OVER w AS gt, sum(h) OVER w AS ht, sum(n) OVER w AS nt
              FROM (SELECT slot, f, bin, sum(g) AS g, sum(h) AS h, sum(n) AS n
                FROM (SELECT /*+ REPARTITION(slot, f) */ * FROM {{cells}}) GROUP BY slot, f, bin)
              WINDOW w AS (PARTITION BY slot, f), l AS (PARTITION BY slot, f ORDER BY bin))"""
        if not self.symmetric:
            pick = lambda c: f"max_by({c}, CASE WHEN gain IS NOT NULL THEN struct(round(gain, 12), -bin) END) AS {c}"
            scored = f"""SELECT slot, f, {', '.join(map(pick, ('bin', 'gain', 'gl', 'hl')))}, max(gt) AS gt, max(ht) AS ht
              FROM ({scored}) GROUP BY slot, f"""
        cells = state.sparkSession.sql(scored, cells=cells)
        out = []
        for row in cells.select("slot", "f", "bin", "gain", "gl", "hl", "gt", "ht").collect():  # bounded by MOST_CELLS
            c, node = open_[row["slot"]]
            out.append({"c": c, "node": node, "f": row["f"], "bin": row["bin"], "gain": row["gain"], "gl": row["gl"], "hl": row["hl"],
                        "g": row["gt"], "h": row["ht"]})
        return out


def _drawn(key: np.ndarray, seed: int, r: int, rate: float) -> np.ndarray:
    """The rows of a round: those whose mixed hash lies below the rate."""
    if rate >= 1:
        return np.ones(len(key), bool)
    h = key.astype(np.int64).view(np.uint64) ^ np.uint64(int(uniform(seed, "rows", r) * 2**48))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(11)).astype(np.float64) / 2**53 < rate


def quantile_edges(plain: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Upper edges of the bins of each feature, at most `bins` - 1, from one aggregation of sketches; NaN is above all."""
    probs = [i / bins for i in range(1, bins)]
    cells = plain.select(F.posexplode("f").alias("f", "x")).filter("not isnan(x)")
    found = cells.groupBy("f").agg(F.percentile_approx("x", F.array(*[F.lit(p) for p in probs]), 10_000).alias("q"), F.max("x").alias("top"))
    out = [np.zeros(0) for _ in range(width)]
    for row in found.collect():  # one row per feature
        edges = np.unique(row["q"])
        out[row["f"]] = edges[edges < row["top"]]
    return out


def _binned(plain: DataFrame, edges: list[np.ndarray], start: list[float]) -> DataFrame:
    """(key, y, bins, margin): the bin of each feature in one byte, and the margins before the first round."""
    shared = plain.sparkSession.sparkContext.broadcast(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            X = batch.column(2).values.to_numpy(zero_copy_only=False).reshape(n, -1)
            B = np.stack([np.searchsorted(e, X[:, f], side="left") for f, e in enumerate(shared.value)], axis=1).astype(np.uint8)
            first = np.array(start, np.float64).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b.tobytes() for b in B], pa.binary()),
                                              pa.array([first] * n, pa.binary())], names=["key", "y", "bins", "margin"])

    return plain.select(F.xxhash64("f", "y").alias("key"), "y", "f").mapInArrow(run, "key long, y double, bins binary, margin binary")


def _moved(state: DataFrame, trees: list[Tree], width: int, outputs: int) -> DataFrame:
    """The margins with the trees added."""
    shared = state.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                B = _matrix(batch.column(2), np.uint8, width)
                margin = _matrix(batch.column(3), np.float64, outputs) + total_of(shared.value, B, [0.0] * outputs)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([m.tobytes() for m in margin], pa.binary())],
                                                 names=["key", "y", "bins", "margin"])

    return state.mapInArrow(run, state.schema)


# ---------------------------------------------------------------- target statistics for text

def ordered_target_statistics(df: DataFrame, columns: list[str], target: str, key: list[str], prior: float, weight: float = 1.0,
                              seed: int = 42) -> DataFrame:
    """M5: adds `<column>_stat`, the mean target of the rows of the same value that come before a row in a drawn order.

    (sum of earlier targets + weight * prior) / (number of earlier rows + weight), so a row never sees its own target.
    Rows are ordered by a hash of their key; null is a value of its own, and rows without a target add nothing.
    A value may hold a third of all rows: its running sums are taken per slice of the hash, and the slices' totals are
    added up, so no task orders a whole value.
    """
    hashed = df.withColumn("_h", hash_order(F.concat_ws("|", *[F.col(k).cast("string") for k in key]), seed))
    for c in columns:
        placed = with_running_sums(hashed, c, target)
        hashed = placed.withColumn(f"{c}_stat", (F.col("_sum") + weight * prior) / (F.col("_count") + weight)).drop("_sum", "_count")
    return hashed.drop("_h")


def with_running_sums(hashed: DataFrame, column: str, target: str) -> DataFrame:
    """`_sum` and `_count` of the targets before each row of its value, in the order of `_h`."""
    y = F.col(target).cast("double")
    rows = hashed.withColumn("_slice", F.struct(F.col(column).alias("v"), F.shiftright("_h", 50).alias("s")))
    parts = rows.groupBy("_slice").agg(F.coalesce(F.sum(y), F.lit(0.0)).alias("_s"), F.count(y).alias("_n"))
    before = Window.partitionBy(F.col("_slice")["v"]).orderBy(F.col("_slice")["s"]).rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    parts = parts.select("_slice", none(F.sum("_s").over(before)).alias("_bs"), none(F.sum("_n").over(before)).alias("_bn"))
    inside = Window.partitionBy("_slice").orderBy("_h").rangeBetween(Window.unboundedPreceding, -1)
    return rows.join(parts, "_slice").withColumns({
        "_sum": F.col("_bs") + none(F.sum(y).over(inside)), "_count": F.col("_bn") + none(F.count(y).over(inside))}).drop("_slice", "_bs", "_bn")


def target_statistics(df: DataFrame, column: str, target: str, prior: float, weight: float = 1.0) -> DataFrame:
    """(value, stat): the statistics of all rows, for tables that are scored; values not seen take the prior."""
    y = F.col(target).cast("double")
    return df.groupBy(F.col(column).alias("value")).agg(
        ((F.coalesce(F.sum(y), F.lit(0.0)) + weight * prior) / (F.count(y) + weight)).alias("stat"))


# ---------------------------------------------------------------- extremely randomised trees

class ExtraTrees(Estimator):
    """M4: every node tries one random cut, drawn evenly between its least and greatest value, of each of some features.

    A level takes two jobs over the rows: the ranges of the features in all open nodes of a block of trees, then the
    sums on both sides of all drawn cuts.  Cuts come from a hash of seed, tree, node and feature.  All rows enter every
    tree.  Regression trees lower the variance, classification trees the Gini impurity; leaves are means or shares,
    and trees are averaged.
    """

    numTrees, maxDepth, minSplit, minRows, maxFeatures = _params(
        "extra", numTrees="toInt", maxDepth="toInt", minSplit="toInt", minRows="toInt", maxFeatures="toString").values()

    def __init__(self, classes: int | None = None, seed: int = 42, block: int = 25, **values) -> None:
        super().__init__()
        self.classes, self.seed, self.block = classes, seed, block
        self._setDefault(numTrees=200, maxDepth=15, minSplit=5, minRows=2, maxFeatures="sqrt" if classes else "all")
        self._set(**values)

    def _fit(self, rows: DataFrame) -> TreeSum:
        get = self.getOrDefault
        k = self.classes or 1
        plain = rows.select(vector_to_array("features").alias("f"), F.col("label").cast("double").alias("y"))
        shares = [F.avg(F.when(F.col("y") == c, 1.0).otherwise(0.0)) for c in range(k)] if self.classes else [F.avg("y")]
        n, width, spread, *root = plain.agg(F.count("*"), F.max(F.size("f")), F.coalesce(F.var_pop("y"), F.lit(0.0)), *shares).first()
        if not n:
            raise ValueError("no rows to fit")
        packed = durable(_dealt(_packed(plain), _tasks(n, 8 * width)), "packed")
        trees: list[Tree] = []
        for at in range(0, get(self.numTrees), self.block):
            block = [Tree() for _ in range(min(self.block, get(self.numTrees) - at))]
            for tree in block:
                tree.add(root)
            open_ = [(t, 0, n, spread) for t in range(len(block))] if n >= get(self.minSplit) and spread > 0 else []
            for _ in range(get(self.maxDepth)):
                fresh = []
                most = max(1, MOST_CELLS // (width * (2 + k) * 2))
                for part in range(0, len(open_), most):
                    fresh += self._level(packed, block, at, open_[part: part + most], width, k)
                open_ = fresh
                if not open_:
                    break
            trees += block
        return TreeSum(trees, [0.0] * k, "mean", width)

    def candidates(self, tree: int, node: int, width: int) -> list[int]:
        """The features that a node tries."""
        most = self.getOrDefault(self.maxFeatures)
        many = width if most == "all" else max(1, int(np.sqrt(width))) if most == "sqrt" else max(1, int(float(most) * width))
        if many >= width:
            return list(range(width))
        return sorted(sorted(range(width), key=lambda f: uniform(self.seed, "try", tree, node, f))[:many])

    def _level(self, packed, block, first, open_, width, k) -> list[tuple]:
        """Splits the open nodes; returns the children that are open."""
        get = self.getOrDefault
        spark = packed.sparkSession
        shared = spark.sparkContext.broadcast((block, [(t, node) for t, node, *_ in open_]))
        ranges = packed.mapInArrow(lambda b: _range_sums(b, shared, width), "slot int, f int, lo double, hi double")
        found = spark.sql("SELECT slot, f, min(lo) AS lo, max(hi) AS hi FROM {r} GROUP BY slot, f", r=ranges).collect()
        cuts = np.full((len(open_), width), np.nan)
        tried = [set(self.candidates(first + t, node, width)) for t, node, *_ in open_]
        for row in found:
            t, node = open_[row["slot"]][:2]
            if row["hi"] > row["lo"] and row["f"] in tried[row["slot"]]:
                cuts[row["slot"], row["f"]] = row["lo"] + uniform(self.seed, "cut", first + t, node, row["f"]) * (row["hi"] - row["lo"])
        drawn = spark.sparkContext.broadcast(cuts)
        classes = self.classes
        sums = packed.mapInArrow(lambda b: _cut_sums(b, shared, drawn, width, classes), "slot int, f int, low array<double>, high array<double>")
        names = [f"{side}[{i}]" for side in ("low", "high") for i in range(k + (1 if classes else 2))]
        totals = ", ".join(f"sum({x}) AS s{i}" for i, x in enumerate(names))
        best: dict = {}
        half = len(names) // 2
        for row in sorted(spark.sql(f"SELECT slot, f, {totals} FROM {{s}} GROUP BY slot, f", s=sums).collect(), key=lambda r: (r.slot, r.f)):
            low, high = np.array(row[2: 2 + half]), np.array(row[2 + half:])
            if min(low[0], high[0]) < get(self.minRows):
                continue
            (vl, il), (vh, ih), (_, whole) = (_summary(x, classes) for x in (low, high, low + high))
            gain = whole * (low[0] + high[0]) - il * low[0] - ih * high[0]
            if gain > 1e-12 and gain > best.get(row["slot"], (0.0,))[0] * (1 + 1e-10):
                best[row["slot"]] = (gain, row["f"], vl, vh, il, ih, low[0], high[0])
        fresh = []
        for slot, (gain, f, vl, vh, il, ih, nl, nh) in sorted(best.items()):
            t, node = open_[slot][:2]
            a, b = block[t].split(node, f, cuts[slot, f], gain, vl, vh)
            fresh += [(t, x, n, i) for x, n, i in ((a, nl, il), (b, nh, ih)) if n >= get(self.minSplit) and i > 1e-12]
        return fresh


def _summary(s: np.ndarray, classes: int | None) -> tuple[list[float], float]:
    """(value, impurity) from (n, sums): the mean and the variance, or the shares of the classes and the Gini impurity."""
    if classes is None:
        mean = s[1] / s[0]
        return [float(mean)], max(0.0, float(s[2] / s[0] - mean * mean))
    p = s[1:] / s[0]
    return [float(x) for x in p], float(1 - (p * p).sum())


def _packed(plain: DataFrame) -> DataFrame:
    """(y, f): the features as bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                X = batch.column(1).values.to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in X], pa.binary())], names=["y", "f"])

    return plain.select("y", "f").mapInArrow(run, "y double, f binary")


def _slots(block: list[Tree], open_: list[tuple], X: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per tree the rows that lie in open nodes, ordered by slot, and their slots."""
    by_tree: dict[int, list] = {}
    for slot, (t, node) in enumerate(open_):
        by_tree.setdefault(t, []).append((node, slot))
    for t, pairs in by_tree.items():
        table = np.full(len(block[t].feature), -1)
        for node, slot in pairs:
            table[node] = slot
        slot = table[block[t].nodes_of(X)]
        rows = np.flatnonzero(slot >= 0)
        rows = rows[np.argsort(slot[rows], kind="stable")]
        if len(rows):
            yield rows, slot[rows]


def _range_sums(batches, shared, width):
    block, open_ = shared.value
    lo, hi = np.full((len(open_), width), np.inf), np.full((len(open_), width), -np.inf)
    for batch in batches:
        if not len(batch):
            continue
        X = _matrix(batch.column(1), np.float64, width)
        for rows, slot in _slots(block, open_, X):
            at = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
            lo[slot[at]] = np.minimum(lo[slot[at]], np.minimum.reduceat(X[rows], at, axis=0))
            hi[slot[at]] = np.maximum(hi[slot[at]], np.maximum.reduceat(X[rows], at, axis=0))
    slot, f = np.nonzero(hi >= lo)
    if len(slot):
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(lo[slot, f]),
                                          pa.array(hi[slot, f])], names=["slot", "f", "lo", "hi"])


def _cut_sums(batches, shared, drawn, width, classes):
    block, open_ = shared.value
    cuts = drawn.value
    many = 1 + (classes or 2)
    low, high = np.zeros((len(open_), width, many)), np.zeros((len(open_), width, many))
    for batch in batches:
        if not len(batch):
            continue
        y, X = batch.column(0).to_numpy(), _matrix(batch.column(1), np.float64, width)
        w = np.column_stack([np.ones(len(y)), y, y * y]) if classes is None else np.column_stack(
            [np.ones(len(y)), y[:, None] == np.arange(classes)]).astype(float)
        for rows, slot in _slots(block, open_, X):
            at = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
            whole = np.add.reduceat(w[rows], at, axis=0)
            below = (X[rows] <= cuts[slot]).astype(float)
            part = np.stack([np.add.reduceat(below * w[rows, j, None], at, axis=0) for j in range(many)], axis=2)
            low[slot[at]] += part
            high[slot[at]] += whole[:, None, :] - part
    slot, f = np.nonzero(~np.isnan(cuts) & (low[:, :, 0] + high[:, :, 0] > 0))
    if len(slot):
        yield pa.RecordBatch.from_arrays(
            [pa.array(slot.astype(np.int32)), pa.array(f.astype(np.int32)),
             *(pa.FixedSizeListArray.from_arrays(pa.array(x[slot, f].ravel()), many).cast(pa.list_(pa.float64())) for x in (low, high))],
            names=["slot", "f", "low", "high"])
