"""Nearest neighbours and clusters."""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.ordering import dense_number
from tabloom.session import durable


# ---------------------------------------------------------------- k nearest neighbours

#: Reference rows of a cell, rows of a block that one task takes, and the most cells (their centres are sent to all tasks).
CELL_ROWS, BLOCK_ROWS, MOST_CELLS = 2_000, 20_000, 4_096
#: Pairs whose distances a task holds at once, and numbers of the pairs that it measures at once.
PAIRS, NUMBERS = 1_000_000, 4_000_000
#: Share of the squared lengths by which a squared distance from a product of matrices may be off, with room to spare.
SLACK = 1e-11


def _ward(na, nb, squares):
    """The height at which clusters of these sizes merge, from the squared distance of their centres."""
    return np.sqrt(2 * na * nb / (na + nb) * squares)


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _at_least(V: np.ndarray, C: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, none too large: products of matrices less what they may be off."""
    v, c = (V * V).sum(axis=1), (C * C).sum(axis=1)
    squares = V @ C.T
    squares *= -2
    squares += c * (1 - SLACK)
    squares += (v * (1 - SLACK))[:, None]
    return squares


def _possible(Q: np.ndarray, qn: np.ndarray, top: np.ndarray, R: np.ndarray, rn: np.ndarray, ward: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, row): all pairs whose squared height may be at most `top`, told by one product of matrices.

    |q - r|² 2 nq nr / (nq + nr) <= t is |q|² - 2 qr + |r|² - t / (2 nq) - t / (2 nr) <= 0; without sizes both shares are t / 2.
    Singles are enough where no number is near their bounds; what they may be off is taken from the squared lengths.
    """
    q2, r2 = (Q * Q).sum(axis=1), (R * R).sum(axis=1)
    share = top / (2 if ward else 1)
    finite = share[np.isfinite(share)]
    largest = max(q2.max(), r2.max(), finite.max() if len(finite) else 0.0)
    kind = np.float32 if 1e-20 < largest < 1e30 else np.float64
    slack = 4 * (Q.shape[1] + 8) * float(np.finfo(kind).eps)
    # every number is below the largest one by a bounded factor, or too small to matter beside the slack
    end = np.where(np.isfinite(share), share, 4 * largest if not ward else 4 * largest * (qn.max() + rn.max()))
    left = np.column_stack([-2 * Q, q2 * (1 - slack) - (end / qn if ward else end) * (1 + slack) - 1e-30, np.ones(len(Q))])
    right = np.column_stack([R, np.ones(len(R)), r2 * (1 - slack)])
    if ward:
        left = np.column_stack([left, -end * (1 + slack)])
        right = np.column_stack([right, 1 / rn])
    hit = np.flatnonzero(left.astype(kind) @ right.astype(kind).T <= 0)
    return hit // len(R), hit % len(R)


def _first_k(keys: list[np.ndarray], query: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first rows of each query in the order of `keys`, by query."""
    order = np.lexsort([*keys[::-1], query])
    sorted_ = query[order]
    starts = np.r_[0, np.flatnonzero(np.diff(sorted_)) + 1] if len(order) else np.zeros(0, dtype=int)
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[nth < k]


def _best(q: dict, at: np.ndarray, r: dict, rows: np.ndarray, k: int, ward: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance): for the queries `at` their k best of the reference `rows`, none farther than their limit.

    `q` and `r` hold ids, vectors and sizes; q["limit"] falls where k rows are found.  Products of matrices rule most pairs
    out; the others are measured one by one, so the distances are those of a plain difference.
    """
    found: list[tuple] = []
    R, rn, rid = r["vec"][rows], r["n"][rows], r["id"][rows]
    middle = R.mean(axis=0)
    R_mid = R - middle
    longest = (R_mid * R_mid).sum(axis=1).max()
    step = max(1, PAIRS // len(rows))
    for part in (at[s: s + step] for s in range(0, len(at), step)):
        Q_mid, qn, limit = q["vec"][part] - middle, q["n"][part], q["limit"][part]
        top = limit * limit * (1 + 1e-9)
        blind = np.flatnonzero(~np.isfinite(limit))
        if len(blind) and len(rows) >= k:
            low = _at_least(Q_mid[blind], R_mid)
            if ward:
                low *= 2 * qn[blind, None] * rn[None] / (qn[blind, None] + rn[None])
                low[q["id"][part[blind], None] == rid[None]] = np.inf  # also where an id comes more than once
            off = 2 * SLACK * ((Q_mid[blind] ** 2).sum(axis=1) + longest) * (2 * qn[blind] if ward else 1.0)
            top[blind] = np.maximum(np.partition(low, k - 1, axis=1)[:, k - 1], 0) * (1 + 1e-9) + off * 2
        qi, rj = _possible(Q_mid, qn, top, R_mid, rn, ward)
        if ward:
            other = q["id"][part][qi] != rid[rj]
            qi, rj = qi[other], rj[other]
        if not len(qi):
            continue
        dist, piece = np.empty(len(qi)), max(1, NUMBERS // R.shape[1])
        for s in range(0, len(qi), piece):
            x, y = qi[s: s + piece], rj[s: s + piece]
            squares = ((q["vec"][part[x]] - R[y]) ** 2).sum(axis=1)
            dist[s: s + piece] = _ward(qn[x], rn[y], squares) if ward else np.sqrt(squares)
        ids, others = q["id"][part][qi], rid[rj]
        # equal heights: the pair with the smaller ids, the same from both ends
        keys = [dist, np.minimum(ids, others), np.maximum(ids, others)] if ward else [dist, others]
        keep = _first_k(keys, qi, k)
        qi, rj, dist = qi[keep], rj[keep], dist[keep]
        last = np.r_[np.flatnonzero(np.diff(qi)), len(qi) - 1]
        full = last[np.diff(np.r_[-1, last]) == k]
        q["limit"][part[qi[full]]] = np.minimum(limit[qi[full]], dist[full])
        found.append((part[qi], rows[rj], dist))
    none = np.zeros(0, dtype=int)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none, np.zeros(0))


def _side(pdf: pd.DataFrame, id_: str) -> dict:
    return {"id": pdf[id_].to_numpy(), "vec": _vectors(pdf["vec"]), "n": pdf["n"].to_numpy(float)}


def _reference(pdf: pd.DataFrame, k: int, ward: bool) -> tuple[pd.DataFrame, dict]:
    """Reference rows in the order of their ids; of rows with equal vectors and sizes the k + 1 first ones are enough.

    Where a row must not meet its own id, these are the k + 1 first ids.
    """
    pdf = pdf.sort_values("rid")
    r = _side(pdf, "rid")
    same = pd.factorize(np.array([*(v.tobytes() for v in np.column_stack([r["vec"], r["n"]])), None], dtype=object)[:-1])[0]
    ids = pd.DataFrame({"same": same, "id": r["id"]})
    new = ~ids.duplicated().to_numpy() if ward else np.ones(len(ids), dtype=bool)
    few = new & (pd.Series(new).groupby(same).cumsum() <= k + 1).to_numpy()
    return pdf[few], {c: v[few] for c, v in r.items()}


def _answer(q: dict, pdf: pd.DataFrame, found: tuple) -> pd.DataFrame:
    return pd.DataFrame({"qid": q["id"][found[0]], "rid": pdf["rid"].to_numpy()[found[1]], "y": pdf["y"].to_numpy()[found[1]], "dist": found[2]})


_NO_ANSWER = {"qid": [], "rid": [], "y": [], "dist": []}
_ANSWER = "qid long, rid long, y double, dist double"


def _meet(queries: DataFrame, reference: DataFrame, k: int, block_rows: int, ward: bool) -> DataFrame:
    """The k best reference rows of each query within its own cell: (qid, rid, y, dist).

    A crowded cell is cut into blocks on both sides; a task meets one block of queries and one of
    reference rows and returns its k best per query.
    """
    blocks = lambda df, n: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(n))
    sizes = blocks(queries, "nq").join(blocks(reference, "nr"), "cell")
    return _meet_blocks(queries.join(sizes, "cell"), reference.join(sizes, "cell"), k, ward)


def _meet_blocks(queries: DataFrame, reference: DataFrame, k: int, ward: bool) -> DataFrame:
    """The k best per query and block of reference rows; both sides name the blocks of their cell, `nq` and `nr`."""
    slot = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # named anew, so that a table can meet itself
    named = lambda *names: [F.col(c).alias(c) for c in names]
    left = queries.select(*named("cell", "qid", "vec", "n"), slot("qid", "nq").alias("bq"), every("nr").alias("br"))
    right = reference.select(*named("cell", "rid", "vec", "n", "y"), slot("rid", "nr").alias("br"), every("nq").alias("bq"))

    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame(_NO_ANSWER)
        ask = {**_side(q, "qid"), "limit": np.full(len(q), np.inf)}
        r, ref = _reference(r, k, ward)
        return _answer(ask, r, _best(ask, np.arange(len(q)), ref, np.arange(len(r)), k, ward))

    keys = ["cell", "bq", "br"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, _ANSWER)


def _centres(reference: DataFrame, rows: int, cell_rows: int, seed: int = 42) -> np.ndarray:
    cells = min(MOST_CELLS, math.ceil(rows / cell_rows))
    ready = reference.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    if cells <= 1:
        return np.array([ready.select(Summarizer.mean(F.col("features"))).first()[0].toArray()])
    return np.array(KMeans(k=cells, seed=seed, maxIter=5, initMode="random").fit(ready).clusterCenters())


def _in_cells(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """The rows with the number of a nearest centre and the distance from it."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("off", T.DoubleType())])

    def place(frames):
        centre = shared.value
        step = max(1, PAIRS // len(centre))
        for whole in frames:
            for pdf in (whole.iloc[s: s + step] for s in range(0, len(whole), step)):
                V = _vectors(pdf["vec"])
                cell = _at_least(V, centre).argmin(axis=1)
                yield pdf.assign(cell=cell.astype("int32"), off=np.sqrt(((V - centre[cell]) ** 2).sum(axis=1)))

    return rows.mapInPandas(place, schema)


def _zones(counts: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first zone, zones) of each cell, and the number of zones; a zone holds about `block_rows` rows of one or more cells."""
    first, pieces, zones, room = np.zeros(len(counts), dtype=int), np.ones(len(counts), dtype=int), 0, 0
    for c, n in enumerate(counts):
        if n > block_rows:
            first[c], pieces[c] = zones, math.ceil(n / block_rows)
            zones, room = zones + pieces[c], 0
        else:
            if n > room:
                zones, room = zones + 1, block_rows
            first[c], room = zones - 1 if zones else 0, room - n
    return first, pieces, max(zones, 1)


class _Cells:
    """Centres, radii, least sizes and zones of the cells, and which of them may hold a row within a query's limit."""

    def __init__(self, centres: np.ndarray, placed: DataFrame, block_rows: int, ward: bool) -> None:
        self.centres, self.ward = centres, ward
        self.radius, self.least, self.counts = np.full(len(centres), -np.inf), np.ones(len(centres)), np.zeros(len(centres), dtype=int)
        for r in placed.groupBy("cell").agg(F.max("off").alias("r"), F.min("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect():  # one row per cell
            self.radius[r["cell"]], self.least[r["cell"]], self.counts[r["cell"]] = r["r"], r["n"], r["rows"]
        self.first, self.pieces, self.zones = _zones(self.counts, block_rows)

    def reached(self, V: np.ndarray, n: np.ndarray, limit: np.ndarray, own: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether a query must ask a cell; a distance may be off in its last bits."""
        gap = np.sqrt(np.maximum(_at_least(V, self.centres[cells]), 0)) - self.radius[cells]
        np.maximum(gap, 0, out=gap)
        floor = _ward(n[:, None], self.least[cells][None], gap * gap) if self.ward else gap
        far = np.where(np.isfinite(limit), limit * (1 + 1e-9) + 1e-9 * (1 + np.abs(np.where(np.isfinite(limit), limit, 0))), np.inf)
        return (floor <= far[:, None]) & (self.counts[cells] > 0)[None] & (own[:, None] != cells[None])

    def share(self) -> np.ndarray:
        """Rows of each cell in each zone."""
        out = np.zeros((len(self.centres), self.zones))
        for c in np.flatnonzero(self.counts).tolist():
            out[c, self.first[c]: self.first[c] + self.pieces[c]] = self.counts[c] / self.pieces[c]
        return out


def _further(asked: DataFrame, placed: DataFrame, cells: _Cells, k: int, block_rows: int, cells_asked: list | None) -> DataFrame:
    """The k best reference rows of each query in the cells beside its own that may hold one within its limit."""
    spark = placed.sparkSession
    shared = spark.sparkContext.broadcast(cells)

    @F.pandas_udf("array<struct<zone:int,rows:double>>")
    def reach(vec: pd.Series, n: pd.Series, limit: pd.Series, own: pd.Series) -> pd.Series:
        c = shared.value
        every, share, out = np.arange(len(c.centres)), c.share(), []
        step = max(1, PAIRS // len(every))
        for s in range(0, len(vec), step):
            cut = slice(s, s + step)
            hit = c.reached(_vectors(vec.iloc[cut]), n.iloc[cut].to_numpy(float), limit.iloc[cut].to_numpy(float), own.iloc[cut].to_numpy(), every)
            rows = hit @ share
            out += [[{"zone": int(z), "rows": float(x[z])} for z in np.flatnonzero(x)] for x in rows]
        return pd.Series(out, dtype=object)

    count = asked.count()
    # few rows are dealt to all cores all the same
    blocks = max(1, math.ceil(count / block_rows), min(spark.sparkContext.defaultParallelism, math.ceil(count / 1_000)))
    left = asked.withColumn("_z", F.explode(reach("vec", "n", "limit", "cell"))).select(
        "qid", "vec", "n", "limit", F.col("cell").alias("own"), F.col("_z.zone").alias("zone"), F.col("_z.rows").alias("rows"),
        F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("bq"))
    if cells_asked is not None:
        cells_asked.append(left.select("qid", "zone", "rows"))
    zones = spark.createDataFrame([(c, int(f), int(p)) for c, (f, p) in enumerate(zip(cells.first, cells.pieces))], "cell int, first int, pieces int")
    right = placed.join(F.broadcast(zones), "cell").select(
        "rid", "vec", "n", "y", "cell", (F.col("first") + F.pmod(F.xxhash64("rid"), "pieces")).cast("int").alias("zone"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("bq"))

    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame(_NO_ANSWER)
        c = shared.value
        ask = {**_side(q, "qid"), "limit": q["limit"].to_numpy(float).copy()}
        r, ref = _reference(r, k, c.ward)
        cell, own = r["cell"].to_numpy(), q["own"].to_numpy()
        found = []
        for here in np.unique(cell):
            hit = c.reached(ask["vec"], ask["n"], ask["limit"], own, np.array([here]))[:, 0]
            if hit.any():
                found.append(_best(ask, np.flatnonzero(hit), ref, np.flatnonzero(cell == here), k, c.ward))
        if not found:
            return pd.DataFrame(_NO_ANSWER)
        qi, rj, dist = (np.concatenate(x) for x in zip(*found))
        ids, others = ask["id"][qi], ref["id"][rj]
        keep = _first_k([dist, np.minimum(ids, others), np.maximum(ids, others)] if c.ward else [dist, others], qi, k)
        return _answer(ask, r, (qi[keep], rj[keep], dist[keep]))

    keys = ["zone", "bq"]
    return left.drop("rows").groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, _ANSWER)


def _search(queries: DataFrame, reference: DataFrame, k: int, block_rows: int, centres: np.ndarray, pick, ward: bool = False,
            cells_asked: list | None = None) -> DataFrame:
    """The k best of reference (rid, vec, n, y) for each of queries (qid, vec, n), as `pick` chooses them: (qid, rid, y, dist)."""
    right = durable(_in_cells(reference, centres), "cells")
    left = durable(_in_cells(queries, centres), "asked")
    own = _meet(left, right, k, block_rows, ward)
    if len(centres) == 1:
        return pick(own)
    own = durable(pick(own), "own")
    kth = own.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).otherwise(float("inf")).alias("limit"))
    asked = left.drop("off").join(kth, "qid", "left").fillna(float("inf"), ["limit"])
    return pick(own.unionByName(_further(asked, right, _Cells(centres, right, block_rows, ward), k, block_rows, cells_asked)))


def nearest(queries: DataFrame, reference: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS,
            cells_asked: list | None = None) -> DataFrame:
    """Exact k nearest reference rows per query: (qid, rid, y, dist).

    Inputs: queries (qid, vec), reference (rid, vec, y).  Reference rows lie in k-means cells with a
    radius.  A query first meets its own cell; then only cells whose centre is nearer than its k-th
    distance so far plus their radius can hold a better row, and these it meets too.  A task takes a
    block of queries and a zone of cells, so a row moves once per block and not once per query.  No pair
    list is built.  `cells_asked`, where given, receives the table of further rows asked for reports.
    """
    ranked = Window.partitionBy("qid").orderBy("dist", "rid")
    first_k = lambda df: df.withColumn("_r", F.row_number().over(ranked)).filter(F.col("_r") <= k).drop("_r")
    right = reference.select(F.col("rid").cast("long").alias("rid"), "vec", F.lit(1.0).alias("n"), F.col("y").cast("double").alias("y"))
    rows = right.count()
    if not rows:
        return queries.select(F.col("qid").cast("long").alias("qid"), F.lit(0).cast("long").alias("rid"), F.lit(0.0).alias("y"),
                              F.lit(0.0).alias("dist")).limit(0)
    left = queries.select(F.col("qid").cast("long").alias("qid"), "vec", F.lit(1.0).alias("n"))
    return _search(left, right, k, block_rows, _centres(right, rows, cell_rows), first_k, cells_asked=cells_asked)


def _weights(neighbours: DataFrame) -> DataFrame:
    """1 / distance; where a neighbour coincides, only coinciding ones count."""
    any_zero = F.max(F.when(F.col("dist") == 0, 1).otherwise(0)).over(Window.partitionBy("qid"))
    w = F.when(any_zero == 1, F.when(F.col("dist") == 0, 1.0).otherwise(0.0)).otherwise(F.try_divide(F.lit(1.0), F.col("dist")))
    return neighbours.withColumn("w", w)


def knn_regress(neighbours: DataFrame) -> DataFrame:
    """M8: distance-weighted mean."""
    return _weights(neighbours).groupBy("qid").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("yhat"))


def knn_classify(neighbours: DataFrame) -> DataFrame:
    """M8: distance-weighted vote, ties to the smallest class."""
    votes = _weights(neighbours).groupBy("qid", "y").agg(F.sum("w").alias("v"))
    return votes.groupBy("qid").agg(F.min_by("y", F.struct(-F.col("v"), F.col("y"))).alias("yhat"))


class KNeighbors(Estimator):
    """M8 as an estimator: keeps the training rows and asks them; regression or classification."""

    def __init__(self, k: int = 5, classes: int | None = None) -> None:
        super().__init__()
        self.k, self.classes = k, classes

    def _fit(self, rows: DataFrame) -> KNeighborsModel:
        kept = rows.select(F.monotonically_increasing_id().alias("rid"), vector_to_array("features").alias("vec"), F.col("label").alias("y"))
        return KNeighborsModel(durable(kept, "neighbours"), self.k, self.classes)


class KNeighborsModel(Model):
    """Adds `prediction`, and for classes `probability`, to rows with `features`."""

    def __init__(self, rows: DataFrame, k: int, classes: int | None) -> None:
        super().__init__()
        self.rows, self.k, self.classes = rows, k, classes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # written once, so that a row keeps its number in the search and in the join back
        asked = durable(dataset.withColumn("_qid", F.monotonically_increasing_id()), "asked")
        found = nearest(asked.select(F.col("_qid").alias("qid"), vector_to_array("features").alias("vec")), self.rows, self.k)
        if self.classes is None:
            out = knn_regress(found).withColumnRenamed("yhat", "prediction")
        else:
            votes = _weights(found).groupBy("qid").agg(*[
                (F.sum(F.when(F.col("y") == c, F.col("w")).otherwise(0.0)) / F.sum("w")).alias(f"_p{c}") for c in range(self.classes)])
            out = votes.select("qid", array_to_vector(F.array(*[f"_p{c}" for c in range(self.classes)])).alias("probability")).join(
                knn_classify(found).withColumnRenamed("yhat", "prediction"), "qid")
        return asked.join(out, asked["_qid"] == out["qid"], "left").drop("_qid", "qid")

    def save_rows(self, path: str) -> None:
        self.rows.withColumns({"_k": F.lit(self.k), "_classes": F.lit(self.classes).cast("int")}).write.mode("overwrite").parquet(path)

    @classmethod
    def load_rows(cls, spark: SparkSession, path: str) -> KNeighborsModel:
        rows = spark.read.parquet(path)
        k, classes = rows.select("_k", "_classes").first()
        return cls(rows.drop("_k", "_classes"), k, classes)


# ---------------------------------------------------------------- centres

def kmeans(rows: DataFrame, k: int = 5, seed: int = 42, max_iter: int = 300) -> DataFrame:
    """Rows with a `features` vector get a `cluster`."""
    return KMeans(k=k, seed=seed, maxIter=max_iter).fit(rows).transform(rows).withColumnRenamed("prediction", "cluster")


#: Clusters that one task merges to the end, and pairs up to which all that ask meet all clusters without cells.
FINISH, DIRECT = 4_096, 2_000_000_000


def nearest_clusters(clusters: DataFrame, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, asking: DataFrame | None = None,
                     centres: np.ndarray | None = None, counts: tuple[int, int] | None = None) -> DataFrame:
    """(id, other, height): the cluster with which each of (id, vec, n) merges at the least height, exactly.

    A cluster first asks its own cell, then the cells that may hold a better one: a cell's clusters are no nearer than its
    centre less its radius and no smaller than its smallest one.  `asking` names some of the clusters where not all ask,
    `centres` the cells where they are known.  `counts`, how many ask and how many there are, is given where all that ask
    shall meet all clusters, in blocks for all cores: few pairs cost less than the tables of the cells.
    """
    def pick(df: DataFrame) -> DataFrame:
        ends = F.struct("dist", F.least("qid", "rid").alias("lo"), F.greatest("qid", "rid").alias("hi"))
        return df.groupBy("qid").agg(F.min(ends).alias("m")).select(
            "qid", F.when(F.col("m.lo") == F.col("qid"), F.col("m.hi")).otherwise(F.col("m.lo")).alias("rid"), F.lit(0.0).alias("y"), "m.dist")

    side = lambda df, name: df.select(F.col("id").cast("long").alias(name), "vec", F.col("n").cast("double").alias("n"))
    left, right = side(clusters if asking is None else asking, "qid"), side(clusters, "rid").withColumn("y", F.lit(0.0))
    if counts:
        spark = clusters.sparkSession
        rows = max(1, min(block_rows, math.isqrt(counts[0] * counts[1] // (4 * spark.sparkContext.defaultParallelism))))
        sizes = spark.createDataFrame([(0, *(max(1, math.ceil(c / rows)) for c in counts))], "cell int, nq int, nr int")
        found = pick(_meet_blocks(left.crossJoin(F.broadcast(sizes)), right.crossJoin(F.broadcast(sizes)), 1, True))
    else:
        if centres is None:
            centres = _centres(clusters, clusters.count(), cell_rows)
        found = _search(left, right, 1, block_rows, centres, pick, ward=True)
    return found.select(F.col("qid").alias("id"), F.col("rid").alias("other"), F.col("dist").alias("height"))


def mutual_pairs(nearest_: DataFrame) -> DataFrame:
    """(a, b, height), a < b: clusters that are each other's nearest."""
    pairs = nearest_.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "height")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("ends"), F.min("height").alias("height")).filter("ends = 2").drop("ends")


def ward_merges(points: DataFrame, finish: int = FINISH, cell_rows: int = CELL_ROWS, asked: list | None = None) -> DataFrame:
    """(a, b, height): all merges of Ward's method on (id, vec), clusters being named by their smallest id.

    Ward's heights never fall and a merge never brings a third cluster nearer, so all pairs that are each other's nearest
    merge in one round and the tree is that of merging one pair at a time.  For the same reason a cluster keeps its nearest
    one until either of both merges; only the others ask again.  Equal vectors merge first, at height 0.  The last `finish`
    clusters are merged by one task.  `asked`, where given, receives the number of clusters that asked in each round.
    """
    same = points.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).cast("double").alias("n"))
    clusters = durable(same, "clusters")
    copies = points.join(clusters.filter("n > 1").select("vec", F.col("id").alias("a")), "vec").filter("id <> a")
    merges = [durable(copies.select("a", F.col("id").alias("b"), F.lit(0.0).alias("height")), "merges")]
    left, near, centres, fitted = clusters.count(), None, None, 0
    while left > max(1, finish):
        stale = clusters if near is None else durable(clusters.join(near.select("id"), "id", "left_anti"), "stale")
        asks = left if near is None else stale.count()
        if asked is not None:
            asked.append(asks)
        direct = asks * left <= DIRECT
        if not direct and (centres is None or 2 * left < fitted):
            centres, fitted = _centres(clusters, left, cell_rows), left
        found = nearest_clusters(clusters, cell_rows, asking=stale, centres=centres, counts=(asks, left) if direct else None)
        fresh = near is None
        near = durable(found if fresh else near.unionByName(found), "nearest")
        pairs = durable(mutual_pairs(near), "pairs")
        merged = pairs.count()
        if not merged:
            if fresh:
                raise ValueError("no cluster has a nearest one; do the vectors hold numbers only?")
            near = None  # heights that differ in their last bits; all ask again
            continue
        ends = pairs.select("a", F.col("a").alias("id")).unionByName(pairs.select("a", F.col("b").alias("id")))
        # the centre of a pair is the mean of both, weighted by their sizes; the other clusters stay
        named = clusters.join(ends, "id", "left").withColumn("to", F.coalesce("a", "id"))
        part = F.transform("vec", lambda v: v * F.col("n"))
        joined = named.filter("a is not null").groupBy("to").agg(F.collect_list(part).alias("parts"), F.sum("n").alias("n"))
        joined = joined.select(F.zip_with(F.col("parts")[0], F.col("parts")[1], lambda x, y: (x + y) / F.col("n")).alias("vec"),
                               F.col("to").alias("id"), "n")
        clusters = durable(joined.unionByName(named.filter("a is null").select("vec", "id", "n")), "clusters")
        gone = ends.select("id")
        near = near.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "other"), "other", "left_anti").select(
            "id", "other", "height")
        merges.append(pairs)
        left -= merged
    if left > 1:
        merges.append(clusters.groupBy(F.lit(0).alias("_all")).applyInPandas(_merge_all, "a long, b long, height double"))
    return functools.reduce(DataFrame.unionByName, merges)


def _merge_all(pdf: pd.DataFrame) -> pd.DataFrame:
    """All merges of a few clusters, one pair at a time; the least height of each row is kept, so that a merge reads few rows."""
    pdf = pdf.sort_values("id")
    C, n, ids = _vectors(pdf["vec"]), pdf["n"].to_numpy(float).copy(), pdf["id"].to_numpy()
    H = np.stack([_ward(n[i], n, ((C - C[i]) ** 2).sum(axis=1)) for i in range(len(ids))])
    np.fill_diagonal(H, np.inf)
    near = H.argmin(axis=1)
    least = H[np.arange(len(ids)), near]
    out = []
    for _ in range(len(ids) - 1):
        i = int(least.argmin())
        i, j = sorted((i, int(near[i])))
        out.append((ids[i], ids[j], H[i, j]))
        C[i], n[i] = (C[i] * n[i] + C[j] * n[j]) / (n[i] + n[j]), n[i] + n[j]
        live = np.flatnonzero(np.isfinite(H[i]))
        live = live[live != j]
        H[j], H[:, j], H[i] = np.inf, np.inf, np.inf
        H[i, live] = _ward(n[i], n[live], ((C[live] - C[i]) ** 2).sum(axis=1))
        H[:, i] = H[i]
        least[j] = np.inf
        again = live[(near[live] == i) | (near[live] == j)]
        again = np.r_[i, again]
        near[again] = H[again].argmin(axis=1)
        least[again] = H[again, near[again]]
        closer = live[H[live, i] < least[live]]
        near[closer], least[closer] = i, H[closer, i]
    return pd.DataFrame(out, columns=["a", "b", "height"])


def agglomerative(rows: DataFrame, k: int = 5, key: str | None = None, finish: int = FINISH) -> DataFrame:
    """Ward clusters of rows with a `features` vector: the k - 1 highest merges are taken back.

    Clusters are numbered by their smallest row; rows without a key column are numbered first.
    """
    named = rows.withColumn("_id", F.col(key).cast("long") if key else F.monotonically_increasing_id())
    named = durable(named, "rows")
    merges = durable(ward_merges(named.select(F.col("_id").alias("id"), vector_to_array("features").alias("vec")), finish), "merges")
    high = merges.orderBy(F.desc("height"), F.desc("a"), F.desc("b")).limit(k - 1)
    kept = merges.join(high.select("a", "b"), ["a", "b"], "left_anti")
    roots = components(named.select(F.col("_id").alias("node")).distinct(), kept)
    number = dense_number(roots.select("root").distinct(), [], "root", "cluster")
    labels = roots.join(number, "root").select(F.col("node").alias("_id"), F.col("cluster").cast("int").alias("cluster"))
    return named.join(labels, "_id").drop("_id")


# ---------------------------------------------------------------- density

def _sq(cols: list[str], a: str, b: str) -> Column:
    total = F.lit(0.0)
    for c in cols:
        d = F.col(f"{a}{c}") - F.col(f"{b}{c}")
        total = total + d * d
    return total


def _cell(cols: list[str], side: float, prefix: str = "") -> Column:
    return F.array(*[F.floor(F.col(f"{prefix}{c}") / F.lit(side)).cast("long") for c in cols])


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): smallest reachable node.

    Each round every root moves to the smallest root next to any of its members, and the moves are
    followed eight steps far, so the number of rounds grows with the logarithm of the longest
    chain.  Rounds are written to the shared folder; a lost executor costs one round at most.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = durable(both.distinct(), "edges")
    label = durable(nodes.select("node", F.col("node").alias("root")), "roots")
    while True:
        of = lambda n: label.select(F.col("node").alias(n), F.col("root").alias(f"{n}_root"))
        touching = both.join(of("a"), "a").join(of("b"), "b").groupBy(F.col("a_root").alias("root")).agg(
            F.min("b_root").alias("to"))
        moves = durable(touching.filter(F.col("to") < F.col("root")), "moves")
        if moves.limit(1).count() == 0:
            return label
        jump = moves
        for _ in range(3):
            onward = jump.select(F.col("root").alias("to"), F.col("to").alias("_next"))
            jump = jump.join(onward, "to", "left").select("root", F.coalesce("_next", "to").alias("to"))
        label = durable(label.join(jump, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")


def _linked_cells(core: DataFrame, cols: list[str], eps: float, side: float, around: list[tuple], factor: int = 8) -> DataFrame:
    """Pairs of neighbouring cells that hold two core points within eps of each other.

    Compares bounding boxes and one representative per box; only boxes that stay undecided are
    split, so two crowded cells never meet point by point.  Splitting ends at single points.
    """
    def boxes(points: DataFrame, key: list[str]) -> DataFrame:
        return points.groupBy(*key).agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))],
                                        F.min_by(F.struct(*cols), "id").alias("rep"))

    def sided(b: DataFrame, s: str) -> DataFrame:
        return b.select(*[F.col(c).alias(f"{s}_{c}") for c in b.columns])

    def decide(pairs: DataFrame) -> DataFrame:
        gap, far, rep = F.lit(0.0), F.lit(0.0), F.lit(0.0)
        for c in cols:
            apart = F.greatest(F.col(f"a_lo_{c}") - F.col(f"b_hi_{c}"), F.col(f"b_lo_{c}") - F.col(f"a_hi_{c}"), F.lit(0.0))
            widest = F.greatest(F.col(f"a_hi_{c}") - F.col(f"b_lo_{c}"), F.col(f"b_hi_{c}") - F.col(f"a_lo_{c}"))
            d = F.col("a_rep")[c] - F.col("b_rep")[c]
            gap, far, rep = gap + apart * apart, far + widest * widest, rep + d * d
        e2 = F.lit(eps * eps)
        state = F.when((rep <= e2) | (far <= e2), "linked").when(gap > e2, "apart").otherwise("open")
        return pairs.withColumn("state", state).filter("state != 'apart'")

    whole = boxes(core, ["cell"])
    shift = F.array(*[F.array(*[F.lit(int(v)) for v in o]) for o in around if o > tuple([0] * len(cols))])
    a = sided(whole, "a").withColumn("_o", F.explode(shift))
    a = a.withColumn("b_cell", F.zip_with("a_cell", "_o", lambda x, y: x + y)).drop("_o")
    state = durable(decide(a.join(sided(whole, "b"), "b_cell")), "pairs")
    linked = state.filter("state = 'linked'").select("a_cell", "b_cell").distinct()
    open_ = state.filter("state = 'open'").select("a_cell", "b_cell", F.col("a_cell").alias("a_sub"), F.col("b_cell").alias("b_sub"))
    level = side
    while open_.limit(1).count():
        finer = level / factor
        sub = core.withColumn("up", _cell(cols, level)).withColumn("sub", _cell(cols, finer))
        busy = open_.select(F.col("a_sub").alias("up")).unionByName(open_.select(F.col("b_sub").alias("up"))).distinct()
        small = durable(boxes(sub.join(busy, "up", "left_semi"), ["cell", "up", "sub"]), "boxes")
        left = sided(small, "a").withColumnsRenamed({"a_sub": "a_new", "a_up": "a_sub"})
        right = sided(small, "b").withColumnsRenamed({"b_sub": "b_new", "b_up": "b_sub"})
        pairs = open_.join(left, ["a_cell", "a_sub"]).join(right, ["b_cell", "b_sub"])
        state = durable(decide(pairs).select("a_cell", "b_cell", "a_new", "b_new", "state"), "pairs")
        linked = durable(linked.unionByName(state.filter("state = 'linked'").select("a_cell", "b_cell")).distinct(), "linked")
        open_ = state.filter("state = 'open'").join(linked, ["a_cell", "b_cell"], "left_anti").select(
            "a_cell", "b_cell", F.col("a_new").alias("a_sub"), F.col("b_new").alias("b_sub"))
        level = finer
    return linked


def dbscan(points: DataFrame, cols: list[str], eps: float = 0.5, min_pts: int = 3, piece: int = 100_000) -> DataFrame:
    """Exact density clusters of (id, cols…) in up to four dimensions: (id, is_core, cluster).

    The grid has side eps/√d: a cell with min_pts points is all core, and every other point sits
    in a cell with fewer than min_pts, so each point takes part in a bounded number of distance
    tests however crowded a cell is; cells above `piece` points are asked in pieces.  Clusters are numbered by their first core point, noise is
    −1, and a border point joins the lowest-numbered cluster that reaches it.
    """
    d = len(cols)
    if d > 4:
        raise ValueError("reduce the data to at most four dimensions first")
    side = eps / math.sqrt(d)
    reach = math.ceil(math.sqrt(d))
    around = [o for o in itertools.product(range(-reach, reach + 1), repeat=d)]
    rows = points.select("id", *[F.col(c).cast("double").alias(c) for c in cols]).withColumn("cell", _cell(cols, side))
    counts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
    pieces = F.ceil(F.col("_n") / piece)
    rows = durable(rows.join(counts, "cell").withColumn("_salt", F.pmod(F.xxhash64("id"), pieces)), "points")

    sparse = rows.filter(F.col("_n") < min_pts).select("id", "cell", *[F.col(c).alias(f"p_{c}") for c in cols])
    shift = F.array(*[F.array(*[F.lit(int(v)) for v in o]) for o in around])
    full = rows.groupBy("cell").agg((F.max("_salt") + 1).alias("_pieces"))
    asks = sparse.withColumn("_o", F.explode(shift)).withColumn(
        "cell", F.zip_with("cell", "_o", lambda x, y: x + y)).drop("_o").join(full, "cell").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1))).drop("_pieces")
    others = rows.select("cell", "_salt", F.col("id").alias("qid"), *[F.col(c).alias(f"q_{c}") for c in cols])
    close = asks.join(others, ["cell", "_salt"]).filter(_sq(cols, "p_", "q_") <= eps * eps)
    close = durable(close.select("id", "qid"), "close")
    sparse_core = close.groupBy("id").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") >= min_pts).select("id")
    core = durable(rows.filter(F.col("_n") >= min_pts).select("id", "cell", *cols).unionByName(
        rows.join(sparse_core, "id", "left_semi").select("id", "cell", *cols)), "core")

    cells = core.groupBy("cell").agg(F.min("id").alias("node"))
    name = lambda side_: cells.select(F.col("cell").alias(f"{side_}_cell"), F.col("node").alias(side_))
    edges = _linked_cells(core, cols, eps, side, around).join(name("a"), "a_cell").join(name("b"), "b_cell")
    roots = components(cells.select("node"), edges)
    clusters = roots.select("root").distinct()
    number = dense_number(clusters, [], "root", "cluster")
    of_cell = cells.join(roots, "node").join(number, "root").select("cell", "cluster")
    of_core = core.join(of_cell, "cell").select("id", "cluster")
    border = close.join(of_core.withColumnRenamed("id", "qid"), "qid").groupBy("id").agg(F.min("cluster").alias("_c"))
    return (
        rows.select("id").join(of_core, "id", "left").join(border, "id", "left")
        .select("id", F.when(F.col("cluster").isNotNull(), 1).otherwise(0).alias("is_core"),
                F.coalesce("cluster", "_c", F.lit(-1)).alias("cluster"))
    )
