"""Embedding near-duplicates by graph search over overlapping shards.

Vectors go to the shards of their nearest centres.  Each shard gets a flat graph with robust-pruned
edges; the edge lists that a vector got in its shards are united, and what leads to a member of a shard
is walked there.  Every vector is searched for in its shards from the medoid, greedily, and once it is
within reach of the wanted similarity the search expands over everything in range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import components
from tabloom.session import durable

MIN_COSINE = 0.9
#: Wanted vectors of a shard, and the most that one task takes; larger shards are searched in pieces.
SHARD = 2_000
PIECE = 6_000
#: Shards that a vector goes to.
OVERLAP = 3
#: The centres are fitted on a bounded sample of this many vectors; every vector is indexed.
SAMPLE = 20_000
MOST_CENTRES = 4_096
#: Edges per vector, beam of the search, and the slack of robust pruning.
DEGREE = 24
BEAM = 48
ALPHA = 1.2


# ---------------------------------------------------------------- one shard

def _top(scores: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The best distinct ids of each row in falling order; -1 marks empty places."""
    order = np.lexsort((-scores, ids), axis=1)
    rows = np.arange(len(ids))[:, None]
    ids, scores = ids[rows, order], scores[rows, order]
    scores[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
    scores[ids < 0] = -np.inf
    best = np.argsort(-scores, axis=1, kind="stable")[:, :keep]
    ids, scores = ids[rows, best], scores[rows, best]
    ids[np.isneginf(scores)] = -1
    return ids, scores


def greedy_search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, start: int, beam: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Beam search of all queries together: (ids, cosines) of the beam, and the ids each round expanded.

    Every round each query expands its best member that is not expanded yet, until no beam has one.
    """
    q = len(queries)
    ids = np.full((q, beam), -1)
    scores = np.full((q, beam), -np.inf)
    old = np.ones((q, beam), dtype=bool)  # expanded, or empty
    ids[:, 0], scores[:, 0], old[:, 0] = start, queries @ x[start], False
    met = np.zeros((q, len(x)), dtype=bool)
    met[:, start] = True
    expanded: list[np.ndarray] = []
    live = np.arange(q)
    while True:
        at = old[live].argmin(axis=1)
        open_ = ~old[live, at]
        live, at = live[open_], at[open_]
        if not len(live):
            return ids, scores, expanded
        node = ids[live, at]
        old[live, at] = True
        step = np.full(q, -1)
        step[live] = node
        expanded.append(step)
        next_ = edges[node]
        new = (next_ >= 0) & ~met[live[:, None], np.maximum(next_, 0)]
        row, col = np.nonzero(new)
        met[live[row], next_[row, col]] = True
        cos = np.full(next_.shape, -np.inf)
        cos[row, col] = np.einsum("pd,pd->p", queries[live[row]], x[next_[row, col]])
        all_scores = np.concatenate([scores[live], cos], axis=1)
        best = np.argsort(-all_scores, axis=1, kind="stable")[:, :beam]
        scores[live] = np.take_along_axis(all_scores, best, axis=1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(new, next_, -1)], axis=1), best, axis=1)
        old[live] = np.take_along_axis(np.concatenate([old[live], ~new], axis=1), best, axis=1)


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Edges of each point: the nearest candidate again and again, dropping those that it covers by the factor alpha."""
    cand = x[np.maximum(candidates, 0)]
    near = np.einsum("pd,pcd->pc", x[points], cand)
    alive = (candidates >= 0) & (candidates != points[:, None])
    to_point = np.sqrt(np.maximum(2 - 2 * near, 0))
    out = np.full((len(points), degree), -1)
    rows = np.arange(len(points))
    for k in range(degree):
        distance = np.where(alive, to_point, np.inf)
        best = distance.argmin(axis=1)
        some = np.isfinite(distance[rows, best])
        if not some.any():
            break
        out[some, k] = candidates[rows, best][some]
        between = np.sqrt(np.maximum(2 - 2 * np.einsum("pd,pcd->pc", cand[rows, best], cand), 0))
        alive &= ~((alpha * between <= to_point) & some[:, None])
        alive[rows, best] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, int]:
    """A flat graph over unit vectors: (edge lists padded with -1, medoid).

    Points are inserted in growing batches: each is searched for in the graph so far, the vectors met on the
    way are pruned to its edges, and the edges lead back, pruned again where a list overflows.
    """
    n = len(x)
    mean = x.mean(axis=0)
    medoid = int((x @ mean).argmax())
    edges = np.full((n, degree), -1)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate(([medoid], order[order != medoid]))
    done = 1
    while done < n:
        batch = order[done: done + max(1, min(done, 512))]
        met_ids, _, expanded = greedy_search(x, edges, x[batch], medoid, beam)
        met = np.concatenate([met_ids, np.stack(expanded, axis=1)], axis=1) if expanded else met_ids
        # points of one batch do not see each other through the graph: the batch itself is offered too
        mates = x[batch] @ x[batch].T
        np.fill_diagonal(mates, -np.inf)
        close = np.argsort(-mates, axis=1)[:, : min(degree, len(batch) - 1)]
        met = np.concatenate([met, batch[close]], axis=1) if len(batch) > 1 else met
        cos = np.einsum("pd,pcd->pc", x[batch], x[np.maximum(met, 0)])
        met, _ = _top(np.where(met >= 0, cos, -np.inf), met.copy(), 3 * beam)
        edges[batch] = robust_prune(x, batch, met, alpha, degree)
        # back edges
        source = np.repeat(batch, degree)
        target = edges[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        for at in range(0, len(nodes), 512):
            some, f, c = nodes[at: at + 512], first[at: at + 512], counts[at: at + 512]
            extra = np.full((len(some), c.max()), -1)
            column = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            extra[np.repeat(np.arange(len(some)), c), column] = source[np.repeat(f, c) + column]
            pool = np.concatenate([edges[some], extra], axis=1)
            held = (pool >= 0).sum(axis=1)
            simple = held <= degree
            if simple.any():
                packed = np.take_along_axis(pool[simple], np.argsort(pool[simple] < 0, axis=1, kind="stable"), axis=1)
                edges[some[simple]] = packed[:, :degree]
            if (~simple).any():
                edges[some[~simple]] = robust_prune(x, some[~simple], pool[~simple], alpha, degree)
        done += len(batch)
    return edges, medoid


def range_search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, start: int, least: float, beam: int = BEAM):
    """Yields (query numbers, ids) of the pairs with a cosine of at least `least`.

    After the greedy search, rounds expand every vector in range that was not expanded yet, so results are
    not bounded by the beam.
    """
    for at in range(0, len(queries), 1024):
        some = queries[at: at + 1024]
        ids, scores, _ = greedy_search(x, edges, some, start, beam)
        hit = scores >= least
        found = np.zeros((len(some), len(x)), dtype=bool)
        row, col = np.nonzero(hit)
        node = ids[row, col]
        found[row, node] = True
        while len(row):
            target = edges[node]
            row2 = np.repeat(row, target.shape[1])
            node2 = target.ravel()
            good = node2 >= 0
            code = np.unique(row2[good] * len(x) + node2[good])
            row2, node2 = code // len(x), code % len(x)
            new = ~found[row2, node2]
            row2, node2 = row2[new], node2[new]
            near = np.zeros(len(row2), dtype=bool)
            for s in range(0, len(row2), 1 << 16):
                e = slice(s, s + (1 << 16))
                near[e] = np.einsum("pd,pd->p", some[row2[e]], x[node2[e]]) >= least
            row, node = row2[near], node2[near]
            found[row, node] = True
        row, node = np.nonzero(found)
        yield row + at, node


# ---------------------------------------------------------------- all shards

def unit_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): vectors in doubles, scaled to length one; null where a vector cannot be used."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def scale(batches):
        for batch in batches:
            # null components come as NaN, which no check below lets pass
            units = [_unit(v) for v in batch.column(1).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.list_(pa.float64()))], ["id", "v"])

    return rows.mapInArrow(scale, "id long, v array<double>")


def _unit(v: np.ndarray | None) -> np.ndarray | None:
    most = np.abs(v).max(initial=0.0) if v is not None else 0.0
    if not 0 < most < np.inf:
        return None
    scaled = np.asarray(v, dtype=np.float64) / most  # squares of huge or tiny components stay in range
    return scaled / np.sqrt(scaled @ scaled)


def _nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 4096):
        cos = x[at: at + 4096] @ centres.T
        out[at: at + 4096] = np.argsort(-cos, axis=1, kind="stable")[:, :k]
    return out


def fit_centres(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means on a bounded sample."""
    centres = sample[np.random.default_rng(seed).choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds):
        mine = _nearest(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, sample)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def _matrix(values, width: int) -> np.ndarray:
    """Rows of doubles, padded with zeros to one width."""
    flat = np.concatenate([np.zeros(0), *values])
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    out = np.zeros((len(values), width))
    rows = np.repeat(np.arange(len(values)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Forest:
    """Joins links as they come and keeps one link per member: to a smaller member of its tree."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, v: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(v, v)) != v:
            parent[v] = v = parent.setdefault(up, up)
        return v

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            i, j = self.root(i), self.root(j)
            if i != j:
                self.parent[max(i, j)] = min(i, j)


def _first_common(shards: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest shard that both of each pair belong to; every row of `shards` is ascending."""
    both = (shards[a][:, :, None] == shards[b][:, None, :]).any(axis=2)
    return shards[a, both.argmax(axis=1)]


def _local_edges(nodes: np.ndarray, lists: pd.Series) -> np.ndarray:
    """Edges by place among the ascending nodes, padded with -1; those to other shards are walked there."""
    number = pd.Index(nodes)
    inside = [e[e >= 0] for e in (number.get_indexer(e) for e in lists)]
    edges = np.full((len(inside), max(1, max(map(len, inside), default=1))), -1)
    for i, e in enumerate(inside):
        edges[i, : len(e)] = e
    return edges


def _search_shards(nodes: DataFrame, width: int, centres: np.ndarray, overlap: int, least: float, piece: int, beam: int) -> DataFrame:
    """(node, links, root): per task and node the rows linked to it, and a smaller node of its component."""
    spark = nodes.sparkSession
    k = min(overlap, len(centres))
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            near = _nearest(_matrix(batch.column(1).to_numpy(zero_copy_only=False), width), shared.value, k)
            flat = pa.array(np.sort(near, axis=1).astype(np.int32).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * k), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["node", "v", "rows", "shards"])

    dealt = durable(nodes.mapInArrow(assign, "node long, v array<double>, rows long, shards array<int>"), "shards")
    sizes = dealt.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / piece).alias("pieces"))
    member = dealt.withColumn("shard", F.explode("shards")).join(sizes, "shard").withColumn(
        "piece", F.pmod(F.xxhash64("node"), "pieces").cast("int"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        edges, _ = build_graph(_matrix(frame["v"].to_list(), width))
        node = frame["node"].to_numpy()
        return pd.DataFrame({"node": node, "edges": [node[e[e >= 0]] for e in edges]})

    graphs = member.groupBy("shard", "piece").applyInPandas(build, "node long, edges array<long>")
    united = durable(graphs.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges")), "edges")

    # a task holds two pieces of a shard, each searched by the other, or one that is searched by itself
    pairs = F.transform(F.sequence(F.lit(0), (F.col("pieces") - 1).cast("int")),
                        lambda other: F.struct(F.least("piece", other).alias("low"), F.greatest("piece", other).alias("high")))
    tasks = member.join(united, "node", "left").withColumn("pair", F.explode(pairs)).select(
        "shard", "pair.low", "pair.high", "piece", "node", "v", "rows", "shards", "edges")

    def search(key, frame: pd.DataFrame) -> pd.DataFrame:
        shard, low, high = key
        frame = frame.sort_values(["piece", "node"])
        x, n = _matrix(frame["v"].to_list(), width), int((frame["piece"] == low).sum())
        node, rows, dims = frame["node"].to_numpy(), frame["rows"].to_numpy(), frame["v"].map(len).to_numpy()
        shards = np.array(frame["shards"].to_list())
        first, second = (slice(0, n), slice(0, n)) if low == high else (slice(0, n), slice(n, len(x)))
        met = np.zeros((len(x[first]), len(x[second])), dtype=bool)  # a pair counts for both ends, whichever search met it
        for index, queries, marks in ((first, second, met.T), (second, first, met))[: 1 if low == high else 2]:
            if not len(x[index]) or not len(x[queries]):
                continue
            edges = _local_edges(node[index], frame["edges"].iloc[index])
            medoid = int((x[index] @ x[index].mean(axis=0)).argmax())
            for q, i in range_search(x[index], edges, x[queries], medoid, least, beam):
                marks[q, i] = True
        if low == high:
            met = np.triu(met | met.T, 1)
        links, forest = np.zeros(len(x), dtype=np.int64), Forest()
        for at in range(0, len(met), 256):
            a, b = np.nonzero(met[at: at + 256])
            a, b = a + at, b + (0 if low == high else n)
            good = dims[a] == dims[b]
            a, b = a[good], b[good]
            forest.add(node[a], node[b])
            count = _first_common(shards, a, b) == shard  # a pair of several shards counts in the first
            a, b = a[count], b[count]
            np.add.at(links, a, rows[b])
            np.add.at(links, b, rows[a])
        return pd.DataFrame({"node": node, "links": links, "root": [forest.root(v) for v in node.tolist()]})

    found = tasks.groupBy("shard", "low", "high").applyInPandas(search, "node long, links long, root long")
    return durable(found, "found")


def _exact_links(nodes: DataFrame, sample: list, width: int, least: float) -> dict[int, int]:
    """Links of a bounded sample of vectors by brute force over all vectors, in one pass."""
    asked = nodes.sparkSession.sparkContext.broadcast((_matrix([r["v"] for r in sample], width), [len(r["v"]) for r in sample]))

    def count(batches):
        total = np.zeros(len(asked.value[1]), dtype=np.int64)
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False)
            cos = _matrix(v, width) @ asked.value[0].T
            same = np.fromiter(map(len, v), dtype=np.int64, count=len(v))[:, None] == np.array(asked.value[1])[None, :]
            total += ((cos >= least) & same).T @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "n"])

    sums = nodes.select("v", "rows").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return {sample[r["k"]]["node"]: r["n"] - sample[r["k"]]["rows"] for r in sums}


#: Vectors with links that the audit wants, the most vectors it draws to get them, and the least mean share found.
AUDIT = 256
MOST_DRAWN = 8_192
MIN_RECALL = 0.98


def audit_sample(nodes: DataFrame, width: int, least: float, audit: int = AUDIT, most: int = MOST_DRAWN) -> dict[int, int]:
    """True links by node of vectors drawn in the order of a hash, until `audit` with links are held, all are seen or
    `most` are drawn.  Vectors without links are left out."""
    held: dict[int, int] = {}
    drawn, block = 0, audit
    while len(held) < audit and drawn < most:
        block = min(block, most - drawn)
        sample = nodes.orderBy(F.xxhash64("node", F.lit(2)), "node").offset(drawn).limit(block).collect()
        exact = _exact_links(nodes, sample, width, least) if sample else {}
        held |= {node: n for node, n in exact.items() if n}
        drawn += len(sample)
        if len(sample) < block:
            break
        block *= 2
    return held


def mean_recall(found: dict[int, int], exact: dict[int, int]) -> float | None:
    """Mean over vectors of the share of their links that was found, so a hot group weighs no more than its members; None
    where no vector has a link."""
    return sum(min(found.get(v, 0), n) / n for v, n in exact.items()) / len(exact) if exact else None


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = MIN_COSINE,
                 shard: int = SHARD, piece: int = PIECE, overlap: int = OVERLAP, beam: int = BEAM, audit: int = AUDIT,
                 min_recall: float = MIN_RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept): direct links by cosine of at least `least` and their components.

    Rows of one vector, bit for bit after scaling, are one node that counts as many links as it has rows.
    Every pair found is verified by its cosine in doubles before it counts, and counts for both ends.  An audit
    compares the links of `audit` vectors that have links with brute force, vector by vector; while the mean share
    found is below `min_recall` the search is done again with twice the overlap and beam, in the end with every
    shard for every vector.  If none of the `MOST_DRAWN` vectors it may draw has a link, recall stays unmeasured.  Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing and are their own component; vectors link only with vectors of their own
    length; a null id names no component while another id is there; `kept` marks the id that names its
    component; repeated rows stay repeated; other columns play no part.
    """
    rows = durable(unit_vectors(vectors, id_col, vector_col).withColumn(
        "key", F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("v").alias("a"), F.hash("v").alias("b")))), "units")
    usable = rows.filter("v is not null")
    width = usable.agg(F.max(F.size("v"))).first()[0] or 1
    grouped = usable.groupBy("key").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("rows"), F.min("id").alias("least"))
    # nodes are numbered by hash, as ids may be null or repeated
    classes = durable(grouped.withColumn("node", F.xxhash64("key")), "classes")
    nodes = classes.select("node", "v", "rows")
    n = nodes.count()
    alone = rows.filter("v is null").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    if n == 0:
        return alone.select("*", kept)
    most = max(1, min(SAMPLE, (64 << 20) // (8 * width)))
    sample = _matrix([r["v"] for r in nodes.orderBy(F.xxhash64("node", F.lit(1))).limit(most).select("v").collect()], width)
    k = max(1, min(MOST_CENTRES, len(sample) // 4, -(-n * overlap // shard)))
    centres = fit_centres(sample, k)
    exact = audit_sample(nodes, width, least, audit)
    while True:
        found = _search_shards(nodes, width, centres, overlap, least, piece, beam)
        links = durable(found.groupBy("node").agg(F.sum("links").alias("links")), "counts")
        mine = {r["node"]: r["links"] for r in links.filter(F.col("node").isin(list(exact))).collect()}
        recall = mean_recall(mine, exact)
        if overlap >= len(centres) and beam >= n or recall is None or recall >= min_recall:
            break
        overlap, beam = min(2 * overlap, len(centres)), min(2 * beam, n)
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = classes.drop("v").join(links, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(names, "root").select("key", (F.col("links") + F.col("rows") - 1).alias("n_links"), "component_id")
    linked = usable.select("id", "key").join(named, "key").select(F.col("id").alias("vec_id"), "n_links", "component_id")
    return linked.unionByName(alone).select("*", kept)
