"""Approximate nearest neighbours by largest inner product: hierarchical k-means tree, best-bin-first.

* *Tree*: k-means splits a bounded sample (``SAMPLE`` vectors by hash of the id) into ``BRANCH`` children,
  each child again, until a node holds about ``leaf_rows`` vectors of the whole table. Largest inner
  product is turned into smallest distance by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm of
  all vectors (0 for a query, which is scaled to norm M). Every vector of the table descends to one leaf.
* *Search*: a priority queue holds tree nodes by distance of their centre to the query. The nearest is
  popped: an inner node adds its children, a leaf is visited. A query stops after ``visits`` leaves.
* *Calibration*: up to ``CALIBRATION`` queries are compared with every vector; visits widen until
  the mean share of their true neighbours in visited leaves reaches ``recall`` (all leaves if need be).

Leaves are packed into bins of about ``BIN_ROWS`` vectors; a larger leaf takes several bins, by hash of the id,
and a visit goes to all of them. Queries that meet in a bin are cut into parts of ``PART_QUERIES``, so a task
holds one bin and one part, however hot a region is. The tree (at most 2 * SAMPLE / MIN_SAMPLED nodes), the leaf
counts and the calibration queries are all that is broadcast or reaches the driver; none grows with the table.

Defined results: a vector that is null, empty or zero or holds a null or non-finite component takes no part,
nor do rows without an id or vectors whose length differs from that of most (ties: the shorter). Rows of
one id are one vector, the smallest in array order. Equal scores are ordered by id. Extra columns are ignored; an empty
table gives an empty result.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.session import reliable_checkpoint

SAMPLE = 65_536
CALIBRATION = 256
BRANCH = 16
LEAF_ROWS = 128
MIN_SAMPLED = 16
ROUNDS = 12
BIN_ROWS = 16_384
PART_QUERIES = 4_096
ROWS_AT_ONCE = 4_096


# ---------------------------------------------------------------- tree
class Tree:
    """Centres of all nodes (row 0 is the root) and their children; a node without children is a leaf."""

    def __init__(self, centres: np.ndarray, parents: np.ndarray):
        self.centres, self.children = centres, [[] for _ in parents]
        for node, parent in enumerate(parents):
            if parent >= 0:
                self.children[parent].append(node)
        self.children = [np.array(c, int) for c in self.children]
        self.leaves = [n for n, c in enumerate(self.children) if not len(c)]
        self.norms = (centres ** 2).sum(1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of x: down to the nearest centre at every level."""
        at = np.zeros(len(x), int)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not len(kids) or not len(rows):
                at[rows] = node
                continue
            near = np.argmin(self.norms[kids] - 2 * x[rows] @ self.centres[kids].T, axis=1)
            todo += [(kid, rows[near == i]) for i, kid in enumerate(kids)]
        return at

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order for one query."""
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            kids = self.children[node]
            if not len(kids):
                yield node
                continue
            for d, kid in zip(self.norms[kids] - 2 * self.centres[kids] @ q, kids, strict=True):
                heapq.heappush(heap, (float(d), int(kid)))


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centre number of each row; fewer than k centres where rows repeat."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = np.argmin((centres ** 2).sum(1) - 2 * x @ centres.T, axis=1)
        _, near = np.unique(near, return_inverse=True)
        sums = np.zeros((near.max() + 1, x.shape[1]))
        np.add.at(sums, near, x)
        centres = sums / np.bincount(near)[:, None]
    return near


def grow(x: np.ndarray, most: int, branch: int = BRANCH, seed: int = 11) -> Tree:
    """Tree over sample x; a node of at most ``most`` vectors, or of equal ones, is a leaf."""
    rng = np.random.default_rng(seed)
    centres, parents, todo = [x.mean(0)], [-1], [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop(0)
        if len(rows) <= most:
            continue
        near = _k_means(x[rows], min(branch, len(rows), -(-2 * len(rows) // most)), rng)
        if near.max() == 0:
            continue
        for c in range(near.max() + 1):
            mine = rows[near == c]
            todo.append((len(centres), mine))
            parents.append(node)
            centres.append(x[mine].mean(0))
    return Tree(np.array(centres), np.array(parents))


# ---------------------------------------------------------------- vectors
def usable(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): one row an id, of the vectors that take part."""
    x = F.col("x")
    good = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x")) \
        .where("vec_id is not null and x is not null").where(F.coalesce(good, F.lit(False)))
    one = reliable_checkpoint(rows.groupBy("vec_id").agg(F.min("x").alias("x")))
    usual = one.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return one.where(F.size("x") == (usual[0]["d"] if usual else 0))


def _stack(vectors) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64)


class _Space:
    """Vectors as points: scaled by the largest component, with the coordinate that makes all norms equal."""

    def __init__(self, scale: float, norm: float):
        self.scale, self.norm = scale, norm

    def points(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        rest = np.sqrt(np.maximum(self.norm ** 2 - (x ** 2).sum(1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def queries(self, q: np.ndarray) -> np.ndarray:
        q = q / np.abs(q).max(1, keepdims=True)
        q *= self.norm / np.sqrt((q ** 2).sum(1, keepdims=True))
        return np.concatenate([q, np.zeros((len(q), 1))], axis=1)


def _space(vectors: DataFrame) -> _Space | None:
    top = vectors.agg(F.max(F.array_max(F.transform("x", lambda v: F.abs(v.cast("double")))))).first()[0]
    if top is None:
        return None
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + (v.cast("double") / top) * (v.cast("double") / top))
    return _Space(top, float(np.sqrt(vectors.agg(F.max(square)).first()[0])))


def _sampled(vectors: DataFrame, rows: int, total: int) -> DataFrame:
    """At most ``rows`` vectors, those of the smallest id hashes."""
    h = F.pmod(F.xxhash64(F.lit(29), "vec_id"), F.lit(1 << 30))
    near = vectors if total <= 2 * rows else vectors.where(h < int((1 << 30) * 2.0 * rows / total))
    return near.orderBy(h, "vec_id").limit(rows)


def _nearest(ids: np.ndarray, x: np.ndarray, q_id, q: np.ndarray, scores: np.ndarray, k: int):
    """Positions and exact scores of the k best of one query: products summed in one fixed order, ties by id.

    Matrix products differ in their last bits with the shape of the block, so they only choose whom to measure.
    """
    scores = np.where(ids == q_id, -np.inf, scores)
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        slack = 1e-9 * np.sqrt((q ** 2).sum()) * np.sqrt((x ** 2).sum(1).max())
        at = np.flatnonzero((scores >= kth - slack) & (scores > -np.inf))
    else:
        at = np.flatnonzero(scores > -np.inf)
    exact = (x[at] * q).sum(1)
    best = np.lexsort((ids[at], -exact))[:k]
    return at[best], exact[best]


# ---------------------------------------------------------------- calibration
def _exact(vectors: DataFrame, tree, space: _Space, q_ids: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
    """(query, vec_id, leaf) of the true k nearest of a few queries: every vector is compared."""
    shared = vectors.sparkSession.sparkContext.broadcast((tree.value, space, q_ids, q))

    def scan(frames):
        t, sp, ids, queries = shared.value
        for frame in frames:
            for a in range(0, len(frame), ROWS_AT_ONCE):
                part = frame.iloc[a:a + ROWS_AT_ONCE]
                x, v = _stack(part["x"]), part["vec_id"].to_numpy()
                leaf = t.leaf_of(sp.points(x))
                s = queries @ x.T
                for i, q_id in enumerate(ids):
                    at, exact = _nearest(v, x, q_id, queries[i], s[i], k)
                    yield pd.DataFrame({"query": i, "vec_id": v[at], "score": exact, "leaf": leaf[at]})

    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    out = vectors.mapInPandas(scan, "query int, vec_id long, score double, leaf int") \
        .withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    return out.select("query", "vec_id", "leaf").toPandas()         # at most CALIBRATION * k rows


def calibrate(truth: pd.DataFrame, tree: Tree, queries: np.ndarray, recall: float) -> tuple[int, float]:
    """Fewest leaves a query has to visit until visited leaves hold ``recall`` of all true neighbours, and that share."""
    found = np.zeros(len(tree.leaves) + 1)
    for i, mine in truth.groupby("query"):
        wanted = mine["leaf"].value_counts().to_dict()
        for place, leaf in enumerate(tree.visit(queries[i]), 1):
            found[place] += wanted.pop(leaf, 0)
            if not wanted:
                break
    share = np.cumsum(found) / max(1, len(truth))
    if not len(truth):
        return len(tree.leaves), 1.0
    visits = int(np.argmax(share >= min(recall, share[-1])))
    return max(1, visits), float(share[max(1, visits)])


# ---------------------------------------------------------------- search
def _bins(counts: dict[int, int], leaves: list[int], bin_rows: int) -> dict[int, tuple[int, int]]:
    """Leaf to (first bin, number of bins): neighbouring leaves share a bin, a large leaf has several."""
    out, at, filled = {}, 0, 0
    for leaf in leaves:
        n = counts.get(leaf, 0)
        if n > bin_rows:
            at += filled > 0
            out[leaf] = (at, -(-n // bin_rows))
            at, filled = at + out[leaf][1], 0
            continue
        if filled + n > bin_rows:
            at, filled = at + 1, 0
        out[leaf] = (at, 1)
        filled += n
    return out


def _compare(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            x, ids, leaf = _stack(vectors["x"]), vectors["vec_id"].to_numpy(), vectors["leaf"].to_numpy()
            here, place = np.unique(leaf, return_inverse=True)
            q_ids, visited = queries["query_id"].to_numpy(), queries["leaves"].to_list()
            for a in range(0, len(queries), 256):
                q = _stack(queries["x"].iloc[a:a + 256])
                s = q @ x.T
                for i in range(len(q)):
                    seen = np.isin(here, visited[a + i])
                    at, exact = _nearest(ids, x, q_ids[a + i], q[i], np.where(seen[place], s[i], -np.inf), k)
                    out.append(pd.DataFrame({"query_id": q_ids[a + i], "vec_id": ids[at], "score": exact}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    return run


def search(embeddings: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           recall: float = 0.95, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, bin_rows: int = BIN_ROWS,
           part_queries: int = PART_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each usable row of which ``is_query`` (over vec_id) holds.

    ``recall`` is the mean share of true neighbours that the visited leaves of the calibration queries hold.
    """
    spark: SparkSession = embeddings.sparkSession
    vectors = usable(embeddings, id_col, vector_col)
    space, total = _space(vectors), vectors.count()
    result = "query_id long, rank int, vec_id long, score double"
    if space is None:
        return spark.createDataFrame([], result)
    most = max(MIN_SAMPLED, min(total, sample) * leaf_rows // total)
    # one task fits the bounded sample; only the nodes come back
    nodes = _sampled(vectors, sample, total).groupBy(F.lit(0).alias("g")).applyInPandas(_fit(space, most), "node int, parent int, centre array<double>") \
        .orderBy("node").toPandas()
    tree = spark.sparkContext.broadcast(Tree(_stack(nodes["centre"]), nodes["parent"].to_numpy()))

    asking = vectors.where(is_query)
    some = _sampled(asking, CALIBRATION, asking.count()).toPandas()
    if not len(some):
        return spark.createDataFrame([], result)
    chosen = _stack(some["x"])
    truth = _exact(vectors, tree, space, some["vec_id"].to_numpy(), chosen, k)
    visits, _ = calibrate(truth, tree.value, space.queries(chosen), recall)

    def descend(frames):
        for frame in frames:
            for a in range(0, len(frame), ROWS_AT_ONCE):
                part = frame.iloc[a:a + ROWS_AT_ONCE]
                yield part.assign(leaf=tree.value.leaf_of(space.points(_stack(part["x"]))))

    def travel(frames):
        for frame in frames:
            if len(frame):
                q = space.queries(_stack(frame["x"]))
                ways = [[leaf for leaf, _ in zip(tree.value.visit(v), range(visits), strict=False)] for v in q]
                yield pd.DataFrame({"query_id": frame["vec_id"], "x": frame["x"], "leaves": ways})

    kind = vectors.schema["x"].dataType.simpleString()
    placed = vectors.mapInPandas(descend, f"vec_id long, x {kind}, leaf int")
    counts = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}   # one row a leaf
    bins = spark.sparkContext.broadcast(_bins(counts, tree.value.leaves, bin_rows))
    ways = reliable_checkpoint(asking.mapInPandas(travel, f"query_id long, x {kind}, leaves array<int>"))

    def bins_of(frames):
        for frame in frames:
            rows = []
            for q, x, leaves in zip(frame["query_id"], frame["x"], frame["leaves"], strict=True):
                by_bin: dict[int, list[int]] = {}
                for leaf in leaves:
                    first, n = bins.value[leaf]
                    for b in range(first, first + n):
                        by_bin.setdefault(b, []).append(leaf)
                rows += [(q, x, b, mine) for b, mine in by_bin.items()]
            yield pd.DataFrame(rows, columns=["query_id", "x", "bin", "leaves"])

    def bin_of(frames):
        for frame in frames:
            first, n = (np.array([bins.value[leaf][i] for leaf in frame["leaf"]], int) for i in (0, 1))
            yield frame.assign(bin=(first + frame["h"].to_numpy() % np.maximum(n, 1))).drop(columns="h")

    asked = ways.mapInPandas(bins_of, f"query_id long, x {kind}, bin int, leaves array<int>")
    of_bin = reliable_checkpoint(asked.groupBy("bin").agg(F.ceil(F.count("*") / part_queries).alias("parts")))
    asked = asked.join(of_bin, "bin").withColumn("part", F.pmod(F.xxhash64("query_id"), "parts"))
    stored = placed.withColumn("h", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))) \
        .mapInPandas(bin_of, f"vec_id long, x {kind}, leaf int, bin int") \
        .join(of_bin, "bin").withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))
    found = stored.groupBy("bin", "part").cogroup(asked.groupBy("bin", "part")) \
        .applyInPandas(_compare(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def _fit(space: _Space, most: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = space.points(_stack(frame.sort_values("vec_id")["x"]))
        tree = grow(x, most)
        parents = np.full(len(tree.centres), -1)
        for node, kids in enumerate(tree.children):
            parents[kids] = node
        return pd.DataFrame({"node": np.arange(len(parents)), "parent": parents, "centre": list(tree.centres)})
    return run


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector of embeddings, against all others."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.pmod(F.col("vec_id"), F.lit(20)) == 0)
