"""Exact path-dependent TreeSHAP for Spark GBT pipelines, as a Spark job.

The fitted booster is written with Spark ML's writer to the shared
checkpoint folder; its node table (treeID, id, prediction, rawCount,
children, split) is read back — parameter-sized, it is the model — and
broadcast. Tasks explain Arrow batches of assembled feature vectors on the
executors and emit long (feature, shap) rows, or for the means only sums of
|shap| a batch. Rows never visit the driver.

Values are path-dependent Shapley values (Lundberg, Erion & Lee, 2018) with
node covers from the training counts. What a leaf adds depends only on
which way a row goes at the splits above it, so trees are cut into subtrees
of few splits, the formula is worked out once for every pattern of sides of
a subtree and all its leaves, and a row costs one lookup a feature and
subtree. Leaves below many splits use the patterns that a batch holds.
Values are in the booster's margin space (Spark's link is 1 / (1 +
exp(-2F))), tree weights multiplied in.
"""
from __future__ import annotations

import math
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.boost import BoosterModel, Tree
from riskweave.session import ensure_checkpoint_dir

#: Splits of a table of values by pattern (2 ** TABLE_SPLITS rows); bytes of tables that a task keeps; rows explained at a time.
TABLE_SPLITS = 7
TABLE_BYTES = 1 << 27
BATCH_ROWS = 10_000


def tree_table(model: PipelineModel) -> tuple[list[dict], list[float]]:
    """Node arrays per tree from the saved booster, and the tree weights."""
    from pyspark.sql import SparkSession
    gbt = model.stages[-1]
    if isinstance(gbt, BoosterModel):
        return [leafwise_tree(t) for t in gbt.booster.trees], [1.0] * len(gbt.booster.trees)
    spark = SparkSession.getActiveSession()
    path = os.path.join(ensure_checkpoint_dir(spark), f"shap-model-{uuid.uuid4().hex}")
    gbt.write().overwrite().save(path)   # goes when the rows are read
    nodes = spark.read.parquet(os.path.join(path, "data")).select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount", "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold",
        "nodeData.split.numCategories").toPandas()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    trees = []
    for tid, g in nodes.groupby("treeID"):
        g = g.sort_values("id")
        n = int(g["id"].max()) + 1
        left = np.full(n, -1, np.int64)
        right = np.full(n, -1, np.int64)
        feat = np.full(n, -1, np.int64)
        thr = np.zeros(n)
        cats = [None] * n
        value = np.zeros(n)
        cover = np.zeros(n)
        for r in g.itertuples(index=False):
            i = int(r.id)
            left[i], right[i], value[i], cover[i] = int(r.leftChild), int(r.rightChild), r.prediction, r.rawCount
            if r.leftChild >= 0:
                feat[i] = int(r.featureIndex)
                if int(r.numCategories) < 0:
                    thr[i] = float(r.leftCategoriesOrThreshold[0])
                else:
                    cats[i] = set(float(c) for c in r.leftCategoriesOrThreshold)
        trees.append({"tid": int(tid), "left": left, "right": right, "feat": feat, "thr": thr, "cats": cats,
                      "value": value, "cover": cover, "root": int(g["id"].min())})
    trees.sort(key=lambda t: t["tid"])
    return trees, list(gbt.treeWeights)


def leafwise_tree(t: Tree) -> dict:
    """Node arrays of a leaf-wise tree; NULL goes left where ``null_left``."""
    n = len(t.left)
    return {"left": np.array(t.left), "right": np.array(t.right), "feat": np.array(t.feature), "thr": np.array(t.threshold), "cats": [None] * n,
            "value": np.array(t.value), "cover": np.array(t.cover), "root": 0, "null_left": np.array(t.null_left)}


class _Test:
    """What one feature must be for a row to stay on a path: in (above, upto], in all category sets, NULL if every split lets it."""

    def __init__(self):
        self.above, self.upto, self.sets, self.null, self.share = -math.inf, math.inf, [], True, 1.0

    def narrowed(self, threshold: float, categories: set | None, left: bool, null: bool, share: float) -> _Test:
        out = _Test()
        out.above, out.upto, out.sets = self.above, self.upto, self.sets
        out.null, out.share = self.null and null, self.share * share
        if categories is not None:
            out.sets = [*self.sets, (sorted(categories), left)]
        elif left:
            out.upto = min(self.upto, threshold)
        else:
            out.above = max(self.above, threshold)
        return out

    def passed(self, x: np.ndarray) -> np.ndarray:
        ok = (x <= self.upto) & ((x > self.above) if self.above > -math.inf else True)
        for categories, left in self.sets:
            ok &= np.isin(x, categories) == left
        return np.where(np.isnan(x), self.null, ok)


def _leaf_paths(t: dict) -> list[tuple[int, float, list[tuple[int, _Test]]]]:
    """(leaf, value, [(feature, test)]) of every reachable leaf.

    A test's share is the product of child / parent covers of its feature's splits: the weight of the leaf's side
    where the feature is not known. Without ``null_left``, NULL goes right.
    """
    out, stack = [], [(t["root"], {})]
    null_left = t.get("null_left")
    while stack:
        node, path = stack.pop()
        if t["left"][node] < 0:
            out.append((node, float(t["value"][node]), list(path.items())))
            continue
        f, whole = int(t["feat"][node]), t["cover"][node] if t["cover"][node] > 0 else 1.0
        to_left = bool(null_left[node]) if null_left is not None else False
        for child, left in ((t["left"][node], True), (t["right"][node], False)):
            stack.append((child, path | {f: path.get(f, _Test()).narrowed(t["thr"][node], t["cats"][node], left, left == to_left, t["cover"][child] / whole)}))
    return out


def _pattern_values(ones: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Shapley weights (... x patterns x features) of leaves of value 1 for rows of pass/fail flags (patterns x features).

    ``shares`` is (... x features), one row a leaf. Feature i gets (o_i - z_i) * sum over subsets S of the others of |S|! (m - 1 - |S|)! / m!
    * prod(o_j in S) * prod(z_j not in S), with o_j whether feature j passes and z_j its share; the sum needs the coefficients of
    prod(z_j + o_j u) in u.
    """
    z, m = np.asarray(shares, float)[..., None, :], ones.shape[1]
    sizes = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
    out = np.empty((*z.shape[:-2], *ones.shape))
    for i in range(m):
        poly = [np.ones(out.shape[:-1])]
        for j in range(m):
            if j != i:
                poly = [(poly[k] * z[..., j] if k < len(poly) else 0.0) + (poly[k - 1] * ones[:, j] if k else 0.0) for k in range(len(poly) + 1)]
        out[..., i] = (ones[:, i] - z[..., i]) * sum(w * c for w, c in zip(sizes, poly, strict=True))
    return out


def _flags(codes: np.ndarray, m: int) -> np.ndarray:
    return (codes[:, None] >> np.arange(m) & 1).astype(float)


class _Paths:
    """A tree cut into pieces: subtrees whose own splits and those above them are at most ``TABLE_SPLITS``.

    ``pieces`` are (splits above, own splits, [(value, {feature: [(bit, left)]}, shares)] of the leaves below): a row's sides at these splits, as bits,
    give what all these leaves add to each feature. Leaves below more splits are in ``deep``, as (value, [(feature, test)]).
    """

    def __init__(self, t: dict):
        self.pieces: list[tuple[list[int], list[int], list[tuple[float, dict, dict]]]] = []
        left, right = t["left"], t["right"]
        null_left = t.get("null_left")
        inner, order, todo = {}, [], [t["root"]]
        while todo:
            node = todo.pop()
            order.append(node)
            if left[node] >= 0:
                todo += [right[node], left[node]]
        for node in reversed(order):
            inner[node] = 0 if left[node] < 0 else 1 + inner[left[node]] + inner[right[node]]
        self.splits = [n for n in order if left[n] >= 0]
        deep = set()
        todo = [(t["root"], [])]
        while todo:
            node, above = todo.pop()
            if len(above) + inner[node] <= TABLE_SPLITS:
                self._piece(t, node, above)
            elif left[node] < 0:
                deep.add(node)
            else:
                todo += [(right[node], [*above, (node, False)]), (left[node], [*above, (node, True)])]
        self.deep = [(v, path) for leaf, v, path in _leaf_paths(t) if leaf in deep] if deep else []
        self.null_left = None if null_left is None else np.asarray(null_left)
        self.size = sum(8 * len(self._features(leaves)) << (len(a) + len(own)) for a, own, leaves in self.pieces)
        self.tables = None

    def _piece(self, t: dict, root: int, above: list[tuple[int, bool]]) -> None:
        left, right, feat, cover = t["left"], t["right"], t["feat"], t["cover"]
        own, leaves, todo = [], [], [(root, above)]
        bit = {n: i for i, (n, _) in enumerate(above)}
        while todo:
            node, path = todo.pop()
            if left[node] >= 0:
                bit[node] = len(bit)
                own.append(node)
                todo += [(right[node], [*path, (node, False)]), (left[node], [*path, (node, True)])]
                continue
            sides, shares = {}, {}
            for n, to_left in path:
                f, whole = int(feat[n]), cover[n] if cover[n] > 0 else 1.0
                sides.setdefault(f, []).append((bit[n], to_left))
                shares[f] = shares.get(f, 1.0) * cover[left[n] if to_left else right[n]] / whole
            if sides and t["value"][node] != 0.0:
                leaves.append((float(t["value"][node]), sides, shares))
        if leaves:
            self.pieces.append(([n for n, _ in above], own, leaves))

    @staticmethod
    def _features(leaves: list) -> list[int]:
        return sorted({f for _, sides, _ in leaves for f in sides})

    def made(self) -> list[tuple[list[int], list[int], dict[int, np.ndarray]]]:
        """(splits above, own splits, {feature: values by pattern}) of every piece; leaves of equal numbers of features are worked out together."""
        flat = [(k, leaf) for k, (_, _, leaves) in enumerate(self.pieces) for leaf in leaves]
        worth: dict[int, np.ndarray] = {}
        for m in {len(leaf[1]) for _, leaf in flat}:
            at = [i for i, (_, leaf) in enumerate(flat) if len(leaf[1]) == m]
            values = _pattern_values(_flags(np.arange(1 << m), m), np.array([list(flat[i][1][2].values()) for i in at]))
            worth |= {i: v * flat[i][1][0] for i, v in zip(at, values, strict=True)}
        out = [(above, own, {f: np.zeros(1 << (len(above) + len(own))) for f in self._features(leaves)}) for above, own, leaves in self.pieces]
        for i, (k, (_, sides, _)) in enumerate(flat):
            above, own, table = out[k]
            bits = _flags(np.arange(1 << (len(above) + len(own))), len(above) + len(own)).astype(bool)
            code = np.zeros(len(bits), np.int64)
            for j, tests in enumerate(sides.values()):
                code |= np.logical_and.reduce([bits[:, b] == to_left for b, to_left in tests]).astype(np.int64) << j
            for j, f in enumerate(sides):
                table[f] += worth[i][code, j]
        return out


def _tree_shap(t: dict, x: np.ndarray, phi: np.ndarray, weight: float, tables: list) -> None:
    """Add weight * SHAP values of one tree for all rows to phi; x and phi are features x rows."""
    paths, to_left = t["paths"], {}
    for n in paths.splits:
        v, sets = x[t["feat"][n]], t["cats"][n]
        side = v <= t["thr"][n] if sets is None else np.isin(v, sorted(sets))
        if paths.null_left is not None and paths.null_left[n]:
            side |= np.isnan(v)
        to_left[n] = side.astype(np.int64)
    n_rows = x.shape[1]
    found, codes = np.empty(n_rows), {(): np.zeros(n_rows, np.int64)}
    for above, own, table in tables:
        for k in range(1, len(above) + 1):                 # neighbours share what is above them
            if tuple(above[:k]) not in codes:
                codes[tuple(above[:k])] = codes[tuple(above[:k - 1])] + (to_left[above[k - 1]] << (k - 1))
        code = codes[tuple(above)]
        for k, n in enumerate(own, len(above)):
            code = code + (to_left[n] << k)
        for f, values in table.items():
            np.take(values, code, out=found, mode="clip")
            phi[f] += found if weight == 1.0 else weight * found
    for value, path in paths.deep:
        m = len(path)
        if value == 0.0:
            continue
        code = np.zeros(n_rows, np.int64)
        for j, (f, test) in enumerate(path):
            code |= test.passed(x[f]).astype(np.int64) << j
        if m <= 16:                                        # which patterns are there: without sorting the rows
            met = np.flatnonzero(np.bincount(code, minlength=1 << m))
            place = np.zeros(1 << m, np.int64)
            place[met] = np.arange(len(met))
            at = place[code]
        else:
            met, at = np.unique(code, return_inverse=True)
        table = weight * value * _pattern_values(_flags(met, m), [test.share for _, test in path])
        for j, (f, _) in enumerate(path):
            phi[f] += table[at, j]


def expected_margin(trees: list[dict], weights: list[float]) -> float:
    """Base value: cover-weighted mean leaf value, summed over weighted trees."""
    total = 0.0
    for t, w in zip(trees, weights):
        leaves = t["left"] < 0
        used = leaves & (t["cover"] > 0)
        c = t["cover"][used]
        total += w * float((t["value"][used] * c).sum() / c.sum()) if c.sum() > 0 else 0.0
    return total


def explain_rows(trees: list[dict], weights: list[float], X: np.ndarray) -> np.ndarray:
    x = np.ascontiguousarray(X.T)
    phi, kept = np.zeros(x.shape), 0
    for t, w in zip(trees, weights):
        if "paths" not in t:
            t["paths"] = _Paths(t)
        paths = t["paths"]
        tables = paths.made() if paths.tables is None else paths.tables
        kept += paths.size
        if kept <= TABLE_BYTES:
            paths.tables = tables
        _tree_shap(t, x, phi, w, tables)
    return phi.T


def _explained(batches, trees: list[dict], weights: list[float], n_features: int):
    """(ids, SHAP values as rows x features) of Arrow batches (_id, _x), a few thousand rows at a time."""
    for batch in batches:
        ids, x = batch.column(0), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, n_features)
        for at in range(0, len(x), BATCH_ROWS):
            yield ids.slice(at, BATCH_ROWS), explain_rows(trees, weights, x[at:at + BATCH_ROWS])


def explain(rows: DataFrame, trees: list[dict], weights: list[float], names: list[str]) -> DataFrame:
    """Long table (_id, feature, shap) for rows (_id, _x array<double>): margin-space values of weighted trees."""
    bc = rows.sparkSession.sparkContext.broadcast((trees, weights, names))   # the model itself

    def run(batches):
        tr, ws, nm = bc.value
        for ids, phi in _explained(batches, tr, ws, len(nm)):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(phi)), len(nm)))), pa.array(list(nm) * len(phi), pa.string()),
                                              pa.array(phi.reshape(-1))], ["_id", "feature", "shap"])

    return rows.select(F.col("_id").cast("long"), "_x").mapInArrow(run, "_id long, feature string, shap double")


def mean_values(rows: DataFrame, trees: list[dict], weights: list[float], names: list[str]) -> DataFrame:
    """(feature, mean |shap|) over rows (_id, _x array<double>): tasks post sums of every few thousand rows, not the values."""
    bc = rows.sparkSession.sparkContext.broadcast((trees, weights, names))   # the model itself

    def run(batches):
        tr, ws, nm = bc.value
        for ids, phi in _explained(batches, tr, ws, len(nm)):
            yield pa.RecordBatch.from_arrays([pa.array(list(nm), pa.string()), pa.array(np.abs(phi).sum(0)), pa.array(np.full(len(nm), len(ids)))],
                                             ["feature", "total", "n"])

    sums = rows.select(F.col("_id").cast("long"), "_x").mapInArrow(run, "feature string, total double, n long")
    return sums.groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("mean_abs_shap"))


def linear_shap(rows: DataFrame, coefficients: list[float], names: list[str]) -> DataFrame:
    """Long table (_id, feature, shap) of a linear margin: coefficient * (value - mean over the rows)."""
    means = rows.agg(*[F.avg(F.col("_x")[i]).alias(f"m{i}") for i in range(len(names))]).first()
    parts = [F.struct(F.lit(n).alias("feature"), (F.lit(float(c)) * (F.col("_x")[i] - F.lit(float(means[i] or 0.0)))).alias("shap"))
             for i, (n, c) in enumerate(zip(names, coefficients, strict=True))]
    return rows.select("_id", F.explode(F.array(*parts)).alias("s")).select("_id", "s.*")


def _assembled(model: PipelineModel, df: DataFrame, id_col: str) -> DataFrame:
    return model.transform(df).select(F.col(id_col).alias("_id"), vector_to_array("features").alias("_x"))


def shap_values(model: PipelineModel, df: DataFrame, names: list[str], id_col: str = "SK_ID_CURR") -> DataFrame:
    """Long table (id, feature, shap) of margin-space SHAP values for every row of ``df``, booster or logistic."""
    feats = _assembled(model, df, id_col)
    last = model.stages[-1]
    if hasattr(last, "coefficients"):
        out = linear_shap(feats, last.coefficients.toArray().tolist(), names)
    else:
        out = explain(feats, *tree_table(model), names)
    return out.withColumnRenamed("_id", id_col)


def _ranked(means: DataFrame) -> DataFrame:
    from riskweave.operators.evaluate import importance_rank
    return importance_rank(means, "feature", "mean_abs_shap")


def importance(values: DataFrame) -> DataFrame:
    """Mean |SHAP| per feature of a long table (feature, shap), ranked 1..n (ties by name)."""
    return _ranked(values.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap")))


def shap_importance(model: PipelineModel, sample: DataFrame, names: list[str], id_col: str = "SK_ID_CURR") -> DataFrame:
    """Mean |SHAP| per encoded feature over every row given, ranked 1..n (ties by name)."""
    if hasattr(model.stages[-1], "coefficients"):
        return importance(shap_values(model, sample, names, id_col))
    return _ranked(mean_values(_assembled(model, sample, id_col), *tree_table(model), names))
