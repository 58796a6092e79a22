"""Model explanation with Shapley values.

* ``tree_shap``  -- exact path-dependent Tree SHAP for Spark random forests
  and boosted trees.  A fitted Spark model is saved to the shared
  checkpoint folder and its node table read back as a DataFrame; the node
  table is bounded by the model size (trees x nodes), not by the data, and is
  broadcast.  Rows are explained in Arrow batches by ``mapInPandas`` and come
  out long: ``(row, class, feature, phi)``.
* ``permutation_shap`` -- model-agnostic sampled-permutation Shapley values:
  a perceptron is evaluated in Arrow batches, a row's equal points once; for
  other models every (row, permutation, step) is a row of a Spark DataFrame
  evaluated by the model's own ``transform``.
* ``kernel_shap`` -- model-agnostic Shapley values by the Shapley kernel: values
  of coalitions, one least-squares system per row and class; exact when all
  coalitions are used.
* ``global_importance`` -- mean |phi| per feature and class, top features.

Path-dependent Tree SHAP, per leaf: with the unique features ``F`` on the
leaf's path, ``z_f`` the product of cover ratios of the path's splits on
``f`` and ``o_f(x)`` whether ``x`` passes all of them, the leaf adds to
feature ``i in F``::

    v * (o_i - z_i) * sum_{S in F\\{i}} |S|! (m-|S|-1)! / m! * prod_{S} o * prod_{F\\S\\i} z

The inner sum is read off the coefficients of ``prod_{j != i}(z_j + o_j t)``,
computed for all leaves of a tree at once (paths padded with neutral
factors) and all rows of a batch.
"""

from __future__ import annotations

import math
import uuid
import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postresp.operators.perceptron import unfold
from postresp.session import scratch_path

# ------------------------------------------------------------- node tables --


def _node_table(spark, path: str) -> pd.DataFrame:
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats",
        "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
        F.col("nodeData.split.leftCategoriesOrThreshold").alias("thr"),
        "nodeData.split.numCategories")
    return nodes.toPandas()  # bounded by model size


def _tree_weights(spark, path: str) -> dict:
    w = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "meta", "weight")
    return {int(r.treeID): float(r.weight) for r in w.collect()}


def _softmax_nodes(model, tree) -> pd.DataFrame:
    """A tree of ``operators.boosting`` in the form of Spark's node table."""
    inner = [f >= 0 for f in tree.feature]
    return pd.DataFrame({
        "id": range(len(inner)), "prediction": tree.value, "impurityStats": [[c] for c in tree.cover], "leftChild": tree.left,
        "rightChild": [x + 1 if x >= 0 else -1 for x in tree.left], "featureIndex": tree.feature,
        "thr": [[model.thresholds(tree, k)] if inner[k] else [] for k in range(len(inner))], "numCategories": -1})


def _compile_tree(nodes: pd.DataFrame, value_fn, n_out: int):
    """Paths of one tree: per leaf, unique features with interval (lo, hi], z, value."""
    by_id = {int(r.id): r for r in nodes.itertuples(index=False)}

    def cover(r):
        s = np.asarray(r.impurityStats, dtype=float)
        return float(s.sum()) if value_fn == "proba" else float(s[0])

    leaves = []

    def walk(nid, conds):
        r = by_id[nid]
        if r.leftChild < 0:
            if value_fn == "proba":
                s = np.asarray(r.impurityStats, dtype=float)
                v = s / s.sum() if s.sum() > 0 else np.zeros(n_out)
            else:
                v = np.array([float(r.prediction)])
            leaves.append((dict(conds), v))
            return
        if r.numCategories is not None and r.numCategories >= 0:
            raise NotImplementedError("categorical splits are not supported by tree_shap")
        f, thr = int(r.featureIndex), float(r.thr[0])
        c = cover(r)
        for child, left in ((int(r.leftChild), True), (int(r.rightChild), False)):
            ratio = cover(by_id[child]) / c if c > 0 else 0.0
            lo, hi, z = conds.get(f, (-np.inf, np.inf, 1.0))
            new = (lo, min(hi, thr), z * ratio) if left else (max(lo, thr), hi, z * ratio)
            walk(child, {**conds, f: new})

    walk(0, {})
    depth = max(1, max(len(c) for c, _ in leaves))
    n_leaf = len(leaves)
    feat = np.full((n_leaf, depth), -1, dtype=np.int64)
    lo = np.full((n_leaf, depth), -np.inf)
    hi = np.full((n_leaf, depth), np.inf)
    z = np.ones((n_leaf, depth))
    m = np.zeros(n_leaf, dtype=np.int64)
    vals = np.zeros((n_leaf, n_out))
    for li, (conds, v) in enumerate(leaves):
        for si, (f, (a, b, zz)) in enumerate(sorted(conds.items())):
            feat[li, si], lo[li, si], hi[li, si], z[li, si] = f, a, b, zz
        m[li] = len(conds)
        vals[li] = v
    # Shapley weights w(s, m) = s! (m - s - 1)! / m!, s < m
    w = np.zeros((n_leaf, depth))
    for li in range(n_leaf):
        mm = m[li]
        for s in range(mm):
            w[li, s] = math.factorial(s) * math.factorial(mm - s - 1) / math.factorial(mm)
    base = (vals * np.prod(z, axis=1, keepdims=True)).sum(axis=0)
    return dict(feat=feat, lo=lo, hi=hi, z=z, w=w, vals=vals, base=base)


def _stack(parts, n_out: int) -> dict:
    """Stack the leaves of all trees (all classes) into one padded path table.

    Each leaf value is pre-multiplied by its tree weight and placed in its
    output column, so the model output is the plain sum over stacked leaves.
    """
    depth = max(t["feat"].shape[1] for trees, _ in parts for t in trees)
    feat, lo, hi, z, w, vals = [], [], [], [], [], []
    base = np.zeros(n_out)
    for c, (trees, ws) in enumerate(parts):
        for t, wt in zip(trees, ws):
            L, d = t["feat"].shape
            pad = depth - d
            feat.append(np.pad(t["feat"], ((0, 0), (0, pad)), constant_values=-1))
            lo.append(np.pad(t["lo"], ((0, 0), (0, pad)), constant_values=-np.inf))
            hi.append(np.pad(t["hi"], ((0, 0), (0, pad)), constant_values=np.inf))
            z.append(np.pad(t["z"], ((0, 0), (0, pad)), constant_values=1.0))
            w.append(np.pad(t["w"], ((0, 0), (0, pad))))
            v = np.zeros((L, n_out))
            if t["vals"].shape[1] == n_out:
                v[:] = wt * t["vals"]
                base += wt * t["base"]
            else:  # one-output tree of class c (one-vs-rest)
                v[:, c] = wt * t["vals"][:, 0]
                base[c] += wt * t["base"][0]
            vals.append(v)
    st = dict(feat=np.vstack(feat), lo=np.vstack(lo), hi=np.vstack(hi), z=np.vstack(z),
              w=np.vstack(w), vals=np.vstack(vals), base=base)
    flat = st["feat"].reshape(-1)
    slots = np.nonzero(flat >= 0)[0]
    order = np.argsort(flat[slots], kind="stable")
    st["slot_order"] = slots[order]
    uniq, starts = np.unique(flat[slots][order], return_index=True)
    st["slot_feat"], st["slot_starts"] = uniq, starts
    return st


def _stacked_phi(st, X: np.ndarray, n_features: int) -> np.ndarray:
    """(rows, features, outputs) Tree SHAP over all stacked leaves at once."""
    feat, z, w = st["feat"], st["z"], st["w"]
    n_leaf, depth = feat.shape
    real = feat >= 0
    xv = X[:, np.where(real, feat, 0)]                               # (R, L, D)
    o = ((xv > st["lo"]) & (xv <= st["hi"]) & real).astype(float)    # pads: o = 0, z = 1
    R = X.shape[0]
    # P(t) = prod_slots (z + o t): coefficients (R, L, D + 1)
    P = np.zeros((R, n_leaf, depth + 1))
    P[:, :, 0] = 1.0
    for s_ in range(depth):
        new = P * z[None, :, s_, None]
        new[:, :, 1:] += P[:, :, :-1] * o[:, :, s_, None]
        P = new
    contrib = np.zeros((R, n_leaf, depth))
    zsafe = np.where(z > 0, z, 1.0)
    for i in range(depth):
        zi, oi = z[None, :, i], o[:, :, i]
        # divide out (z_i + o_i t): o_i = 0 -> P / z_i; o_i = 1 -> synthetic division
        Q_div = np.empty((R, n_leaf, depth))
        Q_div[:, :, depth - 1] = P[:, :, depth]
        for k in range(depth - 1, 0, -1):
            Q_div[:, :, k - 1] = P[:, :, k] - zi * Q_div[:, :, k]
        tot_div = np.einsum("rld,ld->rl", Q_div, w)
        tot_const = np.einsum("rld,ld->rl", P[:, :, :depth], w) / zsafe[None, :, i]
        total = np.where(oi > 0, tot_div, tot_const)
        contrib[:, :, i] = np.where(real[None, :, i], (oi - zi) * total, 0.0)
    flat_c = contrib.reshape(R, n_leaf * depth)[:, st["slot_order"]]     # (R, S)
    leaf_of_slot = st["slot_order"] // depth
    cv = flat_c[:, :, None] * st["vals"][leaf_of_slot][None, :, :]        # (R, S, C)
    phi = np.zeros((R, n_features, st["vals"].shape[1]))
    if cv.shape[1]:
        phi[:, st["slot_feat"], :] = np.add.reduceat(cv, st["slot_starts"], axis=1)
    return phi


def compile_model(model, spark, kind: str, n_classes: int = 3) -> dict:
    """Compile the trees of ``model``; Spark's own models are saved under the shared
    checkpoint folder and their node tables read."""
    if kind == "XGB":  # joint soft-max: its trees by class, leaves are margins
        rounds = next(iter(model.rounds.values()))
        return _stack([([_compile_tree(_softmax_nodes(model, r[c]), "value", 1) for r in rounds], [1.0] * len(rounds)) for c in range(n_classes)], n_classes)
    path = scratch_path(spark, f"shap-models/{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    if kind == "RF":
        nodes = _node_table(spark, path)
        trees = [_compile_tree(g, "proba", n_classes) for _, g in nodes.groupby("treeID")]
        parts = [(trees, [1.0 / len(trees)] * len(trees))]
    elif kind == "GBT":  # one-vs-rest of binary GBTs: one margin per class
        parts = []
        for c in range(n_classes):
            sub = f"{path}/model_{c}"
            nodes = _node_table(spark, sub)
            weights = _tree_weights(spark, sub)
            trees, ws = [], []
            for tid, g in nodes.groupby("treeID"):
                trees.append(_compile_tree(g, "value", 1))
                ws.append(weights[int(tid)])
            parts.append((trees, ws))
    else:
        raise ValueError(f"tree_shap supports RF, XGB and GBT models, not {kind}")
    return _stack(parts, n_classes)


def shap_matrix(stacked: dict, X: np.ndarray, chunk_cells: int = 4_000_000
                ) -> tuple[np.ndarray, np.ndarray]:
    """(phi[rows, features, classes], base[classes]) for a batch of rows,
    in row chunks so the (rows x leaves x depth) work arrays stay bounded."""
    n_leaf, depth = stacked["feat"].shape
    # identical feature vectors have identical Shapley values: compute once
    U, inverse = np.unique(X, axis=0, return_inverse=True)
    step = max(1, chunk_cells // max(1, n_leaf * (depth + 1)))
    phi_u = np.concatenate([_stacked_phi(stacked, U[i:i + step], X.shape[1])
                            for i in range(0, U.shape[0], step)], axis=0)
    return phi_u[inverse.reshape(-1)], stacked["base"]


def tree_shap(model, data: DataFrame, kind: str, feature_names: list[str] | None = None,
              n_classes: int = 3, features_col: str = "features") -> DataFrame:
    """L2: ``(row, class, feature, phi, base)`` for every row of ``data``.

    For RF the explained output is the class probability, for one-vs-rest
    GBT the class margin; ``sum(phi) + base`` equals the model output.
    """
    spark = data.sparkSession
    compiled = spark.sparkContext.broadcast(compile_model(model, spark, kind, n_classes))
    names = feature_names

    def explain(batches):
        comp = compiled.value
        for pdf in batches:
            if pdf.empty:
                continue
            X = np.stack(pdf["_x"].to_numpy()).astype(float)
            phi, base = shap_matrix(comp, X)
            R, Fn, C = phi.shape
            fnames = names or [f"f{j}" for j in range(Fn)]
            yield pd.DataFrame({
                "row": np.repeat(pdf["row"].to_numpy(), Fn * C),
                "class": np.tile(np.arange(C), R * Fn).astype("int32"),
                "feature": np.tile(np.repeat(np.array(fnames, dtype=object), C), R),
                "phi": phi.reshape(-1),
                "base": np.tile(base, R * Fn),
            })

    # SHAP costs far more per row than moving a feature vector: spread the
    # rows over at least as many tasks as there are cores
    n = max(spark.sparkContext.defaultParallelism,
            int(spark.conf.get("spark.sql.shuffle.partitions")))
    src = data.select("row", vector_to_array(features_col).alias("_x")).repartition(n)
    return src.mapInPandas(explain, "row long, class int, feature string, phi double, base double")


# ------------------------------------------------------ model-agnostic -----
SAMPLE_VALUES = 8192    #: values of the samples in a record of ``permutation_shap`` at most


def probability_function(model):
    """The model as a function from a matrix of rows to their class probabilities,
    or ``None``: networks with ``probabilities`` and Spark's perceptron have one."""
    if hasattr(model, "probabilities"):
        return model.probabilities
    if not isinstance(model, MultilayerPerceptronClassificationModel):
        return None
    sizes = list(model.getLayers())
    layers = unfold(model.weights.toArray(), list(zip(sizes, sizes[1:])))

    def probabilities(x: np.ndarray) -> np.ndarray:
        for w, b in layers[:-1]:
            x = 1.0 / (1.0 + np.exp(-(x @ w + b)))
        raw = x @ layers[-1][0] + layers[-1][1]
        out = np.exp(raw - raw.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)

    return probabilities


def _sampled_sums(chances, base: np.ndarray, names: list[str], n_samples: int):
    """Of records ``row, x, bids, perms`` (background row and permutation of each
    sample): ``row, class, feature, phi``, the changes of the output summed over
    the samples.  Points with the same features switched in over the same
    background row are evaluated once."""
    nb, d = base.shape

    def run(batches):
        import pyarrow as pa

        from postresp.operators.blocks import matrix
        table = None
        if d < 20 and nb << d <= n_samples * (d + 1):     # every point may occur: no search for the different ones
            member = ((np.arange(1 << d)[:, None] >> np.arange(d)) & 1).astype(bool)
            table = np.tile(member, (nb, 1)), np.repeat(base, 1 << d, axis=0)
        for batch in batches:
            xs = matrix(batch.column(1))
            for i in range(batch.num_rows):
                bid = batch.column(2)[i].values.to_numpy().astype(np.int64)
                perm = batch.column(3)[i].values.to_numpy().astype(np.int64).reshape(len(bid), d)
                # features switched in after k steps
                inside = np.zeros((len(bid), d + 1, d), bool)
                np.put_along_axis(inside[:, 1:], perm[:, :, None], True, axis=2)
                inside = np.logical_or.accumulate(inside, axis=1)
                if table is not None:
                    value = chances(np.where(table[0], xs[i], table[1]))
                    at = (bid[:, None] << d) + inside @ (1 << np.arange(d))
                else:
                    points = np.where(inside, xs[i], base[bid][:, None, :]).reshape(-1, d)
                    points, at = np.unique(points, axis=0, return_inverse=True)
                    value, at = chances(points), at.reshape(len(bid), d + 1)
                delta = (value[at[:, 1:]] - value[at[:, :-1]]).reshape(len(bid) * d, -1)
                phi = np.stack([np.bincount(perm.ravel(), delta[:, c], d) for c in range(delta.shape[1])])
                n = phi.size
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.full(n, i))), pa.array(np.repeat(np.arange(len(phi), dtype=np.int32), d)),
                     pa.array(names * len(phi)), pa.array(phi.ravel())], names=["row", "class", "feature", "phi"])

    return run


def permutation_shap(model, explain_rows: DataFrame, background: DataFrame, n_features: int,
                     n_samples: int = 1000, seed: int = 13, features_col: str = "features",
                     output_col: str = "probability", n_classes: int = 3,
                     feature_names: list[str] | None = None, max_background: int = 10_000) -> DataFrame:
    """L3: sampled-permutation Shapley values of ``model`` for ``explain_rows``.

    For sample j of row r: a seeded random permutation of the features and a
    background row; step k takes the first k permuted features from the row,
    the rest from the background; ``phi`` of the k-th feature is the mean
    change of the output when it is switched in.  ``background`` should be
    small: it is broadcast, after a check against ``max_background`` rows.
    """
    n_bg = background.count()
    if n_bg > max_background:
        raise ValueError(f"background set larger than {max_background} rows; sample it first")
    bg = (background.select(vector_to_array(features_col).alias("_b"))
          .withColumn("_bid", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1))
    d = n_features
    names = feature_names or [f"f{j}" for j in range(d)]
    rows = explain_rows.select("row", vector_to_array(features_col).alias("_x"))
    key = lambda s: F.concat_ws(":", F.lit(str(seed)), F.col("row").cast("string"), s.cast("string"))
    bid = lambda k: F.pmod(F.xxhash64(k), F.lit(n_bg))
    perm = lambda k: F.transform(
        F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: F.struct(F.xxhash64(k, j).alias("h"), j.alias("j")))), lambda s: s["j"])
    chances = probability_function(model)
    if chances is not None:
        base = np.array([r["_b"] for r in bg.orderBy("_bid").collect()], float).reshape(n_bg, d)
        n = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        per = max(1, min(n_samples, SAMPLE_VALUES // (d + 1)))
        samp = rows.repartition(n).withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1), F.lit(per))))
        samples = F.sequence(F.col("_at"), F.least(F.col("_at") + per, F.lit(n_samples)) - 1)
        samp = samp.withColumn("_keys", F.transform(samples, key))
        samp = samp.select("row", "_x", F.transform("_keys", bid).alias("_bids"),
                           F.flatten(F.transform("_keys", perm)).cast("array<smallint>").alias("_perms"))
        sums = samp.mapInArrow(_sampled_sums(chances, base, names, per), "row long, class int, feature string, phi double")
        return sums.groupBy("row", "class", "feature").agg((F.sum("phi") / n_samples).alias("phi"))
    samp = rows.select("row", "_x", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("_s"))
    samp = samp.withColumn("_key", key(F.col("_s")))
    samp = samp.withColumn("_bid", bid(F.col("_key")))
    perm = perm(F.col("_key"))
    samp = samp.withColumn("_perm", perm).join(F.broadcast(bg), "_bid")
    steps = samp.select("row", "_s", "_x", "_b", "_perm",
                        F.explode(F.sequence(F.lit(0), F.lit(d))).alias("_k"))
    mixed = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: F.when(
        F.array_position(F.slice("_perm", 1, F.greatest(F.col("_k"), F.lit(1))), j) > 0,
        F.when(F.col("_k") > 0, F.col("_x")[j]).otherwise(F.col("_b")[j])).otherwise(F.col("_b")[j]))
    from pyspark.ml.functions import array_to_vector
    ev = steps.withColumn(features_col, array_to_vector(mixed))
    out = model.transform(ev).withColumn("_out", vector_to_array(output_col))
    # each point's output counts for the feature it switched in and against the
    # one the next point switches in: one sum, no order needed
    signed = out.select("row", "_out", F.explode(F.array(
        F.struct(F.when(F.col("_k") > 0, F.get("_perm", F.col("_k") - 1)).alias("feature_idx"), F.lit(1.0).alias("sign")),
        F.struct(F.when(F.col("_k") < d, F.get("_perm", F.col("_k"))).alias("feature_idx"), F.lit(-1.0).alias("sign")))).alias("e"))
    signed = signed.select("row", "_out", "e.*").where("feature_idx IS NOT NULL")
    per_class = signed.select("row", "feature_idx", F.posexplode(
        F.transform("_out", lambda o: o * F.col("sign"))).alias("class", "delta"))
    phi = per_class.groupBy("row", "class", "feature_idx").agg((F.sum("delta") / n_samples).alias("phi"))
    fmap = F.create_map(*[x for j, n in enumerate(names) for x in (F.lit(j), F.lit(n))])
    return phi.select("row", F.col("class").cast("int").alias("class"),
                      F.element_at(fmap, F.col("feature_idx")).alias("feature"), "phi")


def coalitions(n_features: int, n_samples: int = 1000, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """(members, weights): all proper coalitions with their Shapley kernel weights if
    they are no more than ``n_samples``, else a seeded draw of pairs (a coalition
    and its complement) by the kernel's weight of their size."""
    d = n_features
    if 2**d - 2 <= n_samples:
        members = (np.arange(1, 2**d - 1)[:, None] >> np.arange(d)) & 1
        size = members.sum(1)
        weights = np.array([(d - 1) / (math.comb(d, s) * s * (d - s)) for s in size.tolist()])
        return members.astype(float), weights
    rng = np.random.default_rng(seed)
    share = np.array([1.0 / (s * (d - s)) for s in range(1, d)])
    drawn = rng.choice(np.arange(1, d), size=n_samples // 2, p=share / share.sum())
    half = np.zeros((len(drawn), d))
    for k, s in enumerate(drawn):
        half[k, rng.permutation(d)[:s]] = 1.0
    members, counts = np.unique(np.vstack([half, 1.0 - half]), axis=0, return_counts=True)
    return members, counts.astype(float)


def shapley_operator(members: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The least-squares system as a matrix: Shapley values = matrix @ (value of each
    coalition, of none, of all).  They sum to the difference of the last two by construction."""
    m, d = members.shape
    none, every = np.zeros(m + 2), np.zeros(m + 2)
    none[m], every[m + 1] = 1.0, 1.0
    if d == 1:
        return (every - none)[None]
    # the last feature takes what the others leave of the total
    x = members[:, :-1] - members[:, -1:]
    y = np.hstack([np.eye(m), np.zeros((m, 2))]) - none - members[:, -1:] * (every - none)
    xw = x.T * weights
    first = np.linalg.lstsq(xw @ x, xw @ y, rcond=None)[0]
    return np.vstack([first, (every - none) - first.sum(0)])


def kernel_shap(model, explain_rows: DataFrame, background: DataFrame, n_features: int, n_samples: int = 1000, seed: int = 13,
                features_col: str = "features", output_col: str = "probability", n_classes: int = 3,
                feature_names: list[str] | None = None, max_background: int = 10_000) -> DataFrame:
    """L3: ``row, class, feature, phi`` by the Shapley kernel, against every background row.

    A coalition's value is the mean output with its features from the row and the
    others from each background row.  The weighted least squares of a row and
    class, constrained to the total, is linear in these values with the same
    matrix for all rows: one weighted sum.  All coalitions are used when they are
    few (62 for six features): the values are then exact.  The row itself is
    evaluated once, the background once for all rows.

    Models with ``probabilities(matrix)`` are evaluated in Arrow batches, others
    by their ``transform`` of the exploded points.  ``background`` is collected
    after a check against ``max_background`` rows."""
    from postresp.operators.blocks import array_column, matrix
    bg = background.select(array_column(background, features_col).alias("b")).limit(max_background + 1).collect()
    if len(bg) > max_background:
        raise ValueError(f"background set larger than {max_background} rows; sample it first")
    base = np.array([r.b for r in bg], float).reshape(len(bg), n_features)
    members, weights = coalitions(n_features, n_samples, seed)
    solve = shapley_operator(members, weights)
    names = feature_names or [f"f{j}" for j in range(n_features)]
    rows = explain_rows.select("row", array_column(explain_rows, features_col).alias("x"))
    if hasattr(model, "probabilities"):
        def run(batches):
            import pyarrow as pa
            net = model
            m, nb, d = len(members), len(base), members.shape[1]
            none = net.probabilities(base).mean(0)
            per = max(1, 200_000 // max(1, m * nb))
            for batch in batches:
                for at in range(0, batch.num_rows, per):
                    part = batch.slice(at, per)
                    x = matrix(part.column(1))
                    points = np.where(members[None, :, None, :] > 0, x[:, None, None, :], base[None, None])
                    value = net.probabilities(points.reshape(-1, d)).reshape(len(x), m, nb, -1).mean(2)
                    every = net.probabilities(x)
                    values = np.concatenate([value, np.broadcast_to(none, (len(x), 1, len(none))), every[:, None]], 1)
                    phi = np.einsum("jm,rmc->rcj", solve, values)
                    n, c = len(x), phi.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(part.column(0).to_numpy(), c * d)), pa.array(np.tile(np.repeat(np.arange(c, dtype=np.int32), d), n)),
                         pa.array(names * (n * c)), pa.array(phi.ravel())], names=["row", "class", "feature", "phi"])

        return rows.mapInArrow(run, "row long, class int, feature string, phi double")
    from pyspark.ml.functions import array_to_vector
    # coalition k of the points; the last two stand for none and all
    every = np.vstack([members, np.zeros(n_features), np.ones(n_features)])
    member = F.array(*[F.array(*[F.lit(bool(v)) for v in m]) for m in every])
    table = F.array(*[F.array(*[F.lit(float(v)) for v in b]) for b in base])
    per_point = np.full(len(every), 1.0 / len(base))
    per_point[-1] = 1.0                                     # the row itself, once
    k, b = F.col("k"), F.col("b")
    points = rows.select("row", "x", F.explode(F.sequence(F.lit(0), F.lit(len(every) - 1))).alias("k"))
    points = points.withColumn("b", F.explode(F.when(k == len(every) - 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(len(base) - 1)))))
    mixed = F.zip_with(F.zip_with(F.get(member, k), "x", lambda m, v: F.struct(m.alias("m"), v.alias("v"))), F.get(table, b),
                       lambda p, v: F.when(p["m"], p["v"]).otherwise(v))
    out = model.transform(points.select("row", "k", array_to_vector(mixed).alias(features_col))).withColumn("p", vector_to_array(output_col))
    # the weight a point's output has in each feature's value
    share = [F.array(*[F.lit(float(v)) for v in solve[j] * per_point]) for j in range(n_features)]
    sums = [F.sum(F.get(share[j], k) * F.get("p", F.lit(c))).alias(f"v{c}_{j}") for c in range(n_classes) for j in range(n_features)]
    wide = out.groupBy("row").agg(*sums)
    cells = [F.struct(F.lit(c).alias("class"), F.lit(names[j]).alias("feature"), F.col(f"v{c}_{j}").alias("phi")) for c in range(n_classes) for j in range(n_features)]
    return wide.select("row", F.explode(F.array(*cells)).alias("e")).select("row", "e.*")


def global_importance(phi: DataFrame, top: int = 15) -> DataFrame:
    """L4: mean |phi| per (feature, class) for the ``top`` features by total."""
    per = phi.groupBy("feature", "class").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
    tot = per.groupBy("feature").agg(F.sum("mean_abs_phi").alias("_t"))
    rank = tot.withColumn("rank", F.row_number().over(Window.orderBy(F.round("_t", 9).desc(), "feature")))
    keep = rank.where(F.col("rank") <= top).select("feature", "rank")  # one row per feature
    return per.join(F.broadcast(keep), "feature").select("rank", "feature", "class", "mean_abs_phi")
