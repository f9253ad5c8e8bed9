"""Shapley values of boosted trees, computed where the rows are.

For one leaf the prediction is a product game over the features on its path: feature j contributes
o_j (1 if the row meets all its conditions, else 0) when known, and r_j (the share of training weight
that meets them) when unknown. Shapley values of such a game follow from a polynomial in o and r, so
the cost is linear in the number of leaves and does not depend on the number of features.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.functions.sql import q
from candlewick.operators.sampling import sample_rows
from candlewick.session import work_dir

MAX_NODES = 5_000_000  # tree nodes that may be sent to every task


def tree_leaves(df: DataFrame, model: PipelineModel) -> list[tuple]:
    """Leaves of all trees as (value, features, lows, highs, shares), in log-odds.

    The size depends on the model only: trees times leaves. It is checked before it is collected.
    """
    spark = df.sparkSession
    trees = model.stages[-1]
    path = f"{work_dir(spark)}/models/{uuid.uuid4().hex}"
    trees.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if nodes.count() > MAX_NODES:
        raise ValueError(f"Model has more than {MAX_NODES} nodes")
    rows = nodes.selectExpr(
        "treeID AS tree",
        "nodeData.id AS id",
        "nodeData.prediction AS prediction",
        "nodeData.impurityStats[0] AS weight",
        "nodeData.leftChild AS left",
        "nodeData.rightChild AS right",
        "nodeData.split.featureIndex AS feature",
        "get(nodeData.split.leftCategoriesOrThreshold, 0) AS threshold",
    ).collect()
    by_key = {(r["tree"], r["id"]): r for r in rows}
    leaves = []
    for tree, tree_weight in enumerate(trees.treeWeights):
        pending = [(by_key[tree, 0], {})]
        while pending:
            node, path_conditions = pending.pop()
            if node["left"] < 0:
                conditions = list(path_conditions.items())
                # the probability is 1 / (1 + exp(-2 F)), so log-odds are twice the sum of trees
                leaves.append(
                    (
                        2.0 * tree_weight * node["prediction"],
                        [f for f, _ in conditions],
                        [c[0] for _, c in conditions],
                        [c[1] for _, c in conditions],
                        [c[2] for _, c in conditions],
                    )
                )
                continue
            feature, cut = node["feature"], node["threshold"]
            low, high, share = path_conditions.get(feature, (-np.inf, np.inf, 1.0))
            for side, bounds in (("left", (low, min(high, cut))), ("right", (max(low, cut), high))):
                child = by_key[tree, node[side]]
                part = child["weight"] / node["weight"]
                pending.append((child, {**path_conditions, feature: (*bounds, share * part)}))
    return leaves


def expected_margin(leaves: Sequence[tuple]) -> float:
    """Mean log-odds over the training weight: the base the Shapley values add to."""
    return float(sum(value * np.prod(shares) for value, _, _, _, shares in leaves))


def shapley(x: np.ndarray, leaves: Sequence[tuple]) -> np.ndarray:
    """Shapley values of a batch of rows, one column per feature."""
    out = np.zeros_like(x, dtype=float)
    for value, features, lows, highs, shares in leaves:
        d = len(features)
        if d == 0:
            continue
        part = x[:, features]
        known = ((part > np.array(lows)) & (part <= np.array(highs))).astype(float)
        weights = [factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)]
        for i, feature in enumerate(features):
            sums = np.zeros((d, len(x)))  # by the number of known features among the others
            sums[0] = 1.0
            for j in range(d):
                if j == i:
                    continue
                grown = sums * shares[j]
                grown[1:] += sums[:-1] * known[:, j]
                sums = grown
            out[:, feature] += value * (known[:, i] - shares[i]) * np.tensordot(weights, sums, axes=1)
    return out


def attribute(
    df: DataFrame,
    model: PipelineModel,
    features: Sequence[str],
    keys: Sequence[str] = ("series", "datetime"),
) -> DataFrame:
    """One row per row and feature: keys, feature, phi. The phi of a row add up to margin minus base."""
    leaves = df.sparkSession.sparkContext.broadcast(tree_leaves(df, model))
    features, keys = list(features), list(keys)
    rows = df.selectExpr(*map(q, keys), *[f"CAST({q(f)} AS DOUBLE) AS {q('x_' + f)}" for f in features])
    fields = [f for f in rows.schema.fields if f.name in keys]
    schema = T.StructType([*fields, T.StructField("_phi", T.ArrayType(T.DoubleType()))])

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[["x_" + f for f in features]].to_numpy(dtype=float)
            yield batch[keys].assign(_phi=list(shapley(x, leaves.value)))

    names = ", ".join(f"'{f}'" for f in features)
    phi = rows.mapInPandas(explain, schema).selectExpr(*map(q, keys), "posexplode(_phi) AS (_i, phi)")
    return phi.selectExpr(*map(q, keys), f"element_at(array({names}), _i + 1) AS feature", "phi")


def attribution_importance(phi: DataFrame) -> DataFrame:
    """Mean absolute Shapley value per feature."""
    return phi.groupBy("feature").agg(F.expr("avg(abs(phi)) AS mean_abs_shap"))


def explain_sample(
    df: DataFrame,
    model: PipelineModel,
    features: Sequence[str],
    sample_size: int | None = None,
    *,
    series: Sequence[str] = ("series",),
    time: str = "datetime",
) -> DataFrame:
    """Importance over a reproducible sample of at most `sample_size` rows; all rows without a size."""
    rows = df if sample_size is None else sample_rows(df, sample_size, series=series, time=time)
    return attribution_importance(attribute(rows, model, features, [*series, time]))
