"""Boosted-tree classifier: fit, score, summarise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.functions.sql import q
from candlewick.operators.labels import LABEL
from candlewick.operators.ranking import SCORE
from candlewick.session import work_dir

DEFAULTS = {
    "max_depth": 5,
    "learning_rate": 0.05,
    "n_estimators": 200,
    "scale_pos_weight": 8,
    "random_state": 42,
}


def train_model(
    df: DataFrame, features: Sequence[str], params: Mapping[str, Any] | None = None, label: str = LABEL
) -> PipelineModel:
    """Fit gradient-boosted trees with log-loss; positives weigh `scale_pos_weight`.

    Each tree passes over the rows once per level; hand in a stored frame.
    """
    params = {**DEFAULTS, **(params or {})}
    work_dir(df.sparkSession)  # boosting checkpoints there every few trees
    weight = f"CASE WHEN {q(label)} = 1 THEN {float(params['scale_pos_weight'])!r}D ELSE 1.0D END"
    rows = df.selectExpr(
        *map(q, features), f"CAST({q(label)} AS DOUBLE) AS _label", f"{weight} AS _weight"
    )
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error")
    trees = GBTClassifier(
        featuresCol="_features",
        labelCol="_label",
        weightCol="_weight",
        predictionCol="_prediction",
        maxDepth=int(params["max_depth"]),
        stepSize=float(params["learning_rate"]),
        maxIter=int(params["n_estimators"]),
        seed=int(params["random_state"]),
    )
    trees = trees.setProbabilityCol("_probability").setRawPredictionCol("_raw")
    return PipelineModel([assembler, trees.fit(assembler.transform(rows))])


def score(df: DataFrame, model: PipelineModel, name: str = SCORE) -> DataFrame:
    """Append the probability of class 1."""
    out = model.transform(df).withColumn(name, vector_to_array("_probability")[1])
    return out.select(*df.columns, name)


def log_loss(df: DataFrame, label: str = LABEL, name: str = SCORE) -> DataFrame:
    """Mean negative log-likelihood of the labels, as one row."""
    right = f"CASE WHEN {q(label)} = 1 THEN {q(name)} ELSE 1.0D - {q(name)} END"
    return df.agg(F.expr(f"avg(-ln(greatest(1e-15D, {right}))) AS log_loss"))


def training_facts(
    model: PipelineModel, train: DataFrame, val: DataFrame, label: str = LABEL
) -> dict[str, Any]:
    """Sizes and the validation loss of the last iteration; there is no early stopping."""
    loss = log_loss(score(val, model), label).head()["log_loss"]
    return {
        "train_size": train.count(),
        "val_size": val.count(),
        "best_iteration": None,
        "validation_score": loss,
    }


def feature_importance(df: DataFrame, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Importance per feature, highest first by `position`; `df` only lends its session."""
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    ranked = sorted(zip(features, values), key=lambda item: -item[1])
    rows = [(i, name, value) for i, (name, value) in enumerate(ranked)]
    schema = T.StructType(
        [
            T.StructField("position", T.IntegerType()),
            T.StructField("feature", T.StringType()),
            T.StructField("importance", T.DoubleType()),
        ]
    )
    return df.sparkSession.createDataFrame(rows, schema)
