"""Writers for the artifacts of a run.

Every artifact is a folder of part files under <root>/<run_id>/, written by Spark's own committers, so a
lost executor leaves no half-written file. The readers accept such folders and single files alike.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import datetime
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT_ROWS = 1000


def make_run_id(config: Mapping[str, Any], at: datetime | None = None) -> str:
    """<model>_<dataset>_<YYYY-MM-DD>_<HHMM>."""
    run = config.get("run") or {}
    at = at or datetime.now()
    return f"{run.get('model', 'gbt')}_{run.get('dataset', 'bars')}_{at:%Y-%m-%d_%H%M}"


def free_run_id(spark: SparkSession, root: str, base: str) -> str:
    """`base`, or `base` with the first free suffix _02, _03, ... if that run exists."""
    run_id, suffix = base, 2
    while _exists(spark, f"{root}/{run_id}"):
        run_id, suffix = f"{base}_{suffix:02d}", suffix + 1
    return run_id


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException:
        return False
    return True


def write_lines(spark: SparkSession, lines: Sequence[str], path: str) -> None:
    """A short text document."""
    spark.createDataFrame([(line,) for line in lines], "value STRING").coalesce(1).write.mode("overwrite").text(path)


def write_json(spark: SparkSession, value: Any, path: str) -> None:
    """A small JSON document; times turn into ISO text."""
    write_lines(spark, [json.dumps(value, default=plain)], path)


def plain(value: Any) -> Any:
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if hasattr(value, "tolist"):
        return value.tolist()
    return str(value)


def write_config(
    spark: SparkSession, config: Mapping[str, Any], run_dir: str, source: str | None = None
) -> None:
    """config.yaml: the source file word for word if there is one, else the mapping (JSON is YAML)."""
    if source is not None:
        try:
            lines = [row["value"] for row in spark.read.text(source, wholetext=True).collect()]
            return write_lines(spark, lines, f"{run_dir}/config.yaml")
        except AnalysisException:
            pass
    write_json(spark, config, f"{run_dir}/config.yaml")


def write_importance(importance: DataFrame, run_dir: str) -> None:
    """feature_importance.csv, highest first."""
    ordered = importance.orderBy("position").select("feature", "importance").coalesce(1)
    ordered.write.mode("overwrite").csv(f"{run_dir}/feature_importance.csv", header=True)


def write_model(model: PipelineModel, run_dir: str) -> None:
    model.write().overwrite().save(f"{run_dir}/model")


def write_search(spark: SparkSession, best: Mapping[str, Any], results: DataFrame, run_dir: str) -> None:
    """best_params.json and cv_results.csv."""
    write_json(spark, best, f"{run_dir}/best_params.json")
    results.coalesce(1).write.mode("overwrite").csv(f"{run_dir}/cv_results.csv", header=True, escape='"')


def write_attribution(importance: Mapping[str, float], spark: SparkSession, run_dir: str) -> None:
    """shap/shap_importance.json."""
    write_json(spark, importance, f"{run_dir}/shap/shap_importance.json")


def snapshot(
    df: DataFrame, rows: int = SNAPSHOT_ROWS, order: Sequence[str] = ("datetime", "series")
) -> DataFrame:
    """First rows in time order; Spark keeps `rows` rows per task, it does not sort the table."""
    return df.orderBy(*[name for name in order if name in df.columns]).limit(rows)


def write_snapshot(df: DataFrame, path: str, rows: int = SNAPSHOT_ROWS) -> None:
    flat = [
        F.col(f.name).cast("string").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else f.name
        for f in df.schema.fields
    ]
    snapshot(df, rows).select(*flat).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_documents(documents: DataFrame, root: str) -> None:
    """Documents of many runs, (run_id, artifact, body), in one job: <root>/run_id=.../artifact=.../part files."""
    columns = documents.select("run_id", "artifact", "body").repartition("run_id", "artifact")
    columns.write.partitionBy("run_id", "artifact").text(root)


def log_line(event: str, values: Mapping[str, Any], at: datetime | None = None) -> str:
    """`time | INFO | root | event | key=value | ...`."""
    stamp = (at or datetime.now()).strftime("%Y-%m-%d %H:%M:%S,%f")[:-3]
    pairs = [f"{key}={value}" for key, value in values.items()]
    return " | ".join([stamp, "INFO", "root", event, *pairs])
