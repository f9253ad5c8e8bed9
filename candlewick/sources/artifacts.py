"""Artifacts of many runs, read at once into flat tables keyed by run_id.

A run is a folder <root>/<run_id>/ with metrics.json, config.yaml and feature_importance.csv. Each
artifact may be a single file or a folder of part files as Spark writes it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions.sql import text
from candlewick.sources.logs import places_of, plain_part, read_log_lines, run_of

# Artifacts a run must have, in the order in which missing ones are reported.
REQUIRED_ARTIFACTS = ("metrics.json", "config.yaml", "feature_importance.csv")
PRECISION_TYPE = (
    "ARRAY<STRUCT<k_percent: DOUBLE, candidate_count: BIGINT, candidate_rate: DOUBLE, "
    "precision_at_k: DOUBLE, baseline: DOUBLE>>"
)
FOLD_TYPE = f"STRUCT<fold: STRING, rows: BIGINT, baseline: DOUBLE, precision_at_k: {PRECISION_TYPE}>"
EVENT_TYPE = (
    "STRUCT<event_name: STRING, frequency: BIGINT, event_rate: DOUBLE, trade_rate: DOUBLE, "
    f"precision_at_k: {PRECISION_TYPE}>"
)
METRICS_TYPE = (
    f"STRUCT<run_id: STRING, feature_columns: ARRAY<STRING>, evaluation: MAP<STRING, {FOLD_TYPE}>, "
    f"event_diagnostics: MAP<STRING, ARRAY<{EVENT_TYPE}>>, "
    "tuning: STRUCT<best_params: MAP<STRING, STRING>, total_combinations: BIGINT, total_fit_time: DOUBLE>, "
    "shap_importance: MAP<STRING, DOUBLE>>"
)
CONFIG_TYPE = (
    "STRUCT<model: STRUCT<n_estimators: BIGINT, max_depth: BIGINT, learning_rate: DOUBLE, "
    "scale_pos_weight: DOUBLE>, tuning: STRUCT<enabled: BOOLEAN>, shap: STRUCT<enabled: BOOLEAN>>"
)


@dataclass(frozen=True)
class RunTables:
    """Flat tables of many runs."""

    runs: DataFrame  # run_id, feature_columns, model parameters, tuning and attribution facts
    evaluation: DataFrame  # run_id, fold, rows, baseline
    precision: DataFrame  # run_id, fold, position, k_percent, ..., precision_at_k, baseline
    event_stats: DataFrame  # run_id, fold, position, event_name, frequency, event_rate, trade_rate
    event_precision: DataFrame  # run_id, fold, event_name, k_percent, ..., precision_at_k, baseline
    importance: DataFrame  # run_id, position, feature, importance
    artifacts: DataFrame  # run_id, artifact
    log_lines: DataFrame  # run_id, line_no, line


def complete_runs(artifacts: DataFrame) -> DataFrame:
    """Ids of the runs that have all artifacts, all readable."""
    return artifact_status(artifacts).filter("reason IS NULL").select("run_id")


def artifact_status(artifacts: DataFrame) -> DataFrame:
    """Per run the reason to skip it; NULL for a complete run."""
    missing = [
        f"CASE WHEN count_if(artifact = '{name}') = 0 THEN '{name}' END" for name in REQUIRED_ARTIFACTS
    ]
    status = artifacts.groupBy("run_id").agg(
        F.expr(f"concat_ws(', ', {', '.join(missing)}) AS _missing"),
        F.expr("array_sort(collect_set(CASE WHEN artifact LIKE 'unreadable %' THEN artifact END)) AS _bad"),
    )
    reason = (
        "CASE WHEN _missing <> '' THEN concat('missing artifacts: ', _missing) "
        "WHEN size(_bad) > 0 THEN array_join(_bad, ', ') END AS reason"
    )
    return status.selectExpr("run_id", reason)


def read_documents(spark: SparkSession, root: str, artifact: str) -> DataFrame:
    """One small document per run as (run_id, body); none if no run has it."""
    try:
        files = spark.read.text(places_of(root, artifact), wholetext=True)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "run_id STRING, body STRING")
    return files.selectExpr(f"{run_of('_metadata.file_path', artifact)} AS run_id", "value AS body")


READABLE = "coalesce(schema_of_variant(try_parse_json(body)) LIKE 'OBJECT%', false)"


def read_metrics(documents: DataFrame) -> DataFrame:
    """Readable metrics documents as (run_id, m)."""
    return documents.filter(READABLE).selectExpr("run_id", f"from_json(body, '{METRICS_TYPE}') AS m")


def _as_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Config documents, JSON or YAML, to JSON; a problem for what is no mapping."""

    def convert(body: str) -> tuple[str | None, str | None]:
        try:
            data = json.loads(body)
        except json.JSONDecodeError:
            import yaml  # only needed for configs written as YAML blocks

            try:
                data = yaml.safe_load(body)
            except yaml.YAMLError:
                return None, "not YAML"
        return (json.dumps(data, default=str), None) if isinstance(data, dict) else (None, "not a mapping")

    for batch in batches:
        pairs = [convert(body) for body in batch["body"]]
        yield batch.assign(body=[p[0] for p in pairs], problem=[p[1] for p in pairs])


def json_configs(documents: DataFrame) -> DataFrame:
    """Config documents as (run_id, body, problem): JSON, or why there is none."""
    return documents.mapInPandas(_as_json, "run_id STRING, body STRING, problem STRING")


def rejected_documents(spark: SparkSession, root: str) -> DataFrame:
    """Documents that cannot be used, as (run_id, artifact, problem), whether their run is complete or not."""
    metrics = read_documents(spark, root, "metrics.json").selectExpr(
        "run_id",
        "'metrics.json' AS artifact",
        "CASE WHEN try_parse_json(body) IS NULL THEN 'not JSON' "
        f"WHEN NOT {READABLE} THEN 'not an object' END AS problem",
    )
    configs = json_configs(read_documents(spark, root, "config.yaml")).selectExpr(
        "run_id", "'config.yaml' AS artifact", "problem"
    )
    header = r"split(lower(split(trim(body), '\r?\n')[0]), ' *, *')"
    importance = read_documents(spark, root, "feature_importance.csv").selectExpr(
        "run_id",
        "'feature_importance.csv' AS artifact",
        f"CASE WHEN NOT arrays_overlap({header}, array('feature')) OR NOT arrays_overlap({header}, array('importance')) "
        "THEN 'no columns feature and importance' END AS problem",
    )
    return metrics.unionAll(configs).unionAll(importance).filter("problem IS NOT NULL")


def read_configs(documents: DataFrame) -> DataFrame:
    """Config documents in JSON as (run_id, config_json, c)."""
    return documents.filter("body IS NOT NULL").selectExpr(
        "run_id", "body AS config_json", f"from_json(body, '{CONFIG_TYPE}') AS c"
    )


def read_importance(spark: SparkSession, root: str) -> DataFrame:
    """feature_importance.csv of every run, `position` counting up from the top of the file; columns go by name."""
    docs = read_documents(spark, root, "feature_importance.csv").selectExpr(
        "run_id", r"split(trim(body), '\\r?\\n') AS _lines"
    )
    named = docs.selectExpr(
        "run_id", "split(lower(_lines[0]), ' *, *') AS _names", "posexplode(slice(_lines, 2, size(_lines))) AS (position, _line)"
    )
    named = named.filter("trim(_line) <> ''")
    cell = "get(split(_line, ','), CAST(array_position(_names, '{0}') AS INT) - 1)"
    return named.selectExpr(
        "run_id",
        "CAST(position AS BIGINT) AS position",
        f"trim({cell.format('feature')}) AS feature",
        f"try_cast(trim({cell.format('importance')}) AS DOUBLE) AS importance",
    )


def list_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """Names of the artifacts of every run; reads no contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root if "://" in root else os.path.abspath(root.removeprefix("file:"))
    pattern = text(re.escape(base.rstrip("/")) + "/([^/]+)/([^/]+)")
    found = [plain_part(f"regexp_extract(path, {pattern}, {i})") for i in (1, 2)]
    return (
        files.selectExpr(f"{found[0]} AS run_id", f"{found[1]} AS artifact").filter("run_id <> ''").distinct()
    )


def read_runs(spark: SparkSession, root: str) -> RunTables | None:
    """All tables of the runs under a folder; None if the folder does not exist."""
    try:
        artifacts = list_artifacts(spark, root)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    # incomplete runs are not read; what cannot be read is listed as an artifact of that name, a reason to skip the run
    whole = complete_runs(artifacts)
    documents = read_documents(spark, root, "metrics.json").join(whole, "run_id", "left_semi")
    settings = json_configs(read_documents(spark, root, "config.yaml").join(whole, "run_id", "left_semi"))
    bad = documents.filter(f"NOT {READABLE}").selectExpr("run_id", "'unreadable metrics.json' AS artifact")
    bad = bad.unionAll(settings.filter("body IS NULL").selectExpr("run_id", "'unreadable config.yaml' AS artifact"))
    artifacts = artifacts.unionAll(bad)
    metrics, configs = read_metrics(documents), read_configs(settings)
    folds = metrics.selectExpr("run_id", "explode(m.evaluation) AS (fold, f)")
    events = metrics.selectExpr("run_id", "explode(m.event_diagnostics) AS (fold, events)").selectExpr(
        "run_id", "fold", "posexplode(events) AS (position, e)"
    )
    runs = metrics.join(configs, "run_id").selectExpr(
        "run_id",
        "m.feature_columns AS feature_columns",
        "c.model.n_estimators AS n_estimators",
        "c.model.max_depth AS max_depth",
        "c.model.learning_rate AS learning_rate",
        "c.model.scale_pos_weight AS scale_pos_weight",
        "coalesce(c.tuning.enabled, false) AS tuning_enabled",
        "coalesce(c.shap.enabled, false) AS shap_enabled",
        "m.tuning.total_combinations AS tuning_combinations",
        "m.tuning.total_fit_time AS tuning_seconds",
        "to_json(m.tuning.best_params) AS best_params",
        "config_json",
    )
    try:
        lines = read_log_lines(spark, root)
    except AnalysisException:  # no run has a log
        lines = spark.createDataFrame([], "run_id STRING, line_no BIGINT, line STRING")
    return RunTables(
        runs=runs,
        evaluation=folds.selectExpr("run_id", "fold", "f.rows AS rows", "f.baseline AS baseline"),
        precision=folds.selectExpr(
            "run_id", "fold", "posexplode(f.precision_at_k) AS (position, p)"
        ).selectExpr("run_id", "fold", "position", "p.*"),
        event_stats=events.selectExpr(
            "run_id",
            "fold",
            "position",
            "e.event_name AS event_name",
            "e.frequency AS frequency",
            "e.event_rate AS event_rate",
            "e.trade_rate AS trade_rate",
        ),
        event_precision=events.selectExpr(
            "run_id", "fold", "e.event_name AS event_name", "inline(e.precision_at_k)"
        ),
        importance=read_importance(spark, root),
        artifacts=artifacts,
        log_lines=lines,
    )
