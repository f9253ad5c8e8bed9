"""Runs as tables: written as a whole, read by pruning.

Every table is partitioned by run_id and written with dynamic partition overwrite, so a run that is written again takes
the place of its older self. Its rows carry the attempt that wrote them. The row of the run in the catalog comes last and
names the attempt that counts: a writer that dies on the way changes nothing that readers see, and rows of older attempts
in tables to which the new one added none are passed over.

The catalog has one small row per run (artifacts, reason to skip it, attempt) under month and run_id. Listing runs reads the
catalog; looking up a run opens that run's partitions alone.
"""

from __future__ import annotations

import uuid
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from candlewick.functions.sql import q, run_timestamp, text
from candlewick.sources.artifacts import RunTables, artifact_status

AT_K = "k_percent DOUBLE, candidate_count BIGINT, candidate_rate DOUBLE, precision_at_k DOUBLE, baseline DOUBLE"
LINE = "STRUCT<file: STRING, part: BIGINT, row: BIGINT>"
# Columns of the tables besides run_id.
TABLES = {
    "runs": "feature_columns ARRAY<STRING>, n_estimators BIGINT, max_depth BIGINT, learning_rate DOUBLE, "
    "scale_pos_weight DOUBLE, tuning_enabled BOOLEAN, shap_enabled BOOLEAN, tuning_combinations BIGINT, "
    "tuning_seconds DOUBLE, best_params STRING, config_json STRING",
    "evaluation": "fold STRING, rows BIGINT, baseline DOUBLE",
    "precision": f"fold STRING, position BIGINT, {AT_K}",
    "event_stats": "fold STRING, position BIGINT, event_name STRING, frequency BIGINT, event_rate DOUBLE, trade_rate DOUBLE",
    "event_precision": f"fold STRING, event_name STRING, {AT_K}",
    "importance": "position BIGINT, feature STRING, importance DOUBLE",
    "log_lines": f"line_no {LINE}, line STRING",
}
CATALOG = "timestamp STRING, artifacts ARRAY<STRING>, reason STRING"
MONTH = r"coalesce(nullif(regexp_extract(timestamp, '^(\\d{4}-\\d{2})', 1), ''), 'undated')"


class Runs(Protocol):
    """Whatever offers the frames of RunTables."""

    runs: DataFrame
    artifacts: DataFrame


def _fields(schema: str) -> list[tuple[str, str]]:
    """Names and types of a flat list of columns; commas inside <> do not separate."""
    found, depth, start = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            found.append(tuple(schema[start:i].strip().split(" ", 1)))
            start = i + 1
    return found


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a table in their types; what `df` lacks is NULL."""
    have = {f.name: f.dataType.typeName() for f in df.schema.fields}
    columns = []
    for name, kind in _fields(schema):
        value = q(name) if name in have else "NULL"
        if name == "line_no" and have.get(name) != "struct":
            value = f"named_struct('file', '', 'part', 0L, 'row', CAST({value} AS BIGINT))"
        columns.append(f"CAST({value} AS {kind}) AS {q(name)}")
    return df.selectExpr(*columns, "run_id")


def write_table(df: DataFrame, root: str, name: str, attempt: str, by: str = "run_id") -> None:
    """Replace the partitions of the runs in `df`."""
    shaped = _shaped(df, TABLES[name]).selectExpr("*", f"{text(attempt)} AS attempt")
    writer = shaped.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(by).parquet(f"{root}/{name}")


def write_runs(tables: Runs, root: str, attempt: str | None = None) -> str:
    """Write every table of the runs, then their rows in the catalog; returns the attempt."""
    attempt = attempt or uuid.uuid4().hex
    for name in TABLES:
        write_table(getattr(tables, name), root, name, attempt)
    names = tables.artifacts.filter("artifact NOT LIKE 'unreadable %'").groupBy("run_id")
    names = names.agg({"artifact": "collect_set"}).selectExpr("run_id", "sort_array(`collect_set(artifact)`) AS artifacts")
    status = artifact_status(tables.artifacts).join(names, "run_id", "left")
    rows = status.selectExpr(f"{run_timestamp('run_id')} AS timestamp", "artifacts", "reason", f"{text(attempt)} AS attempt", "run_id")
    rows = rows.selectExpr("*", f"{MONTH} AS month").repartition("month")
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("month", "run_id").parquet(f"{root}/catalog")
    return attempt


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table under its own schema, so that run ids stay text; empty if nothing was ever written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def read_catalog(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """run_id, timestamp, artifacts, reason, attempt; of one run if it is named, whose partition alone is opened."""
    rows = _read(spark, f"{root}/catalog", f"{CATALOG}, attempt STRING, month STRING, run_id STRING")
    if run_id is not None:
        here = f"{run_timestamp(text(run_id))}"
        rows = rows.filter(f"run_id = {text(run_id)} AND month = {MONTH.replace('timestamp', here, 1)}")
    return rows.select("run_id", "timestamp", "artifacts", "reason", "attempt")


def read_store(spark: SparkSession, root: str, run_id: str | None = None) -> RunTables:
    """The tables of all runs in the catalog, or of one."""
    catalog = read_catalog(spark, root, run_id)
    current = catalog.select("run_id", "attempt")

    def table(name: str) -> DataFrame:
        rows = _read(spark, f"{root}/{name}", f"{TABLES[name]}, attempt STRING, run_id STRING")
        if run_id is not None:
            rows = rows.filter(f"run_id = {text(run_id)}")
        return rows.join(current, ["run_id", "attempt"], "left_semi").drop("attempt")

    artifacts = catalog.selectExpr("run_id", "explode(artifacts) AS artifact")
    bad = catalog.filter("reason LIKE 'unreadable %'").selectExpr("run_id", "explode(split(reason, ', ')) AS artifact")
    return RunTables(artifacts=artifacts.unionAll(bad), **{name: table(name) for name in TABLES})
