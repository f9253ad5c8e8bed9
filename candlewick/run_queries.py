"""Queries over stored runs: written as tables or as files, read back, listed, looked up and compared.

Twenty runs or so, one per series and ten days. Some lack an artifact and are skipped.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick import catalog
from candlewick.catalog import query, run_tables, scored
from candlewick.functions.sql import text
from candlewick.operators import attribution, models, ranking, sampling, tuning
from candlewick.plans import run_analytics as runs
from candlewick.session import stage, work_dir
from candlewick.sinks import artifacts as sink
from candlewick.sinks.run_documents import metrics_documents
from candlewick.sinks.run_store import read_catalog, read_store, write_runs, write_table
from candlewick.sources.artifacts import read_documents, read_importance, read_runs, rejected_documents

PERIOD = "concat(date_format(datetime, 'yyyy-MM'), '-', lpad(CAST(floor((day(datetime) - 1) / 10) * 10 + 1 AS STRING), 2, '0'))"


class period_tables(run_tables):
    """Runs of ten days each."""

    def __init__(self, spark, sf):
        rows = scored(spark, sf).selectExpr("*", f"concat(series, '_m1_', {PERIOD}, '_2300') AS run_id")
        self.rows = stage(rows, "runs")


def fresh(spark, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(spark, sf) -> str:
    """A store to which all runs were written twice, the first time with rows that must not stay."""
    root = fresh(spark, "store")
    tables = period_tables(spark, sf)
    write_runs(tables, root)
    write_runs(tables, root)
    return root


def newest(spark, root: str, n: int = 1) -> list[str]:
    """The newest complete runs, from the catalog alone; none if all runs lack artifacts."""
    complete = read_catalog(spark, root).filter("reason IS NULL AND run_id IS NOT NULL")
    return [r["run_id"] for r in complete.orderBy(F.desc("timestamp"), F.desc("run_id")).limit(n).collect()]


@query
def metrics_sink(spark, sf):
    """Written twice, read back once."""
    root, precision = fresh(spark, "metrics"), run_tables(spark, sf).precision
    for attempt in ("first", "second"):
        write_table(precision, root, "precision", attempt)
    return spark.read.parquet(f"{root}/precision").drop("position", "attempt")


@query
def run_store_listing(spark, sf):
    found = runs.overview(read_store(spark, stored(spark, sf)))
    return found.select(
        "position", "run_id", "timestamp", "reason", "skipped_runs", "feature_count", "val_rows", "test_lift_at_0_5", "top_feature"
    )


@query
def run_store_lookup(spark, sf):
    root = stored(spark, sf)
    found = newest(spark, root)
    return runs.find_run(read_store(spark, root, found[0] if found else ""), found[0] if found else "")


def long_form(view: str, df: DataFrame, item: str, value: str) -> DataFrame:
    return df.selectExpr(f"{text(view)} AS view", f"{item} AS item", f"CAST({value} AS DOUBLE) AS value")


def detail_rows(detail: dict[str, DataFrame]) -> DataFrame:
    """All views of a run in one table: view, item, value."""
    views = [
        long_form("summary", detail["summary"], "'val_rows'", "val_rows"),
        long_form("summary", detail["summary"], "'test_baseline'", "test_baseline"),
        long_form("lift", detail["scorecard"], "training_label", "out_of_sample_lift"),
        long_form("importance", detail["feature_importance"], "feature", "importance"),
        long_form("top", detail["importance_top"], "feature", "rank"),
        long_form("precision", detail["precision_matrix"], "concat(fold, ' ', k_label)", "precision_at_k"),
        long_form("quality", detail["quality_series"], "label", "test_precision"),
        long_form("event", detail["event_series"], "concat(fold, ' ', event_name)", "baseline_at_0_5"),
        long_form("training", detail["training_summary"], "array_join(selected_features, ',')", "positive_rate"),
        long_form("funnel", detail["row_funnel"], "stage", "rows"),
        long_form("log", detail["logs_preview"].filter("line_rank <= 6"), "line", "line_rank"),
    ]
    rows = views[0]
    for view in views[1:]:
        rows = rows.unionAll(view)
    return rows


@query
def run_detail(spark, sf):
    """All views of the newest complete run; no rows if there is none."""
    root = stored(spark, sf)
    found = newest(spark, root)
    if not found:
        return spark.createDataFrame([], "view STRING, item STRING, value DOUBLE, run_id STRING")
    run_id = found[0]
    return detail_rows(runs.run_detail(read_store(spark, root, run_id), run_id)).withColumn("run_id", F.lit(run_id))


@query
def run_comparison(spark, sf):
    """The newest run beside the newest other one, chosen by default; alone if there is no other, no rows if there is none."""
    root = stored(spark, sf)
    found = newest(spark, root)
    if not found:
        return spark.createDataFrame([], "view STRING, item STRING, left_value DOUBLE, right_value DOUBLE")
    both = runs.compare_runs(read_store(spark, root), found[0], alone=True)
    features = both["feature_importance"].selectExpr(
        "'importance' AS view", "feature AS item", "left_importance AS left_value", "right_importance AS right_value"
    )
    events = both["event_comparison"].selectExpr(
        "'event' AS view", "concat(fold, ' ', event_name) AS item", "left_precision_at_0_5", "right_precision_at_0_5"
    )
    rows = features.unionAll(events)
    for side, other in (("left", "right"), ("right", "left")):
        if both[side] is not None:
            values = {side: "CAST(val_rows AS DOUBLE)", other: "CAST(NULL AS DOUBLE)"}
            rows = rows.unionAll(both[side]["summary"].selectExpr("'rows' AS view", "run_id AS item", values["left"], values["right"]))
    return rows


def documents(tables: run_tables) -> DataFrame:
    """The artifacts of the runs as the documents that a training run writes: JSON, YAML text, CSV, log lines."""
    configs = tables.runs.selectExpr(
        "run_id",
        "'config.yaml' AS artifact",
        "concat('model:\\n  n_estimators: ', n_estimators, '\\n  max_depth: 5\\n  learning_rate: 0.05\\n"
        "  scale_pos_weight: 8\\ntuning: {enabled: ', tuning_enabled, '}\\nsplit: {train_end: 2024-01-19}\\n') AS body",
    )
    lines = tables.importance.groupBy("run_id").agg(
        F.expr("array_sort(collect_list(struct(position, concat(importance, ',', feature) AS line))) AS l")
    )
    importance = lines.selectExpr(
        "run_id", "'feature_importance.csv' AS artifact", "concat('Importance,Feature\\n', array_join(l.line, '\\n'), '\\n') AS body"
    )
    logs = tables.log_lines.groupBy("run_id").agg(F.expr("array_sort(collect_list(struct(line_no, line))) AS l"))
    logs = logs.selectExpr("run_id", "'logs.txt' AS artifact", "array_join(l.line, '\\n') AS body")
    return metrics_documents(tables).unionAll(configs).unionAll(importance).unionAll(logs)


def filed(spark, sf, change: str = "body") -> str:
    """All runs as files, in one job; documents of missing artifacts are left out."""
    tables, root = period_tables(spark, sf), fresh(spark, "files")
    have = tables.artifacts.unionAll(tables.base.selectExpr("run_id", "'logs.txt' AS artifact"))
    kept = documents(tables).join(have, ["run_id", "artifact"], "left_semi")
    sink.write_documents(kept.selectExpr("run_id", "artifact", f"{change} AS body"), root)
    return root


@query
def run_files_listing(spark, sf):
    found = runs.overview(read_runs(spark, filed(spark, sf)))
    return found.select(
        "position", "run_id", "timestamp", "reason", "skipped_runs", "n_estimators", "val_precision_at_0_5", "val_rows", "top_feature"
    )


@query
def run_files_precision(spark, sf):
    tables = read_runs(spark, filed(spark, sf))
    return tables.precision.select("run_id", "fold", "k_percent", "candidate_count", "candidate_rate", "precision_at_k", "baseline")


@query
def run_files_events(spark, sf):
    return runs.event_series(read_runs(spark, filed(spark, sf)))


@query
def run_files_importance(spark, sf):
    """Columns go by name, whatever their order in the file."""
    return read_importance(spark, filed(spark, sf)).select("run_id", "feature", "importance")


@query
def run_files_log(spark, sf):
    found = runs.training_summary(read_runs(spark, filed(spark, sf)))
    return found.select("run_id", "dataset_rows", "date_end", "positive_rate", "raw_train_rows", "tuning_enabled", "train_size")


# what spoils documents: cut off in the middle, a list, a scalar, YAML that does not close, a header without names
BROKEN = """CASE
  WHEN artifact = 'metrics.json' AND run_id LIKE 'click%' THEN substr(body, 1, 40)
  WHEN artifact = 'metrics.json' AND run_id LIKE 'view%' THEN concat('[', body, ']')
  WHEN artifact = 'config.yaml' AND run_id LIKE 'error%' THEN concat(body, '\\nopen: [1, 2')
  WHEN artifact = 'config.yaml' AND run_id LIKE 'purchase%' THEN '- a\\n- b'
  WHEN artifact = 'feature_importance.csv' AND run_id LIKE 'signup%' THEN 'a,b\\n1,2'
  ELSE body END"""


@query
def rejected_files(spark, sf):
    return rejected_documents(spark, filed(spark, sf, BROKEN))


@query
def broken_files_listing(spark, sf):
    """Unreadable documents are a reason to skip the run, as missing ones are."""
    return runs.skipped_runs(read_runs(spark, filed(spark, sf, BROKEN)).artifacts)


@query
def run_files_to_store(spark, sf):
    """Runs read from files and published as tables."""
    root = fresh(spark, "store")
    write_runs(read_runs(spark, filed(spark, sf)), root)
    return runs.event_series(read_store(spark, root))


# ---- sinks of one run, read back ------------------------------------------------------------------


@query
def model_sink(spark, sf):
    df, _, model = catalog.fitted(spark, sf)
    run_dir = fresh(spark, "run")
    sink.write_model(model, run_dir)
    ranked = ranking.add_rank(catalog.on_grid(models.score(df, PipelineModel.load(f"{run_dir}/model")), "p_opportunity"))
    return ranked.select("series", "datetime", "fold", "p_opportunity", "rank_opportunity")


@query
def importance_sink(spark, sf):
    df, _, model = catalog.fitted(spark, sf)
    root = fresh(spark, "runs")
    sink.write_importance(models.feature_importance(df, model, catalog.STUMP_FEATURES), f"{root}/one")
    return read_importance(spark, root).selectExpr("feature", "importance")


@query
def search_sink(spark, sf):
    run_dir = fresh(spark, "run")
    train = sampling.downsample_negatives(catalog.train_rows(spark, sf), catalog.RATIO)
    found = tuning.grid_search(
        train, catalog.STUMP_FEATURES, {"scale_pos_weight": [1, 8]}, splits=2, params=catalog.STUMP
    )
    grid = ("split0_test_score", "split1_test_score", "mean_test_score", "std_test_score")
    sink.write_search(spark, found.best_params, catalog.on_grid(found.results, *grid), run_dir)
    read = spark.read.csv(f"{run_dir}/cv_results.csv", header=True, escape='"')
    return read.selectExpr("params", *[f"CAST({c} AS DOUBLE) AS {c}" for c in grid], "CAST(rank_test_score AS INT) AS rank_test_score")


@query
def attribution_sink(spark, sf):
    df, _, model = catalog.fitted(spark, sf)
    root = fresh(spark, "runs")
    found = attribution.explain_sample(df.filter("fold = 'val'"), model, catalog.STUMP_FEATURES, catalog.SAMPLE)
    means = {r["feature"]: r["mean_abs_shap"] for r in catalog.on_grid(found, "mean_abs_shap").collect()}
    sink.write_attribution(means, spark, f"{root}/one")
    body = spark.read.text(f"{root}/one/shap/shap_importance.json", wholetext=True)
    return body.selectExpr("explode(from_json(value, 'MAP<STRING, DOUBLE>')) AS (feature, mean_abs_shap)")


@query
def config_sink(spark, sf):
    """Configs of all runs as written, JSON being YAML, and the values read from them."""
    root = fresh(spark, "runs")
    bodies = period_tables(spark, sf).runs.selectExpr(
        "run_id", "'config.yaml' AS artifact", "to_json(struct(struct(n_estimators, max_depth) AS model)) AS body"
    )
    sink.write_documents(bodies, root)
    read = read_documents(spark, root, "config.yaml")
    return read.selectExpr("run_id", "CAST(get_json_object(body, '$.model.n_estimators') AS BIGINT) AS n_estimators")
