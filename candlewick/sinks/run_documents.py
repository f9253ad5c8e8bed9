"""The documents of runs, made from their tables for any number of runs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.sinks.run_store import Runs

ENTRY = "struct(k_percent, candidate_count, candidate_rate, precision_at_k, baseline)"


def _in_order(df: DataFrame, keys: list[str], entry: str, name: str) -> DataFrame:
    """Entries of each key as an array, by position or else by themselves."""
    rank = "position" if "position" in df.columns else "0"
    rows = df.groupBy(*keys).agg(F.expr(f"array_sort(collect_list(struct({rank} AS i, {entry} AS e))) AS _pairs"))
    return rows.selectExpr(*keys, f"transform(_pairs, x -> x.e) AS {name}")


def metrics_documents(tables: Runs) -> DataFrame:
    """(run_id, artifact, body): metrics.json of each run, nested by fold and event."""
    folds = tables.evaluation.join(_in_order(tables.precision, ["run_id", "fold"], ENTRY, "precision_at_k"), ["run_id", "fold"])
    folds = folds.groupBy("run_id").agg(
        F.expr("map_from_entries(collect_list(struct(fold, struct(fold, rows, baseline, precision_at_k)))) AS evaluation")
    )
    inside = _in_order(tables.event_precision, ["run_id", "fold", "event_name"], ENTRY, "precision_at_k")
    events = tables.event_stats.join(inside, ["run_id", "fold", "event_name"])
    event = "struct(event_name, frequency, event_rate, trade_rate, precision_at_k)"
    events = _in_order(events, ["run_id", "fold"], event, "events").groupBy("run_id")
    events = events.agg(F.expr("map_from_entries(collect_list(struct(fold, events))) AS event_diagnostics"))
    whole = tables.runs.select("run_id", "feature_columns").join(folds, "run_id").join(events, "run_id", "left")
    body = "to_json(struct(run_id, feature_columns, evaluation, event_diagnostics), map('ignoreNullFields', 'false'))"
    return whole.selectExpr("run_id", "'metrics.json' AS artifact", f"{body} AS body")
