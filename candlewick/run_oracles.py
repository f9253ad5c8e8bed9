"""SQL of the queries over stored runs."""

from __future__ import annotations

from candlewick.oracles import ORACLES as ONE
from candlewick.oracles import RUNS, SUFFIX

PERIOD = "concat(strftime(datetime, '%Y-%m'), '-', lpad(CAST(CAST(floor((day(datetime) - 1) / 10) * 10 + 1 AS INTEGER) AS VARCHAR), 2, '0'))"


def periods(sql: str) -> str:
    """The same over runs of ten days."""
    return sql.replace(f"concat(series, '{SUFFIX}') AS run_id", f"concat(series, '_m1_', {PERIOD}, '_2300') AS run_id").replace(
        "'2024-01-30 23:00' AS timestamp", "concat(substr(run_id, length(run_id) - 14, 10), ' 23:00') AS timestamp"
    )


def view(name: str) -> str:
    return f"(SELECT * FROM ({periods(ONE[name])}))"


ALL = periods(RUNS).rstrip()
STAMPED = f"""{ALL}, stamped AS (SELECT *, concat(substr(run_id, length(run_id) - 14, 10), ' 23:00') AS timestamp,
  nullif(concat('missing artifacts: ', missing), 'missing artifacts: ') AS reason FROM status),
complete AS (SELECT *, row_number() OVER (ORDER BY timestamp DESC, run_id DESC) AS place FROM stamped WHERE reason IS NULL)"""
LISTING = f"""{STAMPED}, shown AS (SELECT summary.* FROM summary JOIN complete USING (run_id))
SELECT row_number() OVER (ORDER BY s.timestamp DESC, s.run_id DESC) AS position, s.run_id, s.timestamp, s.reason,
  CAST(sum(CASE WHEN s.reason IS NOT NULL THEN 1 ELSE 0 END) OVER () AS BIGINT) AS skipped_runs, {{columns}}
FROM stamped s LEFT JOIN shown USING (run_id)"""


def of_one(rows: str) -> str:
    """Rows of the newest complete run."""
    return f"FROM {rows} WHERE run_id = (SELECT run_id FROM complete WHERE place = 1)"


def item(name: str, rows: str, label: str, value: str, test: str = "true") -> str:
    return f"SELECT run_id, '{name}' AS view, {label} AS item, CAST({value} AS DOUBLE) AS value {of_one(rows)} AND {test}"


DETAIL = f"{STAMPED} " + " UNION ALL ".join(
    (
        item("summary", "summary", "'val_rows'", "val_rows"),
        item("summary", "summary", "'test_baseline'", "test_baseline"),
        item("lift", view("scorecard"), "training_label", "out_of_sample_lift"),
        item("importance", "ranked", "feature", "importance"),
        item("top", "ranked", "feature", "position", "position <= 10"),
        item("precision", view("precision_matrix"), "concat(fold, ' ', k_label)", "precision_at_k"),
        item("quality", view("quality_series"), "label", "test_precision"),
        item("event", "series", "concat(fold, ' ', event_name)", "baseline_at_0_5"),
        item("training", view("training_summary"), "selected_features", "positive_rate"),
        item("funnel", "base", "'Raw train'", "train"),
        item("funnel", "facts", "'Sampled train'", "train_rows", "train_rows IS NOT NULL"),
        item("funnel", "facts", "'Validation'", "val_rows", "val_rows IS NOT NULL"),
        item("funnel", "facts", "'Test'", "test_rows", "test_rows IS NOT NULL"),
        item("log", view("logs_preview"), "line", "line_rank"),
    )
)


def side(rows: str, place: int, test: str = "true") -> str:
    return f"(SELECT x.* FROM {rows} x JOIN complete USING (run_id) WHERE place = {place} AND {test})"


COMPARISON = f"""{STAMPED}
SELECT 'importance' AS view, coalesce(a.feature, b.feature) AS item, a.importance AS left_value, b.importance AS right_value
  FROM {side('ranked', 1, 'position <= 10')} a FULL JOIN {side('ranked', 2, 'position <= 10')} b ON a.feature = b.feature
UNION ALL
SELECT 'event', concat(coalesce(a.fold, b.fold), ' ', coalesce(a.event_name, b.event_name)), a.precision_at_0_5, b.precision_at_0_5
  FROM {side('series', 1)} a FULL JOIN {side('series', 2)} b ON a.fold = b.fold AND a.event_name = b.event_name
UNION ALL SELECT 'rows', run_id, CAST(val_rows AS DOUBLE), NULL FROM {side('summary', 1)}
UNION ALL SELECT 'rows', run_id, NULL, CAST(val_rows AS DOUBLE) FROM {side('summary', 2)}"""

HAS_IMPORTANCE = "missing NOT LIKE '%feature_importance.csv%'"
HAS_CONFIG = "missing NOT LIKE '%config.yaml%'"

ORACLES = {
    "metrics_sink": f"{RUNS} SELECT * FROM prec",
    "run_store_listing": LISTING.format(columns="feature_count, val_rows, test_lift_at_0_5, top_feature"),
    "run_store_lookup": f"{STAMPED} SELECT * {of_one('summary')}",
    "run_detail": DETAIL,
    "run_comparison": COMPARISON,
    "run_files_listing": LISTING.format(columns="n_estimators, val_precision_at_0_5, val_rows, top_feature"),
    "run_files_precision": f"{STAMPED} SELECT prec.* FROM prec JOIN complete USING (run_id)",
    "run_files_events": f"{STAMPED} SELECT series.* FROM series JOIN complete USING (run_id)",
    "run_files_importance": f"{STAMPED} SELECT importance.* FROM importance JOIN status USING (run_id) WHERE {HAS_IMPORTANCE}",
    "run_files_log": f"""{STAMPED} SELECT run_id, n AS dataset_rows, last AS date_end, hits / n AS positive_rate,
  train AS raw_train_rows, hits * 5 > n AS tuning_enabled, train AS train_size FROM base JOIN complete USING (run_id)""",
    "rejected_files": f"""{STAMPED}
  SELECT run_id, 'metrics.json' AS artifact, 'not JSON' AS problem FROM status WHERE run_id LIKE 'click%'
  UNION ALL SELECT run_id, 'metrics.json', 'not an object' FROM status WHERE run_id LIKE 'view%'
  UNION ALL SELECT run_id, 'config.yaml', 'not YAML' FROM status WHERE run_id LIKE 'error%' AND {HAS_CONFIG}
  UNION ALL SELECT run_id, 'config.yaml', 'not a mapping' FROM status WHERE run_id LIKE 'purchase%' AND {HAS_CONFIG}
  UNION ALL SELECT run_id, 'feature_importance.csv', 'no columns feature and importance' FROM status
    WHERE run_id LIKE 'signup%' AND {HAS_IMPORTANCE}""",
    "broken_files_listing": f"""{STAMPED}, judged AS (SELECT run_id, coalesce(reason,
    CASE WHEN run_id LIKE 'click%' OR run_id LIKE 'view%' THEN 'unreadable metrics.json'
    WHEN run_id LIKE 'error%' OR run_id LIKE 'purchase%' THEN 'unreadable config.yaml' END) AS reason FROM stamped)
  SELECT * FROM judged WHERE reason IS NOT NULL""",
    "run_files_to_store": f"{STAMPED} SELECT series.* FROM series JOIN complete USING (run_id)",
    "model_sink": ONE["train_score"],
    "importance_sink": f"SELECT feature, importance FROM ({ONE['model_importance']})",
    "search_sink": ONE["grid_search"],
    "attribution_sink": ONE["shap_importance"],
    "config_sink": f"{ALL} SELECT run_id, n AS n_estimators FROM base",
}
