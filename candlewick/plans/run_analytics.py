"""Summaries, verdicts, listings and comparisons over many runs at once.

Every function is a handful of grouped aggregates or joins on run_id over the tables of `RunTables`;
none loops over runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.sql import k_label, mean_present, run_timestamp, safe_ratio, text
from candlewick.operators.cells import add_position, measure
from candlewick.operators.ranking import best_per_group
from candlewick.sources.artifacts import RunTables, artifact_status, complete_runs
from candlewick.sources.logs import log_preview, log_value, parse_log

FOLDS = ("train", "val", "test")
HEADLINE_K = 0.5
TOP_FEATURES = 10


class RunNotFound(LookupError):
    """No complete run of that id."""


def skipped_runs(artifacts: DataFrame) -> DataFrame:
    """Runs left out and the reason."""
    return artifact_status(artifacts).filter("reason IS NOT NULL")


def _pick(value: str, fold: str) -> str:
    return f"max(CASE WHEN fold = '{fold}' THEN {value} END)"


def fold_facts(tables: RunTables) -> DataFrame:
    """One row per run: precision at the headline k, baseline and rows of each fold."""
    precision = tables.precision.filter(f"k_percent = {HEADLINE_K}D").groupBy("run_id")
    precision = precision.agg(
        *[F.expr(f"{_pick('precision_at_k', fold)} AS {fold}_precision_at_0_5") for fold in FOLDS]
    )
    folds = tables.evaluation.groupBy("run_id").agg(
        *[F.expr(f"{_pick('baseline', fold)} AS {fold}_baseline") for fold in FOLDS],
        *[F.expr(f"{_pick('rows', fold)} AS {fold}_rows") for fold in FOLDS],
    )
    facts = folds.join(precision, "run_id", "left")
    lift = [
        f"{safe_ratio(f'{fold}_precision_at_0_5', f'{fold}_baseline')} AS {fold}_lift_at_0_5"
        for fold in ("val", "test")
    ]
    return facts.selectExpr("*", *lift)


def run_summary(tables: RunTables) -> DataFrame:
    """Headline row of each run."""
    top = tables.importance.groupBy("run_id").agg(
        F.expr("min_by(feature, position) AS top_feature"),
        F.expr("min_by(importance, position) AS top_importance"),
    )
    joined = (
        tables.runs.join(fold_facts(tables), "run_id", "left").join(top, "run_id", "left")
    )
    return joined.selectExpr(
        "run_id",
        f"{run_timestamp('run_id')} AS timestamp",
        "CAST(coalesce(array_size(feature_columns), 0) AS INT) AS feature_count",
        *[f"{fold}_precision_at_0_5" for fold in FOLDS],
        "val_baseline",
        "test_baseline",
        "val_lift_at_0_5",
        "test_lift_at_0_5",
        "val_rows",
        "test_rows",
        "n_estimators",
        "max_depth",
        "learning_rate",
        "scale_pos_weight",
        "top_feature",
        "top_importance",
    )


def list_runs(tables: RunTables) -> DataFrame:
    """Summaries of the complete runs, newest first."""
    summary = run_summary(tables).join(complete_runs(tables.artifacts), "run_id", "left_semi")
    return summary.orderBy(F.desc("timestamp"), F.desc("run_id"))


def overview(tables: RunTables) -> DataFrame:
    """All runs newest first, complete and skipped ones: position, the reason of a skipped run, how many are skipped.

    Positions are counted in blocks of run ids, so that a listing of any length is numbered without one task for all.
    """
    rows = artifact_status(tables.artifacts).selectExpr("run_id", f"{run_timestamp('run_id')} AS timestamp", "reason")
    total = rows.agg(F.expr("count(1) AS runs"), F.expr("count(reason) AS skipped_runs")).head()
    cells = measure(rows, [], ["substr(timestamp, 1, 7)", "timestamp", "run_id"])
    numbered = add_position(rows, "oldest", groups=[], order=["timestamp", "run_id"], cells=cells)
    numbered = numbered.selectExpr("*", f"{total['runs']}L + 1 - oldest AS position", f"{total['skipped_runs']}L AS skipped_runs")
    facts = run_summary(tables).join(complete_runs(tables.artifacts), "run_id", "left_semi").drop("timestamp")
    return numbered.drop("oldest").join(facts, "run_id", "left").orderBy("position")


def find_run(tables: RunTables, run_id: str) -> DataFrame:
    """Summary of one run; no row if it is unknown or incomplete."""
    found = run_summary(tables).filter(f"run_id = {text(run_id)}")
    return found.join(complete_runs(tables.artifacts), "run_id", "left_semi")


def scorecard(tables: RunTables) -> DataFrame:
    """Quality and stability verdict of each run."""
    facts = fold_facts(tables).selectExpr(
        "run_id",
        *[f"{fold}_precision_at_0_5" for fold in FOLDS],
        "val_baseline",
        "test_baseline",
        "val_lift_at_0_5",
        "test_lift_at_0_5",
        f"{mean_present('val_lift_at_0_5', 'test_lift_at_0_5')} AS out_of_sample_lift",
        "train_precision_at_0_5 - test_precision_at_0_5 AS generalization_gap",
        "abs(val_precision_at_0_5 - test_precision_at_0_5) AS val_test_gap",
    )
    # Limits and wording of the verdicts.
    quality = "CASE WHEN out_of_sample_lift >= 2 THEN {} WHEN out_of_sample_lift >= 1.4D THEN {} ELSE {} END"
    stability = (
        "CASE WHEN generalization_gap IS NULL OR val_test_gap IS NULL THEN {} "
        "WHEN generalization_gap <= 0.2D AND val_test_gap <= 0.12D THEN {} "
        "WHEN generalization_gap <= 0.35D AND val_test_gap <= 0.18D THEN {} ELSE {} END"
    )
    return facts.selectExpr(
        "*",
        quality.format("'Strong'", "'Promising'", "'Needs work'") + " AS quality_label",
        quality.format("'success'", "'accent'", "'warning'") + " AS quality_tone",
        stability.format("'Hard to judge'", "'Stable'", "'Some overfit'", "'Overfit risk'")
        + " AS training_label",
        stability.format("'accent'", "'success'", "'accent'", "'warning'") + " AS training_tone",
    )


def precision_labels(tables: RunTables) -> DataFrame:
    """Labels of k per run with `label_rank`, in the order train, val, test first name them."""
    fold_order = "array_position(array('train', 'val', 'test'), fold)"
    first = tables.precision.selectExpr(
        "run_id", f"{k_label('k_percent')} AS k_label", f"struct({fold_order}, position) AS _at"
    )
    seen = first.groupBy("run_id", "k_label").agg(F.expr("min(_at) AS _at"))
    rank = "row_number() OVER (PARTITION BY run_id ORDER BY _at) AS label_rank"  # one row per label
    return seen.selectExpr("run_id", "k_label", rank)


def precision_matrix(tables: RunTables) -> DataFrame:
    """Every fold with every label of its run; NULL where a fold lacks the label."""
    grid = precision_labels(tables).selectExpr("*", "explode(array('train', 'val', 'test')) AS fold")
    cells = tables.precision.selectExpr(
        "run_id",
        "fold",
        f"{k_label('k_percent')} AS k_label",
        "precision_at_k",
        "candidate_rate",
        "candidate_count",
    )
    folds = tables.evaluation.select("run_id", "fold", "baseline", "rows")
    return (
        grid.join(cells, ["run_id", "fold", "k_label"], "left")
        .join(folds, ["run_id", "fold"], "left")
        .select(
            "run_id",
            "fold",
            "label_rank",
            "k_label",
            "precision_at_k",
            "candidate_rate",
            "candidate_count",
            "baseline",
            "rows",
        )
    )


def quality_series(tables: RunTables) -> DataFrame:
    """Per label the precision of the three folds beside the holdout baselines."""
    values = tables.precision.groupBy("run_id", F.expr(f"{k_label('k_percent')} AS k_label")).agg(
        *[F.expr(f"{_pick('precision_at_k', fold)} AS {fold}_precision") for fold in FOLDS]
    )
    bases = tables.evaluation.groupBy("run_id").agg(
        F.expr(f"{_pick('baseline', 'val')} AS val_baseline"),
        F.expr(f"{_pick('baseline', 'test')} AS test_baseline"),
    )
    joined = values.join(precision_labels(tables), ["run_id", "k_label"]).join(bases, "run_id", "left")
    return joined.selectExpr(
        "run_id",
        "label_rank",
        "concat('Top ', k_label, '%') AS label",
        *[f"{fold}_precision" for fold in FOLDS],
        "val_baseline",
        "test_baseline",
    )


def event_series(tables: RunTables) -> DataFrame:
    """Rate, headline precision and headline baseline of each event; the trade rate stands in."""
    at_k = tables.event_precision.filter(f"k_percent = {HEADLINE_K}D").selectExpr(
        "run_id", "fold", "event_name", "precision_at_k", "baseline"
    )
    return tables.event_stats.join(at_k, ["run_id", "fold", "event_name"], "left").selectExpr(
        "run_id",
        "fold",
        "event_name",
        "event_rate",
        "trade_rate",
        "precision_at_k AS precision_at_0_5",
        "coalesce(baseline, trade_rate) AS baseline_at_0_5",
    )


def top_importance(importance: DataFrame, n: int = TOP_FEATURES) -> DataFrame:
    """First n features of each run."""
    return best_per_group(importance, n, ["run_id"], ["position"]).select(
        "run_id", "rank", "feature", "importance"
    )


def _log_facts(lines: DataFrame) -> DataFrame:
    """Values the training summary takes from the log, one row per run."""

    def value(event: str, key: str, kind: str, name: str, split: str | None = None) -> str:
        here = f"event = '{event}'" + (f" AND split = '{split}'" if split else "")
        return f"max(CASE WHEN {here} THEN {log_value(key, kind)} END) AS {name}"

    chosen = f"coalesce({log_value('features', 'list')}, array())"
    wanted = [
        value("data_loaded", "rows", "BIGINT", "dataset_rows"),
        value("data_loaded", "date_start", "TIMESTAMP_NTZ", "date_start"),
        value("data_loaded", "date_end", "TIMESTAMP_NTZ", "date_end"),
        value("features_built", "feature_count", "BIGINT", "built_feature_count"),
        value("events_built", "event_count", "BIGINT", "event_count"),
        value("labels_created", "positive_rate", "DOUBLE", "positive_rate"),
        value("split_summary", "rows", "BIGINT", "raw_train_rows", "train"),
        value("tuning_complete", "total_combinations", "BIGINT", "log_combinations"),
        value("tuning_complete", "total_fit_time", "STRING", "log_tuning_time"),
        value("tuning_complete", "best_params", "STRING", "log_best_params"),
        value("model_trained", "validation_score", "DOUBLE", "validation_score"),
        value("model_trained", "train_size", "BIGINT", "log_train_size"),
        value("model_trained", "val_size", "BIGINT", "log_val_size"),
        value("shap_complete", "features_analyzed", "BIGINT", "shap_features_analyzed"),
        f"max(CASE WHEN event = 'features_selected' THEN {chosen} END) AS log_features",
    ]
    return parse_log(lines).groupBy("run_id").agg(*[F.expr(w) for w in wanted])


def training_summary(tables: RunTables) -> DataFrame:
    """How each run was trained, from its log, metrics and config."""
    rows = tables.evaluation.groupBy("run_id").agg(
        *[F.expr(f"{_pick('rows', fold)} AS {fold}_rows") for fold in FOLDS]
    )
    joined = (
        tables.runs.join(_log_facts(tables.log_lines), "run_id", "left").join(rows, "run_id", "left")
    )
    return joined.selectExpr(
        "run_id",
        "dataset_rows",
        "date_start",
        "date_end",
        "CAST(coalesce(array_size(feature_columns), 0) AS INT) AS selected_feature_count",
        "built_feature_count",
        "event_count",
        "positive_rate",
        "raw_train_rows",
        "train_rows AS sampled_train_rows",
        "val_rows",
        "test_rows",
        "tuning_enabled",
        "coalesce(tuning_combinations, log_combinations) AS tuning_combinations",
        "coalesce(log_tuning_time, CASE WHEN tuning_seconds IS NOT NULL THEN "
        "format_string('%.1fs', tuning_seconds) END) AS tuning_time",
        "coalesce(best_params, log_best_params) AS best_params",
        "validation_score",
        "coalesce(log_train_size, train_rows) AS train_size",
        "coalesce(log_val_size, val_rows) AS val_size",
        "shap_enabled",
        "shap_features_analyzed",
        "log_features AS logged_features",
        "coalesce(log_features, feature_columns) AS selected_features",
    )


def row_funnel(tables: RunTables) -> DataFrame:
    """Row counts from raw train to test; stages without a count are left out."""
    stages = (
        "stack(4, 1, 'Raw train', raw_train_rows, 2, 'Sampled train', sampled_train_rows, "
        "3, 'Validation', val_rows, 4, 'Test', test_rows) AS (stage_rank, stage, rows)"
    )
    return training_summary(tables).selectExpr("run_id", stages).filter("rows IS NOT NULL")


def _id(run: str | None) -> str:
    """SQL text of a run id; NULL, which no id equals, if there is no such run."""
    return "NULL" if run is None else text(run)


def _sides(left: str, right: str | None, names: dict[str, str]) -> list[str]:
    """Aggregates that put a column of the left and of the right run side by side."""
    return [
        f"max(CASE WHEN run_id = {_id(run)} THEN {value} END) AS {name.format(side)}"
        for side, run in (("left", left), ("right", right))
        for value, name in names.items()
    ]


def compare_importance(importance: DataFrame, left: str, right: str | None, n: int = TOP_FEATURES) -> DataFrame:
    """Top features of two runs side by side: those of the left run in order, then new right ones."""
    top = top_importance(importance.filter(f"run_id IN ({_id(left)}, {_id(right)})"), n)
    names = {"importance": "{}_importance", "rank": "_{}"}
    both = top.groupBy("feature").agg(*[F.expr(a) for a in _sides(left, right, names)])
    return both.selectExpr(
        "feature",
        f"CAST(row_number() OVER (ORDER BY coalesce(_left, {n} + _right)) AS INT) AS position",
        "left_importance",
        "right_importance",
    )


def compare_events(tables: RunTables, left: str, right: str | None) -> DataFrame:
    """Event figures of two runs per fold and event; NULL on the side that lacks the event."""
    both = event_series(tables).filter(f"run_id IN ({_id(left)}, {_id(right)})")
    names = {value: "{}_" + value for value in ("event_rate", "trade_rate", "precision_at_0_5")}
    return both.groupBy("fold", "event_name").agg(*[F.expr(a) for a in _sides(left, right, names)])


def default_partner(tables: RunTables, left: str) -> str | None:
    """Newest complete run other than `left`."""
    found = list_runs(tables).filter(f"run_id <> {text(left)}").select("run_id").head(1)
    return found[0]["run_id"] if found else None


def run_detail(tables: RunTables, run_id: str) -> dict[str, DataFrame]:
    """All views of one run; raises RunNotFound for unknown or incomplete runs."""
    status = artifact_status(tables.artifacts).filter(f"run_id = {text(run_id)}").head(1)
    if not status:
        raise RunNotFound(f"Unknown run_id: {run_id}")
    if status[0]["reason"] is not None:
        raise RunNotFound(f"Run is missing required artifacts: {run_id}")
    one = RunTables(**{name: df.filter(f"run_id = {text(run_id)}") for name, df in vars(tables).items()})
    return {
        "summary": run_summary(one),
        "scorecard": scorecard(one),
        "feature_importance": one.importance,
        "importance_top": top_importance(one.importance),
        "precision_matrix": precision_matrix(one),
        "quality_series": quality_series(one),
        "event_series": event_series(one),
        "training_summary": training_summary(one),
        "row_funnel": row_funnel(one),
        "logs_preview": log_preview(one.log_lines),
    }


def compare_runs(tables: RunTables, left: str, right: str | None = None, alone: bool = False) -> dict[str, object]:
    """Two runs side by side; the partner defaults to the newest other run.

    Without any other run this is an error or, if the left run may stand `alone`, a comparison whose right side is NULL.
    """
    right = right or default_partner(tables, left)
    if right is None and not alone:
        raise RunNotFound(f"No other complete run to compare with {left}")
    return {
        "left": run_detail(tables, left),
        "right": None if right is None else run_detail(tables, right),
        "feature_importance": compare_importance(tables.importance, left, right),
        "event_comparison": compare_events(tables, left, right),
    }
