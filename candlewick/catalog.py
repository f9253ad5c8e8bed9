"""Queries over the driver tables: one per operator.

The tables hold no OHLC bars, so `events` serves as a stream of ticks: a series per event type, bars per
hour or minute. A deterministic stand-in takes the place of the model score wherever results are checked
against SQL, and each series also plays the part of one training run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions.sql import fixed, run_id, run_timestamp, text, truncate_time
from candlewick.operators import attribution, evaluation, events, features, folds, labels
from candlewick.operators import models, quality, ranking, sampling, signals, tuning
from candlewick.operators.cells import over_series
from candlewick.plans import run_analytics as runs
from candlewick.plans.run_folder import RunStopped
from candlewick.plans.training import STORE, run_training
from candlewick.session import stage, work_dir
from candlewick.sinks.artifacts import snapshot, write_snapshot
from candlewick.sinks.run_store import read_store
from candlewick.sources.artifacts import read_runs
from candlewick.sources.bars import layout_report, read_bars, read_text, split_lines, type_bars
from candlewick.sources.logs import log_preview, log_value, parse_log
from candlewick.sources.ticks import bars_from_ticks

HORIZON, THRESHOLD = 5, 3.0
TRAIN_END, VAL_END = "2024-01-19", "2024-01-25"
TOP_K = (0.5, 1.0, 2.0, 10.0)
RATIO = 2
SAMPLE = 200
RUN_SUFFIX = "_m1_2024-01-30_2300"
LEFT_RUN, RIGHT_RUN = "click" + RUN_SUFFIX, "view" + RUN_SUFFIX
# tiny cells, so that small test tables take the plan for large ones
SPLIT = {"max_rows": 500}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "event_type", "value")


def hourly(spark: SparkSession, sf: str, unit: str = "hour") -> DataFrame:
    return bars_from_ticks(ticks(spark, sf), series="event_type", time="ts", value="value", unit=unit)


def signalled(spark: SparkSession, sf: str, unit: str = "hour") -> DataFrame:
    return signals.add_signals(hourly(spark, sf, unit), HORIZON, THRESHOLD, tie=())


def folded(spark: SparkSession, sf: str, unit: str = "hour") -> DataFrame:
    return folds.time_split(folds.complete_rows(signalled(spark, sf, unit)), TRAIN_END, VAL_END)


def scored(spark: SparkSession, sf: str, unit: str = "hour") -> DataFrame:
    score = fixed("range_ratio / (1.0D + range_ratio)")
    return stage(folded(spark, sf, unit).selectExpr("*", f"{score} AS p_opportunity"), "scored")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.selectExpr(*[f"{fixed(c)} AS {c}" if c in names else c for c in df.columns])


# ---- sources -------------------------------------------------------------------------------------


@query
def bars(spark, sf):
    return hourly(spark, sf)


@query
def bars_per_minute(spark, sf):
    return hourly(spark, sf, "minute")


@query
def parse_text_bars(spark, sf):
    lines = hourly(spark, sf).selectExpr(
        "concat_ws(' ', series, date_format(datetime, 'yyyy.MM.dd'), date_format(datetime, 'HH:mm:ss'), "
        "CAST(open AS STRING), CAST(high AS STRING), CAST(low AS STRING), CAST(close AS STRING), "
        "CASE WHEN close > open THEN 'n/a' ELSE '7' END) AS value"
    )
    header = "<SERIES> <DATE> <TIME> <OPEN> <HIGH> <LOW> <CLOSE> <TICKVOL>"
    raw = split_lines(spark.createDataFrame([(header,)], "value STRING").unionByName(lines), header)
    return type_bars(raw)


@query
def read_csv_bars(spark, sf):
    path = f"{work_dir(spark)}/bars-{uuid.uuid4().hex}"
    out = hourly(spark, sf).selectExpr(
        "series AS ` SERIES`",
        "CAST(datetime AS STRING) AS `<Datetime>`",
        *[f"{name} AS `<{name.upper()}>`" for name in ("open", "high", "low", "close")],
    )
    out.write.csv(path, header=True)
    return read_bars(spark, path)


def written_bars(spark, sf) -> str:
    """Bars as files of several makes: comma or blank between fields, columns in different orders, times in three layouts."""
    path = f"{work_dir(spark)}/bars-{uuid.uuid4().hex}"
    rows = hourly(spark, sf)
    prices = ("open", "high", "low", "close")
    plain = [f"CAST({name} AS STRING) AS {name}" for name in prices]
    day, clock = "date_format(datetime, 'yyyy.MM.dd') AS date", "date_format(datetime, 'HH:mm') AS time"
    makes = {
        "click": ("csv", ["CAST(datetime AS STRING) AS datetime", *plain, "series"]),
        "view": ("csv", ["series", "date_format(datetime, 'MM/dd/yyyy HH:mm:ss') AS `<DateTime>`", *reversed(plain), "'7' AS tickvol"]),
        "": ("text", ["series", day, *plain, clock]),
    }
    for number, (name, (kind, columns)) in enumerate(makes.items()):
        part = rows.filter(f"series = '{name}'" if name else "series NOT IN ('click', 'view')").selectExpr(*columns)
        place = f"{path}/{number}"
        if kind == "csv":
            part.write.csv(place, header=True)
        else:
            lines = part.selectExpr(f"concat_ws('  ', {', '.join(part.columns)}) AS value", "spark_partition_id() AS file")
            header = "  ".join(f"<{c.upper()}>" for c in part.columns)
            heads = lines.select("file").distinct().selectExpr(f"'{header}' AS value", "file")
            both = heads.selectExpr("value", "file", "0 AS rank").unionAll(lines.selectExpr("value", "file", "1 AS rank"))
            both.repartition(2, "file").sortWithinPartitions("file", "rank").select("value").write.text(place)
    return f"{path}/*"


@query
def read_mixed_bars(spark, sf):
    """Columns go by the name in each file's header, times by the layout of each row."""
    return read_bars(spark, written_bars(spark, sf), layouts="each")


@query
def read_blank_bars(spark, sf):
    """Blank-separated files, read as files."""
    return read_bars(spark, written_bars(spark, sf).replace("/*", "/2")).select("series", "datetime", "open", "high", "low", "close")


@query
def time_layouts(spark, sf):
    return layout_report(read_text(spark, written_bars(spark, sf)), ["series"])


# ---- checks and summaries of raw bars ------------------------------------------------------------


def raw_bars(spark, sf):
    """One flat bar per event, stamped with its hour, with gaps."""
    return ticks(spark, sf).selectExpr(
        "event_type AS series",
        f"CASE WHEN value >= 1 THEN {truncate_time('ts', 'hour')} END AS datetime",
        "CASE WHEN value < 150 THEN value END AS open",
        "value AS high",
        "value AS low",
        "nullif(value, 10.0D) AS close",
    )


@query
def quality_summary(spark, sf):
    return quality.quality_summary(raw_bars(spark, sf), ["series"])


@query
def quality_summary_total(spark, sf):
    return quality.quality_summary(raw_bars(spark, sf))


@query
def validation_report(spark, sf):
    return quality.validation_report(raw_bars(spark, sf))


# ---- features, events, labels --------------------------------------------------------------------


@query
def range_mean(spark, sf):
    df = features.add_features(hourly(spark, sf), tie=())
    return rounded(df.select("series", "datetime", "atr_14", "atr_28"), "atr_14", "atr_28")


@query
def returns(spark, sf):
    df = features.add_features(hourly(spark, sf), tie=())
    return rounded(df.select("series", "datetime", "ret_3", "ret_6"), "ret_3", "ret_6")


@query
def range_ratio(spark, sf):
    df = hourly(spark, sf).selectExpr("series", "datetime", f"{features.RANGE_RATIO} AS range_ratio")
    return rounded(df, "range_ratio")


@query
def feature_frame(spark, sf):
    return rounded(features.add_features(hourly(spark, sf), tie=()), *features.BASE_FEATURES)


@query
def feature_summary(spark, sf):
    return features.feature_summary(features.add_features(hourly(spark, sf), tie=()), ["series"])


@query
def feature_registry(spark, sf):
    return features.feature_coverage(signalled(spark, sf), {"features": {}})


@query
def select_features(spark, sf):
    df = signalled(spark, sf)
    names = features.model_columns(df, {"features": {"enabled": ["ret_3", "atr_14", "unknown"]}})
    return rounded(df.select("series", "datetime", *names), *names)


@query
def select_numeric(spark, sf):
    df = signalled(spark, sf)
    names = features.model_columns(df)
    return rounded(df.select("series", "datetime", *names), *features.BASE_FEATURES)


@query
def event_levels(spark, sf):
    def build(part, window):
        return events.event_levels(features.feature_columns(part, window), window)

    df = over_series(hourly(spark, sf), build, before=signals.LOOKBACK, tie=())
    return rounded(df.select("series", "datetime", "atr_mean_50", "ret_std_50"), "atr_mean_50", "ret_std_50")


@query
def event_signals(spark, sf):
    return signalled(spark, sf).select("series", "datetime", *["event_vol_spike", "event_impulse"])


@query
def event_frequency(spark, sf):
    return events.event_frequency(signalled(spark, sf), ("series",))


@query
def opportunity_label(spark, sf):
    df = labels.add_label(hourly(spark, sf), HORIZON, THRESHOLD, tie=())
    return df.select("series", "datetime", "target_opportunity")


@query
def label_summary(spark, sf):
    return labels.label_summary(signalled(spark, sf), ["series"])


# ---- very long series: the plan for large tables -------------------------------------------------


def long_series(spark, sf):
    everything = ticks(spark, sf).withColumn("event_type", F.lit("all"))
    return bars_from_ticks(everything, series="event_type", time="ts", value="value", unit="minute")


@query
def blocked_signals(spark, sf):
    df = stage(long_series(spark, sf), "bars")
    out = signals.add_signals(df, HORIZON, THRESHOLD, tie=(), step=16, **SPLIT)
    return rounded(out.drop("series", "open", "high", "low", "close"), *features.BASE_FEATURES)


@query
def blocked_range_mean(spark, sf):
    df = stage(long_series(spark, sf).select("datetime", "high", "low"), "bars")
    out = over_series(
        df,
        lambda part, window: features.range_mean(part, "mean_50", window, 50),
        before=49,
        series=(),
        tie=(),
        step=16,
        **SPLIT,
    )
    return rounded(out.select("datetime", "mean_50"), "mean_50")


@query
def global_row_index(spark, sf):
    df = ticks(spark, sf).select("event_id", "ts")
    return folds.number_bars(df, series=(), time="ts", tie=("event_id",), step=16, **SPLIT)


@query
def series_row_index(spark, sf):
    return folds.number_bars(hourly(spark, sf)).select("series", "datetime", "bar_idx")


# ---- folds and samples ---------------------------------------------------------------------------


@query
def complete_rows(spark, sf):
    df = folds.complete_rows(signalled(spark, sf))
    return rounded(df, *features.BASE_FEATURES)


@query
def time_split(spark, sf):
    df = folds.time_split(hourly(spark, sf), TRAIN_END, VAL_END)
    return df.select("series", "datetime", "fold")


@query
def split_summary(spark, sf):
    return folds.fold_summary(folded(spark, sf))


@query
def label_distribution(spark, sf):
    maps = folds.fold_distribution(folded(spark, sf))
    return maps.selectExpr("fold", "explode(label_distribution) AS (label, n)")


def train_rows(spark, sf):
    return stage(folded(spark, sf).filter("fold = 'train'"), "train")


@query
def downsample(spark, sf):
    out = sampling.downsample_negatives(train_rows(spark, sf), RATIO)
    return out.select("series", "datetime", "target_opportunity")


@query
def downsample_cells(spark, sf):
    df = stage(train_rows(spark, sf), "train")
    out = sampling.downsample_negatives(df, RATIO, max_rows=1)
    return out.select("series", "datetime", "target_opportunity")


@query
def sampling_summary(spark, sf):
    train = train_rows(spark, sf)
    return sampling.sampling_summary(train, sampling.downsample_negatives(train, RATIO))


@query
def shap_sample(spark, sf):
    val = folded(spark, sf).filter("fold = 'val'")
    return sampling.sample_rows(val, SAMPLE).select("series", "datetime")


@query
def ts_cv_folds(spark, sf):
    out = folds.expanding_splits(train_rows(spark, sf), 3)
    return out.select("series", "datetime", "position", "split", "role")


@query
def first_bars(spark, sf):
    return snapshot(hourly(spark, sf))


@query
def snapshot_sink(spark, sf):
    path = f"{work_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    write_snapshot(hourly(spark, sf), path, 500)
    return read_bars(spark, path)


# ---- ranking and evaluation ----------------------------------------------------------------------


@query
def rank(spark, sf):
    return ranking.add_rank(scored(spark, sf)).select("series", "datetime", "fold", "rank_opportunity")


@query
def rank_cells(spark, sf):
    df = stage(scored(spark, sf), "scored")
    return ranking.add_rank(df, **SPLIT).select("series", "datetime", "fold", "rank_opportunity")


def untidy(spark, sf):
    """Scores with many ties; a quarter of the rows without fold, a whole series without name."""
    return scored(spark, sf).selectExpr(
        "nullif(series, 'click') AS series",
        "datetime",
        "CASE WHEN extract(HOUR FROM datetime) % 4 <> 0 THEN fold END AS fold",
        "floor(p_opportunity * 4.0D) / 4.0D AS p_opportunity",
        "target_opportunity",
    )


@query
def rank_untidy(spark, sf):
    return ranking.add_rank(untidy(spark, sf))


@query
def rank_untidy_cells(spark, sf):
    return ranking.add_rank(untidy(spark, sf), max_rows=5)


@query
def fold_evaluation_untidy(spark, sf):
    return evaluation.fold_evaluation(untidy(spark, sf), TOP_K)


@query
def fold_evaluation_untidy_cells(spark, sf):
    return evaluation.fold_evaluation(untidy(spark, sf), TOP_K, max_rows=5)


@query
def fold_evaluation_empty_fold(spark, sf):
    rows = scored(spark, sf).filter("fold <> 'val'")
    return evaluation.fold_evaluation(rows, TOP_K, expected=("train", "val", "test"))


@query
def series_row_index_untidy(spark, sf):
    df = untidy(spark, sf).select("series", "datetime", "p_opportunity")
    return folds.number_bars(df, tie=("p_opportunity",), max_rows=5)


@query
def top_scores(spark, sf):
    best = ranking.best_per_group(
        scored(spark, sf), 20, ["fold"], ranking.score_order("p_opportunity", "datetime", ["series"])
    )
    return best.select("fold", "rank", "series", "datetime", "p_opportunity")


@query
def precision_at_k(spark, sf):
    return evaluation.precision_at_k(scored(spark, sf), TOP_K)


@query
def precision_at_k_cells(spark, sf):
    df = stage(scored(spark, sf), "scored")
    return evaluation.precision_at_k(df, TOP_K, **SPLIT)


@query
def fold_evaluation(spark, sf):
    return evaluation.fold_evaluation(scored(spark, sf), TOP_K)


@query
def event_diagnostics(spark, sf):
    return evaluation.event_diagnostics(scored(spark, sf), TOP_K)


@query
def nested_precision(spark, sf):
    nested = evaluation.nest_precision(evaluation.precision_at_k(scored(spark, sf), TOP_K), ["fold"])
    return nested.selectExpr("fold", "size(precision_at_k) AS entries", "inline(precision_at_k)")


@query
def event_statistics(spark, sf):
    return evaluation.event_statistics(scored(spark, sf))


# ---- run analytics -------------------------------------------------------------------------------


class run_tables:
    """Each series as one run: its folds, events and feature sizes stand for the run's artifacts.

    Offers the frames of `RunTables`, each built when it is first used.
    """

    BY = ["run_id", "fold"]

    def __init__(self, spark, sf):
        rows = scored(spark, sf).selectExpr("*", f"concat(series, '{RUN_SUFFIX}') AS run_id")
        self.rows = stage(rows, "runs")  # several tables are drawn from it

    @cached_property
    def base(self) -> DataFrame:
        return self.rows.groupBy("run_id").agg(
            F.expr("count(1) AS n"),
            F.expr("sum(target_opportunity) AS hits"),
            F.expr("min(datetime) AS first"),
            F.expr("max(datetime) AS last"),
            *[F.expr(f"count_if(fold = '{fold}') AS {fold}") for fold in runs.FOLDS],
        )

    @cached_property
    def runs(self) -> DataFrame:
        return self.base.selectExpr(
            "run_id",
            f"array({', '.join(text(f) for f in features.BASE_FEATURES)}) AS feature_columns",
            "n AS n_estimators",
            "5L AS max_depth",
            "0.05D AS learning_rate",
            "8.0D AS scale_pos_weight",
            "hits * 5 > n AS tuning_enabled",
            "false AS shap_enabled",
            "CASE WHEN hits * 5 > n THEN 8L END AS tuning_combinations",
            "CASE WHEN hits * 5 > n THEN n / 16.0D END AS tuning_seconds",
            "CAST(NULL AS STRING) AS best_params",
        )

    @cached_property
    def evaluation(self) -> DataFrame:
        return evaluation.group_totals(self.rows, self.BY)

    @cached_property
    def precision(self) -> DataFrame:
        position = f"array_position(array({', '.join(f'{k}D' for k in TOP_K)}), k_percent) - 1 AS position"
        return evaluation.precision_at_k(self.rows, TOP_K, by=self.BY).selectExpr("*", position)

    @cached_property
    def event_stats(self) -> DataFrame:
        return evaluation.event_statistics(self.rows, by=self.BY)

    @cached_property
    def event_precision(self) -> DataFrame:
        return evaluation.event_precision(self.rows, TOP_K, by=self.BY)

    @cached_property
    def importance(self) -> DataFrame:
        size = [f"'{f}', avg(abs({f})) / (1.0D + avg(abs({f})))" for f in features.BASE_FEATURES]
        sizes = self.rows.groupBy("run_id").agg(F.expr(f"map({', '.join(size)})").alias("m"))
        rows = sizes.selectExpr("run_id", "explode(m) AS (feature, importance)").selectExpr(
            "run_id", "feature", f"{fixed('importance')} AS importance"
        )
        position = "row_number() OVER (PARTITION BY run_id ORDER BY importance DESC, feature) AS position"
        return rows.selectExpr("*", position)

    @cached_property
    def artifacts(self) -> DataFrame:
        return self.base.selectExpr(
            "run_id",
            "explode(array_compact(array('metrics.json', CASE WHEN n % 3 <> 0 THEN 'config.yaml' END, "
            "CASE WHEN n % 2 = 0 THEN 'feature_importance.csv' END))) AS artifact",
        )

    @cached_property
    def log_lines(self) -> DataFrame:
        return self.base.selectExpr("run_id", f"posexplode({LOG}) AS (line_no, line)")


# log of a run, built from its counts; noise lines and repeated events included
LOG = """array_compact(array(
  concat('t | INFO | root | data_loaded | rows=', n, ' | date_start=', first, ' | date_end=', last),
  'not a log line',
  'a | b | c',
  't | INFO | root | empty_event | no pairs here',
  't | INFO | root | features_built | feature_count=5 | nan_count=49',
  "t | INFO | root | events_built | event_count=2 | event_columns=['event_vol_spike', 'event_impulse']",
  concat('t | INFO | root | labels_created | label_distribution={0: ', n - hits, ', 1: ', hits,
         '} | positive_rate=', hits / n),
  concat('t | INFO | root | split_summary | split=train | rows=1 | rows=', train),
  concat('t | INFO | root | split_summary | split=val | rows=', val),
  concat('t | INFO | root | split_summary | split=test | rows=', test),
  CASE WHEN hits * 5 > n THEN
    "t | INFO | root | features_selected | feature_count=2 | features=['atr_14', 'ret_3']" END,
  CASE WHEN hits * 5 > n THEN 't | INFO | root | tuning_complete | total_combinations=4' END,
  't | INFO | root | model_trained | train_size=0 | val_size=0 | best_iteration=None',
  concat('t | INFO | root | model_trained | train_size=', train, ' | val_size=', val,
         ' | best_iteration=None | validation_score=', hits / n),
  't | INFO | root | artifacts_saved | run_dir=a=b'
))"""


@query
def run_ids(spark, sf):
    last = hourly(spark, sf).groupBy("series").agg(F.expr("max(datetime) AS at"))
    ids = last.selectExpr("series", f"{run_id('series', text('m1'), 'at')} AS run_id")
    return ids.selectExpr("*", f"{run_timestamp('run_id')} AS timestamp")


@query
def parse_logs(spark, sf):
    found = parse_log(run_tables(spark, sf).log_lines)
    return found.selectExpr(
        "run_id",
        "event",
        "split",
        f"{log_value('rows', 'BIGINT')} AS rows",
        f"{log_value('date_start', 'TIMESTAMP_NTZ')} AS date_start",
        f"{log_value('positive_rate', 'DOUBLE')} AS positive_rate",
        f"{log_value('train_size', 'BIGINT')} AS train_size",
        f"{log_value('best_iteration', 'BIGINT')} AS best_iteration",
        f"array_join({log_value('event_columns', 'list')}, ',') AS event_columns",
        f"element_at({log_value('label_distribution', 'counts')}, 1) AS positives",
        f"{log_value('run_dir', 'STRING')} AS run_dir",
    )


@query
def logs_preview(spark, sf):
    return log_preview(run_tables(spark, sf).log_lines, 6)


@query
def run_listing(spark, sf):
    return runs.list_runs(run_tables(spark, sf))


@query
def skipped_runs(spark, sf):
    return runs.skipped_runs(run_tables(spark, sf).artifacts)


@query
def run_lookup(spark, sf):
    return runs.find_run(run_tables(spark, sf), "error" + RUN_SUFFIX)


@query
def run_summary(spark, sf):
    return runs.run_summary(run_tables(spark, sf))


@query
def scorecard(spark, sf):
    return runs.scorecard(run_tables(spark, sf))


@query
def precision_matrix(spark, sf):
    return runs.precision_matrix(run_tables(spark, sf))


@query
def quality_series(spark, sf):
    return runs.quality_series(run_tables(spark, sf))


@query
def event_series(spark, sf):
    return runs.event_series(run_tables(spark, sf))


@query
def training_summary(spark, sf):
    out = runs.training_summary(run_tables(spark, sf))
    return out.withColumns(
        {
            "selected_features": F.expr("array_join(selected_features, ',')"),
            "logged_features": F.expr("array_join(logged_features, ',')"),
        }
    )


@query
def row_funnel(spark, sf):
    return runs.row_funnel(run_tables(spark, sf))


@query
def importance_top(spark, sf):
    return runs.top_importance(run_tables(spark, sf).importance, 3)


@query
def compare_importance(spark, sf):
    return runs.compare_importance(run_tables(spark, sf).importance, LEFT_RUN, RIGHT_RUN, 3)


@query
def compare_events(spark, sf):
    return runs.compare_events(run_tables(spark, sf), LEFT_RUN, RIGHT_RUN)


# ---- models --------------------------------------------------------------------------------------

# One tree of depth 1 on a flag has a closed form, so these queries can be held against SQL; the tests fit deeper ones.
# Results of floating-point chains are put on a grid (`fixed`).
STUMP = {"max_depth": 1, "learning_rate": 0.1, "n_estimators": 1, "scale_pos_weight": 4}
STUMP_FEATURES = ["event_vol_spike"]
MODEL = {"max_depth": 3, "learning_rate": 0.1, "n_estimators": 5, "scale_pos_weight": 4}
MODEL_FEATURES = ["atr_14", "ret_3", "ret_6", "range_ratio", "event_vol_spike"]


def fitted(spark, sf):
    df = stage(folded(spark, sf), "modelled")
    train = sampling.downsample_negatives(df.filter("fold = 'train'"), RATIO)
    return df, train, models.train_model(train, STUMP_FEATURES, STUMP)


def on_grid(df, *names):
    return df.withColumns({name: F.expr(fixed(name)) for name in names})


@query
def train_score(spark, sf):
    df, _, model = fitted(spark, sf)
    ranked = ranking.add_rank(on_grid(models.score(df, model), "p_opportunity"))
    return ranked.select("series", "datetime", "fold", "p_opportunity", "rank_opportunity")


@query
def model_precision(spark, sf):
    df, train, model = fitted(spark, sf)
    rows = train.unionByName(df.filter("fold <> 'train'"))  # the train fold is judged on its sampled rows
    return evaluation.fold_evaluation(stage(on_grid(models.score(rows, model), "p_opportunity"), "scored"), TOP_K)


@query
def validation_loss(spark, sf):
    df, _, model = fitted(spark, sf)
    return on_grid(models.log_loss(models.score(df.filter("fold = 'val'"), model)), "log_loss")


@query
def model_importance(spark, sf):
    df, _, model = fitted(spark, sf)
    return models.feature_importance(df, model, STUMP_FEATURES)


@query
def grid_search(spark, sf):
    train = sampling.downsample_negatives(train_rows(spark, sf), RATIO)
    found = tuning.grid_search(train, STUMP_FEATURES, {"scale_pos_weight": [1, 8]}, splits=2, params=STUMP).results
    return on_grid(found, "split0_test_score", "split1_test_score", "mean_test_score", "std_test_score")


@query
def shap_values(spark, sf):
    df, _, model = fitted(spark, sf)
    return on_grid(attribution.attribute(df.filter("fold = 'val'"), model, STUMP_FEATURES), "phi")


@query
def shap_importance(spark, sf):
    df, _, model = fitted(spark, sf)
    found = attribution.explain_sample(df.filter("fold = 'val'"), model, STUMP_FEATURES, SAMPLE)
    return on_grid(found, "mean_abs_shap")


@query
def fold_guard(spark, sf):
    """Folds of bars that end before the last border."""
    return folds.fold_report(folded(spark, sf).filter(f"datetime <= TIMESTAMP_NTZ'{VAL_END}'"))


@query
def column_guard(spark, sf):
    """What must not be trained on is barred, whatever its type."""
    return features.column_roles(scored(spark, sf).selectExpr("*", "1 AS rank_opportunity"))


def trial(spark, sf) -> tuple[str, dict]:
    """A config for a whole run, and the folder of its runs."""
    folder = f"{work_dir(spark)}/trial-{uuid.uuid4().hex}"
    return f"{folder}/runs", {
        "run": {"model": "gbt", "dataset": "events", "output_dir": f"{folder}/runs"},
        "split": {"train_end": TRAIN_END, "val_end": VAL_END},
        "sampling": {"ratio": RATIO},
        "label": {"horizon_bars": HORIZON, "threshold": THRESHOLD},
        "model": STUMP,
        "evaluation": {"top_k": list(TOP_K)},
        "features": {"enabled": STUMP_FEATURES},
        "debug": {"output_dir": f"{folder}/debug"},
    }


@query
def train_and_evaluate(spark, sf):
    root, config = trial(spark, sf)
    run_training(spark, config, bars=hourly(spark, sf))
    return runs.run_summary(read_runs(spark, root)).drop("run_id", "timestamp")


@query
def resumed_training(spark, sf):
    """A run that ended after the fit and was taken up again, its metrics as tables of the store."""
    root, config = trial(spark, sf)
    try:
        run_training(spark, config, bars=hourly(spark, sf), stop_after="model")
    except RunStopped as stopped:
        run_id = str(stopped).split(" ")[0]
    run_training(spark, config, resume=run_id)
    tables = read_store(spark, f"{root}/{STORE}", run_id)
    rows = tables.evaluation.select("fold", "rows")
    return tables.precision.drop("run_id", "position").join(rows, "fold")


@query
def training_log(spark, sf):
    """What a run wrote to its log, read back: counts taken while its tables were written."""
    root, config = trial(spark, sf)
    run_training(spark, config, bars=hourly(spark, sf))
    found = parse_log(read_runs(spark, root).log_lines)
    counts = ("rows", "nan_count", "train_rows_before", "train_rows_after", "positive_after", "negative_before", "val_size")
    kept = found.filter("event IN ('data_loaded', 'features_built', 'split_summary', 'after_dropna', 'training_downsampled', 'model_trained')")
    return kept.selectExpr("event", "split", *[f"{log_value(name, 'BIGINT')} AS {name}" for name in counts])
