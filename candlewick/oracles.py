"""The queries of the catalog in plain SQL for an independent engine.

Written straight from the definitions: whole-series windows, whole-fold ranks, no blocks.
"""

from __future__ import annotations

FEATURES = ("atr_14", "atr_28", "ret_3", "ret_6", "range_ratio")


def fixed(x: str) -> str:
    million = "CAST(1000000 AS DOUBLE)"
    return f"CAST(floor(({x}) * {million} + CAST(0.5 AS DOUBLE)) AS DOUBLE) / {million}"


def bars_cte(name: str = "bars", series: str = "event_type", unit: str = "hour") -> str:
    return f"""{name} AS (
  SELECT {series} AS series, CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS datetime,
         arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close
  FROM events GROUP BY 1, 2)"""


def full(aggregate: str, value: str, rows: int) -> str:
    return f"CASE WHEN count({value}) OVER w{rows} = {rows} THEN {aggregate}({value}) OVER w{rows} END"


def windows(*rows: int) -> str:
    frames = [
        f"w{n} AS (PARTITION BY series ORDER BY datetime ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        for n in rows
    ]
    return "WINDOW " + ", ".join(["o AS (PARTITION BY series ORDER BY datetime)", *frames])


def signals_cte(source: str = "bars") -> str:
    return f"""feat AS (
  SELECT *, {full('avg', '(high - low)', 14)} AS atr_14, {full('avg', '(high - low)', 28)} AS atr_28,
         close / nullif(lag(close, 3) OVER o, 0) - 1 AS ret_3,
         close / nullif(lag(close, 6) OVER o, 0) - 1 AS ret_6,
         (high - low) / nullif(close, 0) AS range_ratio
  FROM {source} {windows(14, 28)}),
flags AS (
  SELECT *, {full('avg', 'atr_14', 50)} AS atr_mean, {full('stddev_samp', 'ret_3', 50)} AS ret_std,
         lead(close, 5) OVER o / nullif(close, 0) - 1 AS move
  FROM feat {windows(50)}),
sig AS (
  SELECT series, datetime, open, high, low, close, atr_14, atr_28, ret_3, ret_6, range_ratio,
         coalesce(CAST(atr_14 > atr_mean AS INTEGER), 0) AS event_vol_spike,
         coalesce(CAST(abs(ret_3) > ret_std AS INTEGER), 0) AS event_impulse,
         CASE WHEN move IS NOT NULL THEN CAST(abs(move) > 3.0 AS INTEGER) END AS target_opportunity
  FROM flags)"""


SIGNALS = f"WITH {bars_cte()}, {signals_cte()}"
COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in (*FEATURES, "target_opportunity"))
FOLD = """CASE WHEN datetime <= TIMESTAMP '2024-01-19' THEN 'train'
  WHEN datetime <= TIMESTAMP '2024-01-25' THEN 'val' ELSE 'test' END"""
FOLDED = f"""{SIGNALS},
folded AS (SELECT *, {FOLD} AS fold FROM sig WHERE {COMPLETE})"""
SCORED = f"""{FOLDED},
scored AS (SELECT *, {fixed('range_ratio / (1 + range_ratio)')} AS p_opportunity FROM folded)"""
KS = "(SELECT unnest([CAST(0.5 AS DOUBLE), CAST(1 AS DOUBLE), CAST(2 AS DOUBLE), CAST(10 AS DOUBLE)]) AS k_percent)"
CANDIDATES = """greatest(CAST(1 AS BIGINT), CAST(ceil(CAST(n AS DOUBLE) *
  (k_percent / CAST(100 AS DOUBLE))) AS BIGINT))"""


def precision_cte(name: str, source: str, by: str) -> str:
    return f"""{name} AS (
  SELECT {by}, k_percent, {CANDIDATES} AS candidate_count,
         {CANDIDATES} / CAST(n AS DOUBLE) AS candidate_rate,
         avg(CASE WHEN rk <= {CANDIDATES} THEN CAST(target_opportunity AS DOUBLE) END) AS precision_at_k,
         baseline
  FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY p_opportunity DESC, datetime, series) AS rk,
               count(*) OVER (PARTITION BY {by}) AS n,
               avg(CAST(target_opportunity AS DOUBLE)) OVER (PARTITION BY {by}) AS baseline
        FROM {source}) r CROSS JOIN {KS} k
  GROUP BY {by}, k_percent, n, baseline)"""


EVENT_ROWS = """fired AS (
  SELECT * EXCLUDE (event_vol_spike, event_impulse), 'event_vol_spike' AS event_name
  FROM {0} WHERE event_vol_spike = 1
  UNION ALL
  SELECT * EXCLUDE (event_vol_spike, event_impulse), 'event_impulse' FROM {0} WHERE event_impulse = 1)"""


def stats_cte(by: str) -> str:
    return f"""totals AS (SELECT {by}, count(*) AS n FROM scored GROUP BY {by}),
stats AS (
  SELECT {by}, event_name, count(*) AS frequency,
         count(*) / CAST(any_value(n) AS DOUBLE) AS event_rate,
         avg(CAST(target_opportunity AS DOUBLE)) AS trade_rate
  FROM fired JOIN totals USING ({by}) GROUP BY {by}, event_name)"""


def q(columns: str) -> str:
    """Column list with the features put on the grid."""
    return ", ".join(f"{fixed(c)} AS {c}" if c in FEATURES else c for c in columns.split())


RAW = """WITH raw AS (
  SELECT event_type AS series, CASE WHEN value >= 1 THEN CAST(date_trunc('hour', ts) AS TIMESTAMP) END AS datetime,
         CASE WHEN value < 150 THEN value END AS open, value AS high, value AS low,
         nullif(value, 10.0) AS close
  FROM events)"""


def quality(by: str) -> str:
    nulls = " + ".join(f"count_if({c} IS NULL)" for c in ("datetime", "open", "high", "low", "close"))
    return f"""{RAW} SELECT {by} count(*) AS rows, min(datetime) AS date_start, max(datetime) AS date_end,
  CAST({nulls} AS BIGINT) AS missing_values,
  CAST(count(*) - count(DISTINCT datetime) - max(CASE WHEN datetime IS NULL THEN 1 ELSE 0 END) AS BIGINT)
    AS duplicate_timestamps
  FROM raw {'GROUP BY series' if by else ''}"""


LONG = f"WITH {bars_cte('bars', chr(39) + 'all' + chr(39), 'minute')}, {signals_cte()}"
SAMPLED = f"""{FOLDED}, train AS (SELECT * FROM folded WHERE fold = 'train'),
counts AS (SELECT count_if(target_opportunity = 1) AS pos, count_if(target_opportunity = 0) AS neg FROM train),
hashed AS (SELECT *, row_number() OVER (PARTITION BY target_opportunity ORDER BY
    md5(concat('42|', series, '|', CAST(CAST(epoch(datetime) AS BIGINT) AS VARCHAR)))) AS rk FROM train),
sampled AS (SELECT h.* FROM hashed h, counts WHERE target_opportunity = 1 OR rk <= least(neg, 2 * pos))"""

SUFFIX = "_m1_2024-01-30_2300"
RUN_SCORED = f"""{SCORED.replace('scored AS (SELECT *,', f"scored AS (SELECT *, concat(series, '{SUFFIX}') AS run_id,")}"""
RUNS = f"""{RUN_SCORED}, {EVENT_ROWS.format('scored')},
{precision_cte('prec', 'scored', 'run_id, fold')},
{precision_cte('eprec', 'fired', 'run_id, fold, event_name')},
{stats_cte('run_id, fold')},
evaluation AS (SELECT run_id, fold, count(*) AS rows, avg(CAST(target_opportunity AS DOUBLE)) AS baseline
  FROM scored GROUP BY 1, 2),
base AS (SELECT run_id, count(*) AS n, sum(target_opportunity) AS hits, min(datetime) AS first,
  max(datetime) AS last, CAST(count_if(fold = 'train') AS BIGINT) AS train,
  CAST(count_if(fold = 'val') AS BIGINT) AS val, CAST(count_if(fold = 'test') AS BIGINT) AS test
  FROM scored GROUP BY 1),
sizes AS (SELECT run_id, {', '.join(f"avg(abs({f})) AS {f}" for f in FEATURES)} FROM scored GROUP BY 1),
importance AS (SELECT run_id, feature, {fixed('v / (1 + v)')} AS importance
  FROM (UNPIVOT sizes ON {', '.join(FEATURES)} INTO NAME feature VALUE v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY importance DESC, feature) AS position
  FROM importance),
status AS (SELECT run_id, concat_ws(', ', CASE WHEN n % 3 = 0 THEN 'config.yaml' END,
  CASE WHEN n % 2 <> 0 THEN 'feature_importance.csv' END) AS missing FROM base),
facts AS (SELECT run_id,
  {', '.join(f"max(CASE WHEN fold = '{f}' THEN baseline END) AS {f}_baseline, max(CASE WHEN fold = '{f}' THEN rows END) AS {f}_rows" for f in ('train', 'val', 'test'))}
  FROM evaluation GROUP BY 1),
half AS (SELECT run_id,
  {', '.join(f"max(CASE WHEN fold = '{f}' THEN precision_at_k END) AS {f}_precision_at_0_5" for f in ('train', 'val', 'test'))}
  FROM prec WHERE k_percent = 0.5 GROUP BY 1),
joined AS (SELECT *, val_precision_at_0_5 / nullif(val_baseline, 0) AS val_lift_at_0_5,
  test_precision_at_0_5 / nullif(test_baseline, 0) AS test_lift_at_0_5 FROM facts JOIN half USING (run_id)),
summary AS (SELECT run_id, '2024-01-30 23:00' AS timestamp, CAST(5 AS INTEGER) AS feature_count,
  train_precision_at_0_5, val_precision_at_0_5, test_precision_at_0_5, val_baseline, test_baseline,
  val_lift_at_0_5, test_lift_at_0_5, val_rows, test_rows, n AS n_estimators, CAST(5 AS BIGINT) AS max_depth,
  CAST(0.05 AS DOUBLE) AS learning_rate, CAST(8 AS DOUBLE) AS scale_pos_weight, feature AS top_feature,
  importance AS top_importance
  FROM joined JOIN base USING (run_id) JOIN (SELECT * FROM ranked WHERE position = 1) USING (run_id)),
labels AS (SELECT run_id, k_percent, CASE WHEN k_percent = 0.5 THEN '0.5' ELSE CAST(CAST(k_percent AS INTEGER) AS VARCHAR) END
  AS k_label, CAST(row_number() OVER (PARTITION BY run_id ORDER BY k_percent) AS INTEGER) AS label_rank
  FROM (SELECT DISTINCT run_id, k_percent FROM prec)),
series AS (SELECT s.run_id, s.fold, s.event_name, s.event_rate, s.trade_rate, e.precision_at_k AS precision_at_0_5,
  coalesce(e.baseline, s.trade_rate) AS baseline_at_0_5 FROM stats s LEFT JOIN eprec e
  ON s.run_id = e.run_id AND s.fold = e.fold AND s.event_name = e.event_name AND e.k_percent = 0.5),
logged AS (
  SELECT run_id, 'data_loaded' AS event, NULL AS split, n AS rows, first AS date_start,
    CAST(NULL AS DOUBLE) AS positive_rate, CAST(NULL AS BIGINT) AS train_size, NULL AS event_columns,
    CAST(NULL AS BIGINT) AS positives, NULL AS run_dir FROM base
  UNION ALL SELECT run_id, 'features_built', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM base
  UNION ALL SELECT run_id, 'events_built', NULL, NULL, NULL, NULL, NULL, 'event_vol_spike,event_impulse', NULL, NULL FROM base
  UNION ALL SELECT run_id, 'labels_created', NULL, NULL, NULL, hits / n, NULL, NULL, hits, NULL FROM base
  UNION ALL SELECT run_id, 'split_summary', 'train', train, NULL, NULL, NULL, NULL, NULL, NULL FROM base
  UNION ALL SELECT run_id, 'split_summary', 'val', val, NULL, NULL, NULL, NULL, NULL, NULL FROM base
  UNION ALL SELECT run_id, 'split_summary', 'test', test, NULL, NULL, NULL, NULL, NULL, NULL FROM base
  UNION ALL SELECT run_id, 'features_selected', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM base WHERE hits * 5 > n
  UNION ALL SELECT run_id, 'tuning_complete', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM base WHERE hits * 5 > n
  UNION ALL SELECT run_id, 'model_trained', NULL, NULL, NULL, NULL, train, NULL, NULL, NULL FROM base
  UNION ALL SELECT run_id, 'artifacts_saved', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'a=b' FROM base)
"""
CELLS = "k_label, precision_at_k, candidate_rate, candidate_count"

# many ties, rows without fold, a series without name; NULL comes first, as in Spark
UNTIDY = f"""{SCORED}, untidy AS (SELECT nullif(series, 'click') AS series, datetime,
  CASE WHEN extract(hour FROM datetime) % 4 <> 0 THEN fold END AS fold,
  floor(p_opportunity * CAST(4 AS DOUBLE)) / CAST(4 AS DOUBLE) AS p_opportunity, target_opportunity FROM scored)"""
ORDER_UNTIDY = "p_opportunity DESC, datetime, series NULLS FIRST"
RANK_UNTIDY = f"""{UNTIDY} SELECT *, row_number() OVER (PARTITION BY fold ORDER BY {ORDER_UNTIDY}) AS rank_opportunity
  FROM untidy"""
EVALUATION_UNTIDY = f"""{UNTIDY}, {precision_cte('prec', 'untidy', 'fold').replace('datetime, series)', 'datetime, series NULLS FIRST)')},
  sizes AS (SELECT fold, count(*) AS n FROM untidy GROUP BY 1)
  SELECT prec.*, n AS rows FROM prec JOIN sizes ON prec.fold IS NOT DISTINCT FROM sizes.fold"""


def leaf(weight: str, source: str = "sampled") -> str:
    """A tree of depth 1 on a flag: the weighted mean of labels in {-1, 1} per value."""
    w = f"CASE WHEN target_opportunity = 1 THEN CAST({weight} AS DOUBLE) ELSE CAST(1 AS DOUBLE) END"
    return f"""SELECT event_vol_spike AS flag, sum({w}) AS weight,
    sum({w} * (2 * target_opportunity - 1)) / sum({w}) AS leaf FROM {source}"""


STUMP = f"""{SAMPLED}, fit AS ({leaf('4')} GROUP BY 1),
base AS (SELECT sum(weight * leaf) / sum(weight) AS margin FROM fit),
modelled AS (SELECT f.*, leaf, {fixed('1 / (1 + exp(-2 * leaf))')} AS p_opportunity,
  1 / (1 + exp(-2 * leaf)) AS p FROM folded f JOIN fit ON flag = event_vol_spike)"""
STUMP_EVALUATION = f"""{STUMP}, judged AS (SELECT * FROM modelled WHERE fold <> 'train' UNION ALL
  SELECT m.* FROM modelled m JOIN sampled s ON m.series = s.series AND m.datetime = s.datetime WHERE m.fold = 'train'),
  {precision_cte('prec', 'judged', 'fold')}
  SELECT prec.*, n AS rows FROM prec JOIN (SELECT fold, count(*) AS n FROM judged GROUP BY 1) USING (fold)"""
PHI = f"SELECT m.series, m.datetime, 'event_vol_spike' AS feature, 2 * (leaf - margin) AS phi FROM modelled m, base WHERE fold = 'val'"
GRID = f"""{SAMPLED}, numbered AS (SELECT *, row_number() OVER (ORDER BY datetime, series) - 1 AS pos, count(*) OVER () AS n
  FROM sampled),
points AS (SELECT unnest([1, 8]) AS w), splits AS (SELECT unnest([0, 1]) AS split),
parts AS (SELECT *, CASE WHEN pos < n - (2 - split) * (n // 3) THEN 'train'
  WHEN pos < n - (2 - split) * (n // 3) + n // 3 THEN 'test' END AS role FROM numbered, points, splits),
fits AS ({leaf('w', "parts WHERE role = 'train'").replace('SELECT event', 'SELECT w, split, event')} GROUP BY w, split, event_vol_spike),
hits AS (SELECT p.w, p.split, count_if(leaf > 0 AND target_opportunity = 1) AS hit,
  count_if(leaf > 0) + count_if(target_opportunity = 1) AS found
  FROM parts p JOIN fits f ON p.w = f.w AND p.split = f.split AND flag = event_vol_spike WHERE role = 'test' GROUP BY 1, 2),
f1 AS (SELECT w, split, CASE WHEN found > 0 THEN CAST(2 AS DOUBLE) * hit / found ELSE CAST(0 AS DOUBLE) END AS f FROM hits),
wide AS (SELECT w, max(CASE WHEN split = 0 THEN f END) AS a, max(CASE WHEN split = 1 THEN f END) AS b FROM f1 GROUP BY w),
means AS (SELECT *, (a + b) / 2 AS m FROM wide)
SELECT concat('{{"scale_pos_weight": ', w, '}}') AS params, {fixed('a')} AS split0_test_score, {fixed('b')} AS split1_test_score,
  {fixed('m')} AS mean_test_score, {fixed('sqrt(((a - m) * (a - m) + (b - m) * (b - m)) / 2)')} AS std_test_score,
  CAST(rank() OVER (ORDER BY m DESC) AS INTEGER) AS rank_test_score FROM means"""

ORACLES: dict[str, str] = {
    "bars": f"WITH {bars_cte()} SELECT * FROM bars",
    "bars_per_minute": f"WITH {bars_cte(unit='minute')} SELECT * FROM bars",
    "parse_text_bars": f"""WITH {bars_cte()} SELECT *,
  CASE WHEN close > open THEN NULL ELSE CAST(7 AS DOUBLE) END AS tickvol FROM bars""",
    "read_csv_bars": f"WITH {bars_cte()} SELECT * FROM bars",
    "read_mixed_bars": f"""WITH {bars_cte()} SELECT *, CASE WHEN series = 'view' THEN CAST(7 AS DOUBLE) END AS tickvol FROM bars""",
    "read_blank_bars": f"WITH {bars_cte()} SELECT * FROM bars WHERE series NOT IN ('click', 'view')",
    "time_layouts": f"""WITH {bars_cte()} SELECT series, CASE series WHEN 'click' THEN 'yyyy-MM-dd HH:mm:ss'
  WHEN 'view' THEN 'MM/dd/yyyy HH:mm:ss' ELSE 'yyyy.MM.dd HH:mm' END AS layout, count(*) AS rows, CAST(0 AS BIGINT) AS unreadable
  FROM bars GROUP BY series""",
    "quality_summary": quality("series,"),
    "quality_summary_total": quality(""),
    "validation_report": f"""{RAW}, c AS (SELECT count(*) AS n, {', '.join(f'count_if({x} IS NULL) AS {x}' for x in ('datetime', 'open', 'high', 'low', 'close'))} FROM raw)
  SELECT 'zero rows' AS rule, CAST(n = 0 AS BIGINT) AS violations FROM c
  {' '.join(f"UNION ALL SELECT '{x}', CAST({x} AS BIGINT) FROM c" for x in ('datetime', 'open', 'high', 'low', 'close'))}""",
    "range_mean": f"{SIGNALS} SELECT {q('series datetime atr_14 atr_28')} FROM sig",
    "returns": f"{SIGNALS} SELECT {q('series datetime ret_3 ret_6')} FROM sig",
    "range_ratio": f"{SIGNALS} SELECT {q('series datetime range_ratio')} FROM sig",
    "feature_frame": f"{SIGNALS} SELECT {q('series datetime open high low close atr_14 atr_28 ret_3 ret_6 range_ratio')} FROM sig",
    "feature_summary": f"""{SIGNALS} SELECT series, CAST(5 AS INTEGER) AS feature_count,
  CAST({' + '.join(f'count_if({f} IS NULL)' for f in FEATURES)} AS BIGINT) AS nan_count FROM sig GROUP BY series""",
    "feature_registry": f"""{SIGNALS}
  SELECT 'atr_14' AS name, 'volatility' AS feature_group, '1.0' AS version, count(atr_14) AS present FROM sig
  UNION ALL SELECT 'atr_28', 'volatility', '1.0', count(atr_28) FROM sig
  UNION ALL SELECT 'ret_3', 'momentum', '1.0', count(ret_3) FROM sig
  UNION ALL SELECT 'ret_6', 'momentum', '1.0', count(ret_6) FROM sig
  UNION ALL SELECT 'range_ratio', 'structure', '1.0', count(range_ratio) FROM sig
  UNION ALL SELECT 'event_vol_spike', 'event', '1.0', count(event_vol_spike) FROM sig
  UNION ALL SELECT 'event_impulse', 'event', '1.0', count(event_impulse) FROM sig""",
    "select_features": f"{SIGNALS} SELECT {q('series datetime ret_3 atr_14')} FROM sig",
    "select_numeric": f"""{SIGNALS} SELECT {q('series datetime open high low close atr_14 atr_28 ret_3 ret_6 range_ratio event_vol_spike event_impulse')} FROM sig""",
    "event_levels": f"""{SIGNALS} SELECT series, datetime, {fixed('atr_mean')} AS atr_mean_50,
  {fixed('ret_std')} AS ret_std_50 FROM flags""",
    "event_signals": f"{SIGNALS} SELECT series, datetime, event_vol_spike, event_impulse FROM sig",
    "event_frequency": f"""{SIGNALS}, {EVENT_ROWS.format('sig')}
  SELECT series, event_name, count(*) AS frequency FROM fired GROUP BY 1, 2""",
    "opportunity_label": f"{SIGNALS} SELECT series, datetime, target_opportunity FROM sig",
    "label_summary": f"""{SIGNALS} SELECT series, CAST(count_if(target_opportunity = 0) AS BIGINT) AS label_0,
  CAST(count_if(target_opportunity = 1) AS BIGINT) AS label_1, count(target_opportunity) AS labeled,
  coalesce(avg(CAST(target_opportunity AS DOUBLE)), 0) AS positive_rate FROM sig GROUP BY series""",
    "blocked_signals": f"""{LONG} SELECT {q('datetime atr_14 atr_28 ret_3 ret_6 range_ratio event_vol_spike event_impulse target_opportunity')} FROM sig""",
    "blocked_range_mean": f"""WITH {bars_cte('bars', chr(39) + 'all' + chr(39), 'minute')},
  m AS (SELECT datetime, {full('avg', '(high - low)', 50)} AS mean_50 FROM bars {windows(50)})
  SELECT datetime, {fixed('mean_50')} AS mean_50 FROM m""",
    "global_row_index": """SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS bar_idx FROM events""",
    "series_row_index": f"""WITH {bars_cte()} SELECT series, datetime,
  row_number() OVER (PARTITION BY series ORDER BY datetime) - 1 AS bar_idx FROM bars""",
    "complete_rows": f"""{SIGNALS} SELECT {q('series datetime open high low close atr_14 atr_28 ret_3 ret_6 range_ratio event_vol_spike event_impulse target_opportunity')} FROM sig WHERE {COMPLETE}""",
    "time_split": f"WITH {bars_cte()} SELECT series, datetime, {FOLD} AS fold FROM bars",
    "split_summary": f"""{FOLDED} SELECT fold, CAST(count_if(target_opportunity = 0) AS BIGINT) AS label_0,
  CAST(count_if(target_opportunity = 1) AS BIGINT) AS label_1, count(*) AS rows,
  avg(CAST(target_opportunity AS DOUBLE)) AS positive_rate FROM folded GROUP BY fold""",
    "label_distribution": f"""{FOLDED} SELECT fold, target_opportunity AS label, count(*) AS n
  FROM folded GROUP BY 1, 2""",
    "downsample": f"{SAMPLED} SELECT series, datetime, target_opportunity FROM sampled",
    "downsample_cells": f"{SAMPLED} SELECT series, datetime, target_opportunity FROM sampled",
    "sampling_summary": f"""{SAMPLED} SELECT * FROM
  (SELECT count(*) AS train_rows_before, CAST(count_if(target_opportunity = 1) AS BIGINT) AS positive_before,
          CAST(count_if(target_opportunity = 0) AS BIGINT) AS negative_before FROM train),
  (SELECT count(*) AS train_rows_after, CAST(count_if(target_opportunity = 1) AS BIGINT) AS positive_after,
          CAST(count_if(target_opportunity = 0) AS BIGINT) AS negative_after FROM sampled)""",
    "shap_sample": f"""{FOLDED} SELECT series, datetime FROM folded WHERE fold = 'val' ORDER BY
  md5(concat('42|', series, '|', CAST(CAST(epoch(datetime) AS BIGINT) AS VARCHAR))) LIMIT 200""",
    "ts_cv_folds": f"""{FOLDED}, p AS (SELECT series, datetime,
    row_number() OVER (ORDER BY datetime, series) - 1 AS position, count(*) OVER () AS n
    FROM folded WHERE fold = 'train'),
  s AS (SELECT *, n - (3 - split) * (n // 4) AS start FROM p,
    (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS split))
  SELECT series, datetime, position, split, CASE WHEN position < start THEN 'train' ELSE 'test' END AS role
  FROM s WHERE position < start + n // 4""",
    "first_bars": f"WITH {bars_cte()} SELECT * FROM bars ORDER BY datetime, series LIMIT 1000",
    "snapshot_sink": f"WITH {bars_cte()} SELECT * FROM bars ORDER BY datetime, series LIMIT 500",
    "rank": f"""{SCORED} SELECT series, datetime, fold, row_number() OVER (PARTITION BY fold
  ORDER BY p_opportunity DESC, datetime, series) AS rank_opportunity FROM scored""",
    "rank_untidy": RANK_UNTIDY,
    "rank_untidy_cells": RANK_UNTIDY,
    "fold_evaluation_untidy": EVALUATION_UNTIDY,
    "fold_evaluation_untidy_cells": EVALUATION_UNTIDY,
    "fold_evaluation_empty_fold": f"""{SCORED}, {precision_cte('prec', 'scored', 'fold')}
  SELECT prec.*, n AS rows FROM prec JOIN (SELECT fold, count(*) AS n FROM scored GROUP BY 1) USING (fold)
  WHERE fold <> 'val'
  UNION ALL SELECT 'val', k_percent, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE),
  CAST(0 AS BIGINT) FROM {KS} k""",
    "series_row_index_untidy": f"""{UNTIDY} SELECT series, datetime, p_opportunity, row_number() OVER (PARTITION BY series
  ORDER BY datetime, p_opportunity) - 1 AS bar_idx FROM untidy""",
    "train_score": f"""{STUMP} SELECT series, datetime, fold, p_opportunity, row_number() OVER (PARTITION BY fold
  ORDER BY p_opportunity DESC, datetime, series) AS rank_opportunity FROM modelled""",
    "model_precision": STUMP_EVALUATION,
    "validation_loss": f"""{STUMP} SELECT {fixed('avg(-ln(greatest(CAST(1e-15 AS DOUBLE), CASE WHEN target_opportunity = 1 THEN p ELSE 1 - p END)))')}
  AS log_loss FROM modelled WHERE fold = 'val'""",
    "model_importance": """SELECT CAST(0 AS INTEGER) AS position, 'event_vol_spike' AS feature, CAST(1 AS DOUBLE) AS importance
  FROM (SELECT count(*) FROM events)""",
    "grid_search": GRID,
    "shap_values": f"{STUMP} SELECT series, datetime, feature, {fixed('phi')} AS phi FROM ({PHI})",
    "shap_importance": f"""{STUMP}, phi AS (SELECT *, row_number() OVER (ORDER BY
    md5(concat('42|', series, '|', CAST(CAST(epoch(datetime) AS BIGINT) AS VARCHAR)))) AS rk FROM ({PHI}))
  SELECT feature, {fixed('avg(abs(phi))')} AS mean_abs_shap FROM phi WHERE rk <= 200 GROUP BY 1""",
    "top_scores": f"""{SCORED} SELECT fold, CAST(rk AS INTEGER) AS rank, series, datetime, p_opportunity FROM (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY p_opportunity DESC, datetime, series) AS rk
  FROM scored) WHERE rk <= 20""",
    "precision_at_k": f"{SCORED}, {precision_cte('prec', 'scored', 'fold')} SELECT * FROM prec",
    "fold_evaluation": f"""{SCORED}, {precision_cte('prec', 'scored', 'fold')}
  SELECT prec.*, n AS rows FROM prec JOIN (SELECT fold, count(*) AS n FROM scored GROUP BY 1) USING (fold)""",
    "nested_precision": f"""{SCORED}, {precision_cte('prec', 'scored', 'fold')}
  SELECT *, CAST(4 AS INTEGER) AS entries FROM prec""",
    "event_statistics": f"{SCORED}, {EVENT_ROWS.format('scored')}, {stats_cte('fold')} SELECT * FROM stats",
    "event_diagnostics": f"""{SCORED}, {EVENT_ROWS.format('scored')}, {stats_cte('fold')},
  {precision_cte('prec', 'fired', 'fold, event_name')} SELECT * FROM prec JOIN stats USING (fold, event_name)""",
    "run_ids": f"""WITH {bars_cte()}, m AS (SELECT series, max(datetime) AS latest FROM bars GROUP BY 1)
  SELECT series, concat(series, '_m1_', strftime(latest, '%Y-%m-%d_%H%M')) AS run_id,
  strftime(latest, '%Y-%m-%d %H:%M') AS timestamp FROM m""",
    "parse_logs": f"""{RUNS} SELECT run_id, event, split, rows, date_start, positive_rate, train_size,
  CAST(NULL AS BIGINT) AS best_iteration, event_columns, CAST(positives AS BIGINT) AS positives, run_dir FROM logged""",
    "run_listing": f"{RUNS} SELECT summary.* FROM summary JOIN status USING (run_id) WHERE missing = ''",
    "skipped_runs": f"""{RUNS} SELECT run_id, concat('missing artifacts: ', missing) AS reason FROM status
  WHERE missing <> ''""",
    "run_lookup": f"""{RUNS} SELECT summary.* FROM summary JOIN status USING (run_id)
  WHERE missing = '' AND run_id = 'error{SUFFIX}'""",
    "run_summary": f"{RUNS} SELECT * FROM summary",
    "scorecard": f"""{RUNS}, v AS (SELECT run_id, train_precision_at_0_5, val_precision_at_0_5, test_precision_at_0_5,
    val_baseline, test_baseline, val_lift_at_0_5, test_lift_at_0_5,
    (coalesce(val_lift_at_0_5, 0) + coalesce(test_lift_at_0_5, 0)) / nullif(CAST(val_lift_at_0_5 IS NOT NULL AS INTEGER)
      + CAST(test_lift_at_0_5 IS NOT NULL AS INTEGER), 0) AS out_of_sample_lift,
    train_precision_at_0_5 - test_precision_at_0_5 AS generalization_gap,
    abs(val_precision_at_0_5 - test_precision_at_0_5) AS val_test_gap FROM joined),
  l AS (SELECT *, CASE WHEN out_of_sample_lift >= 2 THEN 'Strong' WHEN out_of_sample_lift >= 1.4 THEN 'Promising'
      ELSE 'Needs work' END AS quality_label,
    CASE WHEN generalization_gap IS NULL OR val_test_gap IS NULL THEN 'Hard to judge'
      WHEN generalization_gap <= 0.2 AND val_test_gap <= 0.12 THEN 'Stable'
      WHEN generalization_gap <= 0.35 AND val_test_gap <= 0.18 THEN 'Some overfit'
      ELSE 'Overfit risk' END AS training_label FROM v)
  SELECT *, CASE quality_label WHEN 'Strong' THEN 'success' WHEN 'Promising' THEN 'accent' ELSE 'warning' END AS quality_tone,
    CASE training_label WHEN 'Stable' THEN 'success' WHEN 'Overfit risk' THEN 'warning' ELSE 'accent' END AS training_tone
  FROM l""",
    "precision_matrix": f"""{RUNS} SELECT l.run_id, f.fold, l.label_rank, l.k_label, p.precision_at_k, p.candidate_rate,
  p.candidate_count, e.baseline, e.rows FROM labels l
  CROSS JOIN (SELECT unnest(['train', 'val', 'test']) AS fold) f
  LEFT JOIN prec p ON p.run_id = l.run_id AND p.fold = f.fold AND p.k_percent = l.k_percent
  LEFT JOIN evaluation e ON e.run_id = l.run_id AND e.fold = f.fold""",
    "quality_series": f"""{RUNS} SELECT l.run_id, l.label_rank, concat('Top ', l.k_label, '%') AS label,
  {', '.join(f"max(CASE WHEN fold = '{f}' THEN precision_at_k END) AS {f}_precision" for f in ('train', 'val', 'test'))},
  any_value(val_baseline) AS val_baseline, any_value(test_baseline) AS test_baseline
  FROM prec JOIN labels l ON prec.run_id = l.run_id AND prec.k_percent = l.k_percent
  JOIN facts ON facts.run_id = l.run_id GROUP BY l.run_id, l.label_rank, l.k_label""",
    "event_series": f"{RUNS} SELECT * FROM series",
    "training_summary": f"""{RUNS} SELECT run_id, n AS dataset_rows, first AS date_start, last AS date_end,
  CAST(5 AS INTEGER) AS selected_feature_count, CAST(5 AS BIGINT) AS built_feature_count,
  CAST(2 AS BIGINT) AS event_count, hits / n AS positive_rate, train AS raw_train_rows,
  train AS sampled_train_rows, val AS val_rows, test AS test_rows, hits * 5 > n AS tuning_enabled,
  CASE WHEN hits * 5 > n THEN CAST(8 AS BIGINT) END AS tuning_combinations,
  CASE WHEN hits * 5 > n THEN printf('%.1fs', n / 16.0) END AS tuning_time, CAST(NULL AS VARCHAR) AS best_params,
  hits / n AS validation_score, train AS train_size, val AS val_size, false AS shap_enabled,
  CAST(NULL AS BIGINT) AS shap_features_analyzed,
  CASE WHEN hits * 5 > n THEN 'atr_14,ret_3' END AS logged_features,
  CASE WHEN hits * 5 > n THEN 'atr_14,ret_3' ELSE 'atr_14,atr_28,ret_3,ret_6,range_ratio' END AS selected_features
  FROM base""",
    "row_funnel": f"""{RUNS} SELECT run_id, CAST(1 AS INTEGER) AS stage_rank, 'Raw train' AS stage, train AS rows FROM base
  UNION ALL SELECT run_id, 2, 'Sampled train', train FROM base
  UNION ALL SELECT run_id, 3, 'Validation', val FROM base
  UNION ALL SELECT run_id, 4, 'Test', test FROM base""",
    "importance_top": f"""{RUNS} SELECT run_id, CAST(position AS INTEGER) AS rank, feature, importance FROM ranked
  WHERE position <= 3""",
    "compare_importance": f"""{RUNS}, a AS (SELECT * FROM ranked WHERE position <= 3 AND run_id = 'click{SUFFIX}'),
  b AS (SELECT * FROM ranked WHERE position <= 3 AND run_id = 'view{SUFFIX}')
  SELECT coalesce(a.feature, b.feature) AS feature,
  CAST(row_number() OVER (ORDER BY coalesce(a.position, 100 + b.position)) AS INTEGER) AS position,
  a.importance AS left_importance, b.importance AS right_importance
  FROM a FULL JOIN b ON a.feature = b.feature""",
    "compare_events": f"""{RUNS}, a AS (SELECT * FROM series WHERE run_id = 'click{SUFFIX}'),
  b AS (SELECT * FROM series WHERE run_id = 'view{SUFFIX}')
  SELECT coalesce(a.fold, b.fold) AS fold, coalesce(a.event_name, b.event_name) AS event_name,
  a.event_rate AS left_event_rate, a.trade_rate AS left_trade_rate, a.precision_at_0_5 AS left_precision_at_0_5,
  b.event_rate AS right_event_rate, b.trade_rate AS right_trade_rate, b.precision_at_0_5 AS right_precision_at_0_5
  FROM a FULL JOIN b ON a.fold = b.fold AND a.event_name = b.event_name""",
}
ORACLES["rank_cells"] = ORACLES["rank"]
ORACLES["precision_at_k_cells"] = ORACLES["precision_at_k"]
LOG_LINES = """[
  concat('t | INFO | root | data_loaded | rows=', n, ' | date_start=', first, ' | date_end=', last),
  'not a log line', 'a | b | c', 't | INFO | root | empty_event | no pairs here',
  't | INFO | root | features_built | feature_count=5 | nan_count=49',
  't | INFO | root | events_built | event_count=2 | event_columns=[''event_vol_spike'', ''event_impulse'']']"""
ORACLES["logs_preview"] = f"""{RUNS}, lines AS (SELECT run_id, unnest({LOG_LINES}) AS line,
    unnest([1, 2, 3, 4, 5, 6]) AS i FROM base)
  SELECT run_id, CAST(i AS INTEGER) AS line_rank, line FROM lines"""
ORACLES["resumed_training"] = STUMP_EVALUATION
ORACLES["train_and_evaluate"] = f"""WITH judged_k AS (SELECT * FROM ({STUMP_EVALUATION})), wide AS (SELECT
  {', '.join(f"max(CASE WHEN fold = '{f}' AND k_percent = 0.5 THEN precision_at_k END) AS {f}_precision_at_0_5, max(CASE WHEN fold = '{f}' THEN baseline END) AS {f}_baseline, max(CASE WHEN fold = '{f}' THEN rows END) AS {f}_rows" for f in ('train', 'val', 'test'))}
  FROM judged_k)
SELECT CAST(1 AS INTEGER) AS feature_count, train_precision_at_0_5, val_precision_at_0_5, test_precision_at_0_5,
  val_baseline, test_baseline, val_precision_at_0_5 / nullif(val_baseline, 0) AS val_lift_at_0_5,
  test_precision_at_0_5 / nullif(test_baseline, 0) AS test_lift_at_0_5, val_rows, test_rows, CAST(1 AS BIGINT) AS n_estimators,
  CAST(1 AS BIGINT) AS max_depth, CAST(0.1 AS DOUBLE) AS learning_rate, CAST(4 AS DOUBLE) AS scale_pos_weight,
  'event_vol_spike' AS top_feature, CAST(1 AS DOUBLE) AS top_importance FROM wide"""
ORACLES["training_log"] = f"""{SAMPLED}, gaps AS (SELECT CAST({' + '.join(f'count_if({f} IS NULL)' for f in FEATURES)} AS BIGINT) AS n FROM sig),
sizes AS (SELECT fold, count(*) AS n FROM folded GROUP BY 1), kept AS (SELECT count(*) AS n, count_if(target_opportunity = 1) AS pos FROM sampled)
SELECT 'data_loaded' AS event, NULL AS split, count(*) AS rows, CAST(NULL AS BIGINT) AS nan_count, CAST(NULL AS BIGINT) AS train_rows_before,
  CAST(NULL AS BIGINT) AS train_rows_after, CAST(NULL AS BIGINT) AS positive_after, CAST(NULL AS BIGINT) AS negative_before,
  CAST(NULL AS BIGINT) AS val_size FROM bars
UNION ALL SELECT 'features_built', NULL, NULL, n, NULL, NULL, NULL, NULL, NULL FROM gaps
UNION ALL SELECT 'after_dropna', NULL, CAST(sum(n) AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL FROM sizes
UNION ALL SELECT 'split_summary', fold, n, NULL, NULL, NULL, NULL, NULL, NULL FROM sizes
UNION ALL SELECT 'training_downsampled', NULL, NULL, NULL, CAST(p + neg AS BIGINT), n, CAST(kept.pos AS BIGINT), CAST(neg AS BIGINT), NULL
  FROM (SELECT pos AS p, neg FROM counts) c, kept
UNION ALL SELECT 'model_trained', NULL, NULL, NULL, NULL, NULL, NULL, NULL, n FROM sizes WHERE fold = 'val'"""
ORACLES["fold_guard"] = f"""{FOLDED} SELECT f.fold, count(folded.fold) AS rows, count(folded.fold) = 0 AS empty
  FROM (SELECT unnest(['train', 'val', 'test']) AS fold) f
  LEFT JOIN folded ON folded.fold = f.fold AND datetime <= TIMESTAMP '2024-01-25' GROUP BY 1"""
ORACLES["column_guard"] = f"{SCORED} " + " UNION ALL ".join(
    f"SELECT '{name}' AS name, '{role}' AS role, count({value}) AS present FROM scored"
    for role, value, names in (
        ("not numeric", "series", "series fold"),
        ("barred", "datetime", "datetime target_opportunity p_opportunity rank_opportunity"),
        ("feature", "close", "open high low close atr_14 atr_28 ret_3 ret_6 range_ratio event_vol_spike event_impulse"),
    )
    for name in names.split()
)
