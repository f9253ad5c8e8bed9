"""Scalar expressions as Spark SQL text, for `selectExpr`, `filter` and `F.expr`.

Arguments are SQL text as well (`q` quotes a column name). Everything maps to built-in functions, so it
stays inside generated code; text also spares a call into the JVM per operand.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RUN_TIMESTAMP = r"(\\d{4}-\\d{2}-\\d{2})_(\\d{2})(\\d{2})(?:_\\d{2})?$"
PLAIN_NUMBER = r"^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$"


def q(name: str) -> str:
    """Quoted column name."""
    return "`" + name.replace("`", "``") + "`"


def qs(names: Iterable[str]) -> str:
    """Quoted column names, separated by commas."""
    return ", ".join(q(name) for name in names)


def text(value: str) -> str:
    """String literal."""
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def clean_header(name: str) -> str:
    """Column name without blanks or angle brackets, in lower case."""
    return str(name).strip().strip("<>").lower()


def clean_text(value: str) -> str:
    """`clean_header` for a string column."""
    return f"lower(btrim(trim({value}), '<>'))"


def epoch_seconds(df: DataFrame, name: str) -> str:
    """Whole seconds since 1970, rounded down; NTZ never passes through the session time zone."""
    col, kind = q(name), df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return f"(CAST(unix_date({col}) AS BIGINT) * 86400)"
    if isinstance(kind, T.TimestampType):
        return f"unix_seconds({col})"
    early = f"{col} < TIMESTAMP_NTZ'1970-01-01 00:00:00' AND {second_fraction(df, name)} > 0"
    return f"(unix_timestamp({col}) - CASE WHEN {early} THEN 1 ELSE 0 END)"  # it rounds towards 1970


def second_fraction(df: DataFrame, name: str) -> str:
    """Microseconds within the second."""
    if isinstance(df.schema[name].dataType, T.DateType):
        return "0L"
    return f"CAST(extract(SECOND FROM {q(name)}) * 1000000 AS BIGINT) % 1000000"


def truncate_time(col: str, unit: str) -> str:
    """NTZ timestamp cut down to its minute or hour, without a detour over a time zone."""
    minutes = {"minute": "0", "hour": f"minute({col})"}.get(unit)
    if minutes is None:
        raise ValueError(f"unsupported unit: {unit}")
    return f"{col} - make_dt_interval(0, 0, {minutes}, extract(SECOND FROM {col}))"


def boundary(value) -> datetime:
    """Point in time from a date, a datetime or ISO text; a bare date means its midnight."""
    return datetime.fromisoformat(str(value))


def time_limit(value) -> str:
    """`boundary` as a literal."""
    return f"TIMESTAMP_NTZ'{boundary(value).isoformat(sep=' ')}'"


def number_or_null(value: str) -> str:
    """Text to DOUBLE; anything that is not a plain decimal number becomes NULL."""
    return f"CASE WHEN {value} RLIKE '{PLAIN_NUMBER}' THEN try_cast(trim({value}) AS DOUBLE) END"


def safe_ratio(numerator: str, denominator: str) -> str:
    """numerator / denominator; NULL if either is NULL or the denominator is 0."""
    return f"try_divide(CAST({numerator} AS DOUBLE), CAST({denominator} AS DOUBLE))"


def mean_present(*values: str) -> str:
    """Mean of the values that are not NULL; NULL if all are."""
    total = " + ".join(f"coalesce({v}, 0.0D)" for v in values)
    present = " + ".join(f"CAST({v} IS NOT NULL AS INT)" for v in values)
    return f"try_divide({total}, {present})"


def k_label(value: str) -> str:
    """Percent as short text: 0.5 -> '0.5', 1.0 -> '1'."""
    return rf"regexp_replace(CAST(CAST({value} AS DOUBLE) AS STRING), '\\.0$', '')"


def run_timestamp(run_id: str) -> str:
    """'YYYY-MM-DD HH:MM' out of a run id; the run id itself if it carries no timestamp."""
    day, hour, minute = (f"regexp_extract({run_id}, '{RUN_TIMESTAMP}', {i})" for i in (1, 2, 3))
    found = f"concat({day}, ' ', {hour}, ':', {minute})"
    return f"CASE WHEN {run_id} RLIKE '{RUN_TIMESTAMP}' THEN {found} ELSE {run_id} END"


def run_id(model: str, dataset: str, at: str) -> str:
    """<model>_<dataset>_<date>_<HHMM>."""
    return f"concat_ws('_', {model}, {dataset}, date_format({at}, 'yyyy-MM-dd_HHmm'))"


def fixed(value: str, digits: int = 6) -> str:
    """Value on a grid of 10^-digits, halves up: the same bits in every engine."""
    scale = f"{10**digits}.0D"
    return f"CAST(floor(({value}) * {scale} + 0.5D) AS DOUBLE) / {scale}"


def sample_key(seed: int, *parts: str) -> str:
    """Reproducible pseudo-random hex key of a row."""
    values = ", ".join(f"CAST({p} AS STRING)" for p in parts)
    return f"md5(concat_ws('|', '{seed}', {values}))"


def candidate_count(rows: str, k_percent: str) -> str:
    """Rows in the top k percent: at least one, rounded up in binary double arithmetic."""
    share = f"CAST({k_percent} AS DOUBLE) / 100.0D"
    return f"greatest(1L, CAST(ceil(CAST({rows} AS DOUBLE) * ({share})) AS BIGINT))"


def over(keys: Iterable[str], order: Iterable[str] = (), frame: str = "") -> str:
    """Window clause from quoted keys and ordering terms."""
    keys, order = list(keys), list(order)
    by = f"PARTITION BY {', '.join(keys)} " if keys else ""
    sort = f"ORDER BY {', '.join(order)} " if order else ""
    return f"OVER ({by}{sort}{frame})"


WHOLE = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
