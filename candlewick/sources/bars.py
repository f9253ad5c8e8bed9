"""Bar files: comma-separated or blank-separated text with a header line."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions.sql import clean_header, number_or_null, q, text
from candlewick.operators.cells import Listed
from candlewick.operators.quality import REQUIRED, check_bars

# Accepted layouts of dates and times, as (name, pattern, groups of year, month, day) and (name, pattern, parts).
DATES = (
    ("yyyy-MM-dd", r"(\d{4})-(\d{1,2})-(\d{1,2})", (1, 2, 3)),
    ("yyyy.MM.dd", r"(\d{4})\.(\d{1,2})\.(\d{1,2})", (1, 2, 3)),
    ("yyyy/MM/dd", r"(\d{4})/(\d{1,2})/(\d{1,2})", (1, 2, 3)),
    ("MM/dd/yyyy", r"(\d{1,2})/(\d{1,2})/(\d{4})", (3, 1, 2)),
    ("yyyyMMdd", r"(\d{4})(\d{2})(\d{2})", (1, 2, 3)),
)
TIMES = (
    (" HH:mm:ss.S", r"[ T](\d{1,2}):(\d{2}):(\d{2}\.\d{1,6})", 3),
    (" HH:mm:ss", r"[ T](\d{1,2}):(\d{2}):(\d{2})", 3),
    (" HH:mm", r"[ T](\d{1,2}):(\d{2})", 2),
    ("", r"", 0),
)
# A map of headers of up to so many files is broadcast.
HEADERS = 50_000


class Layout(NamedTuple):
    """One way to write a time."""

    name: str
    pattern: str
    date: tuple[int, int, int]
    parts: int

    def matches(self, value: str) -> str:
        """SQL text: whether the text has this layout."""
        return f"trim({value}) RLIKE {text(self.pattern)}"

    def stamp(self, value: str) -> str:
        """SQL text: the text as TIMESTAMP_NTZ; NULL for dates that do not exist."""
        field = [f"regexp_extract(trim({value}), {text(self.pattern)}, {i})" for i in range(1, 4 + self.parts)]
        year, month, day = (f"lpad({field[i - 1]}, {width}, '0')" for i, width in zip(self.date, (4, 2, 2)))
        hour, minute, second = [*field[3:], "'0'", "'0'", "'0'"][:3]
        clock = f"lpad({hour}, 2, '0'), ':', lpad({minute}, 2, '0'), ':', CASE WHEN length({second}) < 2 THEN '00' ELSE {second} END"
        return f"try_cast(concat({year}, '-', {month}, '-', {day}, ' ', {clock}) AS TIMESTAMP_NTZ)"


LAYOUTS = tuple(
    Layout(day + clock, f"^{date}{hours}$", groups, parts) for day, date, groups in DATES for clock, hours, parts in TIMES
)


def parse_time(value: str, first: str | None) -> str:
    """SQL text: `value` as TIMESTAMP_NTZ in the layout of the first row; NULL in any other layout."""
    for layout in LAYOUTS:
        if first is not None and re.match(layout.pattern, first.strip()):
            return f"CASE WHEN {layout.matches(value)} THEN {layout.stamp(value)} END"
    return "CAST(NULL AS TIMESTAMP_NTZ)"


def parse_any_time(value: str) -> str:
    """SQL text: `value` as TIMESTAMP_NTZ, each row in its own layout; NULL in none of them. Layouts exclude each other."""
    cases = " ".join(f"WHEN {layout.matches(value)} THEN {layout.stamp(value)}" for layout in LAYOUTS)
    return f"CASE {cases} END"


def time_layout(value: str) -> str:
    """SQL text: name of the layout that a text has; NULL for none."""
    return f"CASE {' '.join(f'WHEN {layout.matches(value)} THEN {text(layout.name)}' for layout in LAYOUTS)} END"


def time_value(columns: Sequence[str]) -> str:
    """SQL text of the time as it is written: `datetime`, else `date` and `time` with a blank between."""
    if "datetime" in columns:
        return q("datetime")
    if "date" in columns and "time" in columns:
        return "concat_ws(' ', `date`, `time`)"
    raise ValueError("Bars need a datetime column, or date and time")


def layout_report(raw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per layout of the time, and how many of them name no time; layout NULL stands for texts in none."""
    value = time_value(raw.columns)
    rows = raw.selectExpr(*map(q, by), f"{time_layout(value)} AS layout", f"{parse_any_time(value)} AS _at")
    return rows.groupBy(*by, "layout").agg(F.expr("count(1) AS rows"), F.expr("count_if(_at IS NULL) AS unreadable"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, header): the first line of each file that is not blank; reads the first split of every file only."""
    lines = spark.read.text(path).selectExpr(
        "_metadata.file_path AS file", "_metadata.file_block_start AS start", "monotonically_increasing_id() AS line", "value"
    )
    first = lines.filter("start = 0 AND trim(value) <> ''").groupBy("file")
    return first.agg(F.expr("min_by(value, line) AS header"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings under cleaned names; separator and order of the columns follow from each file's header."""
    try:
        headers = Listed.of(read_headers(spark, path), "headers", HEADERS)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"Data file not found: {path}") from error
        raise
    kinds = sorted(r["header"] for r in headers.rows.select("header").distinct().collect())
    if len(kinds) > 1:
        return read_by_name(spark, path, headers, kinds)
    header = kinds[0].lstrip(MARK) if kinds else ""
    if "," in header:
        raw = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False)
        return raw.toDF(*[clean_header(name) for name in raw.columns])
    return split_lines(spark.read.text(path), header)


MARK = "\ufeff"


def header_names(header: str) -> list[str]:
    header = header.lstrip(MARK)
    return [clean_header(name) for name in (header.split(",") if "," in header else header.split())]


def read_by_name(spark: SparkSession, path: str, headers: Listed, kinds: Sequence[str]) -> DataFrame:
    """Files of several headers as one table: a column takes the field that the file's own header names so.

    What a file lacks is NULL. Files with date and time and files with datetime agree on `datetime`. Quoted fields may hold
    commas, not line ends.
    """
    places: dict[str, list[str]] = {}
    for header in kinds:
        names = header_names(header)
        found = {name: f"get(_parts, {i})" for i, name in reversed(list(enumerate(names)))}
        if "datetime" not in found and {"date", "time"} <= found.keys():
            found["datetime"] = f"concat_ws(' ', {found.pop('date')}, {found.pop('time')})"
        for name, value in found.items():
            places.setdefault(name, []).append(f"WHEN {text(header)} THEN {value}")
    width = max(len(header_names(header)) for header in kinds)
    struct = ", ".join(f"c{i} STRING" for i in range(width))
    fields = f"from_csv(value, '{struct}')"
    comma = f"array({', '.join(f'_csv.c{i}' for i in range(width))})"
    lines = spark.read.text(path).selectExpr("_metadata.file_path AS file", "value").filter("trim(value) <> ''")
    rows = headers.matched(lines, ["file"]).filter("value <> header")
    rows = rows.selectExpr("header", "value", f"CASE WHEN instr(header, ',') > 0 THEN {fields} END AS _csv")
    rows = rows.selectExpr("header", f"CASE WHEN _csv IS NOT NULL THEN {comma} ELSE split(trim(value), '\\\\s+') END AS _parts")
    return rows.selectExpr(*[f"CASE header {' '.join(cases)} END AS {q(name)}" for name, cases in places.items()])


def split_lines(lines: DataFrame, header: str) -> DataFrame:
    """Blank-separated lines of a `value` column to string columns; header lines are dropped."""
    names = [clean_header(name) for name in header.split()]
    rows = lines.filter(f"trim(value) <> '' AND value <> {text(header)}")
    words = r"split(lower(trim(value)), '\\s+')"
    other = f"array_sort({words}) = array({', '.join(text(w) for w in sorted(header.lower().split()))})"
    checked = f"CASE WHEN {other} THEN raise_error(concat('Another order of columns: ', value)) ELSE value END"
    parts = rows.selectExpr(f"{checked} AS value").selectExpr("split(trim(value), '\\\\s+') AS _parts")
    return parts.selectExpr(*[f"get(_parts, {i}) AS {q(name)}" for i, name in enumerate(names)])


def type_bars(raw: DataFrame, series_columns: Sequence[str] = ("series",), layouts: str = "first") -> DataFrame:
    """String columns to a bar table: `datetime` is built, series columns stay, the rest turn numeric.

    `datetime` wins over `date` and `time`, which are dropped when they are joined. With `layouts` "first" the first row
    tells how times are written and others are NULL; with "each" every row is read in its own layout.
    """
    if layouts not in ("first", "each"):
        raise ValueError(f"layouts must be 'first' or 'each', not {layouts!r}")
    columns, value = raw.columns, time_value(raw.columns)
    dropped = set() if "datetime" in columns else {"date", "time"}
    if layouts == "each":
        stamp = f"{parse_any_time(value)} AS datetime"
    else:
        first = raw.selectExpr(f"{value} AS first").head(1)
        stamp = f"{parse_time(value, first[0]['first'] if first else None)} AS datetime"
    out = []
    for name in columns:
        if name == "datetime":
            out.append(stamp)
        elif name in series_columns:
            out.append(q(name))
        elif name not in dropped:
            out.append(f"{number_or_null(q(name))} AS {q(name)}")
    return raw.selectExpr(*out) if "datetime" in columns else raw.selectExpr(*out, stamp)


def read_bars(
    spark: SparkSession,
    path: str,
    *,
    required: Sequence[str] = REQUIRED,
    series: str = "bars",
    series_columns: Sequence[str] = ("series",),
    check: bool = True,
    layouts: str = "first",
) -> DataFrame:
    """Bar table from text files, checked; without a series column all rows form one series.

    Rows carry no order: operators sort by series and time themselves.
    """
    df = type_bars(read_text(spark, path), series_columns, layouts)
    if check:
        check_bars(df, required)
    if not any(name in df.columns for name in series_columns):
        df = df.selectExpr(f"{text(series)} AS series", "*")
    return df
