"""Structured run logs: `time | level | logger | event | key=value | ...`, one file per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.operators.ranking import best_per_group

PREVIEW_LINES = 12
BLANK = "' \\t\\r\\n'"


def plain_part(part: str) -> str:
    """SQL text: a part of a path, which may be a partition column=value, as the value."""
    value = f"regexp_replace({part}, '^(run_id|artifact)=', '')"
    return f"CASE WHEN {part} LIKE '%=%' THEN url_decode(replace({value}, '+', '%2B')) ELSE {part} END"


def places_of(root: str, artifact: str) -> str:
    """Glob of an artifact of all runs, in both layouts."""
    return f"{root}/*/{{{artifact},artifact={artifact}}}"


def run_of(path: str, artifact: str) -> str:
    """SQL text: run id in a file path <root>/<run_id>/<artifact>, be the artifact a file or a folder.

    Both parts may come as partitions, run_id=.../artifact=..., the layout of many runs written at once. `path` is a
    file's URI, as file metadata has it.
    """
    plain = f"url_decode(replace({path}, '+', '%2B'))"
    return plain_part(f"regexp_extract({plain}, '([^/]+)/(artifact=)?{artifact}(/[^/]+)?$', 1)")


def read_log_lines(spark: SparkSession, root: str, name: str = "logs.txt") -> DataFrame:
    """Lines of all run logs as (run_id, line_no, line).

    `line_no` orders the lines of a run and may have gaps: the position of the file part, then of the
    line in it. Files are read line by line, so a log of any size is split over tasks.
    """
    lines = spark.read.text(places_of(root, name))
    return lines.selectExpr(
        f"{run_of('_metadata.file_path', name)} AS run_id",
        "struct(_metadata.file_path AS file, _metadata.file_block_start AS part, "
        "monotonically_increasing_id() AS row) AS line_no",
        "rtrim('\\r\\n', value) AS line",
    )


def parse_log(lines: DataFrame) -> DataFrame:
    """Last line of each event as (run_id, event, split, kv).

    Lines need four parts and at least one key=value part; a repeated key keeps its last value.
    Lines of split_summary are kept apart by their `split` value.
    """
    fields = lines.selectExpr(
        "run_id", "line_no", f"transform(split(line, '\\\\|'), x -> btrim(x, {BLANK})) AS _parts"
    ).filter("size(_parts) >= 4")
    pairs = (
        "transform(filter(slice(_parts, 5, size(_parts)), x -> instr(x, '=') > 0), x -> struct("
        f"btrim(substring_index(x, '=', 1), {BLANK}) AS key, "
        f"btrim(substr(x, instr(x, '=') + 1), {BLANK}) AS value))"
    )
    last = "filter(_kv, (x, i) -> NOT exists(slice(_kv, i + 2, size(_kv)), y -> y.key = x.key))"
    events = (
        fields.selectExpr("run_id", "line_no", "get(_parts, 3) AS event", f"{pairs} AS _kv")
        .filter("size(_kv) > 0")
        .selectExpr("run_id", "line_no", "event", f"map_from_entries({last}) AS kv")
        .selectExpr("*", "CASE WHEN event = 'split_summary' THEN nullif(kv['split'], '') END AS split")
    )
    return events.groupBy("run_id", "event", "split").agg(F.expr("max_by(kv, line_no) AS kv"))


def log_value(key: str, kind: str) -> str:
    """SQL text: value of `kv` under a key as BIGINT, DOUBLE, TIMESTAMP_NTZ, STRING, or list / counts.

    `None` becomes NULL. `list` reads ['a', 'b']; `counts` reads {0: 180, 1: 30}.
    """
    raw = f"nullif(kv['{key}'], 'None')"
    if kind == "list":
        return f"regexp_extract_all({raw}, '\\'([^\\']*)\\'', 1)"
    if kind == "counts":
        pairs = f"nullif(regexp_replace({raw}, '[{{}} ]', ''), '')"
        return (
            f"transform_values(transform_keys(str_to_map({pairs}, ',', ':'), "
            "(k, v) -> try_cast(k AS INT)), (k, v) -> try_cast(v AS BIGINT))"
        )
    return raw if kind == "STRING" else f"try_cast({raw} AS {kind})"


def log_preview(lines: DataFrame, n: int = PREVIEW_LINES) -> DataFrame:
    """First n lines of each run."""
    return best_per_group(lines, n, ["run_id"], ["line_no"]).selectExpr(
        "run_id", "rank AS line_rank", "line"
    )
