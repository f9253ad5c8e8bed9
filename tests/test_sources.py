import re
from datetime import datetime

import pytest

from candlewick.operators.quality import check_bars, quality_summary, validation_report
from candlewick.sources.bars import LAYOUTS, layout_report, parse_any_time, parse_time, read_bars, read_text, type_bars
from helpers import linear_bars


def test_blank_separated_file_with_angle_brackets(spark, tmp_path):
    path = tmp_path / "sample.csv"
    path.write_text(
        "<DATE> <TIME> <OPEN> <HIGH> <LOW> <CLOSE> <TICKVOL> <VOL> <SPREAD>\n"
        "2023.11.30 23:58:00 7.25 7.5 7.0 7.375 31 5 2\n"
        "2023.11.30\t23:59:00 7.375  8.0 7.125 7.75 44 0 3\n"
    )
    rows = read_bars(spark, str(path)).orderBy("datetime").collect()
    assert [r["datetime"] for r in rows] == [datetime(2023, 11, 30, 23, 58), datetime(2023, 11, 30, 23, 59)]
    assert rows[0]["close"] == 7.375 and rows[1]["tickvol"] == 44.0
    assert "date" not in rows[0].asDict() and rows[0]["series"] == "bars"


def test_comma_file_keeps_extras_and_turns_text_into_null(spark, tmp_path):
    path = tmp_path / "sample.csv"
    path.write_text(
        " DateTime,Open,High,Low,Close,Extra\n"
        "2025-01-01 00:00:00,1,2,0.5,1.5,abc\n"
        "2025-01-01 00:01:00,1,2,0.5,1e1,1d\n"
    )
    rows = read_bars(spark, str(path)).orderBy("datetime").collect()
    assert [r["close"] for r in rows] == [1.5, 10.0]
    assert [r["extra"] for r in rows] == [None, None]


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_bars(spark, str(tmp_path / "absent.csv"))


def test_rejections(spark):
    bars = linear_bars(spark, 5)
    with pytest.raises(ValueError, match="Missing required columns"):
        check_bars(bars.select("datetime"))
    with pytest.raises(ValueError, match="empty"):
        check_bars(bars.limit(0))
    with pytest.raises(ValueError, match="readable datetime"):
        check_bars(bars.selectExpr("CAST(NULL AS TIMESTAMP_NTZ) AS datetime", "open", "high", "low", "close"))
    with pytest.raises(ValueError, match="column low"):
        check_bars(bars.selectExpr("datetime", "open", "high", "nullif(low, 64.125D) AS low", "close"))
    with pytest.raises(ValueError, match="date and time"):
        type_bars(bars.select("open"))


def test_mixed_time_layouts_are_rejected(spark, tmp_path):
    path = tmp_path / "sample.csv"
    path.write_text(
        "datetime,open,high,low,close\n2025-01-01 00:00:00,1,2,0,1\n2025.01.01 00:01:00,1,2,0,1\n"
    )
    with pytest.raises(ValueError, match="readable datetime"):
        read_bars(spark, str(path))


@pytest.mark.parametrize(
    "value",
    [
        "2025-03-09 02:30:00",  # does not exist on a New York clock
        "2025-03-09T02:30:00",
        "2025.03.09 02:30",
        "2025/03/09 02:30:00",
        "03/09/2025 02:30",
        "20250309 02:30:00",
        "2025-03-09 2:30:00.000000",
    ],
)
def test_time_layouts(spark, value):
    df = spark.createDataFrame([(value,), ("rubbish",)], "t STRING")
    got = [r[0] for r in df.selectExpr(f"{parse_time('t', value)} AS t").collect()]
    assert got == [datetime(2025, 3, 9, 2, 30), None]


def test_date_only(spark):
    df = spark.createDataFrame([("2025-04-01",)], "t STRING")
    assert df.selectExpr(parse_time("t", "2025-04-01")).head()[0] == datetime(2025, 4, 1)


def test_quality_counts_repeated_times_and_gaps(spark):
    bars = linear_bars(spark, 4)
    doubled = bars.unionByName(bars.limit(2)).selectExpr("*", "nullif(close, 65.5D) AS extra")
    row = quality_summary(doubled).head()
    assert (row["rows"], row["missing_values"], row["duplicate_timestamps"]) == (6, 1, 2)
    empty = quality_summary(bars.limit(0)).head()
    assert (empty["rows"], empty["duplicate_timestamps"]) == (0, 0)
    assert {r["rule"] for r in validation_report(bars).collect()} >= {"zero rows", "datetime", "close"}


@pytest.mark.parametrize("sep", [",", " "])
def test_files_with_another_order_of_columns_are_read_by_name(spark, tmp_path, sep):
    for name, header in (("a", "date time open high low close"), ("b", "date time close low high open")):
        row = "2024-03-01 10:00:00 1 2 0.5 1.5" if name == "a" else "2024-03-01 11:00:00 1.5 0.5 2 1"
        (tmp_path / f"{name}.csv").write_text("\n".join(x.replace(" ", sep) for x in (header, row)) + "\n")
    assert read_bars(spark, str(tmp_path / "a.csv"), check=False).count() == 1
    both = read_bars(spark, str(tmp_path / "*.csv")).orderBy("datetime").select("datetime", "open", "high", "low", "close")
    assert [tuple(r) for r in both.collect()] == [(datetime(2024, 3, 1, h), 1.0, 2.0, 0.5, 1.5) for h in (10, 11)]


def test_files_of_all_kinds_together(spark, tmp_path):
    files = {
        "a.csv": "\ufeffDatetime,Open,High,Low,Close,Note\n2024-03-01 10:00:00,1,2,0.5,1.5,\"5,5\"\n",
        "b.csv": "\n<DATE>\t<TIME>\t<CLOSE>\t<LOW>\t<HIGH>\t<OPEN>\n2024.03.01  11:00  1.5 0.5 2 1\n\n2024.03.01 12:00 1.5 0.5 2\n",
        "c.csv": "close,datetime,high,low,open,open\n1.5,03/01/2024 13:00,2,0.5,1,99\nclose,datetime,high,low,open,open\n",
        "empty.csv": "",
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    got = read_bars(spark, str(tmp_path / "*.csv"), check=False, layouts="each").orderBy("datetime")
    rows = [tuple(r) for r in got.select("datetime", "open", "high", "low", "close").collect()]
    assert rows == [(datetime(2024, 3, 1, h), None if h == 12 else 1.0, 2.0, 0.5, 1.5) for h in (10, 11, 12, 13)]
    assert sorted(got.columns) == ["close", "datetime", "high", "low", "note", "open", "series"]


def test_each_row_in_its_own_layout(spark, tmp_path):
    times = ["2025-03-09 02:30:00", "2025.03.09 02:30", "03/09/2025 02:30", "20250309", "2025-03-09T02:30:00.25", "2025-02-30 01:00", "soon", ""]
    path = tmp_path / "sample.csv"
    path.write_text("datetime,open,high,low,close\n" + "".join(f"{t},1,2,0,{i}\n" for i, t in enumerate(times)))
    got = read_bars(spark, str(path), check=False, layouts="each").orderBy("close").collect()
    at = datetime(2025, 3, 9, 2, 30)
    assert [r["datetime"] for r in got] == [at, at, at, datetime(2025, 3, 9), at.replace(microsecond=250_000), None, None, None]
    report = {r["layout"]: (r["rows"], r["unreadable"]) for r in layout_report(read_text(spark, str(path))).collect()}
    assert report == {
        "yyyy-MM-dd HH:mm:ss": (1, 0), "yyyy.MM.dd HH:mm": (1, 0), "MM/dd/yyyy HH:mm": (1, 0), "yyyyMMdd": (1, 0),
        "yyyy-MM-dd HH:mm:ss.S": (1, 0), "yyyy-MM-dd HH:mm": (1, 1), None: (2, 2),
    }
    with pytest.raises(ValueError, match="layouts"):
        read_bars(spark, str(path), layouts="any")


def test_layouts_exclude_each_other(spark):
    for layout in LAYOUTS:
        stamp = datetime(2024, 11, 23, 21, 48, 57)
        sample = layout.name.replace("yyyy", "2024").replace("MM", "11").replace("dd", "23")
        sample = sample.replace("HH", "21").replace("mm", "48").replace("ss", "57").replace(".S", ".125")
        fits = [other.name for other in LAYOUTS if re.match(other.pattern, sample)]
        assert fits == [layout.name]
        df = spark.createDataFrame([(sample,)], "t STRING").selectExpr(f"{parse_any_time('t')} AS a", f"{parse_time('t', sample)} AS b")
        row = df.head()
        assert row["a"] == row["b"] and row["a"].date() == stamp.date()
