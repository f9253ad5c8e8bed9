from datetime import datetime, timedelta

import pytest

from candlewick.run_queries import run_comparison, run_detail

# A run of 8 or 10 complete bars has all artifacts, one of 6 lacks its config, one of 9 its config and importances.
WARM_UP = 27 + 5  # bars that get no features or no label
START = datetime(2024, 1, 17, 21)  # of 32 + n bars, the first complete one is the last of the training fold


def events(spark, path, **bars):
    """Two ticks an hour for each series, whose number of complete bars is given."""
    rows = [
        (name, START + timedelta(hours=h, minutes=30 * half), 10.0 + (7 * h + 3 * half + len(name) * h * h) % 11)
        for name, n in bars.items()
        for h in range(WARM_UP + n)
        for half in (0, 1)
    ]
    df = spark.createDataFrame(rows, "event_type STRING, ts TIMESTAMP_NTZ, value DOUBLE")
    df.selectExpr("monotonically_increasing_id() AS event_id", "*").write.parquet(f"{path}/events.parquet")
    return str(path)


def run_of(series):
    return f"{series}_m1_2024-01-11_2300"


FEATURES = {"atr_14", "atr_28", "ret_3", "ret_6", "range_ratio"}


def views(rows):
    return {(r["view"], r["item"]): (r["left_value"], r["right_value"]) for r in rows}


@pytest.mark.parametrize("bars", [{"odd": 9}, {"odd": 9, "unset": 6}])
def test_comparison_has_no_rows_if_no_run_is_complete(spark, tmp_path, bars):
    found = run_comparison(spark, events(spark, tmp_path, **bars))
    assert found.dtypes == [("view", "string"), ("item", "string"), ("left_value", "double"), ("right_value", "double")]
    assert found.collect() == []


def test_only_complete_run_is_compared_with_none(spark, tmp_path):
    found = run_comparison(spark, events(spark, tmp_path, one=8, odd=9)).collect()
    by = views(found)
    assert len(by) == len(found) and {item for view, item in by if view == "importance"} == FEATURES
    assert by["rows", run_of("one")] == (7, None) and [item for view, item in by if view == "rows"] == [run_of("one")]
    assert all(right is None for _, right in by.values()) and all(by["importance", f][0] is not None for f in FEATURES)


def test_two_newest_runs_are_compared(spark, tmp_path):
    by = views(run_comparison(spark, events(spark, tmp_path, one=8, three=10, odd=9)).collect())
    assert by["rows", run_of("three")] == (9, None) and by["rows", run_of("one")] == (None, 7)
    assert all(None not in by["importance", f] for f in FEATURES)


@pytest.mark.parametrize("bars", [{"odd": 9}, {"odd": 9, "unset": 6}])
def test_detail_has_no_rows_if_no_run_is_complete(spark, tmp_path, bars):
    found = run_detail(spark, events(spark, tmp_path, **bars))
    assert found.dtypes == [("view", "string"), ("item", "string"), ("value", "double"), ("run_id", "string")]
    assert found.collect() == []


def test_detail_of_the_newest_complete_run(spark, tmp_path):
    found = run_detail(spark, events(spark, tmp_path, one=8, odd=9))
    assert found.dtypes == [("view", "string"), ("item", "string"), ("value", "double"), ("run_id", "string")]
    rows = found.collect()
    assert {r["run_id"] for r in rows} == {run_of("one")}
    assert {r["item"] for r in rows if r["view"] == "importance"} == FEATURES
    assert [r["value"] for r in rows if (r["view"], r["item"]) == ("summary", "val_rows")] == [7]
