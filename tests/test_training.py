import pytest

from candlewick.operators.features import NOT_FEATURES, column_roles, model_columns, refuse_leaks
from candlewick.operators.folds import fold_report, refuse_empty
from candlewick.plans import training
from candlewick.plans.run_analytics import overview
from candlewick.plans.run_folder import RunFolder, RunStopped
from candlewick.plans.training import STORE, run_training
from candlewick.sinks.run_store import read_store
from candlewick.sources.artifacts import read_runs
from helpers import START, linear_bars


def wave(spark, rows=240):
    return linear_bars(spark, rows).selectExpr(
        "series", "datetime", "open", "high", "low", "40 + pmod(CAST(close * 37 AS INT), 101) / 50.0D AS close"
    )


def settings(tmp_path, **more):
    return {
        "run": {"model": "gbt", "dataset": "wave", "output_dir": str(tmp_path / "runs")},
        "split": {"train_end": "2023-06-05 11:30:00", "val_end": "2023-06-05 12:10:00"},
        "sampling": {"ratio": 2},
        "label": {"horizon_bars": 5, "threshold": 0.02},
        "model": {"max_depth": 2, "n_estimators": 2, "learning_rate": 0.1},
        "features": {"enabled": ["atr_14", "ret_3"]},
        "debug": {"output_dir": str(tmp_path / "debug"), "sample_rows": 5},
        **more,
    }


def plain(document):
    return {k: v for k, v in document.items() if k != "run_id"}


def log_of(spark, tmp_path, run_id):
    return [r["line"].split(" | ")[3:] for r in read_runs(spark, str(tmp_path / "runs")).log_lines.filter(f"run_id = '{run_id}'").orderBy("line_no").collect()]


def test_a_run_is_taken_up_where_it_ended(spark, tmp_path, monkeypatch):
    config, bars = settings(tmp_path), wave(spark)
    whole = run_training(spark, config, bars=bars)
    for step in ("labeled", "model"):
        with pytest.raises(RunStopped) as stopped:
            run_training(spark, config, bars=bars, stop_after=step)
        run_id = str(stopped.value).split(" ")[0]
        assert log_of(spark, tmp_path, run_id)[-1] == ["run_stopped", "error=RunStopped"]
        with pytest.raises(ValueError, match="another config"):
            run_training(spark, {**config, "sampling": {"ratio": 1}}, resume=run_id)
        with monkeypatch.context() as patch:
            patch.setattr(training, "prepare", None)  # the step is finished and must not run again
            if step == "model":
                patch.setattr(training, "train_model", None)
            again = run_training(spark, config, resume=run_id)  # without the bars: they are stored
        assert plain(again) == plain(whole)
        events = [line[0] for line in log_of(spark, tmp_path, run_id)]
        assert events[:2] == ["run_created", "run_resumed"] and events[-1] == "artifacts_saved"
        assert run_training(spark, config, resume=run_id) == again  # finished: nothing is left to do
    stored = read_store(spark, str(tmp_path / "runs" / STORE))
    listed = overview(stored).collect()
    assert len(listed) == 3 and not any(r["reason"] for r in listed)
    files = overview(read_runs(spark, str(tmp_path / "runs"))).collect()
    columns = ("run_id", "position", "feature_count", "val_rows", "test_precision_at_0_5", "top_feature")
    assert [[r[c] for c in columns] for r in files] == [[r[c] for c in columns] for r in listed]
    tables = [f.name for f in (tmp_path / "runs" / whole["run_id"] / "_steps").iterdir() if not f.name.endswith(".json")]
    assert tables == []  # their space is freed


def test_a_failed_run_leaves_its_log(spark, tmp_path):
    config = settings(tmp_path, split={"train_end": "2023-06-05 11:30:00", "val_end": "2030-01-01"})
    with pytest.raises(ValueError, match=r"without rows: \['test'\]"):
        run_training(spark, config, bars=wave(spark))
    run_id = next((tmp_path / "runs").iterdir()).name
    events = [line[0] for line in log_of(spark, tmp_path, run_id)]
    assert events[0] == "run_created" and "labels_created" in events and events[-1] == "run_failed"
    broken = wave(spark).selectExpr("* EXCEPT (low)", "nullif(low, 64.125D) AS low")
    with pytest.raises(ValueError, match="column low"):
        run_training(spark, settings(tmp_path), bars=broken)
    with pytest.raises(ValueError, match="Missing required columns"):
        run_training(spark, settings(tmp_path), bars=wave(spark).drop("high"))


def test_a_step_without_an_entry_is_done_anew(spark, tmp_path):
    folder = RunFolder(spark, str(tmp_path), "r")
    calls = []

    def build():
        calls.append(1)
        return spark.range(10).selectExpr("id", "IF(id = 3, NULL, id) AS x")

    facts = lambda df: {"n": "count(1)", "gaps": "count_if(x IS NULL)", "top": "CAST(max(x) AS STRING)"}
    spark.range(3).write.parquet(str(tmp_path / "r" / "_steps" / "t"))  # what a dead writer left
    rows, found = folder.table("t", build, facts)
    assert rows.count() == 10 and found == {"n": 10, "gaps": 1, "top": "9"}
    late = RunFolder(spark, str(tmp_path), "r")
    rows, again = late.table("t", build, facts)
    assert rows.dtypes == build().dtypes and again == found and late.resumed == ["t"] and len(calls) == 2


def test_guards(spark):
    with pytest.raises(ValueError, match=r"\['train', 'test'\]"):
        refuse_empty({"val": 3, "test": 0})
    with pytest.raises(ValueError, match="p_opportunity"):
        refuse_leaks(["atr_14", "p_opportunity"])
    refuse_leaks(["atr_14"])
    df = linear_bars(spark, 5).selectExpr("*", "1 AS target_opportunity", "'val' AS fold")
    assert set(model_columns(df)).isdisjoint(NOT_FEATURES)
    roles = {r["name"]: r["role"] for r in column_roles(df).collect()}
    assert roles["series"] == "not numeric" and roles["target_opportunity"] == roles["datetime"] == "barred"
    some = {r["name"]: r["role"] for r in column_roles(df.withColumnRenamed("open", "atr_14"), {"features": {}}).collect()}
    assert some["atr_14"] == "feature" and some["close"] == "not enabled"
    assert {(r["fold"], r["rows"], r["empty"]) for r in fold_report(df).collect()} == {("train", 0, True), ("val", 5, False), ("test", 0, True)}
    assert str(START.year) == "2023"
