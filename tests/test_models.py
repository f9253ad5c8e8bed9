import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.operators.attribution import (
    attribute,
    attribution_importance,
    expected_margin,
    explain_sample,
    shapley,
    tree_leaves,
)
from candlewick.operators.models import feature_importance, log_loss, score, train_model, training_facts
from candlewick.operators.tuning import MAX_COMBINATIONS, grid_points, grid_search
from candlewick.plans.run_analytics import list_runs, run_detail
from candlewick.plans.training import run_training
from candlewick.sources.artifacts import read_runs
from helpers import START

FEATURES = [f"feat_{i}" for i in range(4)]
PARAMS = {"max_depth": 3, "learning_rate": 0.3, "n_estimators": 4, "scale_pos_weight": 2, "random_state": 0}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + 0.3 * rng.standard_normal(300) > 0.8).astype(int)
    data = [("a", i, *map(float, x[i]), int(y[i])) for i in range(300)]
    columns = ", ".join(f"{f} DOUBLE" for f in FEATURES)
    df = spark.createDataFrame(data, f"series STRING, i INT, {columns}, target_opportunity INT")
    start = START.isoformat(sep=" ")
    return df.selectExpr(
        "series", f"TIMESTAMP_NTZ'{start}' + make_dt_interval(0, 0, i) AS datetime", *FEATURES, "target_opportunity"
    ).persist()


@pytest.fixture(scope="module")
def model(rows):
    return train_model(rows, FEATURES, PARAMS)


def test_scores_are_probabilities(rows, model):
    out = score(rows, model)
    assert out.columns == [*rows.columns, "p_opportunity"]
    low, high, count = out.agg(F.min("p_opportunity"), F.max("p_opportunity"), F.count("*")).head()
    assert 0 <= low < high <= 1 and count == 300
    loss = log_loss(out).head()[0]
    assert 0 < loss < 0.7
    facts = training_facts(model, rows, rows)
    assert facts["train_size"] == facts["val_size"] == 300
    assert facts["validation_score"] == pytest.approx(loss) and facts["best_iteration"] is None


def test_importance_sums_to_one(rows, model):
    found = feature_importance(rows, model, FEATURES).orderBy("position").collect()
    values = [r["importance"] for r in found]
    assert sorted(r["feature"] for r in found) == FEATURES
    assert values == sorted(values, reverse=True) and sum(values) == pytest.approx(1)


def test_weights_shift_the_scores(rows):
    means = [
        score(rows, train_model(rows, FEATURES, {**PARAMS, "scale_pos_weight": w})).agg(F.avg("p_opportunity")).head()[0]
        for w in (1, 20)
    ]
    assert means[1] > means[0]


def test_attributions_add_up_to_the_margin(rows, model):
    base = expected_margin(tree_leaves(rows, model))
    phi = attribute(rows, model, FEATURES)
    assert phi.count() == 300 * 4
    total = phi.groupBy("series", "datetime").agg((F.sum("phi") + base).alias("margin"))
    joined = total.join(score(rows, model), ["series", "datetime"])
    worst = joined.agg(F.max(F.abs(F.col("p_opportunity") - 1 / (1 + F.exp(-F.col("margin")))))).head()[0]
    assert worst < 1e-9


def test_shapley_equals_enumeration_of_coalitions(rows, model):
    """Against the definition: average marginal contribution over all orders of the features."""
    leaves = tree_leaves(rows, model)
    x = np.array([list(r) for r in rows.select(*FEATURES).limit(5).collect()])

    def value(row, known):
        total = 0.0
        for leaf, features, lows, highs, shares in leaves:
            for f, low, high, share in zip(features, lows, highs, shares):
                leaf *= float(low < row[f] <= high) if f in known else share
            total += leaf
        return total

    got = shapley(x, leaves)
    for n, row in enumerate(x):
        for f in range(4):
            others = [g for g in range(4) if g != f]
            want = 0.0
            for mask in range(8):
                known = {g for bit, g in enumerate(others) if mask >> bit & 1}
                weight = math.factorial(len(known)) * math.factorial(3 - len(known)) / math.factorial(4)
                want += weight * (value(row, known | {f}) - value(row, known))
            assert got[n, f] == pytest.approx(want, abs=1e-9)


def test_explain_sample(rows, model):
    found = {r["feature"]: r["mean_abs_shap"] for r in explain_sample(rows, model, FEATURES, 20).collect()}
    assert set(found) == set(FEATURES) and all(v >= 0 for v in found.values())
    everything = attribution_importance(attribute(rows, model, FEATURES))
    assert {r["feature"]: r["mean_abs_shap"] for r in everything.collect()} == pytest.approx(
        {r["feature"]: r["mean_abs_shap"] for r in explain_sample(rows, model, FEATURES).collect()}
    )


def test_grid_points():
    assert grid_points({}) == [{}]
    assert grid_points({"b": [1, 2], "a": [3, 4]}) == [
        {"a": 3, "b": 1},
        {"a": 3, "b": 2},
        {"a": 4, "b": 1},
        {"a": 4, "b": 2},
    ]
    with pytest.raises(ValueError, match="Grid too large"):
        grid_points({"max_depth": list(range(MAX_COMBINATIONS + 1))})


def test_grid_search(rows):
    found = grid_search(rows, FEATURES, {"max_depth": [1, 3]}, splits=2, params={**PARAMS, "n_estimators": 2})
    table = found.results.orderBy("rank_test_score").collect()
    assert found.total_combinations == len(table) == 2
    assert json.loads(table[0]["params"]) == found.best_params
    for r in table:
        assert r["mean_test_score"] == pytest.approx((r["split0_test_score"] + r["split1_test_score"]) / 2)
        assert 0 <= r["mean_test_score"] <= 1


def test_window_with_one_class_scores_zero(rows):
    negative = rows.selectExpr("* EXCEPT (target_opportunity)", "0 AS target_opportunity")
    found = grid_search(negative, FEATURES, {"max_depth": [1]}, splits=2, params=PARAMS)
    assert found.results.head()["mean_test_score"] == 0.0 and found.best_params == {"max_depth": 1}


def test_whole_training_run(spark, tmp_path):
    path = tmp_path / "bars.csv"
    lines = ["datetime,open,high,low,close"]
    for i in range(240):
        opened = 40 + (i * 37 % 101) / 50 + (3 if i % 40 > 25 else 0)
        close = 40 + ((i + 1) * 37 % 101) / 50 + (3 if (i + 1) % 40 > 25 else 0)
        reach = 0.125 + (i * 13 % 17) / 40
        lines.append(
            f"2023-06-05 {10 + i // 60:02d}:{i % 60:02d}:00,{opened!r},{max(opened, close) + reach!r},"
            f"{min(opened, close) - reach!r},{close!r}"
        )
    path.write_text("\n".join(lines))
    config = {
        "data": {"path": str(path)},
        "run": {"model": "gbt", "dataset": "itest", "output_dir": str(tmp_path / "runs")},
        "split": {"train_end": "2023-06-05 12:39:00", "val_end": "2023-06-05 13:19:00"},
        "sampling": {"ratio": 2, "random_state": 7},
        "label": {"horizon_bars": 5, "threshold": 0.04},
        "model": {"max_depth": 3, "learning_rate": 0.1, "n_estimators": 3, "scale_pos_weight": 1},
        "evaluation": {"top_k": [0.5, 1]},
        "features": {"enabled": ["atr_14", "ret_3", "event_vol_spike"]},
        "tuning": {"enabled": True, "param_grid": {"max_depth": [2], "n_estimators": [2, 3]}, "cv": 2},
        "shap": {"enabled": True, "sample_size": 25},
        "debug": {"output_dir": str(tmp_path / "debug"), "sample_rows": 10},
    }
    metrics = run_training(spark, config)
    again = run_training(spark, {**config, "tuning": {}, "shap": {}})
    assert again["run_id"] != metrics["run_id"]
    assert metrics["feature_columns"] == ["atr_14", "ret_3", "event_vol_spike"]
    assert set(metrics["shap_importance"]) == set(metrics["feature_columns"])
    assert metrics["tuning"]["total_combinations"] == 2
    assert metrics["evaluation"]["val"]["rows"] == 40
    run_dir = tmp_path / "runs" / metrics["run_id"]
    wanted = ["config.yaml", "metrics.json", "feature_importance.csv", "logs.txt", "model", "best_params.json"]
    for name in [*wanted, "cv_results.csv", "shap/shap_importance.json"]:
        assert (run_dir / name).exists(), name
    assert spark.read.csv(str(tmp_path / "debug" / "df_feat_sample.csv"), header=True).count() == 10

    tables = read_runs(spark, str(tmp_path / "runs"))
    listed = list_runs(tables).collect()
    assert [r["run_id"] for r in listed] == sorted([metrics["run_id"], again["run_id"]], reverse=True)
    detail = run_detail(tables, metrics["run_id"])
    training = detail["training_summary"].head()
    assert training["dataset_rows"] == 240 and training["raw_train_rows"] == 133
    assert training["selected_features"] == metrics["feature_columns"]
    assert [r["rows"] for r in detail["row_funnel"].orderBy("stage_rank").collect()] == [
        133,
        metrics["evaluation"]["train"]["rows"],
        40,
        35,
    ]
    summary = detail["summary"].head()
    assert summary["val_precision_at_0_5"] == metrics["evaluation"]["val"]["precision_at_k"][0]["precision_at_k"]
