import random

import pytest

from candlewick.plans.run_analytics import compare_runs, default_partner, find_run, overview, run_detail
from candlewick.sinks.artifacts import write_documents
from candlewick.sinks.run_store import TABLES, _fields, read_catalog, read_store, write_runs, write_table
from candlewick.sources.artifacts import RunTables, read_runs, rejected_documents
from candlewick.sources.logs import parse_log

NAMES = ["007", "2024", "2024-01-01", "a b=c:d%+/..", "alpha_m1_2025-02-03_0405", "beta_m1_2025-03-01_0000"]


def runs_of(spark, names, seed=1, events=True, lacking=()):
    """Tables of some runs with numbers drawn from a seed."""
    rng = random.Random(seed)
    at_k = "k_percent DOUBLE, candidate_count BIGINT, candidate_rate DOUBLE, precision_at_k DOUBLE, baseline DOUBLE"

    def frame(rows, schema):
        return spark.createDataFrame(rows, f"run_id STRING, {schema}")

    folds = [(n, f) for n in names for f in ("train", "val", "test")]
    spikes = [(n, f) for n, f in folds if events and f != "train"]
    have = ("metrics.json", "config.yaml", "feature_importance.csv")
    return RunTables(
        runs=frame([(n, ["a", "b"], 10 + i) for i, n in enumerate(names)], "feature_columns ARRAY<STRING>, n_estimators BIGINT"),
        evaluation=frame([(*f, rng.randrange(50, 90), 0.25) for f in folds], "fold STRING, rows BIGINT, baseline DOUBLE"),
        precision=frame([(*f, 0, 0.5, 1, 0.02, rng.random(), 0.25) for f in folds], f"fold STRING, position BIGINT, {at_k}"),
        event_stats=frame([(*f, 0, "event_x", 4, 0.1, rng.random()) for f in spikes], "fold STRING, position BIGINT, event_name STRING, frequency BIGINT, event_rate DOUBLE, trade_rate DOUBLE"),
        event_precision=frame([(*f, "event_x", 0.5, 1, 0.1, rng.random(), 0.2) for f in spikes], f"fold STRING, event_name STRING, {at_k}"),
        importance=frame([(n, i, f, rng.random()) for n in names for i, f in enumerate("ab")], "position BIGINT, feature STRING, importance DOUBLE"),
        artifacts=frame([(n, a) for n in names for a in have if (n, a) not in lacking], "artifact STRING"),
        log_lines=frame([(n, i, f"t | INFO | root | e | k={i}") for n in names for i in range(3)], "line_no BIGINT, line STRING"),
    )


def rows(df):
    return sorted(map(repr, df.collect()))


def test_ids_of_any_shape_come_back_as_they_are(spark, tmp_path):
    root = str(tmp_path / "store")
    write_runs(runs_of(spark, NAMES, lacking={("2024", "config.yaml")}), root)
    back = read_store(spark, root)
    assert sorted(r["run_id"] for r in read_catalog(spark, root).collect()) == sorted(NAMES)
    found = overview(back).collect()
    assert [r["position"] for r in found] == list(range(1, 7))
    stamps = {"alpha_m1_2025-02-03_0405": "2025-02-03 04:05", "beta_m1_2025-03-01_0000": "2025-03-01 00:00"}
    assert [r["run_id"] for r in found] == sorted(NAMES, key=lambda n: (stamps.get(n, n), n), reverse=True)
    assert {r["run_id"]: r["reason"] for r in found if r["reason"]} == {"2024": "missing artifacts: config.yaml"}
    assert {r["skipped_runs"] for r in found} == {1} and [r["feature_count"] for r in found if r["reason"]] == [None]
    for name in NAMES:
        assert read_store(spark, root, name).importance.count() == 2
        assert find_run(read_store(spark, root, name), name).count() == (name != "2024")


def test_tables_survive_the_store(spark, tmp_path):
    tables = runs_of(spark, NAMES[4:])
    write_runs(tables, str(tmp_path))
    back = read_store(spark, str(tmp_path))
    for name in ("evaluation", "precision", "event_stats", "event_precision", "importance", "artifacts"):
        mine = getattr(tables, name)
        assert rows(getattr(back, name).select(mine.columns)) == rows(mine)
    assert rows(parse_log(back.log_lines)) == rows(parse_log(tables.log_lines))
    assert default_partner(back, NAMES[4]) == NAMES[5]
    assert set(compare_runs(back, NAMES[5])) == {"left", "right", "feature_importance", "event_comparison"}


def test_a_run_written_again_replaces_itself_alone(spark, tmp_path):
    root = str(tmp_path)
    write_runs(runs_of(spark, NAMES[:3]), root)
    write_runs(runs_of(spark, NAMES[:3]), root)
    assert read_store(spark, root).precision.count() == 9
    again = runs_of(spark, NAMES[1:2], seed=9, events=False)
    write_runs(again, root)
    back = read_store(spark, root)
    assert back.precision.count() == 9 and read_catalog(spark, root).count() == 3
    assert rows(back.precision.filter("run_id = '2024'").select(again.precision.columns)) == rows(again.precision)
    # the new attempt has no events: those of the old one are gone, though their files were not overwritten
    assert {r["run_id"] for r in back.event_stats.collect()} == {"007", "2024-01-01"}


def test_a_writer_that_dies_changes_nothing_new_readers_rely_on(spark, tmp_path):
    root = str(tmp_path)
    write_table(runs_of(spark, ["x"]).precision, root, "precision", "half done")
    assert read_store(spark, root).precision.count() == 0 and overview(read_store(spark, root)).collect() == []
    write_runs(runs_of(spark, ["y"]), root)
    write_table(runs_of(spark, ["x"]).evaluation, root, "evaluation", "half done")
    assert {r["run_id"] for r in read_store(spark, root).precision.collect()} == {"y"}


def test_looking_up_a_run_opens_its_partition_alone(spark, tmp_path):
    root = str(tmp_path)
    write_runs(runs_of(spark, NAMES), root)
    one = read_store(spark, root, NAMES[4])
    files = {f.split("run_id=")[1].split("/")[0] for f in one.precision.inputFiles()}
    plan = one.precision._jdf.queryExecution().executedPlan().toString()
    assert files == set(map(str, files)) and f"(run_id#" in plan and f"= {NAMES[4]})" in plan
    assert "PartitionFilters: [isnotnull(month" in plan or "PartitionFilters: [isnotnull(run_id" in plan


def test_empty_store_and_unknown_run(spark, tmp_path):
    root = str(tmp_path / "nowhere")
    assert read_catalog(spark, root).collect() == [] and read_store(spark, root).importance.collect() == []
    write_runs(runs_of(spark, ["z"]), root)
    with pytest.raises(LookupError):
        run_detail(read_store(spark, root, "other"), "other")


def test_fields():
    assert [n for n, _ in _fields(TABLES["log_lines"])] == ["line_no", "line"]


def test_documents_of_many_runs_in_one_job(spark, tmp_path):
    root = str(tmp_path / "files")
    body = '{"feature_columns": ["a"], "evaluation": {"val": {"fold": "val", "rows": 3, "baseline": 0.5, "precision_at_k": []}}}'
    good = {"metrics.json": body, "config.yaml": "model: {max_depth: 4}\n", "feature_importance.csv": "feature,importance\nx,0.75\n", "logs.txt": "t | I | r | e | k=1"}
    docs = [(name, a, b) for name in NAMES for a, b in good.items()]
    spoilt = {("007", "metrics.json"): body[:30], ("2024", "metrics.json"): "[1]", ("2024-01-01", "config.yaml"): "a: [", (NAMES[3], "config.yaml"): "7"}
    docs = [(n, a, spoilt.get((n, a), b)) for n, a, b in docs if (n, a) != (NAMES[4], "feature_importance.csv")]
    write_documents(spark.createDataFrame(docs, "run_id STRING, artifact STRING, body STRING"), root)
    found = {(r["run_id"], r["artifact"]): r["problem"] for r in rejected_documents(spark, root).collect()}
    assert found == dict(zip(spoilt, ("not JSON", "not an object", "not YAML", "not a mapping")))
    tables = read_runs(spark, root)
    listing = overview(tables).collect()
    assert len(listing) == 6 and [r["run_id"] for r in listing if not r["reason"]] == [NAMES[5]]
    assert {r["max_depth"] for r in listing} == {None, 4}
    write_runs(tables, f"{root}-stored")
    assert rows(overview(read_store(spark, f"{root}-stored"))) == rows(overview(tables))
