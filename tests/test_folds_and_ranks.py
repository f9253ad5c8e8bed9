import math
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from candlewick.operators.copies import expand_copies
from candlewick.operators.evaluation import (
    event_diagnostics,
    event_statistics,
    fold_evaluation,
    nest_precision,
    precision_at_k,
)
from candlewick.operators.folds import (
    check_folds,
    complete_rows,
    expanding_splits,
    fold_summary,
    number_bars,
    time_split,
)
from candlewick.operators.ranking import add_rank
from candlewick.operators.sampling import downsample_negatives, sample_rows, sampling_summary
from helpers import START, linear_bars, same_rows

SPLIT = {"max_rows": 30}


def labelled(spark, values):
    rows = [("bars", START + timedelta(minutes=i), int(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series STRING, datetime TIMESTAMP_NTZ, target_opportunity INT")


def scored(spark, rows=300, seed=3, ties=True):
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        fold = rng.choices(["train", "val", "test"], [8, 1, 1])[0]
        p = rng.choice([0.1, 0.5, 0.5, 0.5, 0.9]) if ties else rng.random()
        data.append((f"s{i % 3}", START + timedelta(minutes=i // 3), fold, p, int(rng.random() < p), i % 2))
    return spark.createDataFrame(
        data,
        "series STRING, datetime TIMESTAMP_NTZ, fold STRING, p_opportunity DOUBLE, "
        "target_opportunity INT, event_odd INT",
    )


def test_split_borders_are_inclusive(spark):
    df = time_split(labelled(spark, [1, 0, 0, 1, 1, 0, 0]), "2023-06-05 09:02", "2023-06-05 09:04")
    assert check_folds(df) == {"train": 3, "val": 2, "test": 2}
    rows = {r["fold"]: r for r in fold_summary(df).collect()}
    assert rows["val"]["rows"] == 2 and rows["val"]["positive_rate"] == 1.0
    with pytest.raises(ValueError, match="before"):
        time_split(df, "2025-01-02", "2025-01-02")
    with pytest.raises(ValueError, match="test"):
        check_folds(df.filter("fold <> 'test'"))


def test_complete_rows_looks_at_all_columns(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (None, 1.0, 0.0), (1.0, 1.0, None)], "a DOUBLE, b DOUBLE, target_opportunity DOUBLE")
    kept = complete_rows(df)
    assert kept.count() == 1 and dict(kept.dtypes)["target_opportunity"] == "int"
    assert complete_rows(df, ["b"]).count() == 3


def test_downsampling_keeps_positives_and_is_exact(spark):
    df = labelled(spark, [1, 1] + [0] * 8)
    out = downsample_negatives(df, 2, 1)
    row = sampling_summary(df, out).head().asDict()
    assert row == {
        "train_rows_before": 10,
        "train_rows_after": 6,
        "positive_before": 2,
        "positive_after": 2,
        "negative_before": 8,
        "negative_after": 4,
    }
    assert downsample_negatives(df, 50).count() == 10
    with pytest.raises(ValueError, match="1 or more"):
        downsample_negatives(df, 0)
    with pytest.raises(ValueError, match="No positive"):
        downsample_negatives(df.filter("target_opportunity = 0"), 2)
    with pytest.raises(ValueError, match="No negative"):
        downsample_negatives(df.filter("target_opportunity = 1"), 2)


@pytest.mark.parametrize("n", [0, 1, 37, 299, 300, 1000])
def test_sample_of_exact_size(spark, n):
    df = scored(spark, 300)
    plain = sample_rows(df, n)
    assert plain.count() == min(n, 300)
    same_rows(plain, sample_rows(df, n, max_rows=1))


def test_sample_among_copies(spark):
    bars = linear_bars(spark, 10)
    copies = bars
    for _ in range(5):
        copies = copies.unionByName(bars)
    assert sample_rows(copies, 25, max_rows=1).count() == 25


def test_rank_and_precision_example(spark):
    rows = [(1, 0.35), (0, 0.6), (1, 0.85), (0, 0.05), (1, 0.5)]
    df = spark.createDataFrame(
        [("a", START + timedelta(minutes=i), "val", p, y) for i, (y, p) in enumerate(rows)],
        "series STRING, datetime TIMESTAMP_NTZ, fold STRING, p_opportunity DOUBLE, target_opportunity INT",
    )
    assert [r["rank_opportunity"] for r in add_rank(df).orderBy("datetime").collect()] == [4, 2, 1, 5, 3]
    for split in ({}, {"max_rows": 7}):
        row = precision_at_k(df, [60], **split).head()
        assert (row["candidate_count"], row["precision_at_k"], row["baseline"]) == (3, 2 / 3, 0.6)


def test_rank_of_copies(spark):
    df = scored(spark, 60)
    copies = df.unionByName(df.limit(1).selectExpr("*", "explode(sequence(1, 300)) AS i").drop("i"))
    cut = add_rank(copies, max_rows=4)
    same_rows(add_rank(copies), cut)
    for split in ({}, {"max_rows": 4}):
        got = precision_at_k(copies, [50], **split).orderBy("fold").collect()
        want = brute_force(copies.collect(), [50])
        assert [r["precision_at_k"] for r in got] == pytest.approx([want[r["fold"], 50.0][2] for r in got])


def brute_force(rows, ks):
    out = {}
    for fold in {r["fold"] for r in rows}:
        part = sorted(
            (r for r in rows if r["fold"] == fold), key=lambda r: (-r["p_opportunity"], r["datetime"], r["series"])
        )
        for k in ks:
            count = max(1, math.ceil(len(part) * (k / 100)))
            top = part[:count]
            out[fold, float(k)] = (
                count,
                count / len(part),
                sum(r["target_opportunity"] for r in top) / len(top),
                sum(r["target_opportunity"] for r in part) / len(part),
            )
    return out


@pytest.mark.parametrize("ties", [True, False])
@pytest.mark.parametrize("split", [{}, {"max_rows": 7}, SPLIT])
def test_precision_against_brute_force(spark, ties, split):
    df = scored(spark, ties=ties)
    ks = [0.5, 1, 7, 33.3, 100, 150]
    want = brute_force(df.collect(), ks)
    got = {
        (r["fold"], r["k_percent"]): (r["candidate_count"], r["candidate_rate"], r["precision_at_k"], r["baseline"])
        for r in precision_at_k(df, ks, **split).collect()
    }
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key])


def test_candidate_count_is_binary(spark):
    df = scored(spark, 700).selectExpr("* EXCEPT (fold)", "'train' AS fold")
    assert precision_at_k(df, [7]).head()["candidate_count"] == 50


@pytest.mark.parametrize("ties", [True, False])
def test_rank_in_cells(spark, ties):
    df = scored(spark, ties=ties)
    same_rows(add_rank(df), add_rank(df, **SPLIT))


def test_rows_without_a_score_rank_last(spark):
    df = scored(spark, 50).selectExpr("* EXCEPT (p_opportunity)", "nullif(p_opportunity, 0.5D) AS p_opportunity")
    same_rows(add_rank(df), add_rank(df, max_rows=3))
    assert add_rank(df).count() == 50


def test_evaluation_and_events(spark):
    df = scored(spark).selectExpr("*", "0 AS event_never")
    folds = fold_evaluation(df, [1, 2])
    assert folds.count() == 6 and "rows" in folds.columns
    stats = event_statistics(df).collect()
    assert {r["event_name"] for r in stats} == {"event_odd"}
    odd = df.filter("event_odd = 1 AND fold = 'train'")
    row = next(r for r in stats if r["fold"] == "train")
    assert row["frequency"] == odd.count()
    diagnostics = event_diagnostics(df, [5, 10])
    want = brute_force(df.filter("event_odd = 1").collect(), [5, 10])
    for r in diagnostics.collect():
        assert r["precision_at_k"] == pytest.approx(want[r["fold"], r["k_percent"]][2])
    nested = nest_precision(diagnostics, ["fold", "event_name"]).head()
    assert [e["k_percent"] for e in nested["precision_at_k"]] == [5.0, 10.0]


def test_expanding_splits(spark):
    df = labelled(spark, [0] * 11)
    for split in ({}, {"max_rows": 2}):
        rows = expanding_splits(df, 3, **split).collect()
        for i in range(3):
            test = sorted(r["position"] for r in rows if r["split"] == i and r["role"] == "test")
            train = sorted(r["position"] for r in rows if r["split"] == i and r["role"] == "train")
            start = 11 - (3 - i) * 2
            assert test == [start, start + 1] and train == list(range(start))
    with pytest.raises(ValueError, match="Cannot make"):
        expanding_splits(df.limit(2), 3)


def untidy(spark):
    """400 rows, a quarter without fold, a third without series, with few different scores."""
    return spark.range(400).selectExpr(
        "CASE WHEN id % 4 <> 0 THEN concat('f', id % 3) END AS fold",
        "CASE WHEN id % 3 <> 0 THEN concat('s', id % 2) END AS series",
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id DIV 2 AS INT)) AS datetime",
        "CAST(id % 7 AS DOUBLE) / 7 AS p_opportunity",
        "CAST(id % 5 = 0 AS INT) AS target_opportunity",
    )


def test_null_groups_keep_their_rows_under_any_split(spark):
    df = untidy(spark)
    for split in ({"max_rows": 9},):
        same_rows(add_rank(df), add_rank(df, **split))
        same_rows(number_bars(df), number_bars(df, **split))
        same_rows(fold_evaluation(df, [1, 10, 50]), fold_evaluation(df, [1, 10, 50], **split))
    assert add_rank(df, max_rows=3).count() == 400
    assert {r["fold"]: r["rows"] for r in fold_evaluation(df, [10], max_rows=3).collect()}[None] == 100


def test_precision_counts_the_rows_that_rank_first(spark):
    tied = spark.range(40).selectExpr(
        "'a' AS series", "'val' AS fold", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS datetime", "0.5D AS p_opportunity",
        "CAST(id % 3 = 0 AS INT) AS target_opportunity", "id",
    )
    for df in (tied, untidy(spark)):
        ranked = add_rank(df).collect()
        for fold in {r["fold"] for r in ranked}:
            rows = [r for r in ranked if r["fold"] == fold]
            n = -(-len(rows) * 25 // 100)
            hits = sum(r["target_opportunity"] for r in rows if r["rank_opportunity"] <= n)
            for split in ({}, {"max_rows": 2}):
                got = precision_at_k(df, [25], **split).filter(F.col("fold").eqNullSafe(fold)).head()
                assert (got["candidate_count"], got["precision_at_k"]) == (n, hits / n)


def test_expected_folds_and_missing_events(spark):
    df = untidy(spark).filter("fold = 'f1'")
    rows = {r["fold"]: r for r in fold_evaluation(df, [10], expected=["f1", "f2"]).collect()}
    assert rows["f1"]["rows"] > 0
    assert rows["f2"][1:] == (10.0, 0, 0.0, 0.0, 0.0, 0)
    assert event_diagnostics(df, [10]).count() == 0
    assert precision_at_k(df, []).count() == 0


def test_copies_are_written_by_many_tasks(spark):
    merged = spark.range(200).selectExpr("id", "1500L AS _times")
    out = expand_copies(merged.repartition(1))
    sizes = out.repartition(16, "id").count(), out.selectExpr("spark_partition_id() AS p").distinct().count()
    assert sizes[0] == 300_000
    assert sizes[1] > 1
