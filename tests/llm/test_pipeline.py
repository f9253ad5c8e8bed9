import os
import random

import corpus_pipeline
from pyspark.sql import functions as F
from candlewick.llm.queries import ORACLES, QUERIES
from texts import SCHEMA, frame, prose, rows


def test_queries_are_complete():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert not set(ORACLES) - set(QUERIES)


def test_stages(spark, tmp_path):
    pairs = rows(8, 120) + [(None, None)]
    frame(spark, pairs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, pairs[8][1]), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf, docs = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.store(stage(spark, docs, sf), "test")
        assert [f.dataType for f in out.schema.fields] == [f.dataType for f in docs.schema.fields], name
        assert out.columns == docs.columns
        sizes.append((docs.count(), out.count()))
        docs = out
    assert sizes[0][1] < sizes[0][0] and sizes[1][1] < sizes[1][0]
    assert corpus_pipeline.run(spark, sf).count() >= docs.count()


def test_stages_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert os.path.isdir(tmp_path)


CLASHING = (
    "_t", "_w", "_l", "_e", "_h", "_s", "_g", "_kept", "_row", "_doc", "_body", "leak_doc", "body", "h", "item", "n_words",
    "kept", "failed", "block", "class", "n", "s1", "node", "component", "number", "_number", "length", "piece",
)


def test_stages_leave_columns_of_any_name_alone(spark, tmp_path):
    rng = random.Random(3)
    texts = [prose(rng, 90, 3000) for _ in range(12)]
    texts += [texts[0], "short", None]
    df = frame(spark, list(enumerate(texts)))
    for i, name in enumerate(CLASHING):
        df = df.withColumn(name, F.lit(f"{name} {i}") if i % 2 else F.lit(i))
    spark.createDataFrame([(1, prose(rng, 30, 3000))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {name: f"{name} {i}" if i % 2 else i for i, name in enumerate(CLASHING)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, df, str(tmp_path))
        assert kept.columns == df.columns and kept.dtypes == df.dtypes, name
        rows = kept.collect()
        assert len(rows) >= 10, name
        assert all({c: r[c] for c in CLASHING} == want for r in rows), name
    places = corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path))
    assert places.count() == df.count()
