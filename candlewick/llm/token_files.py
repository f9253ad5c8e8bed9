"""Token ids of a corpus in compressed files, in the order of the document ids.

Documents are dealt by ranges of their id and sorted within them; each task turns its texts into ids, appends the end id
to each document and codes runs of about FILE_BYTES of text into files (see `range_coder`). A file is one row of a table
in the shared folder: its number, the ids and token counts of its documents, and the coded bytes. Files are read back one
by one, without a shuffle; only their token counts are added up to know where each file starts in the corpus.

Null and empty texts have the end id alone. Rows with a null id come first. Repeated rows are written each, side by side.
Equal ids are dealt by a hash of their text as well, so that one id with many texts does not fill a task; texts stream
through a task in runs of bounded size. Other columns are ignored. An empty table gives no files and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candlewick.llm import range_coder
from candlewick.llm.common import blocks, documents, mapped, small, store
from candlewick.llm.tokens import encoder, slices, vocabulary_path

END_ID = 0
FILE_BYTES = 24 << 20


def _write(path: str, end_id: int, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, held_bytes = TaskContext.get().partitionId(), 0, [], 0

        def file() -> pa.RecordBatch:
            ids = np.concatenate([x for x, _, _ in held])
            docs = pa.concat_arrays([d for _, _, d in held])
            counts = np.concatenate([c for _, c, _ in held])
            return pa.RecordBatch.from_pydict(
                {
                    "file": pa.array([(part << 32) + number], pa.int64()),
                    "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
                    "counts": pa.array([counts], pa.list_(pa.int64())),
                    "body": pa.array([range_coder.encode(ids)], pa.binary()),
                }
            )

        for batch in batches:
            for a, b in slices(batch.column("text"), 4 << 20):
                rows = batch.slice(a, b - a)
                ids, offsets = encoder(path).encode(rows.column("text"))
                ids = np.insert(ids, offsets[1:], end_id)
                held.append((ids, np.diff(offsets) + 1, rows.column("doc_id")))
                held_bytes += rows.column("text").nbytes
                if held_bytes >= size:
                    yield file()
                    number, held, held_bytes = number + 1, [], 0
        if held:
            yield file()

    return run


def write(
    df: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    path: str | None = None,
    size: int = FILE_BYTES,
) -> DataFrame:
    """The files of a corpus, as a table: file, doc_ids, counts, body; files ascend with the document ids."""
    rows = df.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    dealt = rows.withColumn("_h", F.xxhash64("text"))
    n = blocks(df, text=text, size=size)
    dealt = dealt.repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"file long, doc_ids array<{kind}>, counts array<long>, body binary"
    return store(mapped(dealt, _write(path or vocabulary_path(), end_id, size), schema), "token-files")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            ids = range_coder.decode(batch.column("body")[i].as_py())
            counts = np.array(batch.column("counts")[i].as_py(), dtype=np.int64)
            ends = np.cumsum(counts)
            if len(ids) != (ends[-1] if len(ends) else 0):
                raise ValueError("a token file does not hold what its index says")
            raw = memoryview(ids.astype("<u4").tobytes())
            sums = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
            n = len(counts)
            yield pa.RecordBatch.from_pydict(
                {
                    "file": pa.array([batch.column("file")[i].as_py()] * n, pa.int64()),
                    "doc_id": batch.column("doc_ids")[i].values,
                    "at": pa.array(ends - counts, pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_crc32": pa.array(sums, pa.int64()),
                }
            )


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the decoded files."""
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    found = mapped(files, _read, f"file long, doc_id {kind}, at long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # one number per file
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    starts = files.select("file", total.alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("b"))
    return found.join(small(starts), "file").select("doc_id", (F.col("b") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_output(spark: SparkSession, sf: str) -> DataFrame:
    return read(write(documents(spark, sf)))
