"""Helpers shared by the operators: tables, staged results, sizes."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.textarrays import trim
from candlewick.session import work_dir

# Upper bounds of what may be broadcast.
BROADCAST_ROWS = 100_000
# Text bytes of one block of documents, the unit that a Python task works on.
BLOCK_BYTES = 8 << 20
_shipped: set[str] = set()


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents", "doc_id", "text")


def store(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write `df` to the folder all executors share and read it back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it is shown to have at most `limit` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def text_bytes(df: DataFrame, text: str = "text") -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]


def blocks(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = BLOCK_BYTES) -> int:
    """Number of blocks so that one holds about `size` bytes of text."""
    return max(1, -(-text_bytes(df, text) // size))


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of the column as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they import it and keep their caches."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="candlewick-")  # read again whenever an executor joins
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "candlewick.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for top, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(top, name)
                    archive.write(file, os.path.relpath(file, os.path.dirname(package)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with this package at hand in the workers, which are trimmed after each task."""
    ship(df.sparkSession)

    def run(batches):
        yield from function(batches)
        trim()

    return df.mapInArrow(run, schema)


def blocked(df: DataFrame, doc: str = "doc_id", text: str = "text", size: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """block, doc_id, text, dealt so that a block holds about `size` bytes of text, and the number of blocks.

    The block depends on the row alone: one id or one text that fills much of the table does not fill a block.
    """
    n = blocks(df, text=text, size=size)
    block = F.pmod(F.xxhash64(doc, text), F.lit(n)).cast("int")
    return df.select(block.alias("block"), F.col(doc).alias("doc_id"), F.col(text).alias("text")), n


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, component: the smallest node reachable, for every node of an undirected list of pairs.

    Alternates two kinds of steps until nothing changes: every node hands its smallest neighbour to its larger ones, then
    to its smaller ones. Each step is one grouping; what is known shrinks to a star around each smallest node, so the
    number of steps grows with the logarithm of the longest path. A hot node needs no task of its own: neighbours are
    joined with the minimum of their group, never collected.
    """
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u <> v").distinct()
    pairs = store(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(large.distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small_star = store(moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        # as long as something moves, the sum of what nodes point at falls
        before, after = (
            tuple(x.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()) for x in (pairs, small_star)
        )
        pairs = small_star
        if before == after:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
