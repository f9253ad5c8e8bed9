"""Equal rows, merged into one row with a count and expanded again.

Copies of one row cannot be told apart by any key, so they cannot be split over blocks. They are merged
before they are shuffled, which Spark does map-side, and written out again from several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 100_000  # copies one task writes at a time


def merge_copies(df: DataFrame) -> DataFrame:
    """Distinct rows with the number of copies as `_times`."""
    return df.groupBy(*df.columns).agg(F.expr("count(1) AS _times"))


def expand_copies(df: DataFrame) -> DataFrame:
    """Each row `_times` times, numbered from 1 in `_copy`; rows with `_times` = 0 vanish."""
    chunks = df.filter("_times > 0").selectExpr(
        "*", f"explode(sequence(0L, (_times - 1) DIV {CHUNK}L)) AS _chunk"
    )
    first, last = f"_chunk * {CHUNK} + 1", f"least(_times, (_chunk + 1) * {CHUNK})"
    # The chunk alone would send all rows with few copies to one task. The number is given, as Spark would otherwise
    # merge partitions that look small before the rows are multiplied.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = chunks.repartition(tasks, F.xxhash64(*df.columns), "_chunk").selectExpr("*", f"explode(sequence({first}, {last})) AS _copy")
    return numbered.drop("_chunk")
