"""Benchmark decontamination: short test items found inside long documents.

Texts become lower-case words between white space; a shingle is five words in a row, or the whole sequence where there
are fewer. An item leaks into a document that holds at least 80 % of the item's distinct shingles.

Items of fewer than five words are not searched inside longer documents: such an item is one shorter shingle, and only a
document of exactly these words has it.

Search: size-partitioned MinHash containment. Items are partitioned by shingle count, each partition spanning a factor
of two. Within a partition an item is represented by its k smallest shingle hashes, k being one more than the number of
shingles that an item of the partition's upper size may lack. So every containing document holds at least one of them,
whatever its own length: the search loses nothing. Candidates are then verified by counting the item's shingles, as
words, in the document.

DataFrame functions only. The documents are never shuffled in the search while the sketches stay below a checked number
of rows; beyond that the same join is shuffled by hash. No pairs of documents arise: rows are (document, item) hits.

Null or empty texts hold nothing and leak nothing. Rows equal in key and text count as one document. Items with equal
texts are reported each. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.common import documents, small, store, table, unused

WORDS = 5
CONTAINMENT = 0.8
SPACE = r"[\x20\x09-\x0D]+"


def _with_words(df: DataFrame, text: str) -> DataFrame:
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE), lambda w: w != "")
    return df.withColumn("_w", words)


def _shingle_starts(words: int) -> F.Column:
    """Positions of the shingles of `_w`; one for a short sequence, none for an empty one."""
    return F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.greatest(F.size("_w") - words, F.lit(0))))


def _hashes(words: int) -> F.Column:
    """One hash per shingle. A missing word of a short sequence is skipped by the hash function."""
    return F.transform(_shingle_starts(words), lambda i: F.xxhash64(*(F.get("_w", i + j) for j in range(words))))


def _shingles(words: int) -> F.Column:
    return F.transform(_shingle_starts(words), lambda i: F.array_join(F.slice("_w", i + 1, words), " "))


def item_shingles(items: DataFrame, item: str, text: str, words: int) -> DataFrame:
    """Distinct shingles of each item with their hash: item, n_shingles, h, shingle."""
    rows = _with_words(items.select(F.col(item).alias("item"), text), text).withColumn("h", _hashes(words))
    pairs = F.array_distinct(F.arrays_zip(F.col("h"), _shingles(words).alias("shingle")))
    rows = rows.select("item", pairs.alias("_s")).dropDuplicates()
    return rows.select("item", F.size("_s").alias("n_shingles"), F.inline("_s").alias("h", "shingle"))


def sketches(shingles: DataFrame, containment: float) -> DataFrame:
    """The k smallest hashes of each item, k fixed by the size partition: h, item."""
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n_shingles"))))  # upper size of the partition
    lacking = F.floor(upper * F.lit(1 - containment) + F.lit(1e-9))
    return (
        shingles.groupBy("item", "n_shingles")
        .agg(F.array_sort(F.collect_set("h")).alias("_h"))
        .select("item", F.explode(F.slice("_h", F.lit(1), (lacking + 1).cast("int"))).alias("h"))
    )


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc: str = "doc_id",
    item: str = "item_id",
    text: str = "text",
    item_text: str = "text",
    words: int = WORDS,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """One row per document and item that it holds: doc, item, n_shingles, n_found, containment."""
    shingles = store(item_shingles(items, item, item_text, words), "item-shingles")
    keyed = docs.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    hashed = _with_words(keyed, "text").select("doc", "body", "_w")
    probes = small(sketches(shingles, containment))
    found = (
        hashed.select("doc", "body", F.explode(_hashes(words)).alias("h"))
        .join(probes, "h")
        .select("doc", "body", "item")
        .distinct()
    )
    candidates = store(found, "leak-candidates")
    suspects = small(candidates.select("doc", "body").distinct())
    # null keys are keys too
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("body") == F.col("_body"))
    texts = keyed.join(suspects.select(F.col("doc").alias("_doc"), F.col("body").alias("_body")), same, "left_semi")
    held = _with_words(texts, "text").select("doc", "body", F.explode(F.array_distinct(_shingles(words))).alias("shingle"))
    wanted = candidates.select(
        F.col("doc").alias("_doc"), F.col("body").alias("_body"), F.col("item").alias("_item")
    )
    hits = held.join(small(shingles), "shingle").select("doc", "body", "item", "n_shingles", "shingle").distinct()
    counted = hits.groupBy("doc", "body", "item", "n_shingles").agg(F.count("*").alias("n_found"))
    verified = counted.filter(F.col("n_found") >= F.lit(containment) * F.col("n_shingles"))
    verified = verified.join(wanted, same & F.col("item").eqNullSafe(F.col("_item")), "left_semi")
    return verified.select(
        F.col("doc").alias(doc), F.col("item").alias(item), F.col("n_shingles").cast("long").alias("n_shingles"),
        "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"), "body",
    )


def decontaminated(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that hold no item, all columns kept."""
    names = [unused(docs, "leak_doc"), unused(docs, "leak_body")]
    found = leaks(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), items).select("doc_id", "body")
    bad = small(store(found.distinct().toDF(*names), "leaking"))
    same = F.col(doc).eqNullSafe(F.col(names[0])) & (F.xxhash64(text) == F.col(names[1]))
    return docs.join(bad, same, "left_anti")


def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = leaks(documents(spark, sf), table(spark, sf, "benchmark", "item_id", "text"))
    return found.select("doc_id", "item_id", "n_shingles", "n_found", "containment").distinct()
