"""Quality rules as a ledger of bits: every rule is evaluated once, policies are masks over the bits.

`ledger` reads the texts once and keeps, per document, the measurements and a bit per failed rule. `verdicts` applies
a policy (a named, versioned set of rules) and `ablation` tells what each rule of a policy costs, both from the bits
alone, without another look at the texts.

Only DataFrame functions: higher-order functions over the words of one row, no shuffle. A null or empty text has zero
words and fails `few_words`. Repeated rows get equal ledgers. Texts of any length are measured whole; the memory of a
row grows with its text alone. Extra columns pass through if `keep` names them; the measurements win on a name clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: str  # SQL over the measurements


# Bits are never reused: a new rule takes the next one, so old ledgers stay readable.
RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "2 * n_symbols > n_words"),
    Rule("repeated_lines", 3, "10 * n_dup_lines > 3 * n_lines"),
    Rule("long_words", 4, "word_chars > 25 * n_words"),
    Rule("exclamations", 5, "5 * n_exclaims > n_words"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << rule.bit for rule in RULES if rule.name in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STANDARD = Policy("standard", 1, tuple(rule.name for rule in RULES))
LENIENT = Policy("lenient", 1, ("few_words", "repeated_words", "symbols", "repeated_lines"))
POLICIES = (BASE, STANDARD, LENIENT)

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims",
)


def _count(text: str, characters: str) -> F.Column:
    """Occurrences of the characters: what is missing once each is replaced by nothing."""
    rest = F.col(text)
    for character in characters:
        rest = F.replace(rest, F.lit(character), F.lit(""))
    return F.length(text) - F.length(rest)


def _twins(entries: str) -> F.Column:
    """Elements of the sorted array column `entries` of (g, i) whose g equals that of a neighbour."""

    def twin(e, j):
        before, after = F.get(entries, j - 1)["g"], F.get(entries, j + 1)["g"]
        return before.eqNullSafe(e["g"]) | after.eqNullSafe(e["g"])

    return F.filter(entries, twin)


def _sorted(values: F.Column) -> F.Column:
    return F.array_sort(F.transform(values, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))


def measured(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and MEASURES, one row per row of `df`."""
    kept = [c for c in keep if c not in MEASURES]
    words = F.filter(F.split(F.col("_t"), SPACE), lambda w: w != "")
    lines = F.filter(F.split(F.col("_t"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # the columns kept travel as one, so that their names cannot clash with those used here
    whole = F.struct(*kept) if kept else F.struct(F.lit(0).alias("none"))
    first = df.select(whole.alias("_kept"), F.coalesce(F.col(text), F.lit("")).alias("_t")).select(
        "_kept", "_t", words.alias("_w"), lines.alias("_l")
    )
    # windows of three words as hashes; only those with an equal hash elsewhere are compared as words
    index = F.sequence(F.lit(0), F.size("_w") - 3)
    hashes = F.transform(index, lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    second = first.select("*", F.when(F.size("_w") >= 3, hashes).alias("_h"))
    suspects = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), _sorted(F.col("_h")))
    third = second.select("*", suspects.alias("_e")).select("*", _twins("_e").alias("_s"))
    grams = F.transform("_s", lambda e: F.struct(F.slice("_w", e["i"] + 1, 3).alias("g"), e["i"].alias("i")))
    fourth = third.select("*", F.array_sort(grams).alias("_g"))
    at = F.array_sort(F.transform(_twins("_g"), lambda e: e["i"]))
    # positions ascend: each window adds what the one before has not covered, three words at most
    covered = F.aggregate(
        at,
        F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    # A filter on a verdict must stay above the measurements: pushed below, it would repeat them for every rule. Spark
    # pushes no filter below an expression that depends on the partition.
    columns = {
        "n_words": F.size("_w") + 0 * F.spark_partition_id(),
        "word_chars": F.length(F.array_join("_w", "")),
        "n_symbols": _count("_t", SYMBOLS),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size("_l"),
        "n_exclaims": _count("_t", "!"),
    }
    own = [F.col("_kept")[c].alias(c) for c in kept]
    return fourth.select(*own, *(columns[m].cast("long").alias(m) for m in MEASURES))


def ledger(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Measurements and `failed`, a long with one bit per rule that the document fails."""
    bits = [f"CASE WHEN {rule.fails} THEN {1 << rule.bit}L ELSE 0L END" for rule in RULES]
    return measured(df, text, keep).withColumn("failed", F.expr(" | ".join(bits)))


def verdicts(rows: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """`kept`: no rule of the policy fails."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) == 0)


def passing(df: DataFrame, policy: Policy = STANDARD, text: str = "text") -> DataFrame:
    """The rows of `df` that the policy keeps, every column as it was, whatever its name."""
    packed = df.select(F.struct(*df.columns).alias("_row"), F.col(text).alias("text"))
    return verdicts(ledger(packed, keep=["_row"]), policy).filter("kept").select("_row.*")


def ablation(rows: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """Per policy and rule: documents, those the rule rejects, those it alone rejects, those kept without the rule.

    The ledger is first counted by bit pattern, combined map-side: at most 2 ** rules rows are shuffled per task. An
    empty ledger gives no rows.
    """
    spark = rows.sparkSession
    patterns = rows.groupBy("failed").count()
    pairs = [(p.name, p.version, p.mask, r.name, 1 << r.bit) for p in policies for r in RULES if r.name in p.rules]
    rules = spark.createDataFrame(pairs, "policy string, version int, mask long, rule string, bit long")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    one = F.col("failed").bitwiseAND(F.col("bit")) != 0
    others = hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    n = F.col("count")
    # every pattern meets every rule of every policy: both sides are bounded by the number of rules, not by the data
    return (
        patterns.join(F.broadcast(rules), F.col("mask") >= 0)
        .groupBy("policy", "version", "rule")
        .agg(
            F.sum(n).alias("documents"),
            F.sum(F.when(one, n).otherwise(0)).alias("rejected"),
            F.sum(F.when(one & others, n).otherwise(0)).alias("rejected_alone"),
            F.sum(F.when(others, n).otherwise(0)).alias("kept_without"),
        )
    )


def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = verdicts(ledger(spark.read.parquet(f"{sf}/documents.parquet")))
    failed = F.col("failed").bitwiseAND(F.lit(BASE.mask).cast("long")) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "kept", "failed",
    )
