"""Similarity join on word n-grams with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their shingle sets reaches a threshold. Shingles are ordered from rare
to frequent. If two sets link, they share at least l shingles among the first n - ceil(t * n) + l of each, n being the
set's size: with longer prefixes a pair must share more before it is verified. Each document chooses its own l by the
estimated cost of its candidates, the document frequencies in its prefix; a pair is judged by the smaller of the two.

The steps:

1. Texts are dealt into blocks of bounded size. Every block asks for the frequencies of its distinct shingles, packed in
   one array per block and range of hashes; the answers come back packed in the same order.
2. A block orders its shingles and emits the prefixes. A shingle of one document only can't meet another, so a document
   whose prefix is made of such ones emits nothing: passages that many documents share stay out of nearly all prefixes.
3. Documents with equal sets form a class, represented by its smallest id.
4. First round: per shingle, each class meets the most central one, whose shingles are the most frequent: the text that
   others are copies of. Verified links form components. Copies of one text end here, however many there are.
5. Second round: only pairs from different components that share enough prefix shingles are verified, and only if their
   sizes, their unshared shingles and what both are known to share with one central class, or to lack, still allow a link. Nothing is
   capped, so no link between components is lost.

Verification intersects the whole sets. Shingles are 64-bit hashes; the order uses 32 bits within a range of hashes, and
a collision there only moves a shingle in the order, alike for all documents.

A null or empty text, or one without words, has an empty set and links with nothing. Rows with equal ids count as one
document. Rows with a null id are returned with a null component and link nothing. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.common import blocked, components, documents, mapped, ship, store
from candlewick.llm.exchange import ranges_of
from candlewick.llm.textarrays import mix, shingles, trimmed, word_hashes
from candlewick.llm.tokens import release

LONGEST = 6  # most shared shingles asked for
VERIFY_COST = 16  # of one candidate, in shingles looked at


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Shared shingles without which a set of n cannot link."""
    return -(-n * percent // 100)


def _sets(texts: pa.Array, size: int):
    """Distinct shingles by text, the sizes, two sums that name a set, and whether a text is the first with its set."""
    hashes, owner, n = word_hashes(texts)
    found, text = shingles(hashes, owner, n, size)
    counts = np.bincount(text, minlength=n)
    sums = []
    for salt in (1, 2):
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(found + np.uint64(salt)))])
        ends = np.cumsum(counts)
        sums.append(running[ends] - running[ends - counts])
    _, first = np.unique(np.stack([*sums, counts.astype(np.uint64)]), axis=1, return_index=True)
    new = np.zeros(n, dtype=bool)
    new[first] = True
    return found, text, counts, sums, new


def _asked(found: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles ascending, their counts, and the ranges of hashes that they are in."""
    values, counts = np.unique(found, return_counts=True)
    return values, counts, ranges_of(values, ranges)


def _ask(size: int, ranges: int):
    @trimmed
    def run(table: pa.Table) -> pa.Table:
        """A row per range that is asked anything: never more than there are shingles, however many the ranges."""
        release()
        found, text, _, _, new = _sets(table.column("text"), size)
        values, counts, of = _asked(found[new[text]], ranges)
        keys = values.astype(np.uint32)
        counts = np.minimum(counts, 65535).astype(np.uint16)
        asked, firsts = np.unique(of, return_index=True)
        cuts = list(zip(firsts, np.append(firsts[1:], len(of))))
        return pa.table(
            {
                "block": pa.array([table.column("block")[0].as_py()] * len(asked), pa.int32()),
                "range": pa.array(asked, pa.int32()),
                "keys": pa.array([keys[a:b].tobytes() for a, b in cuts], pa.binary()),
                "counts": pa.array([counts[a:b].tobytes() for a, b in cuts], pa.binary()),
            }
        )

    return run


@trimmed
def _answer(table: pa.Table) -> pa.Table:
    """Per block, the frequencies over all blocks of what it asked for: a bit where above one, then those."""
    keys = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("keys")]
    counts = [np.frombuffer(x.as_py(), np.uint16) for x in table.column("counts")]
    values, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(values))
    total = np.minimum(total, 2**32 - 1).astype(np.uint32)[inverse]
    masks, more, at = [], [], 0
    for key in keys:
        own = total[at : at + len(key)]
        at += len(key)
        masks.append(np.packbits(own > 1).tobytes())
        more.append(own[own > 1].tobytes())
    return pa.table(
        {
            "block": table.column("block"),
            "range": table.column("range"),
            "mask": pa.array(masks, pa.binary()),
            "more": pa.array(more, pa.binary()),
        }
    )


def _frequencies(answers: pa.Table, of: np.ndarray) -> np.ndarray:
    found = np.ones(len(of), dtype=np.int64)
    for i, mask, more in zip(*(answers.column(c).to_pylist() for c in ("range", "mask", "more"))):
        a, b = np.searchsorted(of, [i, i + 1])
        hit = np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a).astype(bool)
        found[a:b][hit] = np.frombuffer(more, np.uint32)
    return found


PREFIXES = (
    "doc_id {kind}, n long, s1 long, s2 long, unshared long, central double, asks int, "
    "tokens array<long>, levels array<int>, shingles binary"
)


def _prefixes(size: int, ranges: int, percent: int):
    @trimmed
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        release()
        found, text, counts, sums, new = _sets(docs.column("text"), size)
        values, _, of = _asked(found[new[text]], ranges)
        known = _frequencies(answers, of)
        firsts = np.cumsum(counts) - counts
        lengths = counts - needed(counts, percent) + 1  # of the prefix for one shared shingle
        smallest = next(n for n in range(1, 101) if 100 * n >= percent * (n + 1) or n == 100)  # else links are equal sets
        maybe = np.flatnonzero(counts >= smallest)
        # texts whose prefix is not full of shingles of their own
        frequency = known[np.searchsorted(values, found)] if len(values) else np.zeros(0, np.int64)
        own = np.bincount(text[frequency == 1], minlength=len(counts))
        total = np.bincount(text, weights=np.log(frequency), minlength=len(counts))
        maybe = maybe[own[maybe] < lengths[maybe]]
        tokens, levels, sets, asks = ([None] * len(counts) for _ in range(4))
        for i in maybe.tolist():
            mine = found[firsts[i] : firsts[i] + counts[i]]
            often = frequency[firsts[i] : firsts[i] + counts[i]]
            order = np.lexsort((mine, often))[: lengths[i] + LONGEST - 1]
            cost = np.cumsum(often[order] - 1)[lengths[i] - 1 :]
            ask = np.arange(1, len(cost) + 1)
            best = int(np.argmin(cost + VERIFY_COST * cost / ask)) + 1
            order = order[: lengths[i] + best - 1]
            level = np.maximum(1, np.arange(len(order)) - lengths[i] + 2)
            shared = often[order] > 1
            tokens[i], levels[i] = mine[order][shared].view(np.int64), level[shared]
            asks[i], sets[i] = best, mine.tobytes()
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "n": pa.array(counts, pa.int64()),
                "s1": pa.array(sums[0].view(np.int64)),
                "s2": pa.array(sums[1].view(np.int64)),
                "unshared": pa.array(own, pa.int64()),
                "central": pa.array(total / np.maximum(1, counts), pa.float64()),
                "asks": pa.array(asks, pa.int32()),
                "tokens": pa.array(tokens, pa.list_(pa.int64())),
                "levels": pa.array(levels, pa.list_(pa.int32())),
                "shingles": pa.array(sets, pa.binary()),
            }
        )

    return run


def prefixes(df: DataFrame, doc: str, text: str, size: int, percent: int) -> DataFrame:
    ship(df.sparkSession)
    docs, n = blocked(df, doc, text)
    asked = docs.groupBy("block").applyInArrow(
        _ask(size, n), "block int, range int, keys binary, counts binary"
    )
    answers = asked.groupBy("range").applyInArrow(_answer, "block int, range int, mask binary, more binary")
    schema = PREFIXES.format(kind=df.schema[doc].dataType.simpleString())
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_prefixes(size, n, percent), schema)


def _intersect(batches):
    for batch in batches:
        shared, low, high = [], [], []
        for x, y in zip(*(batch.column(c).to_pylist() for c in ("x", "y"))):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            shared.append(int(np.count_nonzero(both[1:] == both[:-1])))
            lacking = np.setdiff1d(y, x, assume_unique=True) >> np.uint64(57)
            bits = np.zeros(128, np.uint8)
            bits[lacking] = 1
            words = np.packbits(bits).view(">i8")
            low.append(int(words[0]))
            high.append(int(words[1]))
        columns = [*batch.select(["a", "b", "na", "nb"]).columns, *(pa.array(v, pa.int64()) for v in (shared, low, high))]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "na", "nb", "shared", "low", "high"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb, shared: the sizes of the sets of each pair and of their intersection; low, high: 128 bits, of which
    each shingle that b has and a lacks sets one."""
    x = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("y"))
    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "x", "y")
    return mapped(both, _intersect, f"a {kind}, b {kind}, na long, nb long, shared long, low long, high long")


def _reached(shared: str, percent: int) -> str:
    return f"100 * ({shared}) >= {percent} * (na + nb - ({shared}))"


def _possible(percent: int) -> str:
    """Whether sizes and unshared shingles of both sides allow a link."""
    return _reached("least(na - ua, nb - ub)", percent)


def _possible_beside(percent: int) -> str:
    """Whether what both sides share with the same central class allows a link: of its set at most the smaller of the two
    intersections, and not what either side lacks; beside it at most what is left without the unshared shingles."""
    outside = [f"greatest(0L, n{s} - o{s} - u{s})" for s in "ab"]
    lacking = "bit_count(xa | xb) + bit_count(ya | yb)"
    most = f"least(oa, ob, za - ({lacking})) + least({outside[0]}, {outside[1]})"
    return f"pa IS NULL OR pb IS NULL OR pa <> pb OR {_reached(most, percent)}"


def links(df: DataFrame, doc: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90):
    """(rows, pairs): `rows` holds doc_id, n_shingles, class (smallest id with the same set); `pairs` verified links
    (a, b) between classes that connect whatever links connect."""
    table = store(prefixes(df, doc, text, size, percent), "prefixes")
    sets = table.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("class"))
    sets = store(sets.filter("n > 0 AND class IS NOT NULL"), "classes")
    rows = table.select("doc_id", "n", "s1", "s2").join(sets, ["n", "s1", "s2"], "left")
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class", "doc_id").alias("class"))
    heads = table.filter("asks IS NOT NULL AND doc_id IS NOT NULL").join(
        sets.withColumnRenamed("class", "doc_id"), ["doc_id", "n", "s1", "s2"], "left_semi"
    )
    # an id that occurs with several texts may stand for several sets; each of them is compared
    heads = store(heads.dropDuplicates(["doc_id", "n", "s1", "s2"]), "heads")
    several = store(heads.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "several")
    posts = heads.select(
        "doc_id", "n", "unshared", "central", "asks", F.inline(F.arrays_zip("tokens", "levels")).alias("token", "level")
    )
    # first round: the most central class of each token
    centre = F.struct((-F.col("central")).alias("far"), "unshared", "n", "doc_id")
    centres = posts.groupBy("token").agg(F.min(centre).alias("c"), F.count("*").alias("k")).filter("k > 1")
    met = (
        posts.select("token", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("unshared").alias("ua"))
        .join(centres.selectExpr("token", "c.doc_id AS b", "c.n AS nb", "c.unshared AS ub", "c.far AS far"), "token")
        .groupBy("a", "b", "na", "nb", "ua", "ub", "far")
        .agg(F.count("*").alias("k"))
    )
    met = store(met, "centres")
    first = store(compared(met.filter("a <> b").select("a", "b"), heads), "compared")
    linked = first.filter(_reached("shared", percent)).select("a", "b")
    known = store(components(linked), "components")
    # what each class shares with the most central class that it met, itself included
    own = met.filter("a = b").selectExpr("a", "b", "nb", "na AS shared", "0L AS low", "0L AS high")
    near = first.select("a", "b", "nb", "shared", "low", "high").unionAll(own)
    near = near.join(met.select("a", "b", "far"), ["a", "b"]).groupBy("a")
    near = near.agg(F.min(F.struct("far", "b", "shared", "nb", "low", "high")).alias("c"))
    near = near.selectExpr(
        "a AS near_id", "c.b AS centre", "c.shared AS overlap", "c.nb AS centre_n", "c.low AS low", "c.high AS high"
    )
    # which set of such an id was met is not known afterwards, so no bound follows from it
    for side in ("near_id", "centre"):
        near = near.join(several.withColumnRenamed("doc_id", side), side, "left_anti")
    # second round: what different components still share
    placed = (
        posts.join(known, posts["doc_id"] == known["node"], "left")
        .join(near, F.col("doc_id") == F.col("near_id"), "left")
        .select(*posts.columns, "centre", "overlap", "centre_n", "low", "high", F.coalesce("component", "doc_id").alias("component"))
    )
    open_tokens = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    open_tokens = open_tokens.filter("lo <> hi").select("token")
    placed = store(placed.join(open_tokens, "token", "left_semi"), "open-posts")
    short = {
        "doc_id": "", "n": "n", "unshared": "u", "asks": "l", "component": "c", "centre": "p", "overlap": "o",
        "centre_n": "z", "low": "x", "high": "y",
    }
    # a pair that links shares a shingle of the shortest prefixes; whether it shares enough of the longer ones is seen
    # from the prefixes themselves
    shortest = placed.filter("level = 1")
    sides = [shortest.select("token", *(F.col(c).alias(x + side) for c, x in short.items())) for side in "ab"]
    pairs = sides[0].join(sides[1], "token").filter("a < b AND ca <> cb")
    pairs = pairs.filter(_possible(percent)).filter(_possible_beside(percent))
    pairs = pairs.select("a", "b", F.expr("least(la, lb) AS ask")).distinct()
    for side in "ab":
        prefix = heads.select(F.col("doc_id").alias(side), F.arrays_zip("tokens", "levels").alias("prefix" + side))
        pairs = pairs.join(prefix, side)
    within = [f"transform(filter(prefix{side}, x -> x.levels <= ask), x -> x.tokens)" for side in "ab"]
    enough = pairs.filter(f"size(array_intersect({within[0]}, {within[1]})) >= ask").select("a", "b").distinct()
    second = compared(enough, heads).filter(_reached("shared", percent)).select("a", "b")
    return rows, store(linked.unionAll(second), "links")


def joined(df: DataFrame, doc: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id reachable by links, of one row per row of `df`."""
    rows, pairs = links(df, doc, text, size, percent)
    # equal ids and equal sets connect as links do
    same = rows.filter("class IS NOT NULL AND doc_id <> class").select(
        F.col("doc_id").alias("a"), F.col("class").alias("b")
    )
    found = components(pairs.unionAll(same))
    return rows.join(found, rows["doc_id"] == found["node"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def one_of_each(df: DataFrame, doc: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `df`, all columns, of the document with the smallest id of each component. Of rows with equal ids one
    stays; rows without an id all stay."""
    found = joined(df, doc, text, size, percent).filter("doc_id = component_id").select(F.col("doc_id").alias(doc))
    stay = df.filter(F.col(doc).isNotNull()).join(store(found.distinct(), "survivors"), doc, "left_semi")
    return stay.dropDuplicates([doc]).unionByName(df.filter(F.col(doc).isNull()))


def op9_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return joined(documents(spark, sf))
