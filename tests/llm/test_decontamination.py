import random

from candlewick.llm import decontamination as d
from texts import frame, prose, rows, words


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def case(spark, seed=5):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.randint(1, 60), 5000)) for i in range(12)] + [(90, None), (91, ""), (92, "a b"), (93, "a b")]
    docs = rows(seed)
    for i, (_, text) in enumerate(items[:8]):
        w = words(text, lower=False)
        if i % 2:
            w[len(w) // 2] = "changed"
        docs.append((1000 + i, prose(rng, 300) + " " + " ".join(w) + " " + prose(rng, 40)))
    docs += [(2000, "a b"), (2001, "a b c"), (None, items[3][1]), (1003, docs[-1][1])]
    return docs, items


def test_leaks_against_brute_force(spark):
    docs, items = case(spark)
    found = d.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"], r["body"] is not None): (r["n_shingles"], r["n_found"]) for r in found}
    want = {}
    for i, text in docs:
        for k, item in items:
            n = len(grams(text) & grams(item))
            if grams(item) and n >= 0.8 * len(grams(item)):
                want[i, k, True] = (len(grams(item)), n)
    assert got == want
    assert len(want) > 8


def test_decontaminated_keeps_all_columns_and_clean_rows(spark):
    docs, items = case(spark)
    df = frame(spark, docs).withColumn("item", d.F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = d.decontaminated(df, bench)
    assert kept.columns == df.columns
    bad = {i for i, t in docs for _, item in items if grams(item) and len(grams(t) & grams(item)) >= 0.8 * len(grams(item))}
    want = sorted(str((i, t)) for i, t in docs if not any(
        grams(x) and len(grams(t) & grams(x)) >= 0.8 * len(grams(x)) for _, x in items))
    assert sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == want
    assert bad


def test_empty_tables(spark):
    docs, items = case(spark)
    df, bench = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    assert d.leaks(df.limit(0), bench).count() == 0
    assert d.leaks(df, bench.limit(0)).count() == 0
    assert d.decontaminated(df, bench.limit(0)).count() == len(docs)
