import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from candlewick.llm import jaccard_join, language_id, lm_scoring, quality_classifier
from candlewick.llm.html_extraction import Page, content, extracted, train
from texts import ODD, frame, prose, rows, words


def katz(pairs, held):
    """Log probabilities of a dictionary-based Katz model."""
    tokens = {i: [*words(t), "</s>"] for i, t in pairs}
    learnt = [tokens[i] for i in tokens if not held(i)]
    ones = Counter(w for t in learnt for w in t)
    twos = Counter(p for t in learnt for p in zip(["<s>", *t], t))
    stats = lambda c: np.array([sum(c.values()), len(c), *(sum(v == r for v in c.values()) for r in range(1, 7))])
    u, d = lm_scoring.Unigrams(stats(ones)), lm_scoring.discounts(stats(twos))
    p = lambda w: float(u(np.array([ones.get(w, 0)]))[0])
    follow = defaultdict(list)
    for (h, w), r in twos.items():
        follow[h].append((w, r))

    def alpha(h):
        times = sum(r for _, r in follow[h])
        kept = sum(r * (d[r] if r <= 5 else 1) for _, r in follow[h])
        size = times if times - kept > 1e-9 * times else times + 1
        return size, (1 - kept / size) / (1 - sum(p(w) for w, _ in follow[h]))

    def probability(h, w):
        if r := twos.get((h, w), 0):
            return r * (d[r] if r <= 5 else 1) / alpha(h)[0]
        return alpha(h)[1] * p(w) if h in follow else p(w)

    return tokens, ones, probability, u, follow


@pytest.mark.parametrize("hot", [1000, 20])
def test_katz_scores_against_brute_force(spark, small_blocks, monkeypatch, hot):
    monkeypatch.setattr(lm_scoring, "HOT_SHARE", hot)
    pairs = rows(n=60)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens, ones, probability, unigrams, follow = katz(pairs, held)
    total, kinds = sum(ones.values()), len(ones)
    df = frame(spark, pairs)
    got = lm_scoring.scored(df, "crc32(cast(cast(doc_id as string) as binary)) % 7 = 2").collect()
    assert len(got) == len(pairs)
    for r in got:
        t = tokens[r["doc_id"]]
        assert r["held_out"] == held(r["doc_id"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in ones for w in t), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((ones.get(w, 0) + 1) / (total + kinds + 1)) for w in t))
        assert r["score"] == pytest.approx(sum(math.log10(probability(h, w)) for h, w in zip(["<s>", *t], t)))
    for h in ["<s>", *list(follow)[:20], "never seen"]:
        mass = sum(probability(h, w) for w in ones) + probability(h, "unknown word")
        assert mass == pytest.approx(1)


@pytest.mark.parametrize("blocks", [2, 7, 1000])
def test_katz_scores_do_not_depend_on_the_blocks(spark, monkeypatch, blocks):
    """With far more ranges than words most ranges are asked nothing and have no row."""
    monkeypatch.setattr(lm_scoring, "HOT_SHARE", 20)
    df = frame(spark, rows(n=25))
    result = lambda: sorted((r["doc_id"], r["n_known"], r["base_score"], round(r["score"], 9)) for r in lm_scoring.scored(df, "doc_id % 4 = 0").collect())
    want = result()
    monkeypatch.setattr(lm_scoring, "blocks", lambda *a, **k: blocks)
    assert result() == want


def test_messages_are_bounded_by_the_words_of_a_block():
    texts = ["a b c a b", "b c d", None]
    docs = pa.table({"block": pa.array([5] * 3, pa.int32()), "text": texts, "held_out": [False, True, False]})
    for ranges in (1, 3, 10**6):
        asked = lm_scoring._ask_words(ranges)(docs)
        assert 1 <= len(asked) <= min(ranges, 5)
        answers = pa.concat_tables([lm_scoring._answer_words(ranges)(asked.slice(i, 1)) for i in range(len(asked))])
        assert len(lm_scoring._ask_pairs(ranges)(docs, answers)) <= 10
        assert len(jaccard_join._ask(1, ranges)(docs)) <= min(ranges, 4)


def test_katz_edge_cases(spark):
    df = frame(spark, [])
    assert lm_scoring.scored(df, "false").count() == 0
    one = lm_scoring.scored(frame(spark, [(1, None), (None, "a a"), (1, None)]), "false").collect()
    assert sorted(r["n_tokens"] for r in one) == [1, 1, 3]
    assert all(math.isfinite(r["score"]) for r in one)
    none = lm_scoring.scored(frame(spark, [(1, "a b")]), "true").head()
    assert (none["n_known"], none["train_tokens"]) == (0, 0)


def labelled(spark, n=300):
    rng = random.Random(2)
    data = []
    for i in range(n):
        text = prose(rng, rng.randint(20, 60))
        data.append((i, text if i % 3 else " ".join(w + "%%%" if rng.random() < 0.7 else w for w in text.split()), int(i % 3 > 0)))
    return data


def test_quality_classifier_on_rows_not_learnt(spark):
    data = labelled(spark)
    df = spark.createDataFrame(data, "doc_id long, text string, quality int")
    weights = quality_classifier.train(df.filter("doc_id < 200"), "text", "quality")
    odd = spark.createDataFrame([(1000 + i, t, None) for i, t in enumerate(ODD)], df.schema)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.scored(df.unionAll(odd), weights, ["doc_id"]).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert got[1000] == got[1001] == got[1002]  # null, empty and blank texts
    right = [(got[i] >= 0.3) == bool(y) for i, _, y in data if i >= 200]
    assert sum(right) >= 0.95 * len(right)
    again = quality_classifier.train(df.filter("doc_id < 200"), "text", "quality")
    assert (weights == again).all()


def test_quality_classifier_without_labels(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, None, 7)], "doc_id long, text string, quality int")
    weights = quality_classifier.train(df, "text", "quality")
    assert [r["score"] for r in quality_classifier.scored(df, weights, ["doc_id"]).collect()] == [0.5, 0.5]
    assert quality_classifier.scored(df.limit(0), weights, ["doc_id"]).count() == 0


def test_codes_separate_languages():
    for n in range(1, 30):
        m = language_id.code(n).astype(int)
        gaps = [(m[i] != m[j]).sum() for i in range(n) for j in range(i)]
        assert m.shape[0] == n
        assert not gaps or min(gaps) >= (1 if n == 2 else 2)


@pytest.mark.parametrize("names", [["xa", "yb"], ["xa", "yb", "zc"], [f"{a}{b}" for a in "pqr" for b in "uvw"]])
def test_language_id(spark, names):
    rng = random.Random(4)
    make = lambda k: " ".join(names[k] * rng.randint(1, 3) + rng.choice("aeiou") for _ in range(rng.randint(5, 40)))
    data = [(i, make(i % len(names)), names[i % len(names)]) for i in range(40 * len(names))]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language_id.train(df.filter("doc_id % 4 > 0"))
    odd = spark.createDataFrame([(10_000 + i, t, None) for i, t in enumerate([None, "", "12 %%", names[0] * 4])], df.schema)
    got = {r["doc_id"]: r for r in language_id.predicted(df.unionAll(odd), model, ["doc_id"]).collect()}
    right = [got[i]["lang_pred"] == lang for i, _, lang in data if i % 4 == 0]
    assert sum(right) >= 0.95 * len(right)
    assert [got[10_000 + i]["lang_pred"] for i in range(4)] == ["und"] * 3 + [names[0]]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_with_nothing_or_one_language(spark):
    df = frame(spark, [(2, "text"), (4, None)])
    assert language_id.train(df) is None
    assert {r["lang_pred"] for r in language_id.predicted(df, None, ["doc_id"]).collect()} == {"und"}
    one = language_id.train(frame(spark, [(1, "text")]))
    assert {r["lang_pred"] for r in language_id.predicted(df, one, ["doc_id"]).collect()} == {"en", "und"}


PAGE = (
    '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Menu</a>'
    '<li><a href=/b>more</a></ul></nav><!-- x --><div class="ad">Buy now, really.</div><article><h1>Head {i}</h1><p><b>First'
    ' &lt;part&gt; of {i},\n it goes  on.<br><p>{body}</p></article><footer>&copy; me</footer></body></html>'
)
OTHER = (
    '<body><header>Site</header><main><p>Kept&nbsp;text.</p><div class="share-box">Share</div><ul><li>one<li>two</ul>'
    '<section id=comments><p>Nice post!</p></section></main><aside>Side</aside><form><label>Mail</label></form>'
    '<script>var t="</p>";</script><p hidden>no</p>'
)


def test_pages(spark):
    rng = random.Random(1)
    bodies = [prose(rng, rng.randint(1, 80)) for _ in range(60)]
    pages = [(i, f"u{i}", PAGE.replace("{i}", str(i)).replace("{body}", b), "own") for i, b in enumerate(bodies)]
    pages += [(100, "v", OTHER, ""), (101, None, None, ""), (102, "w", "", ""), (103, "x", "a &amp; b <", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    model = train(df.filter("page_id < 100"))
    got = {r["page_id"]: r for r in extracted(df, model, ["page_id", "url"]).collect()}
    for i, body in enumerate(bodies):
        want = f"Head {i}\n\nFirst <part> of {i}, it goes on.\n\n{' '.join(body.split())}"
        assert (got[i]["text"], got[i]["n_chars"]) == (want, len(want))
    assert got[100]["text"] == "Kept text.\n\none\n\ntwo"
    assert (got[101]["text"], got[102]["text"], got[103]["text"]) == ("", "", "a & b <")
    assert train(df.limit(0)) == []
    assert extracted(df.limit(0), [], ["page_id"]).count() == 0


def test_dropped_nodes_take_their_content_along():
    page = Page("<div><div class=ad><p>One</p><p>Two</p></div><p>Three</p></div>")
    p = np.array([0.9, 0.9, 0.1, 0.99, 0.99, 0.9])
    assert page.text(p) == "Three"
    assert Page("<p>a<p>b</div></p>c").text(np.full(9, 0.9)[: len(Page("<p>a<p>b</div></p>c").nodes)]) == "a\n\nb\n\nc"
    assert content(np.zeros((2, 15)), []).tolist() == [0.75, 0.75]


def test_long_pages_are_kept_whole(spark):
    rng = random.Random(3)
    learnt = [(i, PAGE.replace("{i}", str(i)).replace("{body}", prose(rng, rng.randint(1, 80)))) for i in range(60)]
    bodies = {n: [f"{k} {prose(rng, 12)}" for k in range(n)] for n in (10, 1_000, 50_000)}
    wide = [(n, PAGE.replace("{i}", "0").replace("{body}", "</p><p>".join(b))) for n, b in bodies.items()]
    schema = "page_id long, html string"
    model = train(spark.createDataFrame(learnt, schema))
    got = {r["page_id"]: r["text"] for r in extracted(spark.createDataFrame(wide, schema), model, ["page_id"]).collect()}
    for n, body in bodies.items():
        assert got[n] == "\n\n".join(["Head 0", "First <part> of 0, it goes on.", *body])
    page = Page("<div>" + "<p>x</p>" * 1_000 + "</div>")
    assert page.text(np.full(len(page.nodes), 0.982)).count("x") == 1_000


RAW_PARTS = (
    "<script>for(i=0;i<n;i++){f(i);}</script>", "<SCRIPT>if(a<b)x='</p>'</Script >", "<script>s='<!-- ';t=\"it's\"</script>",
    "<style>a::after{content:'<?'}</style>", "<textarea>1 <b and \"</textarea>", "<svg><text>x<y</text></svg>", "<svg/>",
)


@pytest.mark.parametrize("raw", [*RAW_PARTS, "".join(RAW_PARTS)])
def test_raw_elements_end_at_their_own_end(raw):
    for source in (
        f"<body>{raw}<article><p>One</p>{raw}<p>Two</p></article>",
        f"<head>{raw}<script>d='</head><body>'</script></head><body><article><p>One</p><p>Two</p></article>",
    ):
        page = Page(source)
        assert page.text(np.ones(len(page.nodes))) == "One\n\nTwo"


def test_boilerplate_by_structure_and_wrappers_by_whole_names(spark):
    rng = random.Random(5)
    bodies = ["</p><p>".join(prose(rng, rng.randint(5, 60)) for _ in range(rng.randint(2, 12))) for _ in range(80)]
    ads = [prose(rng, rng.randint(4, 14)) for _ in bodies]
    learnt = [
        (i, PAGE.replace("{i}", str(i)).replace("{body}", b).replace("Buy now, really.", ad))
        for i, (b, ad) in enumerate(zip(bodies, ads))
    ]
    paragraphs = [prose(rng, 30) for _ in range(8)]
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    menu = "<div class=x1><ul>" + "".join(f"<li><a href=/{k}>Entry {k}</a>" for k in range(6)) + "</ul></div>"
    notice = "<div class=x2>We use small files, as you know.</div>"
    wrappers = ("class='content with-sidebar'", "class=ad-free", "class='overflow-hidden'", "style='overflow: hidden'")
    pages = [f"<body><div {w}>{body}</div></body>" for w in wrappers]
    pages += [f"<body>{menu}<div>{body}</div></body>", f"<body><article>{menu}{body}</article></body>"]
    pages += [f"<body>{notice}<article>{body}</article></body>"]
    pages += [f"<body><div>{body}</div><div {w}>Gone.</div></body>" for w in ("hidden", "style='display:none'", "class='share-box'")]
    schema = "page_id long, html string"
    model = train(spark.createDataFrame(learnt, schema))
    got = extracted(spark.createDataFrame(list(enumerate(pages)), schema), model, ["page_id"]).collect()
    assert {r["page_id"] for r in got if r["text"] != "\n\n".join(paragraphs)} == set()
    short = Page("<body><div>Short note.</div><div>Another one.</div></body>")
    assert short.text(short.judged(content(short.features(), model))) == "Short note.\n\nAnother one."


def _kept(source):
    page = Page(source)
    return page.text(page.judged(np.full(len(page.nodes), 0.9)))


def test_quotation_marks_in_attributes():
    assert _kept("<p data-x=it's>One long text.</p><p>Two.</p><p>They don't stop.</p>") == "One long text.\n\nTwo.\n\nThey don't stop."
    assert _kept('<p title="a>One</p>') == "One"
    assert _kept("<p title='5 > 4' alt=\"x > y\">One</p><p a = 'b'c>Two</p><p \"x\">Three</p>") == "One\n\nTwo\n\nThree"
    assert _kept("<p>One <b and no end") == "One <b and no end"
    assert _kept("<p>One</p> two <!-- never closed <p>Three") == "One\n\ntwo"
    assert _kept("<p>One</p><!-- > <p>gone") == "One"
    assert _kept("1 < 2 and 3 > 2<br>a<b>b</b>") == "1 < 2 and 3 > 2 ab"


def test_names_of_several_words():
    body, thing = "Body text here, with words.", "Thing inside of it."
    page = '<article><p>{}</p><div class="{}"><p>{}</p></div></article>'
    for name in ("entry-comments", "post-comments", "related-posts", "article-ad", "main-nav", "postComments", "post__footer"):
        assert _kept(page.format(body, name, thing)) == body, name
    for name in ("comment-free", "content with-sidebar", "entry-header", "article__body", "post-list", "ad-free", "overflow-hidden"):
        assert _kept(page.format(body, name, thing)) == f"{body}\n\n{thing}", name


@pytest.mark.parametrize(
    "part", ["<i>x", '<p title="a>x</p>', "<p title='it\"s a>x", "<div><i>", "</b>x", "<a href=x>y", "<li><dl><dt>", "<", "<p =", "<!--", "<td>"]
)
def test_malformed_pages_take_linear_time(part):
    began = time.perf_counter()
    _kept(part * 30_000)
    assert time.perf_counter() - began < 10


def test_counts_beyond_32_bits():
    for counts in (np.array([1, 2, (1 << 32) - 1]), np.array([[1, 1 << 32], [5, (1 << 40) + 3]]), np.zeros(0, np.int64)):
        back = lm_scoring.counts_in(lm_scoring.counts_out(counts))
        assert back.tolist() == counts.reshape(-1).tolist()
    assert lm_scoring.counts_in(b"").tolist() == []
    assert lm_scoring.wide(np.array([1 << 32])) is np.uint64 and lm_scoring.wide(np.array([7])) is np.uint32
