"""Main text of web pages: boosted trees judge DOM nodes, a decoding over the tree makes the choices agree.

A page is read into a tree of its block-level elements and of all elements with a class, id or role. Each node has
features: depth, text and its density in the subtree, link density, punctuation, how it compares with its siblings in
length and tag, its place in the page, whether it is a paragraph or the like, whether it is named as content, and whether
it stands outside an article. Gradient-boosted trees, fitted by Spark on the nodes of a bounded sample of TRAIN_PAGES
pages, give the probability that a node is content if its parent is. Labels for the fit come from the pages: elements
that name themselves boilerplate, or stand outside an article, are not content. These names are no features, so the trees
must tell boilerplate by its structure; each example is also shown without the two hints that pages give, and once more
without its tag, at depths that vary by page.

What names itself boilerplate is dropped by its name: an element of such a kind, one with the attribute hidden or
display:none, or one with a whole class, id or role that says so ("share-box", not "with-sidebar") and none that speaks
of content. An article, a main part, or what a whole name calls so, is kept with all above it that names itself nothing
else. A paragraph, list or table, or what is at least half as long as its siblings are on average, is kept too unless most of
it is links:
fixtures of one make cannot teach the trees that such text may go. So boilerplate without a name that comes as bare
paragraphs stays. All other nodes are judged by the trees.

Decoding is hierarchical: what stands in a dropped element is dropped with it, and an element is kept only if all above
are. From the root down, a node below a kept one is kept if it is more likely content than not, given that its parent is;
contradictions between ancestor and descendant cannot arise, and the number of descendants plays no part.

Scripts, styles, comments, the head and markup never count as text. Character references are decoded; white space inside
a block becomes one space; blocks are joined by two line feeds in page order. Null and empty pages have an empty text.
Unclosed and stray tags are tolerated. Pages of any length are read whole, each on its own: nothing is shuffled. Repeated
rows get equal texts. Extra columns are ignored unless `keep` names them. An empty table gives no rows.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.common import mapped, store, table

TRAIN_PAGES = 400
TREES, DEPTH, STEP = 20, 4, 0.3
FEATURES = 13
# features that examples are also shown without, or with others
DEEP, LINKED, RELATIVE, PLACE, LOGS, LENGTHS, TAGS, HINTS = 0, 3, 7, 9, [1, 4], [2, 6], [8, 10], [11, 12]

# Element names of HTML by role, and attribute tokens that name a part of a page.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe noembed noframes xmp svg math object canvas".split())
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
BOILERPLATE_TAGS = set("nav footer aside header form menu dialog button select fieldset search".split())
CONTENT_TAGS = {"article", "main"}
BOILERPLATE_TOKENS = set(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies copyright discussion disqus footer form gdpr header login masthead menu "
    "modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion "
    "recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription tags teaser toc toolbar widget".split()
)
CONTENT_TOKENS = set("article body content entry main post story text".split())
MANY_TOKENS = set("articles entries posts stories".split())  # lists of other pages, if they come with a word of these
OTHER_TOKENS = set("promo promoted recommended related sponsored".split())
# words that leave the meaning of a name as it is
NEUTRAL_TOKENS = set("area bar block box container group inner item items list outer section wrap wrapper".split())
PARAGRAPHS = set(
    "blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr li ol p pre table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY = {  # an open element that ends where one of these begins
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"},
}

# A quotation mark quotes only where a value begins, up to its next like; without one it is an ordinary character. No part
# is tried twice, so the time is linear.
CLOSERS = BLOCK | CLOSED_BY.keys() | {"p"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
NAMING = {"class", "id", "role", "itemprop"}
UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
CAPITAL = re.compile(r"([a-z])([A-Z])")


def names_of(rest: str) -> tuple[list[list[str]], bool]:
    """The names an element bears, each as its words in order, and whether it is hidden."""
    names, hidden = [], False
    for name, *values in ATTRIBUTE.findall(rest):
        name, value = name.lower(), "".join(values)
        if name in NAMING:
            found = (re.findall("[a-z]+", CAPITAL.sub(r"\1 \2", x).lower()) for x in value.split())
            names += [x for x in found if x]
        elif name == "hidden":
            hidden |= value.lower() != "false"
        elif name == "style":
            hidden |= bool(UNSEEN.search(value))
    return names, hidden


def unwanted(name: list[str]) -> bool:
    """Whether a name is one of boilerplate: in all its words, or, among words of content, in the last, which says what the
    thing is (entry-comments, article-ad), or as a list of other pages (related-posts)."""
    words = [word for word in name if word not in NEUTRAL_TOKENS]
    if not words or not all(word in BOILERPLATE_TOKENS or word in CONTENT_TOKENS or word in MANY_TOKENS for word in words):
        return False
    if all(word in BOILERPLATE_TOKENS for word in words) or words[-1] in BOILERPLATE_TOKENS and words[-1] != "header":
        return True
    return words[0] in OTHER_TOKENS


class Node:
    __slots__ = (
        "tag", "parent", "children", "content", "boilerplate", "main", "chars", "links", "tags", "stops", "words", "blocks",
        "own", "at",
    )

    def __init__(self, tag: str, parent: int, names: list[list[str]], hidden: bool, at: int):
        self.tag, self.parent, self.at = tag, parent, at
        whole = [set(name) - NEUTRAL_TOKENS for name in names]
        self.main = tag in CONTENT_TAGS or {"main"} in whole
        # a name acquits only if it is one of content as a whole
        acquitted = any(name and name <= CONTENT_TOKENS for name in whole)
        self.content = tag in CONTENT_TAGS or acquitted
        self.boilerplate = hidden or tag in BOILERPLATE_TAGS or not acquitted and any(unwanted(name) for name in names)
        self.children: list[int] = []
        self.chars = self.links = self.tags = self.stops = self.words = self.blocks = self.own = 0


class Page:
    """The tree of a page, parents before children, and its texts as (block, node, text)."""

    def __init__(self, source: str):
        self.nodes = [Node("html", -1, [], False, 0)]
        self.texts: list[tuple[int, int, str]] = []
        self._read(source)
        self._measure()

    def _read(self, source: str) -> None:
        # open elements with the node they belong to and the links open around them; the places of each tag, and of the
        # tags that take part in closing, so that no end is looked for in the whole stack
        stack = [("html", 0, 0)]
        places: dict[str, list[int]] = {}
        closers: list[int] = []
        block, links, at, seen = 0, 0, 0, 0

        def close(k: int) -> int:
            """End the open element number k and all within it; the links open after it."""
            left = stack[k][2]
            for tag, _, _ in stack[k:]:
                places[tag].pop()
            del stack[k:]
            while closers and closers[-1] >= k:
                closers.pop()
            return left

        skipping = ""  # the head, while it is being passed over

        def text(raw: str) -> None:
            nonlocal seen
            if not raw:
                return
            body = references.unescape(raw)
            i = stack[-1][1]
            self.texts.append((block, i, body))
            n = len(body.strip())
            if n:
                seen += n
                node = self.nodes[i]
                node.own += n
                node.chars += n
                node.links += n * bool(links)
                node.words += len(body.split())
                node.stops += sum(body.count(c) for c in ".,;!?")

        last = source.rfind(">") + 1  # behind it no tag ends
        while match := TOKEN.search(source, at, last):
            if not skipping:
                text(source[at : match.start()])
            closing, tag, rest = match.groups()
            at = match.end()
            if tag is None:
                opened = match.group()
                if opened.startswith("<!--") and not opened.endswith("-->") or opened.startswith("<![") and not opened.endswith(">"):
                    at = len(source)  # a comment without an end
                continue
            tag = tag.lower()
            if not closing and tag in RAW:
                if not (rest.rstrip().endswith("/") and tag in ("svg", "math")):
                    # what stands inside is no markup: tags are read again from its end, or nothing if it has none
                    end = RAW_END[tag].search(source, at)
                    at = end.start() if end else len(source)
                continue
            if closing and tag in RAW:
                continue
            if skipping:
                if tag != "body" and not (tag == "head" and closing):
                    continue
                skipping = ""
                if closing:
                    continue
            if not closing and tag == "head":
                skipping = tag
                continue
            if tag in BLOCK:
                block += 1
            if tag == "br":
                self.texts.append((block, stack[-1][1], " "))
            if closing:
                if places.get(tag):
                    links = close(places[tag][-1])
                continue
            if tag in ("html", "body") or tag in VOID:
                continue
            ended = self._ended(stack, closers, tag)
            if ended:
                links = close(ended)
            names, hidden = names_of(rest) if rest and not rest.isspace() else ([], False)
            parent = stack[-1][1]
            if tag in BLOCK or tag in BOILERPLATE_TAGS or names or hidden:
                self.nodes.append(Node(tag, parent, names, hidden, seen))
                self.nodes[parent].children.append(len(self.nodes) - 1)
                parent = len(self.nodes) - 1
            else:
                self.nodes[parent].tags += 1
            places.setdefault(tag, []).append(len(stack))
            if tag in CLOSERS:
                closers.append(len(stack))
            stack.append((tag, parent, links))
            links += tag == "a"
        if not skipping:
            text(re.split("<[!?]", source[at:], maxsplit=1)[0])

    @staticmethod
    def _ended(stack: list, closers: list[int], tag: str) -> int:
        """The number of the element that the beginning of `tag` ends: an open paragraph, or an item of the same list; or 0."""
        for k in reversed(closers):
            open_tag = stack[k][0]
            if open_tag == "p" and tag in BLOCK or tag in CLOSED_BY.get(open_tag, ()):
                return k
            if open_tag in BLOCK and open_tag not in ("p", "li", "dt", "dd", "td", "th", "tr", "option"):
                break
            if open_tag in ("li", "td", "th", "dd") and tag not in CLOSED_BY[open_tag]:
                break
        return 0

    def _measure(self) -> None:
        for i in {i for _, i, t in self.texts if t.strip()}:
            self.nodes[i].blocks += 1
        for node in reversed(self.nodes[1:]):
            up = self.nodes[node.parent]
            for name in ("chars", "links", "stops", "words", "blocks"):
                setattr(up, name, getattr(up, name) + getattr(node, name))
            up.tags += node.tags + 1
        # where a page has content elements: what lies inside them or around them
        inside = [n.main for n in self.nodes]
        self.marked = any(inside)
        around = list(inside)
        for i in range(len(self.nodes) - 1, 0, -1):
            around[self.nodes[i].parent] |= around[i]
        for i in range(1, len(self.nodes)):
            inside[i] |= inside[self.nodes[i].parent]
        self.outside = [self.marked and not (a or b) for a, b in zip(inside, around)]

    def features(self) -> np.ndarray:
        rows, depth = [], [0] * len(self.nodes)
        alike = [Counter(self.nodes[i].tag for i in n.children) for n in self.nodes]
        for i, n in enumerate(self.nodes):
            up = self.nodes[n.parent] if i else n
            depth[i] = depth[n.parent] + 1 if i else 0
            siblings = max(1, len(up.children))
            rows.append(
                (
                    depth[i],
                    math.log1p(n.chars),
                    n.chars / (n.tags + 1),
                    n.links / max(1, n.chars),
                    math.log1p(n.own),
                    n.stops / max(1, n.words),
                    n.words / max(1, n.blocks),
                    n.chars * siblings / max(1, up.chars),
                    alike[n.parent][n.tag] / siblings if i else 1,
                    n.at / max(1, self.nodes[0].chars),
                    n.tag in PARAGRAPHS,
                    n.content,
                    self.outside[i],
                )
            )
        return np.array(rows, dtype=np.float64)

    def labels(self) -> list[int | None]:
        """1 content, 0 not, None where the page does not tell or the parent is no content and the node not mere links."""
        found: list[int | None] = []
        for i, n in enumerate(self.nodes):
            if i == 0 or found[n.parent] == 0 or found[n.parent] is None and n.parent > 0:
                found.append(1 if i == 0 else 0 if n.links > 0.5 * n.chars else None)
            elif n.boilerplate or self.outside[i]:
                found.append(0)
            elif self.marked or n.chars > 80 and n.links < 0.3 * n.chars:
                found.append(1)
            else:
                found.append(None)
        return found

    def judged(self, content: np.ndarray) -> np.ndarray:
        """The probabilities; 0 for nodes that name themselves boilerplate; 1 for those named as content or around such,
        and for paragraphs and what is at least half as long as its siblings on average, if no more than half is links."""
        sure = [n.content for n in self.nodes]
        for i in range(len(self.nodes) - 1, 0, -1):
            sure[self.nodes[i].parent] |= sure[i] and not self.nodes[i].boilerplate
        for i, n in enumerate(self.nodes):
            up = self.nodes[max(0, n.parent)]
            long = 2 * n.chars * len(up.children) >= up.chars
            sure[i] |= (long or n.tag in PARAGRAPHS) and 2 * n.links <= n.chars
        return np.where([n.boilerplate for n in self.nodes], 0.0, np.where(sure, 1.0, content))

    def text(self, content: np.ndarray) -> str:
        """The text of the nodes kept, given each node's probability of content if its parent is."""
        kept = [True] * len(self.nodes)
        for i in range(1, len(self.nodes)):
            kept[i] = kept[self.nodes[i].parent] and bool(content[i] > 0.5)
        blocks: dict[int, list[str]] = {}
        for block, i, body in self.texts:
            if kept[i]:
                blocks.setdefault(block, []).append(body)
        joined = (" ".join("".join(b).split()) for b in blocks.values())
        return "\n\n".join(b for b in joined if b)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    random = np.random.default_rng(7)
    for batch in batches:
        rows, labels = [np.zeros((0, FEATURES))], []
        for source in batch.column("html").to_pylist():
            page = Page(source or "")
            told = [(i, y) for i, y in enumerate(page.labels()) if i and y is not None]
            x = page.features()[[i for i, _ in told]]
            y = np.array([float(y) for _, y in told])
            for copy in range(3):
                shown = x.copy()
                shown[:, DEEP] += random.integers(0, 6)
                scale = np.exp(random.uniform(-4, 0))  # a page of the same make with shorter texts
                shown[:, LOGS] = np.log1p(np.expm1(shown[:, LOGS]) * scale)
                shown[:, LENGTHS] *= scale
                some = (y == 1) & (random.random(len(y)) < 0.2)
                shown[some, LINKED] = random.uniform(0, 0.7, int(some.sum()))
                if copy > 0:
                    shown[:, HINTS] = 0
                if copy > 1:
                    shown[:, TAGS] = (1, 0)
                else:  # paragraphs of any length beside others of any kind, anywhere
                    some = (y == 1) & (x[:, TAGS[1]] == 1) & (random.random(len(y)) < 0.3)
                    shown[some, RELATIVE] = np.exp(random.uniform(-4, 1, int(some.sum())))
                    shown[some, TAGS[0]], shown[some, PLACE] = random.random((2, int(some.sum())))
                rows.append(shown)
                labels += y.tolist()
        yield pa.RecordBatch.from_pydict(
            {"x": pa.array(np.concatenate(rows).tolist(), pa.list_(pa.float64())), "label": pa.array(labels, pa.float64())}
        )


# per tree: feature, threshold, left, right, value of each node; feature -1 is a leaf
Trees = list[tuple[float, np.ndarray]]


def train(pages: DataFrame, html: str = "html", rows: int = TRAIN_PAGES) -> Trees:
    """Boosted trees from a sample of at most `rows` pages; none if their nodes are all of one kind."""
    sample = pages.select(F.col(html).alias("html")).filter("html IS NOT NULL").orderBy(F.xxhash64("html")).limit(rows)
    nodes = store(mapped(sample, _examples, "x array<double>, label double"), "dom-nodes")
    kinds = {r["label"]: r["count"] for r in nodes.groupBy("label").count().collect()}
    if len(kinds) < 2:
        return []
    # a page has many paragraphs and few menus; text lost counts twice as much as boilerplate kept
    weight = F.when(F.col("label") == 1, 2 / kinds[1.0]).otherwise(1 / kinds[0.0]) * (sum(kinds.values()) / 3)
    data = nodes.select(array_to_vector("x").alias("features"), "label", weight.alias("weight"))
    fit = GBTClassifier(
        maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, featureSubsetStrategy="0.5", seed=7, maxBins=64,
        weightCol="weight",
    ).fit(data)
    trees = []
    for weight, tree in zip(fit.treeWeights, fit.trees):
        nodes = []

        def walk(node) -> int:
            at = len(nodes)
            nodes.append(None)
            if node.numDescendants() == 0:
                nodes[at] = (-1, 0.0, -1, -1, node.prediction())
            else:
                split = node.split()
                nodes[at] = (split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild()), 0.0)
            return at

        walk(tree._java_obj.rootNode())
        trees.append((weight, np.array(nodes, dtype=np.float64)))
    return trees


def content(features: np.ndarray, trees: Trees) -> np.ndarray:
    """Probability of content per row of features; even odds of three to one without a model."""
    if not trees:
        return np.full(len(features), 0.75)
    margin = np.zeros(len(features))
    rows = np.arange(len(features))
    for weight, tree in trees:
        at = np.zeros(len(features), dtype=np.int64)
        while (inner := tree[at, 0] >= 0).any():
            f = np.where(inner, tree[at, 0], 0).astype(np.int64)
            to = np.where(features[rows, f] <= tree[at, 1], tree[at, 2], tree[at, 3])
            at = np.where(inner, to, at).astype(np.int64)
        margin += weight * tree[at, 4]
    return 1 / (1 + np.exp(-2 * margin))


def _extract(trees: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for first in range(0, len(batch), 200):
                pages = [Page(x or "") for x in batch.column("html")[first : first + 200].to_pylist()]
                p = content(np.concatenate([page.features() for page in pages]), trees)
                cuts = np.cumsum([len(page.nodes) for page in pages])
                texts += [page.text(page.judged(part)) for page, part in zip(pages, np.split(p, cuts[:-1]))]
            kept = batch.drop_columns(["html"])
            found = {
                "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            }
            yield pa.RecordBatch.from_arrays([*kept.columns, *found.values()], names=[*kept.schema.names, *found])

    return run


def extracted(pages: DataFrame, trees: Trees, keep: list[str], html: str = "html") -> DataFrame:
    """The columns `keep`, text and n_chars."""
    rows = pages.select(*keep, F.col(html).alias("html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema.fields)
    return mapped(rows, _extract(trees), schema + ", text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages", "page_id", "url", "html")
    return extracted(pages, train(pages), ["page_id", "url"])
