"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is a node that is content or not.  Its potential comes from its tag, the hints in its class, id and
role, the length of its text, and the shares of links and sentence marks in it; a parent-child potential ties its
label to its parent's.  Potentials are fitted on a bounded sample of pages whose own markup labels them
(article or main against menus, sidebars and footers).  Sum-product message passing, first up and then down the
tree, gives each node's marginal, and the text of nodes with a content marginal of at least one half is kept.

Elements that never hold article text (forms, scripts, styles, menus, sidebars, footers and the like) are clamped.
Character references are decoded, white space inside a block becomes one space, and blocks are joined by a line feed.

Defined results: NULL and empty pages give an empty text; unclosed and stray tags are tolerated; equal rows
give equal results; without labelled pages the stated priors decide; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.words import parts, record

#: Labelled pages that the potentials are fitted on at most (about).
SAMPLE_PAGES = 600

# Fixed values of HTML and of page layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "", "tbody": "thead tr td th", "body": "head"}
NEVER = frozenset(
    "aside button canvas datalist fieldset footer form head iframe input menu nav noscript object option script select style svg template "
    "textarea title video audio dialog".split()
)
AGAINST = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup "
    "promo promoted promotion recommended related reply replies respond search share sharing shoutbox sidebar sidebars signup social sponsor "
    "sponsored subscribe toolbar topbar widget widgets".split()
)
TOWARDS = frozenset("article articlebody body content entry main maincontent post story text".split())
REGION = frozenset({"article", "main"})
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HINT = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|(?P<text>[^<]+)|<",
    re.S,
)


class Page:
    """The element tree of a page and its text in page order."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.hint, self.clamped = [-1], ["#page"], [0], [False]
        self.region = [False]  # within an article or main element
        self.closed = [False]  # within an element whose names speak against it
        self.chunks: list[tuple[int, int, str]] = []  # node, block, text
        self.block = 0
        self.implied: set[int] = set()  # paragraphs that no tag opens
        self.stack = [0]
        self._read(source)

    def _open(self, tag: str, attrs: str) -> int:
        hint = 0
        if attrs:
            for a, b, c in NAMED.findall(attrs):
                names = set(HINT.findall(CAMEL.sub(" ", a or b or c).lower()))
                hint = -1 if names & AGAINST else hint or (1 if names & TOWARDS else 0)
            if HIDDEN.search(attrs):
                hint = -1
        above = self.stack[-1]
        self.region.append(self.region[above] or tag in REGION)
        if tag == "header" and not self.region[above]:
            hint = -1
        self.parent.append(above)
        self.tag.append(tag)
        self.hint.append(hint)
        self.clamped.append(self.clamped[above] or tag in NEVER)
        self.closed.append(self.closed[above] or (hint < 0 and tag not in REGION))
        return len(self.tag) - 1

    def _pop(self, tags: frozenset[str] | set[str], until: frozenset[str]) -> None:
        """Closes the innermost open element of ``tags``, unless one of ``until`` stands in between."""
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[depth]]
            if tag in tags:
                del self.stack[depth:]
                return
            if tag in until:
                return

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        scope = frozenset("table td th ul ol dl article section div body".split())
        lowered: str | None = None
        while at < end:
            m = TOKEN.match(source, at)
            at = m.end()
            text = m["text"]
            if text is None and m[0] == "<":
                text = "<"
            if text is not None:
                if len(self.stack) == 1 and not text.isspace():
                    # text directly under the root begins a paragraph, as it would in a browser's body
                    self.stack.append(self._open("p", ""))
                    self.implied.add(self.stack[-1])
                self.chunks.append((self.stack[-1], self.block, text))
                continue
            tag = (m["tag"] or m["tag2"] or "").lower()
            if not tag:
                if m[0].startswith("<![CDATA["):
                    self.chunks.append((self.stack[-1], self.block, m[0][9:].removesuffix("]]>")))
                continue
            inline = tag in INLINE
            if not inline:
                self.block += 1
            if m["end"] or m["end2"]:
                self._pop({tag}, frozenset() if not inline else frozenset(CLOSES_P - {"p"}) | {"td", "th", "li"})
                continue
            if tag in CLOSES_P or tag in ("html", "head", "body"):
                self._pop({"p"}, frozenset({"table", "td", "th", "button", "object"}))
            if tag in SIBLINGS:
                self._pop(set(SIBLINGS[tag].split()), scope if tag != "body" else frozenset())
            if tag == "br":
                self.chunks.append((self.stack[-1], self.block, " "))
                continue
            attrs = m["attrs"] if m["tag"] else m["attrs2"]
            node = self._open(tag, attrs or "")
            if tag in RAW:
                lowered = source.lower() if lowered is None else lowered
                close = lowered.find(f"</{tag}", at) if len(lowered) == end else source.find(f"</{tag}", at)
                close = end if close < 0 else close
                if not self.clamped[node]:
                    self.chunks.append((node, self.block, source[at:close]))
                at = close
                self.stack.append(node)
            elif tag not in VOID and not (attrs or "").endswith("/"):
                self.stack.append(node)


def _bucket(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


def node_features(page: Page) -> list[tuple[str, ...]]:
    """Categorical features of each node; sums over subtrees are made from the last node to the first."""
    n = len(page.tag)
    own, total, linked, marks = [0] * n, [0] * n, [0] * n, [0] * n
    for node, _, text in page.chunks:
        size = len(text) - text.count(" ")
        own[node] += size
        total[node] += size
        marks[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        if page.tag[node] == "a":
            linked[node] += size
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        total[p] += total[i]
        marks[p] += marks[i]
        linked[p] += total[i] if page.tag[i] == "a" else linked[i]
    return [
        (
            f"tag={page.tag[i]}", f"hint={page.hint[i]}", f"own={_bucket(own[i], (1, 20, 80, 300, 1200))}",
            f"all={_bucket(total[i], (1, 20, 80, 300, 1200))}", f"links={_bucket(linked[i] / max(total[i], 1), (0.01, 0.2, 0.5, 0.9))}",
            f"marks={_bucket(marks[i] / max(total[i], 1), (0.005, 0.02, 0.05))}",
        )
        for i in range(n)
    ]


def markup_labels(page: Page) -> list[int] | None:
    """Labels that the markup itself gives, if the page has an article or main element."""
    if not any(t in REGION for t in page.tag):
        return None
    inside = [0] * len(page.tag)
    for i in range(1, len(page.tag)):
        region = page.tag[i] in REGION or inside[page.parent[i]]
        inside[i] = int(bool(region) and not page.clamped[i] and page.hint[i] >= 0)
    return inside


# --- potentials --------------------------------------------------------------------------------
#: Log-odds for content that hold before any page is seen, by feature.
PRIORS = {
    "hint=-1": -5.0, "hint=1": 1.5, "tag=article": 3.0, "tag=main": 2.0, "tag=p": 0.5, "tag=h1": 0.5,
    "links=4": -1.5, "links=3": -0.7, "all=5": 0.8, "all=4": 0.4, "marks=1": 0.3, "marks=2": 0.3,
}
#: How much parent and child labels agree, before any page is seen: containers bind their children less, and what
#: lies inside an element whose names speak against it is bound most.
AGREE = {"tight": 2.5, "loose": 0.8, "closed": 7.0}
CONTAINERS = frozenset("#page html body div section table tbody tr td center".split())
LIMIT = 2.5


def _edge_kind(page: Page, i: int) -> str:
    if page.closed[page.parent[i]]:
        return "closed"
    return "loose" if page.tag[page.parent[i]] in CONTAINERS else "tight"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[tuple[str, int]] = Counter()
    for _, pages in parts(batches, "html"):
        for source in pages:
            page = Page(source or "")
            labels = markup_labels(page)
            if labels is None:
                continue
            for i, (features, y) in enumerate(zip(node_features(page), labels)):
                if page.clamped[i]:
                    continue
                counts.update((f, y) for f in features)
                counts["node", y] += 1
                if i:
                    counts[f"edge {_edge_kind(page, i)} {labels[page.parent[i]]}", y] += 1
    rows = sorted(counts.items())
    yield record({
        "feature": pa.array([f[:60] for (f, _), _ in rows], pa.string()), "label": pa.array([y for (_, y), _ in rows], pa.int32()),
        "n": pa.array([n for _, n in rows], pa.int64()),
    })


def train(pages: DataFrame, *, limit: int = SAMPLE_PAGES) -> dict[str, float]:
    """Log-odds by feature and by kind of edge, from about ``limit`` pages; at most 500 features come to the driver."""
    share = min(1.0, limit / max(pages.count(), 1))
    chosen = F.pmod(F.xxhash64(F.lit(23), F.col("page_id").cast("string")), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = pages.filter(chosen & F.col("html").isNotNull()).select(F.col("html").cast("string").alias("html"))
    counted = sample.mapInArrow(_counted, "feature string, label int, n bigint").groupBy("feature", "label").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "feature", "label").limit(1000).collect()
    n = {(r["feature"], r["label"]): r["n"] for r in rows}
    ones, zeros = n.get(("node", 1), 0), n.get(("node", 0), 0)
    model = {}
    for feature in {f for f, _ in n} - {"node"}:
        a, b = n.get((feature, 1), 0), n.get((feature, 0), 0)
        if feature.startswith("edge "):
            model[feature] = math.log((a + 1) / (b + 1))
        elif ones and zeros:
            odds = math.log(((a + 1) / (ones + 2)) / ((b + 1) / (zeros + 2)))
            model[feature] = max(-LIMIT, min(LIMIT, odds))
    return model


def marginals(page: Page, model: dict[str, float]) -> list[float]:
    """Probability of content for each node, exact for the tree."""
    n = len(page.tag)
    node = []
    for i, features in enumerate(node_features(page)):
        if page.clamped[i] or i == 0:
            node.append(-60.0)
            continue
        odds = sum(PRIORS.get(f, 0.0) for f in features)
        odds += 0.5 * sum(model.get(f, 0.0) for f in features)
        node.append(odds - (4.0 if page.hint[i] < 0 and page.tag[i] not in REGION else 0.0))
    # log-odds of a child under either label of its parent
    under = []
    for i in range(n):
        if i == 0:
            under.append((0.0, 0.0))
            continue
        kind = _edge_kind(page, i)
        prior = AGREE[kind]
        low, high = model.get(f"edge {kind} 0", 0.0), model.get(f"edge {kind} 1", 0.0)
        under.append((max(-3.0, min(0.0, low)) - prior, max(0.0, min(3.0, high)) + prior))
    up = node[:]  # evidence of the subtree
    message = [0.0] * n
    for i in range(n - 1, 0, -1):
        low, high = under[i]
        # log of (sum over child labels | parent 1) minus the same for parent 0, with normalised edges
        message[i] = _mix(high, up[i]) - _mix(low, up[i])
        up[page.parent[i]] += message[i]
    belief = up[:]
    for i in range(1, n):
        p = page.parent[i]
        cavity = belief[p] - message[i]
        low, high = under[i]
        # log-odds that the parent's label gives the child
        one = _sum(cavity - _soft(high) + high, -_soft(low) + low)
        zero = _sum(cavity - _soft(high), -_soft(low))
        belief[i] = up[i] + one - zero
    return [1 / (1 + math.exp(-max(-50.0, min(50.0, b)))) for b in belief]


def _soft(x: float) -> float:
    return max(x, 0.0) + math.log1p(math.exp(-abs(x)))


def _sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _mix(edge: float, evidence: float) -> float:
    """log(P(0) + P(1) e^evidence) where P(1) has the log-odds ``edge``."""
    return _sum(-_soft(edge), edge - _soft(edge) + evidence)


def main_text(source: str | None, model: dict[str, float]) -> str:
    if not source:
        return ""
    page = Page(source)
    keep = [p >= 0.5 for p in marginals(page, model)]
    blocks: list[tuple[int, list[str]]] = []
    for node, block, text in page.chunks:
        if keep[node]:
            if not blocks or blocks[-1][0] != block:
                blocks.append((block, []))
            blocks[-1][1].append(text)
    lines = (" ".join(html.unescape("".join(b)).split()) for _, b in blocks)
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, model: dict[str, float]) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row of ``pages(page_id, url, html)``.  No shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sources in parts(batches, "html"):
            texts = [main_text(s, model) for s in sources]
            yield record({
                "page_id": rows.column("page_id"), "url": rows.column("url"), "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            })

    types = dict(pages.dtypes)
    only = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return only.mapInArrow(scan, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars bigint")
