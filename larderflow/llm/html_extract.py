"""Main text of web pages by a site style tree: what importance each branch of a site's pages has decides what stays.

The pages of a host are merged into one tree. A node is a chain of presentation styles (element name, class and id
names) from the root; for each node the tree counts which sequences of child styles (presentation) and which contents
its pages show there. The importance of a node is

    prior * (1 - link share) * (diversity of presentation + 3 * diversity of content) / 4

Diversity is the entropy of what the pages show, in units of the logarithm of their number: 0 if all show the same, 1 if
all differ. The prior tells what the style itself says: 0 for styles named as menus, adverts, forms, comments and the
like, whose wording may differ on every page and so looks important by entropy; 1 for others. Content styles (article,
main) and all that stands in them without such a name are not open to doubt: their importance is 1. There, everyday words
such as "discussion" or "related" only make a branch open to doubt, so that the tree decides, and names of headings and
sections that are made of their wording do not even do that. A node that fewer
than ``LEAST_PAGES`` different pages of the host show keeps its prior. Branches below ``THRESHOLD`` are cut from each
page; the text of the rest is the page's main text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderflow.llm.url_filter import host
from larderflow.session import written

THRESHOLD = 0.3
LEAST_PAGES = 4

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("title textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption option html head body title legend".split())
# What an opening element closes if it is open above the nearest of the elements named after it.
CLOSED_BY = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table", "tbody", "thead", "tfoot")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "thead": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
# Elements that are never main text, and those that are not outside of an article.
APART = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe input label menu nav noscript object search select "
    "svg template textarea video".split()
)
CONTENT = frozenset("article main".split())
# Names in classes, ids and roles that tell of something else than main text.
APART_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot banner promo promotion promoted sponsor "
    "sponsored sponsors nav navbar navigation navigator menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside rail "
    "footer footnav foot masthead topbar toolbar header cookie cookies consent gdpr notice notices notification alert popup "
    "modal overlay newsletter subscribe subscription signup login signin register search searchform share sharing social "
    "related recommended recommendations comment comments commentlist reply replies respond disqus discussion widget widgets "
    "pagination pager skip copyright legal disclaimer complementary contentinfo form".split()
)
# Of these, words that also name parts of articles: in a content style they leave it to the tree.
EVERYDAY_NAMES = frozenset(
    "discussion related search legal social form notice notices copyright menu menus share sharing reply replies respond register "
    "navigation navigator promotion alert notification consent recommended recommendations disclaimer subscription rail skip".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Names of articles that end so tell how the page is set up, as in "comments-open".
SETTINGS = frozenset("open closed enabled disabled on off".split())

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
_NAMED = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?![\w-])""", re.I)
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """The nodes of a page in the order they open, and its pieces of text with the nodes they stand in.

    ``parent``, ``path`` (hash of the chain of styles), ``prior``, ``inside`` (in a content style) and ``sure`` (there, and
    not open to doubt) are by node; node 0 is the page. ``items`` holds (node, text) and, where a block begins or ends, (node, None).
    """

    def __init__(self, source: str) -> None:
        self.parent, self.path, self.prior, self.sure, self.link = [-1], [0], [1.0], [False], [False]
        self.inside = [False]
        self.children: list[int] = [0]
        self.items: list[tuple[int, str | None]] = []
        self._names: list[str] = ["#page"]
        self._stack: list[int] = [0]
        self._open: dict[str, int] = {}
        self._read(source)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            tag = _TAG.search(source, at)
            if tag is None:
                self._text(source[at:])
                return
            if tag.start() > at:
                self._text(source[at : tag.start()])
            at = tag.end()
            if not tag[2]:
                continue
            name = tag[2].lower()
            if tag[1]:
                self._close(name)
                continue
            self._start(name, tag[3] or "")
            if name in RAW or name in ESCAPABLE:
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(source, at)
                if name in ESCAPABLE:
                    self._text(source[at : stop.start() if stop else end])
                at = stop.start() if stop else end

    def _text(self, text: str) -> None:
        self.items.append((self._stack[-1], entities.unescape(text) if "&" in text else text))

    def _push(self, node: int) -> None:
        self._stack.append(node)
        name = self._names[node]
        self._open[name] = self._open.get(name, 0) + 1

    def _pop_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            node = self._stack.pop()
            self._open[self._names[node]] -= 1
            if self._names[node] in BLOCK:
                self.items.append((node, None))

    def _find(self, wanted: tuple[str, ...], barrier) -> int:
        """The depth of the innermost open element of these names that no barrier is open above of, 0 if none."""
        if not any(self._open.get(w) for w in wanted):
            return 0
        for depth in range(len(self._stack) - 1, 0, -1):
            name = self._names[self._stack[depth]]
            if name in wanted:
                return depth
            if barrier(name):
                return 0
        return 0

    def _start(self, name: str, attributes: str) -> None:
        if name in CLOSES_P and (depth := self._find(("p",), lambda n: n in BLOCK and n != "p")):
            self._pop_to(depth)
        if name in CLOSED_BY:
            wanted, within = CLOSED_BY[name]
            if depth := self._find(wanted, within.__contains__):
                self._pop_to(depth)
        parent = self._stack[-1]
        node = len(self.parent)
        style, prior, doubt = _style(name, attributes, self.inside[parent])
        digest = xxhash.xxh64_intdigest(style, self.path[parent]) >> 1
        self.parent.append(parent)
        self.path.append(digest)
        self.prior.append(prior * self.prior[parent])
        self.inside.append(self.inside[parent] or name in CONTENT)
        self.sure.append(not doubt and (self.sure[parent] or (name in CONTENT and not self.inside[parent])))
        self.link.append(self.link[parent] or name == "a")
        self.children.append(0)
        self.children[parent] = xxhash.xxh64_intdigest(style, self.children[parent]) >> 1
        self._names.append(name)
        if name in BLOCK:
            self.items.append((node, None))
        if name == "br":
            self.items.append((parent, " "))
        if name not in VOID:
            self._push(node)

    def _close(self, name: str) -> None:
        barrier = (lambda n: False) if name in BLOCK and name != "p" else (lambda n: n in BLOCK and n != name)
        if depth := self._find((name,), barrier):
            self._pop_to(depth)


_STYLES: dict[tuple[str, str, bool], tuple[str, float, bool]] = {}


def _style(name: str, attributes: str, inside: bool) -> tuple[str, float, bool]:
    """The presentation style of an element, its prior, and whether in a content style (``inside``) its names leave doubt.

    Digits in names count as alike.
    """
    key = (name, attributes if len(attributes) < 200 else "", inside)
    if key in _STYLES and len(attributes) < 200:
        return _STYLES[key]
    named: dict[str, str] = {}
    if attributes:
        for m in _NAMED.finditer(attributes):
            named.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    names = f"{named.get('class', '')} {named.get('id', '')}".split()
    prior = 0.0 if name in APART or (name == "header" and not inside) else 1.0
    if name == "label" and inside:
        prior = 1.0  # a form is cut as a whole; elsewhere in an article a label is text
    doubt = False
    if "hidden" in named or named.get("aria-hidden") == "true" or _HIDDEN.search(named.get("style", "")):
        prior = 0.0
    wording = set(named.get("id", "").split()) - set(named.get("class", "").split()) if inside and name in HEADINGS | {"section"} else ()
    for one in [*names, *named.get("role", "").split()]:
        parts = _WORDS.findall(one)
        if name in ("html", "body") or (name in CONTENT and parts[-1:] and parts[-1] in SETTINGS):
            parts = parts if len(parts) == 1 else []
        told = {parts[0], parts[-1]} & APART_NAMES - ({"header"} if inside else frozenset()) if parts else frozenset()
        if not told:
            continue  # the header of an article holds its title
        if one in wording and (name != "section" or told <= EVERYDAY_NAMES):
            continue
        if inside and (told <= EVERYDAY_NAMES or (one in wording and len(parts) > 1)):
            doubt = True
        else:
            prior = 0.0
    found = _DIGITS.sub("0", f"{name}.{'.'.join(sorted(set(names)))}"), prior, doubt
    if len(attributes) < 200 and len(_STYLES) < 50_000:
        _STYLES[key] = found
    return found


def shown(source: str) -> dict[int, tuple[int, int, int, int]]:
    """What a page shows at each node of the site's tree that is open to doubt: presentation, content, characters, and
    characters in links. Branches with a prior of 0 and content styles need no counting."""
    page = Page(source)
    n = len(page.parent)
    content, size, linked = [0] * n, [0] * n, [0] * n
    for node, text in page.items:
        if text and not text.isspace():
            words = " ".join(text.split())
            content[node] = xxhash.xxh64_intdigest(words, content[node]) >> 1
            size[node] += len(words)
            linked[node] += len(words) if page.link[node] else 0
    for node in range(n - 1, 0, -1):
        up = page.parent[node]
        content[up] = (content[up] * 1_000_003 + content[node]) & 0x7FFFFFFFFFFFFFFF
        size[up] += size[node]
        linked[up] += linked[node]
    out: dict[int, tuple[int, int, int, int]] = {}
    for node in range(1, n):
        if page.prior[node] and not page.sure[node] and size[node]:
            p, c, s, k = out.get(page.path[node], (0, 0, 0, 0))
            out[page.path[node]] = (
                (p * 31 + page.children[node]) & 0x7FFFFFFFFFFFFFFF, (c * 31 + content[node]) & 0x7FFFFFFFFFFFFFFF, s + size[node], k + linked[node],
            )
    return out


def main_text(source: str, low: frozenset[int]) -> str:
    """The text of the branches that are left without those of prior 0 and those in ``low``, a line for each block."""
    page = Page(source)
    kept = [True] * len(page.parent)
    for node in range(1, len(kept)):
        kept[node] = kept[page.parent[node]] and page.prior[node] > 0 and (page.sure[node] or page.path[node] not in low)
    blocks, held = [], []
    for node, text in page.items:
        if text is None:
            if held:
                blocks.append("".join(held))
                held = []
        elif kept[node]:
            held.append(text)
    blocks.append("".join(held))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def style_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, node, pages, importance) of the nodes whose importance is open to doubt.

    Different pages count once however many copies there are, and rows of a host with very many pages are spread by page
    and content until they have been counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if source:
                    copy = xxhash.xxh64_intdigest(source) >> 1
                    rows += [(name, node, copy, *told) for node, told in shown(source).items()]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.string(), *[pa.int64()] * 6]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["host", "node", "copy", "presentation", "content", "size", "linked"])

    told = pages.select(host(url).alias("host"), html).mapInArrow(
        run, "host string, node long, copy long, presentation long, content long, size long, linked long"
    )
    # Copies show the same, so one row of each is kept; then equal contents are counted, and then a node's contents.
    each = told.distinct().groupBy("host", "node", "presentation", "content").agg(
        F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("linked").alias("linked")
    )
    looks = each.groupBy("host", "node", "presentation").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("by_content"), F.sum("size").alias("size"), F.sum("linked").alias("linked")
    )
    nodes = looks.groupBy("host", "node").agg(
        F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("by_presentation"), F.sum("by_content").alias("by_content"),
        (F.sum("linked") / F.sum("size")).alias("link_share"),
    )

    def diversity(weighted: str):
        return F.when(F.col("pages") > 1, 1 - F.col(weighted) / F.col("pages") / F.log("pages")).otherwise(1.0)

    importance = (1 - F.col("link_share")) * (diversity("by_presentation") + 3 * diversity("by_content")) / 4
    known = F.when(F.col("pages") >= LEAST_PAGES, importance).otherwise(1.0)
    return nodes.select("host", "node", "pages", known.alias("importance"))


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``pages``: id, url, ``text`` (main text, a line for each block; empty if none) and ``n_chars``.

    White space of a block, including that between its elements and ``<br>``, is one space, character references are
    decoded; nothing is cut off. Null html is empty. Pages without a host (null URL or one without ``://``) make up one
    site, named by the empty string. Rows with null ids and repeated rows all come back. Other columns are not read; an
    empty table gives no rows.

    The nodes to be cut are few for each host; they are written to the shared folder, so that Spark sees their size and
    sends them to the pages if they are small, or else joins by host.
    """
    low = style_tree(pages, url, html).filter(F.col("importance") < threshold).groupBy("host").agg(F.collect_set("node").alias("_low"))
    low = written(low.withColumnRenamed("host", "_host"), "styles")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    told = pages.select(F.col(id), F.col(url), F.col(html).alias("_html"), host(url).alias("_host")).join(low, "_host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(source or "", frozenset(nodes or ()))
                for source, nodes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [id, url, "text", "n_chars"],
            )

    return told.select(id, url, "_html", "_low").mapInArrow(run, f"{id} {kinds[id]}, {url} {kinds[url]}, text string, n_chars long")
