"""Main text of HTML pages by composite text density.

Every element gets a density: its characters per tag, lowered by the share of
characters and tags that belong to links.  The body's own ratio scales the
logarithm's base, so link-rich pages are judged against themselves.  The sums of
the children's densities are taken, and the element with the largest sum is the
content's kernel.  Elements whose name or form makes them page furniture are
left out first, unless they turn out to wrap the article.  The smallest density on its path to the body is the
threshold that a subtree or stretch of text beside the path must reach to count
as content too; in the article the kernel stands in, parts that are not mostly
links need not reach it.  Blocks of links are left out everywhere.

Defined results: a null or empty page, or one without text outside excluded
elements, gives an empty text; malformed markup is closed the way browsers do
for paragraphs, list items and table cells; unknown or unclosed tags end with
their parent; the time is linear in a page's length; repeated rows give repeated results; null ids and urls are kept;
further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import map_batches, table, without

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
SPACE = re.compile(r"\s+")
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
NEGATED = {"with", "has", "no", "without"}

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: their content is no markup
RAW = set("script style textarea title noscript iframe xmp noframes template".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: never part of an article
EXCLUDED = set("head nav header footer aside script style noscript iframe button select option input textarea dialog menu template svg canvas object embed title".split())
#: not part of an article unless it is wrapped in them
FORMS = {"form", "fieldset"}
#: words in class, id or role that mark page furniture, notices, adverts and comments
FURNITURE = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted cookie cookies consent gdpr notice notification alert popup modal newsletter subscribe signup login "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer header masthead share sharing social related recommended comment comments disqus replies reply respond "
    "pagination pager toolbar complementary contentinfo search".split()
)
#: words that only say where or what kind of box something is
LAYOUT = set(
    "area bar block bottom box button center close col column component container content entry form group head heading inner item items label left link links list main module outer overlay panel posts "
    "primary region right row section secondary slot small stories story text thread title top unit wrap wrapper zone articles big body id js large lg md sm xs".split()
)
#: an open tag of the key ends open elements of the value, up to the nearest container
BLOCKS = set("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {b: {"p"} for b in BLOCKS}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
CONTAINERS = set("body html article section main div table td th blockquote ul ol dl form nav aside header footer figure".split())


class Node:
    """An element: its parts are texts and child elements in page order."""

    __slots__ = ("tag", "parts", "parent", "barred", "doubtful", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, barred: bool, doubtful: bool = False):
        self.tag, self.parent, self.barred, self.doubtful = tag, parent, barred, doubtful
        self.parts: list = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0

    def children(self) -> Iterator[Node]:
        return (x for x in self.parts if isinstance(x, Node))


def is_hidden(attributes: str) -> bool:
    return bool(re.search(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", attributes, re.I))


def named_furniture(tag: str, attributes: str) -> bool:
    """Whether class, id or role call the element page furniture.

    The last word of a name decides ("post-comments"), or the first one if
    all others are about layout ("sidebar-left", but not "related-work").
    """
    if not attributes or tag in ("body", "html", "article", "main"):
        return False
    for m in NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = WORD.findall(name)
            if not words or not NEGATED.isdisjoint(words):  # "with-sidebar" is not furniture
                continue
            if words[-1] in FURNITURE or (words[0] in FURNITURE and all(w in FURNITURE or w in LAYOUT for w in words[1:])):
                return True
    return False


def bar_furniture(nodes: list[Node]) -> None:
    """Decide about elements that only their name or a form makes furniture.

    One that holds more than half of the page's text outside links, and a main
    heading or nine tenths of that text, is a wrapper of the article and stays.
    """
    free: dict[int, int] = {}
    headed: set[int] = set()
    for node in reversed(nodes):
        own = sum(len(SPACE.sub("", x)) for x in node.parts if isinstance(x, str)) + sum(free[id(c)] for c in node.children())
        free[id(node)] = 0 if node.barred or node.tag == "a" else own
        if not node.barred and (node.tag in ("h1", "main") or any(id(c) in headed for c in node.children())):
            headed.add(id(node))
    total = free[id(nodes[0])]
    for node in nodes:
        mine = free[id(node)]
        wrapper = 2 * mine > total and (id(node) in headed or 10 * mine >= 9 * total)
        node.barred = node.barred or (node.parent is not None and node.parent.barred) or (node.doubtful and not wrapper)


def parse(page: str) -> tuple[Node, list[Node]]:
    """The tree, and its elements in page order (parents before children)."""
    root = Node("html", None, False)
    nodes, here, at = [root], root, 0
    open_tags: Counter[str] = Counter()  # names of the elements between here and the root

    def close(upto: Node) -> Node:
        node = here
        while node is not upto:
            open_tags[node.tag] -= 1
            node = node.parent
        return upto

    while True:
        m = TOKEN.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at:
            here.parts.append(page[at:stop])
        if m is None:
            bar_furniture(nodes)
            return root, nodes
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                here.parts.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m[1]:
            if open_tags[tag] > 0:
                node = here
                while node.tag != tag:
                    node = node.parent
                here = close(node.parent)
            continue
        if tag in ("html", "body") and (tag == "html" or any(n.tag == "body" for n in nodes[:64])):
            continue
        if tag in ENDS and any(open_tags[t] > 0 for t in ENDS[tag]):
            node, stops = here, SCOPE.get(tag, CONTAINERS)
            while node is not root and node.tag not in ENDS[tag] and node.tag not in stops:
                node = node.parent
            if node is not root and node.tag in ENDS[tag]:
                here = close(node.parent)
        if tag == "body":
            here = close(root)  # an unclosed head ends here
        node = Node(tag, here, here.barred or tag in EXCLUDED or is_hidden(m[3]), tag in FORMS or named_furniture(tag, m[3]))
        here.parts.append(node)
        nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)  # the content is dropped: none of these holds article text
        elif tag not in VOID and not m[0].endswith("/>"):
            here = node
            open_tags[tag] += 1


def densities(nodes: list[Node]) -> float:
    """Characters, tags and link shares bottom up, then densities and their sums; the body's share of link characters."""
    for node in reversed(nodes):
        own = sum(len(SPACE.sub("", x)) for x in node.parts if isinstance(x, str))
        node.chars += own
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    share = body.link_chars / max(body.chars, 1)
    for node in nodes:
        if node.chars and not node.barred:
            node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        if node.parent is not None:
            node.parent.total += node.density
    return share


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density; ``share`` is the body's share of characters in links."""
    tags, links, link_tags = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * links + share * chars + math.e)
    ratio = chars / links * (tags / link_tags)
    return chars / tags * max(math.log(max(ratio, 1.0)) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else 0.0, 0.0)


def content_nodes(nodes: list[Node], share: float) -> list[Node | list]:
    """The subtree of the largest density sum and all dense parts beside its path to the root, in page order.

    A part is a subtree, or a stretch of bare text and inline elements of an
    element on the path.  Inside the article (or main) the kernel stands in, the
    threshold weighs nothing: there only parts made of links stay out.  Blocks
    of links inside the subtrees are barred.
    """
    open_nodes = [n for n in nodes if not n.barred and n.chars]
    if not open_nodes:
        return []
    best = max(open_nodes, key=lambda n: n.total)
    if best.total <= 0:
        return [nodes[0]]
    path, node = [best], best
    while node.parent is not None:
        node = node.parent
        path.append(node)
    has_body = any(n.tag == "body" for n in path)
    upto = next(k for k, n in enumerate(path) if n.tag == "body" or (n.parent is None and not has_body))
    threshold = min((n.density for n in path[: upto + 1] if n.density > 0), default=0.0)
    on_path = {id(n) for n in path}
    # on this element and below it short parts need no density
    home = next((k for k, n in enumerate(path) if n.tag in ("article", "main")), -1)
    eased = {id(n) for n in path[: home + 1]}
    out: list[Node | list] = []

    def close(stretch: list, need: float) -> None:
        inner = [x for x in stretch if isinstance(x, Node)]
        chars = sum(x.chars if isinstance(x, Node) else len(SPACE.sub("", x)) for x in stretch)
        counts = sum(x.tags + 1 for x in inner), sum(x.link_chars for x in inner), sum(x.link_tags for x in inner)
        if chars and counts[1] * 2 < chars and density(chars, *counts, share) >= need:
            out.append(stretch)

    def walk(n: Node) -> Iterator[None]:
        stretch: list = []
        need = 0.0 if id(n) in eased else threshold
        for x in n.parts:
            if isinstance(x, str) or (x.tag in INLINE | {"br"} and id(x) not in on_path and not x.barred):
                stretch.append(x)
                continue
            close(stretch, need)
            stretch = []
            if x is best:
                out.append(x)
            elif id(x) in on_path:
                yield x
            elif not x.barred and x.chars and x.link_chars * 2 < x.chars and x.density >= need:
                out.append(x)
        close(stretch, need)

    # the path can be as deep as the page
    if best.parent is None:
        out.append(best)
    else:
        stack = [walk(nodes[0])]
        while stack:
            deeper = next(stack[-1], None)
            if deeper is None:
                stack.pop()
            else:
                stack.append(walk(deeper))
    for top in out:
        inside = [top] if isinstance(top, Node) else [x for x in top if isinstance(x, Node)]
        while inside:
            for x in inside.pop().children():
                if x.tag not in INLINE and x.chars and x.link_chars * 2 >= x.chars and x.density < threshold:
                    x.barred = True
                else:
                    inside.append(x)
    return out


def blocks(kernel: list[Node | list]) -> list[str]:
    """Text blocks of the content in page order: references decoded, white space folded, trimmed."""
    out: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(line))).strip()
        if text:
            out.append(text)
        line.clear()

    for top in kernel:
        stack: list = [top] if isinstance(top, Node) else top[::-1]
        while stack:
            x = stack.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                line.append(x)
            elif x.barred:
                continue
            elif x.tag in INLINE:
                stack.extend(reversed(x.parts))
            elif x.tag == "br":
                line.append(" ")
            else:
                close()
                stack.append(None)
                stack.extend(reversed(x.parts))
        close()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    _, nodes = parse(page)
    share = densities(nodes)
    return "\n".join(blocks(content_nodes(nodes, share)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text`` of every page."""
    types = dict(pages.dtypes)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    out = map_batches(without(pages, id_col, url_col, html_col), one, f"id {types[id_col]}, url {types[url_col]}, text string")
    return out.toDF(id_col, url_col, "text")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))
