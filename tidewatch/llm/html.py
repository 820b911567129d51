"""Operator 4: main text of web pages, with site template removal.

Every element's subtree is hashed, once with its text and, for lists of links, once as a shape of tags and class names. Spark
counts, for every host, the pages that have a hash; subtrees that recur across many pages of their host are the site's
template and are deleted. What elements say of themselves (menus, footers, adverts, ...) decides where a host has too few
pages to count. The text of what is left of the article follows in page order.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import written

BROADCAST_ROWS = 50_000
#: Elements nested deeper are siblings of each other, as in browsers.
DEPTH = 512

# HTML's own element kinds.
VOID = {*"area base br col embed hr img input link meta param source track wbr".split()}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
BLOCK = {
    *"address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
}
CLOSES_P = BLOCK - {"br", "option", "select", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SELF_CLOSING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HIDDEN = {*"head title script style noscript template svg annotation annotation-xml canvas object embed audio video iframe noembed noframes xmp map".split()}
DROPPED = HIDDEN | {*"nav footer aside form button select input textarea dialog menu".split()}
LAYOUT = {"div", "section", "ul", "ol", "table", "header", "dl", "center", "details", "fieldset"} | DROPPED - HIDDEN
WHOLE = {"html", "body", "main", "article"}
# Names that sites give to what is not the article: parts of a class or id. Parts that turn a name round spare it.
SPARED = {"no", "non", "not", "without", "with", "has", "is", "hide", "had"}
COMMENTS = {*"comment comments commentlist disqus respond reply replies".split()}
NAMES = COMMENTS | {
    *"ad ads adbox adsense banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar rail menu navbar nav navigation pagination pager toolbar footer foot masthead share sharing social related newsletter subscribe signup login widget hidden".split()
}
# With one of these beside it, a name is still a name inside an article.
BESIDE = {*"area articles bar block box button buttons container form icons inner items links list module posts section slot stories top bottom unit wrap wrapper".split()}
_STEMS = ("advert", "sponsor", "promo", "breadcrumb", "recommend")
_PAIRS = {("site", "header"), ("page", "header"), ("skip", "link"), ("side", "bar")}
ROLES = {*"navigation banner contentinfo complementary search dialog form".split()}
_ATTRS = re.compile(r"""([^\s"'<>/=]+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>""")
_CLOSES = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}


class Node:
    """An element. Filled in by `measure`: text and shape hashes, characters in all and in links, and its part in the page."""

    __slots__ = ("attrs", "chars", "children", "depth", "holds", "inside", "links", "parent", "shape", "tag", "text")

    def __init__(self, tag: str, attrs: str, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.holds = self.inside = False
        self.chars = self.links = self.text = self.shape = 0


def parse(page: str) -> list[Node]:
    """The elements of a page in page order, the root first, with the end tags that HTML lets one leave out."""
    root = at = Node("#root", "", None)
    nodes, opened, pos, end = [root], Counter(), 0, len(page)

    def up_to(node: Node) -> Node:
        """Closes everything from the innermost element to this one."""
        n = at
        while n is not node:
            opened[n.tag] -= 1
            n = n.parent
        opened[node.tag] -= 1
        return node.parent

    while pos < end:
        start = page.find("<", pos)
        if start < 0:
            at.children.append(page[pos:])
            break
        if start > pos:
            at.children.append(page[pos:start])
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            pos = end if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), start):
            mark = "]]>" if page.startswith("<![CDATA[", start) else ">"
            stop = page.find(mark, start)
            pos = end if stop < 0 else stop + len(mark)
            continue
        m = _NAME.match(page, start)
        if m is None:
            at.children.append("<")
            pos = start + 1
            continue
        rest = _REST.match(page, m.end())
        pos = rest.end() if rest else page.find(">", m.end()) + 1
        if not pos:  # a tag that the page breaks off in
            break
        tag, attrs = m[1].lower(), page[m.end() : pos - 1]
        if page[start + 1] == "/":
            node = at if opened[tag] > 0 else root
            while node is not root and node.tag != tag:
                # an inline end tag doesn't close a block
                node = root if tag not in BLOCK and node.tag in ("td", "th", "article", "section", "div", "body") else node.parent
            if node is not root:
                at = up_to(node)
            continue
        if tag in CLOSES_P and opened["p"] > 0:
            node = at
            while node is not root and node.tag != "p" and (node.tag not in BLOCK or node.tag == "br"):
                node = node.parent
            if node.tag == "p":
                at = up_to(node)
        if tag in SELF_CLOSING:
            same, stop_at = SELF_CLOSING[tag]
            node = at if any(opened[t] > 0 for t in same) else root
            while node is not root and node.tag not in same and node.tag not in stop_at:
                node = node.parent
            if node.tag in same:
                at = up_to(node)
        node = Node(tag, attrs, at)
        nodes.append(node)
        at.children.append(node)
        if tag in RAW:
            close = _CLOSES[tag].search(page, pos)
            node.children.append(page[pos : close.start() if close else end])
            pos = page.find(">", close.end()) + 1 or end if close else end
        elif tag not in VOID and not (attrs.endswith("/") and tag in ("svg", "path")) and node.depth < DEPTH:
            at = node
            opened[tag] += 1
    return nodes


def _attributes(node: Node) -> Iterator[tuple[str, str]]:
    for name, *values in _ATTRS.findall(node.attrs) if node.attrs.strip() else ():
        yield name.lower(), next((v for v in values if v), "")


def _parts(value: str) -> Iterator[list[str]]:
    for name in value.lower().split():
        yield re.split(r"[-_:]+", name)


def _named_out(node: Node, half: int) -> bool:
    """Whether an element's names say that it is no part of the article; what holds most of a page is no side matter, unless it is comments."""
    if node.tag in WHOLE or node.holds:
        return False
    for name, value in _attributes(node):
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id", "aria-label", "data-role", "itemprop"):
            for parts in _parts(value):
                if SPARED.isdisjoint(parts):
                    if not COMMENTS.isdisjoint(parts):
                        return True
                    if node.inside and name != "itemprop" and not all(p in BESIDE or p in NAMES or p.startswith(_STEMS) for p in parts):
                        continue  # "related-work", "social-history": the article's own matters
                    if node.inside and parts in (["widget"], ["foot"], ["rail"], ["alert"], ["notes"]):
                        continue
                    if node.chars <= half and (not NAMES.isdisjoint(parts) or any(p.startswith(_STEMS) for p in parts) or any(p in _PAIRS for p in zip(parts, parts[1:]))):
                        return True
    return False


def _is_main(node: Node) -> bool:
    return node.tag in ("article", "main") or 'role="main"' in node.attrs or "articleBody" in node.attrs


def _digest(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def measure(nodes: list[Node]) -> None:
    """Hashes and sizes of all elements, each from those of its children: one step an element, however deep the page."""
    for node in nodes[1:]:
        node.inside = node.parent.inside or _is_main(node.parent)
    for node in reversed(nodes):
        if node.tag in HIDDEN:
            continue
        text, shape, said = [node.tag], [node.tag, *sorted(re.sub(r"\d+", "", n) for name, value in _attributes(node) if name == "class" for n in value.split())], False
        for c in node.children:
            if isinstance(c, str):
                line = " ".join(c.split())
                if line:
                    text.append(line)
                    node.chars += len(line)
                    said = True
            elif c.tag not in HIDDEN:
                text.append(f"<{c.text}")
                if shape[-1] != f"<{c.shape}":  # a list is a list however long
                    shape.append(f"<{c.shape}")
                node.chars += c.chars
                node.links += c.links
                node.holds = node.holds or c.holds or _is_main(c)
        if node.tag == "a":
            node.links = node.chars
        node.text = _digest(*text)
        node.shape = _digest("shape", *shape, "text" if said else "")


def _hashes(node: Node) -> tuple[int, ...]:
    """The hashes by which an element can be a site's template: of its text, and of its shape if it is a list of links."""
    return (node.text, node.shape) if node.links * 3 >= node.chars * 2 and len(node.children) else (node.text,)


def candidates(nodes: list[Node]) -> list[Node]:
    """Elements that can be a site's template: those with layout. A heading, a paragraph or a cell that recurs is text, and what holds the article is none."""
    return [n for n in nodes[1:] if n.chars and n.tag in BLOCK | DROPPED and n.tag not in HIDDEN | WHOLE and not n.holds and not _is_main(n) and n.tag in LAYOUT]


def template_nodes(nodes: list[Node], template: set[int]) -> set[int]:
    """id() of the elements to delete: templates, and what consists of them for two thirds of its text.

    Templates never take more than half of an article's text, nor all of a page that has no article.
    """
    if not template:
        return set()
    able = candidates(nodes)
    gone = {id(n) for n in able if not template.isdisjoint(_hashes(n))}
    if not gone:
        return gone
    taken: dict[int, int] = {}
    allowed = {id(n) for n in able}
    for n in reversed(nodes):
        lost = n.chars if id(n) in gone else sum(taken[id(c)] for c in n.children if isinstance(c, Node))
        if id(n) in allowed and lost * 3 >= n.chars * 2 and lost:
            gone.add(id(n))
            lost = n.chars
        taken[id(n)] = lost
    for n in nodes:
        if _is_main(n) and not n.inside and taken[id(n)] * 2 > n.chars:
            gone -= {id(x) for x in nodes if x.inside}
    if not nodes[0].holds and taken[id(nodes[0])] == nodes[0].chars:
        return set()
    return gone


def _articles(nodes: list[Node], out) -> list[Node]:
    """The outermost article and main elements in page order; of a main element, the articles in it if it has any."""
    found: list[Node] = []
    stack = [nodes[0]]
    while stack:
        node = stack.pop()
        if _is_main(node) and (node.tag != "main" or not node.holds):
            found.append(node)
        else:
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and c.tag not in DROPPED and not out(c))
    return found or [n for n in nodes if n.tag == "main"][:1]


def main_text(page: str | None, template: set[int]) -> tuple[str, int, int, int]:
    """The article's text, blocks in page order with one space between, and how many characters went as templates, by
    their elements' kinds and names, and as what is outside of the article; each character counts for the first of these."""
    nodes = parse(page or "")
    measure(nodes)
    half = nodes[0].chars // 2
    named: dict[int, bool] = {}

    def out(node: Node) -> bool:
        known = named.get(id(node))
        if known is None:
            known = named[id(node)] = _named_out(node, half)
        return known

    gone = template_nodes(nodes, template)
    roots = _articles(nodes, out)
    top = not roots
    first = {id(n) for n in roots or [nodes[0]]}

    def side(c: Node) -> bool:
        return id(c) not in first and (c.tag in DROPPED or out(c) or (c.tag == "header" and top and not c.holds and c.depth <= 3))

    by_template = by_name = 0
    stack: list = [nodes[0]]
    while stack:
        c = stack.pop()
        if isinstance(c, Node) and c.tag not in HIDDEN:
            if id(c) in gone and id(c) not in first:
                by_template += c.chars
            elif side(c):
                by_name += c.chars
            else:
                stack.extend(c.children)
    text: list[str] = []
    kept = 0
    stack = [*reversed(roots or [nodes[0]])]
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            text.append(html.unescape(c) if "&" in c else c)
            kept += len(" ".join(c.split()))
        elif (id(c) in gone and id(c) not in first) or side(c):
            text.append(" ")
        elif c.tag in BLOCK or id(c) in first:
            text.append(" ")
            stack.append(" ")
            stack.extend(reversed(c.children))
        else:
            stack.extend(reversed(c.children))
    return " ".join("".join(text).split()), by_template, by_name, nodes[0].chars - by_template - by_name - kept


def host_of(url: Column) -> Column:
    """The host of a URL, lower case; anything else is the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def site_of(url: Column) -> Column:
    """The sites that a page belongs to: its host, and the section of the host that the path begins with."""
    part = F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([^/?#]+)/", 1), F.lit(""))
    return F.array(host_of(url), F.concat(host_of(url), F.lit("/"), part))


def site_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: float = 0.3, least: int = 10) -> DataFrame:
    """(site, hashes): subtrees on at least `least` pages of their host, or of a section of it, and on a `share` of them.

    Counts are of pages, summed before they are shuffled, so a large host is no large task. A site has at most
    (candidates of a page) / share hashes, however many pages it has.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for sites, page in zip(pdf["sites"], pdf["html"]):
                nodes = parse(page or "")
                measure(nodes)
                hashes = {h for n in candidates(nodes) for h in _hashes(n)}
                rows += [(site, h) for site in sites for h in hashes]
            yield pd.DataFrame(rows, columns=["site", "hash"]).astype({"hash": "int64"})

    own = pages.select(site_of(F.col(url_col)).alias("sites"), F.col(html_col).alias("html"))
    seen = own.mapInPandas(run, "site string, hash long").groupBy("site", "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    sizes = own.select(F.explode("sites").alias("site")).groupBy("site").agg(F.count("*").alias("pages"))
    return seen.join(sizes, "site").filter(F.col("n") >= share * F.col("pages")).groupBy("site").agg(F.collect_set("hash").alias("hashes"))


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: float = 0.3, least: int = 10) -> DataFrame:
    """pages, without the html, with columns text, n_chars (code points), n_template, n_named and n_outside.

    The last three are the characters that went as templates of the site, by their elements' kinds and names, and as what
    lies outside of the article; each counts for the first that applies. Null and empty pages give an empty text; a null or
    odd URL is of the empty host. A page without article or main element gives what is left of its body. A page is parsed in
    one task, whole, however long. Repeated rows are counted each and answered each; an empty table stays empty; columns named
    like the new ones give way. The table of templates is broadcast only if it has at most BROADCAST_ROWS hashes.
    """
    templates = written(site_templates(pages, url_col, html_col, share, least), "site-templates")
    small = (templates.agg(F.sum(F.size("hashes")).alias("n")).first()["n"] or 0) <= BROADCAST_ROWS
    joined = pages.withColumn("__sites", site_of(F.col(url_col)))
    for i in (0, 1):
        named = templates.select(F.col("site").alias(f"__site{i}"), F.col("hashes").alias(f"__hashes{i}"))
        joined = joined.join(F.broadcast(named) if small else named, F.col("__sites")[i] == F.col(f"__site{i}"), "left").drop(f"__site{i}")
    fresh = {"text": "string", "n_chars": "long", "n_template": "long", "n_named": "long", "n_outside": "long"}
    keep = [f for f in pages.columns if f not in (html_col, *fresh)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [main_text(page, {*(() if a is None else a), *(() if b is None else b)}) for page, a, b in zip(pdf[html_col], pdf["__hashes0"], pdf["__hashes1"])]
            texts, *counts = zip(*found) if found else [()] * 4
            more = dict(zip(fresh, (texts, [len(t) for t in texts], *counts)))
            yield pdf[keep].assign(**{name: pd.Series(values, index=pdf.index, dtype="object" if name == "text" else "int64") for name, values in more.items()})

    schema = joined.select(*keep)
    for name, kind in fresh.items():
        schema = schema.withColumn(name, F.lit(None).cast(kind))
    return joined.select(*keep, html_col, "__hashes0", "__hashes1").mapInPandas(run, schema.schema)
