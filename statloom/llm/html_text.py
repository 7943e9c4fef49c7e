"""Main text of web pages by composite text density.

Each page becomes a small tree.  Parts that are never article text (menus, forms, scripts, adverts, comments
and the like, told by tag, role, class or id) are taken out first.  Every node then gets its composite density:
characters per tag, raised where little of the text is link text.  The node whose children's densities have the
largest sum is the core of the page.  The article or main element around it is kept whole; on a page without
one, the containers around it are kept as far up as most of the text beside it stands in lines like the core's.
Outside of that, headings, nodes whose lines are like the core's (or, where the page names its article, further
articles of such lines) and nodes at or above the smallest density on the path from the core up to the body are kept.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from statloom.llm.common import fresh, on_workers

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
DROPPED = RAW_TEXT | frozenset(
    "head nav footer aside button select option input svg math canvas object audio video map dialog menu".split())
BLOCKS = frozenset(
    "html body main article section div header footer aside nav p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre "
    "figure figcaption form table caption thead tbody tfoot tr td th address fieldset details summary center hgroup hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p blockquote pre".split())
#: A line outside the core is like the core's if it has this share of the length of the core's middle line.
LINE_SHARE = 0.25
#: An opening tag of the key closes an open element of the value, unless one of the walls lies between.
CLOSES = {
    "li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "option": ("option", {"select"}),
    "tr": ("tr", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}),
    "thead": ("thead tbody tfoot", {"table"}), "tbody": ("thead tbody tfoot", {"table"}), "tfoot": ("thead tbody tfoot", {"table"}),
}
#: Elements whose end tag may be left out.
OPEN_ENDED = frozenset("p li dt dd tr td th thead tbody tfoot".split())
#: Names in a class or id that mark a part as not belonging to the article.
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner comment comments "
    "disqus respond reply replies nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars widget widgets "
    "footer header masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations pagination pager skip toolbar "
    "copyright disclaimer legal hidden".split())
#: Words that may stand beside them in a name: "comment-list" and "sidebar-left" are such parts, "share-price" is not.
PLAIN = frozenset(
    "area bar block box btn button buttons card cards container count form group icon icons inner item items label left line "
    "link links list main panel region right row side site slot space title top bottom tool tools unit wrap wrapper zone page "
    "global primary secondary mobile desktop js module component news more read".split())
#: Words for the article itself: "post-comments" is an unwanted part of it, "post-header" holds its headline.
OWN = frozenset("article articles post posts entry story stories content section text body".split())
HEADERS = frozenset("header banner masthead".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
MARKUP = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|--!>|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?P<shut>>)?",
    re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
EPSILON = 1e-9


class Node:
    __slots__ = ("tag", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.parts = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0

    @property
    def children(self) -> list[Node]:
        return [x for x in self.parts if isinstance(x, Node)]


def unwanted_name(name: str) -> bool:
    """Whether a class or id says, as a whole, that its part does not belong to the article."""
    words = WORD.findall(CAMEL.sub("-", name).lower())
    marks = UNWANTED.intersection(words)
    if not marks or not marks.union(PLAIN, OWN).issuperset(words):
        return False
    return not (marks <= HEADERS and OWN.intersection(words))


def unwanted(tag: str, attrs: str, open_tags: list[str]) -> bool:
    """Whether an element and all it holds are left out."""
    if tag in DROPPED:
        return True
    if tag == "header" and {"article", "main"}.isdisjoint(open_tags):
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            if any(map(unwanted_name, value.split())):
                return True
            continue
        value = value.lower()
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def closed_by(tag: str, open_tags: list[str]) -> int | None:
    """The place of the outermost of the open elements that an opening tag ends, if it ends any."""
    if tag in BLOCKS and "p" in open_tags:
        return open_tags.index("p")
    if tag in CLOSES:
        shut, walls = CLOSES[tag]
        for k in range(len(open_tags) - 1, 0, -1):
            if open_tags[k] in walls:
                break
            if open_tags[k] in shut.split():
                return k
    return None


def parse(page: str) -> Node:
    """The tree of a page without its unwanted parts; forgiving about missing end tags."""
    root = node = Node("body", None)
    open_tags = ["body"]
    at, low, forms = 0, None, []

    def close(upto: int):
        nonlocal node
        while len(open_tags) > upto:
            open_tags.pop()
            node = node.parent

    def skip(tag: str, pos: int) -> int:
        """The place behind the end of the unwanted element that was opened just before pos."""
        nonlocal low
        if tag in VOID:
            return pos
        if tag in RAW_TEXT:
            low = page.lower() if low is None else low
            end = low.find(f"</{tag}", pos)
            if end < 0:
                return len(page)
            end = page.find(">", end)
            return len(page) if end < 0 else end + 1
        if tag in OPEN_ENDED:
            inside = [*open_tags, tag]
            while m := MARKUP.search(page, pos):
                pos, name = m.end(), (m["name"] or "").lower()
                if m["end"]:
                    if name in BLOCKS and name in inside and name not in ("body", "html"):
                        k = len(inside) - 1 - inside[::-1].index(name)
                        if k <= len(open_tags):  # its own end, or the parent ends first
                            return pos if k == len(open_tags) else m.start()
                        del inside[k:]
                    continue
                if name in BLOCKS and name not in ("body", "html"):
                    while (k := closed_by(name, inside)) is not None:
                        if k <= len(open_tags):
                            return m.start()
                        del inside[k:]
                    if name not in VOID:
                        inside.append(name)
                elif name in DROPPED:
                    pos = skip(name, pos)
            return len(page)
        depth = 1
        for m in MARKUP.finditer(page, pos):
            name = (m["name"] or "").lower()
            if m.start() < pos or not name:
                continue
            if name == tag:
                depth += -1 if m["end"] else 1
                if not depth:
                    return m.end()
            elif m["end"] and name in BLOCKS and name in open_tags and tag not in ("nav", "aside", "form", "footer", "header", "div", "section"):
                return m.start()  # the parent ends first
            elif name in RAW_TEXT and not m["end"]:
                pos = skip(name, m.end())
        return len(page)

    while at < len(page):
        m = MARKUP.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            node.parts.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        if not m["name"]:
            continue
        if not m["shut"]:  # a quote that is never closed: the tag ends at the next bracket
            end = page.find(">", m.start())
            if end < 0:
                node.parts.append(html.unescape(page[m.start():]))
                break
            at = end + 1
        tag = m["name"].lower()
        if m["end"]:
            if tag == "br":
                node.parts.append(" ")
            elif tag in open_tags and tag not in ("body", "html"):
                close(len(open_tags) - 1 - open_tags[::-1].index(tag))
            continue
        if tag in ("html", "body"):
            continue
        while (k := closed_by(tag, open_tags)) is not None:
            close(k)
        if unwanted(tag, m["attrs"], open_tags):
            at = skip(tag, at)
            continue
        if tag in VOID:
            if tag in BLOCKS:
                node.parts.append(Node(tag, node))
            elif tag == "br":
                node.parts.append(" ")
            continue
        child = Node(tag, node)
        node.parts.append(child)
        if tag == "form":
            forms.append(child)
        if not m["attrs"].endswith("/") or tag in BLOCKS or tag in ("a", "b", "i", "span", "em", "strong"):
            node = child
            open_tags.append(tag)
    if forms:
        drop_forms(root, forms)
    return root


def drop_forms(root: Node, forms: list[Node]) -> None:
    """Take out the forms that are forms; one around the article, or around most of the page in paragraphs, is a container."""
    nodes = weigh(root)
    prose: dict[int, int] = {}
    for node in reversed(nodes):
        prose[id(node)] = node.chars if node.tag in PARAGRAPHS or node.tag in HEADINGS else sum(prose[id(k)] for k in node.children)
    named = {id(n) for n in nodes if n.tag in ("article", "main")}
    for form in forms:
        holds = any(id(n) in named for n in _ordered(form)) if named else form.chars * 2 > root.chars and prose[id(form)] * 2 > form.chars
        if not holds:
            form.parent.parts = [x for x in form.parent.parts if x is not form]


def _ordered(root: Node) -> list[Node]:
    """All nodes, parents before children; no recursion, as pages may nest thousands deep."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def weigh(root: Node) -> list[Node]:
    """Set counts, composite densities and density sums; returns all nodes in page order."""
    nodes = _ordered(root)
    for node in reversed(nodes):
        own = sum(len(x.strip()) for x in node.parts if isinstance(x, str))
        kids = node.children
        node.chars = own + sum(k.chars for k in kids)
        node.tags = sum(k.tags + 1 for k in kids)
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        else:
            node.link_chars, node.link_tags = sum(k.link_chars for k in kids), sum(k.link_tags for k in kids)
    body_ratio = root.link_chars / max(root.chars, 1)
    for node in reversed(nodes):
        if node.chars:
            c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
            base = math.log(c / max(c - lc, 1) * lc + body_ratio * c + math.e) + 1.0  # + 1: a page without links would divide by log 1
            node.density = c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0) + 1.0) / base
        kids = node.children
        node.total = sum(k.density for k in kids) + (node.density if not kids else 0.0)
    return nodes


def lines_of(nodes: list[Node]) -> dict[int, tuple[int, int]]:
    """Characters and link characters of the text that stands in each block itself, not in blocks inside it."""
    holds, out = {}, {}
    for node in reversed(nodes):
        kids = node.children
        holds[id(node)] = any(k.tag in BLOCKS or holds[id(k)] for k in kids)
        flat = [k for k in kids if k.tag not in BLOCKS and not holds[id(k)]]
        if node.tag in BLOCKS or holds[id(node)]:
            out[id(node)] = (sum(len(x.strip()) for x in node.parts if isinstance(x, str)) + sum(k.chars for k in flat),
                             sum(k.link_chars for k in flat))
    return out


def prose_of(nodes: list[Node], core: Node) -> dict[int, int]:
    """Characters of each node that stand in lines like those of the core: mostly not links, and not much shorter."""
    lines = lines_of(nodes)
    own = sorted(c - lc for n in _ordered(core) if n.tag not in HEADINGS for c, lc in [lines.get(id(n), (0, 0))] if c > 2 * lc)
    least = own[len(own) // 2] * LINE_SHARE if own else 0
    out = {}
    for node in reversed(nodes):
        c, lc = lines.get(id(node), (0, 0))
        out[id(node)] = (c if c > 2 * lc and c - lc >= least else 0) + sum(out[id(k)] for k in node.children)
    return out


def widened(core: Node, prose: dict[int, int]) -> Node:
    """The article around the core: the element that says so, or else as far up as the text beside it is prose too."""
    for tag in ("article", "main"):
        node = core
        while node is not None:
            if node.tag == tag:
                return node
            node = node.parent
    node = core
    while node.parent is not None and node.parent.parent is not None:
        beside = [k for k in node.parent.children if k is not node]
        rest = node.parent.chars - node.chars - sum(k.chars for k in beside if k.tag in HEADINGS)
        # a paragraph right beside the core belongs to it at any length
        like = prose[id(node.parent)] - prose[id(node)] + sum(
            k.chars - prose[id(k)] for k in beside if k.tag in PARAGRAPHS and k.link_chars * 2 < k.chars) - sum(
            prose[id(k)] for k in beside if k.tag in HEADINGS)
        if like * 2 < rest:
            break
        node = node.parent
    return node


def chosen(root: Node) -> list[Node]:
    """The subtrees that make up the main text, in page order."""
    nodes = weigh(root)
    core = max(nodes, key=lambda n: n.total)  # the first in page order among equals
    # blocks are kept whole: the core of a lone paragraph is the paragraph's container
    while core.parent is not None and core.tag not in BLOCKS:
        core = core.parent
    threshold, node = core.density, core
    while node is not None:
        threshold, node = min(threshold, node.density), node.parent
    prose = prose_of(nodes, core)
    core = widened(core, prose)
    named = core.tag in ("article", "main")
    taken, path = [core], set()
    node = core
    while node is not None:
        path.add(id(node))
        node = node.parent
    stack = [k for n in nodes if id(n) in path and n is not core for k in n.children if id(k) not in path]
    beside = set(map(id, stack))
    while stack:
        node = stack.pop()
        # text like the core's counts without regard to the containers; where the page names its article, only in further ones
        like = prose[id(node)] * 2 > node.chars or node.tag in PARAGRAPHS and id(node) in beside
        if node.link_chars * 2 < node.chars and (
                node.tag in HEADINGS or node.density >= threshold - EPSILON or like and (not named or node.tag == "article")):
            taken.append(node)
        else:
            stack.extend(node.children)
    keep = set(map(id, taken))
    return [n for n in nodes if id(n) in keep]


def blocks(root: Node) -> list[str]:
    """Text of the blocks of a subtree, white space turned into single blanks, empty blocks left out."""
    out, line = [], []

    def end():
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            line.append(x)
        elif x is None:
            end()
        else:
            inner = x.parts
            if x.tag in BLOCKS:
                end()
                stack.append(None)
            stack.extend(reversed(inner))
    end()
    return out


def main_text(page: str | None) -> str:
    """The main text of one page; blocks joined by line feeds, empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    own = any(isinstance(x, str) and x.strip() for x in root.parts)
    parts = [root] if own and not any(k.chars for k in weigh(root)[1:]) else chosen(root)
    return "\n".join(t for n in parts for t in blocks(n))


def extract_text(df: DataFrame, html_col: str = "html", text_out: str = "text", chars_out: str = "n_chars",
                 keep: list[str] | None = None) -> DataFrame:
    """Add the main text of each page and its number of code points; `keep` names the columns to carry along.

    Defined cases: a null or empty page has an empty text; a page without markup is its own text; repeated
    pages get equal texts; columns that bear the names of the outputs are replaced; pages of any length and
    depth are read whole.  Each page is read on its own, so nothing is shuffled.
    """
    on_workers(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c not in (text_out, chars_out)]
    work = fresh(df, "page")
    frame = df.select(*[df[f"`{c.replace('`', '``')}`"] for c in keep], df[f"`{html_col}`"].alias(work))
    schema = T.StructType([*frame.schema.fields[:-1], T.StructField(text_out, T.StringType()), T.StructField(chars_out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    [*part.schema.names[:-1], text_out, chars_out])

    return frame.mapInArrow(run, schema)
