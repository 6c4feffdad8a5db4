"""HTML extraction by composite text density."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortwell.llm.arrow import sliced
from sortwell.session import evenly, map_arrow, table

# Fixed values of HTML: elements without an end tag; elements that start a block; elements whose start closes an open paragraph or sibling.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option p pre search section summary table caption thead tbody tfoot tr td th title ul".split())
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "option": "option", "tr": "tr td th", "td": "td th", "th": "td th", "thead": "thead tbody tfoot tr td th", "tbody": "thead tbody tfoot tr td th", "tfoot": "thead tbody tfoot tr td th"}
#: Where the search for a sibling to close ends.
SCOPE = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "option": "select datalist", "tr": "table", "td": "table tr", "th": "table tr", "thead": "table", "tbody": "table", "tfoot": "table"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements that never hold text of the page: they leave the tree. CONTROLS that are left open end at the next block.
NEVER = frozenset("head title script style noscript template svg canvas iframe object audio video datalist map annotation annotation-xml".split())
CONTROLS = frozenset("button select textarea".split())
#: Evidence against a block, which density weighs: elements (a header outside of an article), roles, and words that are the whole or the last part of a class or id.
SIDE = frozenset("nav footer aside form menu dialog header".split())
SIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
SIDE_WORDS = frozenset("ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
#: Names of what readers add, which density can't tell from the main text.
READER_WORDS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
#: How much of its density such a block keeps.
SIDE_WEIGHT, READER_WEIGHT = 1 / 64, 0.0
#: Elements that hold other blocks without being prose themselves, and those that are prose.
GENERIC = frozenset("#page html body article aside center details dialog div fieldset footer form header hgroup main nav search section".split())
PROSE = frozenset("p pre blockquote li dt dd td th".split())
#: Share of the main block's density sum that other text needs which isn't in an element of prose.
BESIDE = 1.0
_WORDS = re.compile(r"[a-z0-9]+")
#: The start of a tag, comment or declaration.
_OPEN = re.compile(r"<[A-Za-z/!?]")


def _invisible(tag: str, attrs: dict[str, str | None]) -> bool:
    if tag in ("html", "body", "article", "main"):
        return False
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower()


def _name_words(names: str | None) -> list[list[str]]:
    """Words of each name, without numbers at the end."""
    out = []
    for name in (names or "").split():
        words = _WORDS.findall(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name).lower())
        while len(words) > 1 and words[-1].isdigit():
            words.pop()
        out.append(words)
    return out


def _named(tag: str, attrs: dict[str, str | None]) -> tuple[frozenset[str], frozenset[str]]:
    """The words of the class and of the id that speak against the element.

    Headings and links are never judged by name, other inline elements not by their
    id, since such an id is an anchor; an article only by names of readers' additions.
    """
    none = frozenset()
    if tag in ("html", "body", "main", "a") or tag in HEADINGS or not (attrs.get("class") or attrs.get("id")):
        return none, none
    classes, ids = _name_words(attrs.get("class")), _name_words(attrs.get("id"))
    if any(w in ("with", "has", "no", "without") for ws in classes + ids for w in ws):
        return none, none
    against = READER_WORDS if tag == "article" else READER_WORDS | SIDE_WORDS
    last = lambda names: frozenset(ws[-1] for ws in names if ws and ws[-2:] != ["overflow", "hidden"]) & against
    return last(classes), last(ids) if tag in BLOCK else none


class Node:
    """A block of the page. Inline elements count as tags of the block they stand in."""

    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "sum", "best", "kept", "names", "weight", "prose")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.children = tag, parent, []
        self.chars = self.link_chars = self.link_tags = 0
        self.tags = 1
        self.density = self.sum = 0.0
        self.best, self.kept = self, False
        self.names: tuple[frozenset[str], frozenset[str]] = (frozenset(), frozenset())
        self.weight = 1.0
        self.prose = tag in PROSE
        if parent is not None:
            parent.children.append(self)


class Line:
    """Text of one block up to a line break or another block. Inline elements count as its tags, line breaks do not."""

    __slots__ = ("node", "chars", "tags", "link_chars", "link_tags")

    def __init__(self, node: Node) -> None:
        self.node, self.tags = node, 1
        self.chars = self.link_chars = self.link_tags = 0


class Run:
    """Text that stands directly in a block, up to another block: a leaf beside the block's children."""

    __slots__ = ("node", "parts", "lines", "density", "kept", "sure")

    def __init__(self, node: Node) -> None:
        self.node, self.parts, self.lines = node, [], []
        self.density, self.kept = 0.0, False
        self.sure = False  # whether any of it stands outside of inline elements with names against them


class Page(HTMLParser):
    """A tolerant tree of blocks, and the page's text in runs of one block each."""

    def __init__(self, left_open: frozenset[str] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.left_open = left_open  # controls without their end tags
        self.root = self.node = Node("#page", None)
        self.body: Node | None = None
        self.stack: list[tuple[str, bool, bool, Node]] = []  # open tag, whether it is skipped, whether its name is against it, the block outside it
        self.open: Counter[str] = Counter()
        self.skips = self.links = self.doubts = 0
        self.runs: list[Run] = []
        self.fresh = True
        self.line: Line | None = None
        self.doubted: list[Node] = []  # blocks with evidence against them

    def parse_marked_section(self, i, report=1):  # a bogus comment in HTML
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def close(self) -> None:
        """What is left is text, or a tag or comment that never ends, which takes the rest of the page with it.

        It is decided once here; trying every later ``<`` of such a rest again would be
        quadratic.
        """
        if self.cdata_elem is not None or _OPEN.match(self.rawdata):
            self.rawdata = ""
        super().close()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.fresh, self.line = True, None
            if tag != "option":
                for control in self.left_open:
                    if self.open[control]:
                        self._close(control)
            if tag in CLOSES:
                self._close_among(CLOSES[tag].split(), SCOPE[tag].split())
            if self.open["p"]:
                self._close("p")
        named = dict(attrs)
        names = _named(tag, named) if attrs else (frozenset(), frozenset())
        skip = tag in NEVER or tag in CONTROLS or _invisible(tag, named)
        # an inline element has no density of its own; its name decides on text that stands alone
        doubt = any(names) and tag not in BLOCK
        if tag in VOID:
            if not self.skips and not skip:
                self.node.tags += 1
                if tag != "br":
                    self._line().tags += 1
                else:
                    self.line = None
                    if self.runs and not self.fresh:
                        self.runs[-1].parts.append(" ")
            return
        if tag in ("html", "body") and self.open[tag]:
            return
        in_math = self.open["math"] > 0  # a formula is one tag
        in_article = self.open["article"] or self.open["main"]
        self.stack.append((tag, skip, doubt, self.node))
        self.open[tag] += 1
        self.skips += skip
        self.doubts += doubt
        self.links += tag == "a"
        if self.skips:
            return
        if tag in BLOCK:
            self.node = Node(tag, self.node)
            if tag == "body" and self.body is None:
                self.body = self.node
            role = (named.get("role") or "").lower() in SIDE_ROLES and tag not in ("body", "main", "article")
            if any(names) or role or (tag in SIDE and not (tag == "header" and in_article)):
                self.node.names = names
                self.node.weight = READER_WEIGHT if not READER_WORDS.isdisjoint(names[0] | names[1]) else SIDE_WEIGHT
                self.doubted.append(self.node)
        elif not in_math:
            self.node.tags += 1
            self._line().tags += 1
        if tag == "a":
            self.node.link_tags += 1
            self._line().link_tags += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.fresh, self.line = True, None
        if self.open[tag] and tag not in ("html", "body"):
            self._close(tag)

    def _pop(self) -> str:
        tag, skip, doubt, self.node = self.stack.pop()
        self.open[tag] -= 1
        self.skips -= skip
        self.doubts -= doubt
        self.links -= tag == "a"
        return tag

    def _close(self, tag: str) -> None:
        while self._pop() != tag:
            pass

    def _close_among(self, tags: list[str], scope: list[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] in scope:
                return
            if self.stack[at][0] in tags:
                last = at
                while last > 0 and self.stack[last - 1][0] in tags:
                    last -= 1
                while len(self.stack) > last:
                    self._pop()
                return

    def _line(self) -> Line:
        if self.line is None or self.line.node is not self.node:
            self.line = Line(self.node)
        return self.line

    def handle_data(self, data):
        if self.skips:
            return
        n = len("".join(data.split()))
        counts = 0 if self.doubts else n
        self.node.chars += counts
        if self.links:
            self.node.link_chars += counts
        if self.fresh or not self.runs or self.runs[-1].node is not self.node:
            if not n:
                return
            self.runs.append(Run(self.node))
            self.fresh = False
        run = self.runs[-1]
        run.parts.append(data)
        if counts:
            run.sure = True
            line = self._line()
            if not run.lines or run.lines[-1] is not line:
                run.lines.append(line)
            line.chars += n
            if self.links:
                line.link_chars += n


def _in_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.children))
    return out


def composite_density(node: Node | Line, body_chars: int, body_link_chars: int) -> float:
    """Characters per tag, on a logarithmic scale less the more of them are in links; zero counts under a quotient are one."""
    if not node.chars:
        return 0.0
    c, t, lc, lt = node.chars, node.tags, node.link_chars, node.link_tags
    base = math.log(c / max(1, c - lc) * lc + body_link_chars / max(1, body_chars) * c + math.e)
    if base <= 1 + 1e-12:
        return c / t  # no link anywhere: nothing to adjust for
    return c / t * math.log(max(1.0, c / max(1, lc) * (t / max(1, lt)))) / math.log(base)


def _value(node: Node) -> float:
    """What a block adds to its parent's density sum. A block of lines only counts by its lines, so line breaks do not thin its text."""
    return node.weight * (node.density if node.children else max(node.density, node.sum))


def _measure(root: Node, runs: dict[int, list[Run]]) -> list[Node]:
    """The blocks of ``root`` in order, with their densities, sums and best blocks."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        for run in runs.get(id(node), ()):
            run.density = sum(composite_density(line, root.chars, root.link_chars) for line in run.lines)
            node.sum += run.density
        node.density = composite_density(node, root.chars, root.link_chars)
        # containers compete with the body for being the main block, so they do not make it one
        node.sum += sum(_value(child) for child in node.children if node is not root or child.tag not in GENERIC)
        for child in node.children:
            if child.weight * child.best.sum > node.best.sum:
                node.best = child.best
    return nodes


def _total(nodes: list[Node]) -> None:
    """Add up characters and tags of the blocks inside each of ``nodes``, a tree in order."""
    for node in reversed(nodes):
        for child in node.children:
            node.chars += child.chars
            node.tags += child.tags
            node.link_chars += child.link_chars
            node.link_tags += child.link_tags
            node.prose |= child.prose


def _believed(page: Page, body: Node, nodes: list[Node], runs: dict[int, list[Run]]) -> list[Node]:
    """Drop the evidence that the page itself refutes; the blocks for which only their share of the text speaks.

    A block whose id is made from its heading is named for its subject. One that holds
    the page's ``main``, or most of the page's text outside of links while no other
    article or ``main`` has any, is a layout; readers' additions may be most of the
    text, and are doubted until all the rest is less than a tenth.
    """
    by_share = []
    at = {id(node): k for k, node in enumerate(nodes)}
    end = list(range(1, len(nodes) + 1))  # past the last block inside each
    for k in range(len(nodes) - 1, 0, -1):
        up = at[id(nodes[k].parent)]
        end[up] = max(end[up], end[k])
    is_main = [node.tag in ("article", "main") and node.chars > 0 and node.weight == 1 for node in nodes]
    before = list(accumulate(is_main, initial=0))  # mains ahead of each place
    tops = list(accumulate((m and node.tag == "main" for m, node in zip(is_main, nodes, strict=True)), initial=0))
    around = [0] * len(nodes)  # mains around each
    for k in range(1, len(nodes)):
        up = at[id(nodes[k].parent)]
        around[k] = around[up] + is_main[up]
    heading = [len(nodes)] * (len(nodes) + 1)  # the first one from each place on
    for k in range(len(nodes) - 1, -1, -1):
        heading[k] = k if nodes[k].tag in HEADINGS else heading[k + 1]
    ahead: dict[int, Node] = {}  # the block beside and in front of each
    for node in nodes:
        ahead |= {id(b): a for a, b in pairwise(node.children)}
    plain = lambda node: node.chars - node.link_chars

    for node in page.doubted:
        k = at.get(id(node))
        if k is None:
            continue
        by_class, by_id = node.names
        # the heading that it begins with or follows
        near = [nodes[heading[k]]] if heading[k] < end[k] else []
        near += [x for x in [ahead.get(id(node))] if x is not None and x.tag in HEADINGS]
        others = before[-1] - (before[end[k]] - before[k]) - around[k]
        if by_id and not by_class and by_id.isdisjoint(READER_WORDS - {"discussion"}) and _titled(node, near, runs):
            node.weight = 1.0
        elif tops[end[k]] - tops[k + 1] > 0:
            node.weight = 1.0
        elif plain(node) > plain(body) * (0.5 if node.weight == SIDE_WEIGHT else 0.9) and not others:
            node.weight = 1.0
            by_share.append(node)
    return by_share


def _titled(node: Node, headings: list[Node], runs: dict[int, list[Run]]) -> bool:
    """Whether the id of ``node`` is made from one of ``headings``."""
    for heading in headings:
        title = _WORDS.findall("".join(p for x in _in_order(heading) for run in runs.get(id(x), ()) for p in run.parts).lower())
        if node.names[1] <= set(title):
            return True
    return False


def _keep(nodes: list[Node], runs: list[Run], by_share: list[Node] = ()) -> None:
    """Mark the content among ``nodes``, those of a whole tree, and ``runs``.

    Where the main block is within one of ``by_share``, half the threshold is enough for
    prose beside it.
    """
    root = nodes[0]
    main = root.best
    path = [main]
    while path[-1] is not root:
        path.append(path[-1].parent)
    threshold = min(node.density for node in path)
    around = {id(node) for node in path}
    least = threshold / 2 if any(id(node) in around for node in by_share) else threshold
    # how much of its density a block keeps, with the blocks around it
    trust = {id(root): root.weight}
    for node in nodes[1:]:
        trust[id(node)] = trust[id(node.parent)] * node.weight
    above = [id(main)]
    if main is root:
        # the text stands in the body itself; its containers have to show that they belong to it
        for run in runs:
            run.kept = run.node is root
        for child in root.children:
            child.kept = child.prose and child.tag not in GENERIC and child.link_chars * 2 < child.chars or child.tag in HEADINGS
    else:
        main.kept = True
        for run in runs:
            run.kept = id(run.node) in around and run.node is not main and run.density >= max(threshold, BESIDE * main.sum)
    for node in nodes:
        if node.chars and id(node) not in above and trust[id(node)] * (node.density if node.children else max(node.density, node.sum)) >= least:
            best = node.best
            if best is not root and (best.prose or trust[id(best)] * max(best.density, best.sum) >= BESIDE * main.sum):
                best.kept = True
    for node in nodes[1:]:  # parents come before children
        if node.parent.kept and node.parent is not root:
            node.kept = trust[id(node)] == 1 or trust[id(node)] * max(node.density, node.sum) >= threshold
        elif node.tag in HEADINGS and id(node.parent) in around and trust[id(node)] == 1:
            node.kept = True


def main_text(html: str | None) -> str:
    """The text of the main content: its blocks in page order, one a line.

    Every block gets its composite density, then the sum of its children's and of its
    own lines'. The block with the largest sum is the main one, and the least density on
    the path from it to the body is the threshold: under every other block that reaches
    it the subtree with the largest sum is content as well, if it is prose or much
    beside the main block, and so are headings beside content.

    Elements, roles and names that speak against a block take most of its density, also
    inside the content, and leave the choice to density: there is no list by which a
    block of text is left out of the tree. Evidence that the page refutes counts for
    nothing (see ``_believed``). Ties go to the block further out.
    """
    html = html or ""
    lower = html.lower()
    page = Page(frozenset(c for c in CONTROLS if lower.count(f"<{c}") > lower.count(f"</{c}")))
    page.feed(html)
    page.close()
    body = page.body or page.root
    runs: dict[int, list[Run]] = {}
    for run in page.runs:
        runs.setdefault(id(run.node), []).append(run)
    nodes = _in_order(body)
    _total(nodes)
    by_share = _believed(page, body, nodes, runs)
    _keep(_measure(body, runs), page.runs, by_share)
    blocks = (" ".join("".join(run.parts).split()) for run in page.runs if run.sure and (run.kept or run.node.kept))
    return "\n".join(b for b in blocks if b)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``pages`` as a struct) and ``out_col``, the main text.

    A null or empty page, and one without text, gives the empty string. Pages are
    read whole, however long, each on its own; repeated rows give repeated results.
    Columns keep their names inside ``row``, so none can clash. An empty table gives no
    rows.
    """
    kept = pages.select(F.struct("*").alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inner = batch.column(0)
            for part in sliced(iter([pa.RecordBatch.from_arrays([inner, inner.field(html_col)], names=["row", "text"])])):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([main_text(t.as_py()) for t in part.column(1)], pa.string())], names=["row", out_col])

    return map_arrow(kept, run, T.StructType([kept.schema["row"], T.StructField(out_col, T.StringType())]))


def op3_html_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = evenly(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return extract(pages).select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
