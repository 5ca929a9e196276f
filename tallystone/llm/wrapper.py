"""Main text of web pages by wrapper induction.

For each host one page is the reference tree. Every page of the host is aligned with it by simple
tree matching: equal roots match, and their children are aligned in order for the largest total
of matched nodes. What the aligned pages have in common makes the host's wrapper:

- a reference text that is the same nearly everywhere is template and goes, whatever its name;
- the others are slots. A block whose slots hold link texts nearly only is a menu and goes;
- a block that holds most of the varying text is content and stays, unless it is named an advert, a notice or comments.

Tags and names (nav, footer, class="ad") break the tie that alignment leaves open: slots that
vary as the article does but are adverts, notices or comments. They never apply to body, main or
article, nor to what surrounds the page's only article. A class or id counts as a whole word, and one
that names a place (sidebar, search, header) never takes most of a page's own text.

Defined cases: a null html is empty and has no text. Pages without a host share one group. A host
with too few differing pages has no wrapper, and its pages rely on names alone. A page that
repeats over 95 % of the reference may be a copy of it, and has no vote on what stands in article or
main; without these tags, pages that are copies nearly all over a host look like its frame. Children are matched exactly up to 40,000 pairs under one parent, and in
order by tag and class beyond, so that wide pages take linear time. A null page_id is kept;
repeated rows each get a row. Extra input columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import shared_dir, written

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|([^<]+|<)",
    re.S | re.I,
)
_attribute = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_space = re.compile(r"\s+")
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a block; all others begin and end blocks.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br img wbr".split())
#: Which open elements a start tag closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Regions that are not the article, by tag.
APART = frozenset("nav footer aside form button select option dialog menu head".split())
#: And by a class, id or role that is one of these words, or made of one and the words around it below; has-sidebar or social-history are not.
_firm = r"ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo|cookies?|consent|notices?|alert|popup|modal|comments?|replies|respond|disqus"
_place = r"menu|nav(?:bar|igation)?|sidebar|side|footer|header|masthead|breadcrumbs?|share|social|related|newsletter|subscribe|login|search|complementary|contentinfo"
_before = r"site|page|main|global|top|bottom|left|right|primary|secondary|sticky|mobile|user|reader|cookie|ad|post|entry"
_after = r"bar|box|area|block|wrap(?:per)?|container|inner|list|links?|widget|section|panel|slot|unit|form|thread|posts|notice|consent|banner|menu|nav"
_named = rf"(?i)(?:(?:{_before})[-_])?(?:{{}})(?:[-_](?:{_after}))*"
_apart = re.compile(_named.format(f"{_firm}|{_place}"))
#: Adverts, notices and comments may well be longer than the article; only words of a place are void around most of a text.
_always = re.compile(_named.format(_firm))


#: Elements to which names never apply.
WHOLE = frozenset(("html", "body", "main", "article"))


class Node:
    """An element, or a ``#text`` leaf. named: its own tag or class says that it is not the article."""

    __slots__ = ("tag", "mark", "kids", "text", "shape", "size", "named", "main", "link", "by_mark", "firm")

    def __init__(self, tag: str, mark: str = "") -> None:
        self.tag, self.mark, self.kids, self.text = tag, mark, [], ""
        self.shape = self.size = 0
        self.named = self.main = self.link = self.by_mark = self.firm = False


def parse(html: str | None) -> Node:
    """A forgiving tree of elements, with one ``#text`` leaf for each run of text."""
    root = Node("#root")
    stack, opened = [root], Counter()

    def close(i: int) -> None:
        for node in stack[i:]:
            opened[node.tag] -= 1
        del stack[i:]

    for m in _token.finditer(html or ""):
        raw, end, tag, attributes, text = m.groups()
        if text:
            if text.isspace() and not (stack[-1].kids and stack[-1].kids[-1].tag in INLINE | {"#text"}):
                continue
            leaf = Node("#text")
            leaf.text = entities.unescape(text) if "&" in text else text
            leaf.link, leaf.main = stack[-1].link, stack[-1].main
            stack[-1].kids.append(leaf)
        elif raw or not tag:
            continue
        elif end:
            tag = tag.lower()
            for i in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break  # a stray inline end tag does not close a block
        else:
            tag = tag.lower()
            closes = CLOSES.get(tag) or ({"p"} if tag not in INLINE and tag not in VOID else ())
            for i in range(len(stack) - 1, 0, -1) if any(opened[c] > 0 for c in closes) else ():
                if stack[i].tag in closes:
                    close(i)
                    break
                if stack[i].tag not in INLINE and stack[i].tag != "p":
                    if tag not in CLOSES or stack[i].tag in ("ul", "ol", "dl", "table", "select"):
                        break
            mark = " ".join(a or b or c for a, b, c in _attribute.findall(attributes)) if attributes else ""
            node = Node(tag, mark)
            parent = stack[-1]
            node.main, node.link = parent.main or tag in ("article", "main"), parent.link or tag == "a"
            by_tag = tag in APART or tag == "header" and not parent.main
            node.by_mark = bool(mark) and not by_tag and tag not in ("html", "body") and any(_apart.fullmatch(x) for x in mark.split())
            node.firm = node.by_mark and any(_always.fullmatch(x) for x in mark.split())
            node.named = by_tag or node.by_mark
            parent.kids.append(node)
            if tag not in VOID and not attributes.endswith("/"):
                stack.append(node)
                opened[tag] += 1
    _free_the_article(root)
    _free_most_of_the_text(root)
    return root


def _free_most_of_the_text(root: Node) -> None:
    """A class or id that names a place is void where it would take over two thirds of the page's own text."""
    order, marked = [(root, False)], []
    for node, apart in order:
        apart = apart or node.named and not node.by_mark
        if not apart:
            if node.by_mark and node.named:
                marked.append(node)
            order += [(k, apart) for k in node.kids]
    if not marked:
        return
    own: dict[int, int] = {}
    for node, _ in reversed(order):
        plain = node.tag == "#text" and not node.link
        own[id(node)] = len(node.text.strip()) if plain else sum(own.get(id(k), 0) for k in node.kids)
    for node in marked:
        if 3 * own[id(node)] > 2 * own[id(root)] and not node.firm:
            node.named = False


def _free_the_article(root: Node) -> None:
    """If all articles lie in named regions, the names around the first one are void."""
    stack: list[tuple[Node, tuple]] = [(root, ())]
    first: tuple | None = None
    while stack:
        node, around = stack.pop()
        if node.tag in ("article", "main"):
            if not around and not node.named:
                return
            first = first or (node, around)
        around = (node, around) if node.named else around
        stack += [(k, around) for k in reversed(node.kids)]
    if first:
        node, around = first
        node.named = False
        while around:
            around[0].named = False
            around = around[1]


class Matcher:
    """Simple tree matching without recursion; subtrees of one shape are compared once."""

    def __init__(self, most_shapes: int = 100_000, most_cells: int = 40_000) -> None:
        self.most_shapes, self.most_cells = most_shapes, most_cells
        self.shapes: dict[tuple, int] = {}
        self.known: dict[tuple[int, int], int] = {}

    def shape(self, root: Node) -> None:
        """Numbers each subtree by tag, mark and the shapes of its children."""
        order = [root]
        for node in order:
            order += node.kids
        for node in reversed(order):
            key = (node.tag, node.mark, *(k.shape for k in node.kids))
            node.shape = self.shapes.setdefault(key, len(self.shapes) + 1)
            node.size = 1 + sum(k.size for k in node.kids)

    def forget(self) -> bool:
        """Empties the memory once it is large; shapes numbered before are then void."""
        if len(self.shapes) + len(self.known) <= self.most_shapes:
            return False
        self.shapes.clear()
        self.known.clear()
        return True

    def _ready(self, a: Node, b: Node) -> int | None:
        if a.tag != b.tag or a.mark != b.mark:
            return 0
        return a.size if a.shape == b.shape else self.known.get((a.shape, b.shape))

    def weight(self, a: Node, b: Node) -> int:
        """Nodes in the best match of two trees."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self._ready(x, y) is None:
                lo, n, m = self._middle(x.kids, y.kids)
                need = {(p.shape, q.shape): (p, q) for p, q in self._compared(x.kids[lo:n], y.kids[lo:m]) if self._ready(p, q) is None}
                if need:
                    todo += need.values()
                    continue
                self.known[x.shape, y.shape] = 1 + sum(self._ready(p, q) for p, q in self.align(x.kids, y.kids))
            todo.pop()
        return self._ready(a, b)

    @staticmethod
    def _middle(a: list[Node], b: list[Node]) -> tuple[int, int, int]:
        """Where the children differ: those before and after have the same shapes in pairs."""
        lo, n, m = 0, len(a), len(b)
        while lo < n and lo < m and a[lo].shape == b[lo].shape:
            lo += 1
        while n > lo and m > lo and a[n - 1].shape == b[m - 1].shape:
            n, m = n - 1, m - 1
        return lo, n, m

    def _compared(self, a: list[Node], b: list[Node]) -> Iterator[tuple[Node, Node]]:
        """The pairs of children whose weights an alignment asks for."""
        if len(a) * len(b) <= self.most_cells:
            yield from ((x, y) for x in a for y in b)
        else:
            places: dict[tuple[str, str], list[int]] = defaultdict(list)
            for j in range(len(b) - 1, -1, -1):
                places[b[j].tag, b[j].mark].append(j)
            after = -1
            for x in a:
                free = places[x.tag, x.mark]
                while free and free[-1] <= after:
                    free.pop()
                if free:
                    after = free.pop()
                    yield x, b[after]

    def align(self, a: list[Node], b: list[Node]) -> list[tuple[Node, Node]]:
        """Pairs of children in order with the largest total weight."""
        lo, n, m = self._middle(a, b)
        out, tail = list(zip(a[:lo], b[:lo], strict=True)), list(zip(a[n:], b[m:], strict=True))
        if (n - lo) * (m - lo) > self.most_cells:
            return out + list(self._compared(a[lo:n], b[lo:m])) + tail
        if lo < n and lo < m:
            best = [[0] * (m - lo + 1) for _ in range(n - lo + 1)]
            cell = [[self.weight(x, y) for y in b[lo:m]] for x in a[lo:n]]
            for i in range(n - lo - 1, -1, -1):
                here, below, w = best[i], best[i + 1], cell[i]
                for j in range(m - lo - 1, -1, -1):
                    here[j] = max(below[j], here[j + 1], below[j + 1] + w[j] if w[j] else 0)
            i = j = 0
            while i < n - lo and j < m - lo:
                if cell[i][j] and best[i][j] == best[i + 1][j + 1] + cell[i][j]:
                    out.append((a[lo + i], b[lo + j]))
                    i, j = i + 1, j + 1
                elif best[i][j] == best[i + 1][j]:
                    i += 1
                else:
                    j += 1
        return out + tail

    def pairs(self, a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
        """The aligned nodes of two trees, parents first."""
        stack = [(a, b)]
        while stack:
            x, y = stack.pop()
            yield x, y
            if x.kids and y.kids:
                stack += self.align(x.kids, y.kids)


class Reference:
    """A host's reference tree with its nodes numbered in page order."""

    def __init__(self, html: str | None, matcher: Matcher) -> None:
        self.root = parse(html)
        matcher.shape(self.root)
        self.number: dict[int, int] = {}
        stack = [self.root]
        while stack:
            node = stack.pop()
            self.number[id(node)] = len(self.number)
            stack += node.kids[::-1]


def masses(page: Node, same: set[int]) -> dict[int, tuple[int, int, int]]:
    """Letters of varying text, those in links, and links, in the subtree of each element (by identity)."""
    order = [page]
    for node in order:
        order += node.kids
    out: dict[int, tuple[int, int, int]] = {}
    for node in reversed(order):
        if node.tag == "#text":
            n = 0 if id(node) in same else len(node.text.strip())
            out[id(node)] = n, n * node.link, 0
        else:
            text, linked, n_links = 0, 0, int(node.tag == "a")
            for k in node.kids:
                own = out[id(k)]
                text, linked, n_links = text + own[0], linked + own[1], n_links + own[2]
            out[id(node)] = text, linked, n_links
    return out


def clean(text: str) -> str:
    return _space.sub(" ", text).strip()


def main_text(root: Node, template: set[int], kept: set[int] = frozenset(), menus: set[int] = frozenset()) -> str:
    """Blocks outside regions apart, menus and template leaves (all by identity), one per line."""
    blocks: list[str] = []
    now: list[str] = []

    def close() -> None:
        if text := clean("".join(now)):
            blocks.append(text)
        now.clear()

    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, leaving = stack.pop()
        if node.tag == "#text":
            if id(node) not in template:
                now.append(node.text)
            continue
        if not leaving and (node.named and id(node) not in kept or id(node) in menus):
            close()
            continue
        if node.tag == "br":
            now.append(" ")
        elif node.tag not in INLINE:
            close()
        if not leaving:
            stack.append((node, True))
            stack += [(k, False) for k in reversed(node.kids)]
    close()
    return "\n".join(blocks)


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.lower(F.expr("try_parse_url(url, 'HOST')")), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host)


def _beside(rows: DataFrame, small: DataFrame, n_bytes: int, most_bytes: int) -> DataFrame:
    """rows left-joined with one row per host: broadcast if the measured size allows, else shuffled."""
    return rows.join(F.broadcast(small) if n_bytes <= most_bytes else small.hint("merge"), "host", "left")


class _Worker:
    """Reference trees by host, kept while a task reads pages."""

    def __init__(self, most_hosts: int = 500) -> None:
        self.matcher, self.most_hosts = Matcher(), most_hosts
        self.references: dict[str, Reference] = {}

    def reference(self, host: str, html: str | None) -> Reference:
        if self.matcher.forget() or len(self.references) >= self.most_hosts:
            self.references.clear()
        if host not in self.references:
            self.references[host] = Reference(html, self.matcher)
        return self.references[host]


#: What is counted of each reference node that pages are aligned with.
COUNTS = ("n_pages", "n_same", "n_near", "n_near_same", "chars", "link_chars", "n_links")
#: Kinds of reference nodes.
LEAF, NAMED, BLOCK = 0, 1, 2


def learn(pages: DataFrame, most_bytes: int = 32_000_000, least_pages: int = 8, least_share: float = 0.9) -> tuple[DataFrame, int]:
    """host, reference (html) and the wrapper: numbers of constant leaves, of named blocks to keep and of menus; and its size.

    Constant are leaves with the same text on least_share of at least least_pages pages. Kept are named
    blocks that hold half of the host's varying text; menus are other blocks with three links a page
    or more and least_share of their varying text in links.
    """
    rows = _hosted(pages)
    folder = shared_dir(pages.sparkSession)
    # Both small tables are written, so that their sizes are known and pages need not be shuffled.
    whole = rows.filter(F.trim("html") != "")
    first = written(whole.groupBy("host").agg(F.min("page_id").alias("page_id")), f"{folder}/first")
    references = written(whole.join(first, ["host", "page_id"]).groupBy("host").agg(F.max("html").alias("reference")), f"{folder}/references")
    n_bytes = references.agg(F.sum(F.octet_length("reference") + 200)).first()[0] or 0
    schema = "host string, node int, kind int, in_article boolean, " + ", ".join(f"{c} long" for c in COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _Worker()
        counts: dict[tuple[str, int, int, bool], list[int]] = defaultdict(lambda: [0] * len(COUNTS))

        def sums() -> pa.RecordBatch:
            keys, values = list(counts), list(counts.values())
            types = (pa.string(), pa.int32(), pa.int32(), pa.bool_())
            return pa.RecordBatch.from_arrays(
                [*(pa.array([k[i] for k in keys], t) for i, t in enumerate(types)), *(pa.array([v[i] for v in values], pa.int64()) for i in range(len(COUNTS)))], ["host", "node", "kind", "in_article", *COUNTS]
            )

        for b in batches:
            for host, html, reference in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if reference is None or html == reference:
                    continue  # an exact copy says nothing about its slots
                ref = worker.reference(host, reference)
                page = parse(html)
                worker.matcher.shape(page)
                pairs = list(worker.matcher.pairs(ref.root, page))
                leaves = [(x, y) for x, y in pairs if x.tag == "#text"]
                same = {id(y) for x, y in leaves if x.text == y.text}
                near = 20 * sum(len(y.text) for _, y in leaves if id(y) in same) > 19 * sum(len(x.text) for x, _ in leaves)
                mass = masses(page, same)
                for x, y in pairs:
                    if x.tag == "#text":
                        c = counts[host, ref.number[id(x)], LEAF, x.main]
                        c[2 if near else 0] += 1
                        c[3 if near else 1] += id(y) in same
                    elif x.named or x.tag not in INLINE:
                        c = counts[host, ref.number[id(x)], NAMED if x.named and not x.firm else BLOCK, False]
                        c[0] += 1
                        c[4], c[5], c[6] = (m + n for m, n in zip(c[4:], mass[id(y)], strict=True))
            if len(counts) > 200_000:
                yield sums()
                counts.clear()
        yield sums()

    aligned = _beside(rows.select("host", "html"), references, n_bytes, most_bytes).select("host", "html", "reference")
    nodes = aligned.mapInArrow(run, schema).groupBy("host", "node", "kind", "in_article").agg(*(F.sum(c).alias(c) for c in COUNTS))
    # A host's list has one entry per node of its reference page at most.
    by_host = nodes.groupBy("host").agg(F.collect_list(F.struct("node", "kind", "in_article", *COUNTS)).alias("nodes"), F.max(F.when(F.col("node") == 0, F.col("chars"))).alias("varying"))
    of = lambda rule: F.expr(f"array_sort(transform(filter(nodes, x -> {rule}), x -> x.node))")
    enough = f"x.n_pages >= {least_pages}"
    constant = of(
        f"x.kind = {LEAF} AND ({enough} AND x.n_same >= {least_share} * x.n_pages OR NOT x.in_article"
        f" AND x.n_pages + x.n_near >= {least_pages} AND x.n_same + x.n_near_same >= {least_share} * (x.n_pages + x.n_near))"
    )
    kept = of(f"x.kind = {NAMED} AND {enough} AND varying > 0 AND 2 * x.chars >= varying")
    menus = of(f"x.kind = {BLOCK} AND {enough} AND x.n_links >= 3 * x.n_pages AND x.chars > 0 AND x.link_chars >= {least_share} * x.chars AND 2 * x.chars < varying")
    wrappers = written(by_host.select("host", constant.alias("constant"), kept.alias("kept"), menus.alias("menus")), f"{folder}/wrappers")
    return references.join(wrappers, "host", "left"), n_bytes


def extract(pages: DataFrame, most_bytes: int = 32_000_000, **rules: float) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""
    small, n_bytes = learn(pages, most_bytes, **rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _Worker()
        for b in batches:
            texts = []
            for html, host, reference, *found in zip(*(b.column(i).to_pylist() for i in range(2, 8)), strict=True):
                page = parse(html)
                template, kept, menus = set(), set(), set()
                if any(found):
                    constant_in, kept_in, menus_in = (set(x or ()) for x in found)
                    ref = worker.reference(host, reference)
                    worker.matcher.shape(page)
                    for x, y in worker.matcher.pairs(ref.root, page):
                        n = ref.number[id(x)]
                        if x.tag == "#text":
                            if n in constant_in and x.text == y.text:
                                template.add(id(y))
                        elif n in kept_in:
                            kept.add(id(y))
                        elif n in menus_in:
                            menus.add(id(y))
                texts.append(main_text(page, template, kept, menus))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = _beside(_hosted(pages), small, n_bytes, most_bytes).select("page_id", "url", "html", "host", "reference", "constant", "kept", "menus")
    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
