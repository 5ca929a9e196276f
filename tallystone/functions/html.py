"""Pages read once into a tree: text, links, events, embedded JSON, stated sizes; and classification of responses."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qs, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallystone.functions.versions import parse_size

#: Elements that never hold others, and those that close an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSE_PARAGRAPH = frozenset("p div table h1 h2 h3 h4 ul ol blockquote".split())
#: Elements whose text is not seen.
UNSEEN = frozenset(("script", "style"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Types of structured data that describe one file.
FILE_TYPES = ("MediaObject", "DigitalDocument", "DataDownload", "SoftwareApplication")
#: The ampersand of a character reference that no semicolon ends.
_UNENDED = re.compile(r"&(?=(?:[A-Za-z][A-Za-z0-9]*+|#[0-9]++|#[xX][0-9A-Fa-f]++)(?!;))")


class Page(HTMLParser):
    """One pass over a page, with the tree's rules kept on a stack of open elements.

    Void elements are never open, a block closes an open paragraph with all in it, and end tags
    without an open element are ignored. Kept are texts with the path of elements around them,
    links with their texts, headings and separators, and the raw JSON of data scripts.
    Browsers read some character references without their semicolon; with ended_only these stay as written.
    """

    def __init__(self, html: str | None, ended_only: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.count: dict[str, int] = {}
        self.texts: list[tuple[str, str]] = []  # the innermost element and its text
        self.links: list[tuple[str, list[str]]] = []
        self.events: list[list[str]] = []
        self.data: list[str] = []
        self.title = ""
        self.classes: set[str] = set()
        self._link: list[str] | None = None
        self._heading: list[str] | None = None
        self._is_data = False
        self.feed(_UNENDED.sub("&amp;", html or "") if ended_only else html or "")
        self.close()

    def _leave(self, depth: int) -> None:
        for tag in self.open[depth:]:
            self.count[tag] -= 1
            if tag == "a":
                self._link = None
            elif tag in HEADINGS:
                self._heading = None
        del self.open[depth:]

    def _depth(self, tag: str) -> int:
        """Where the innermost open element of that name stands; -1 if none is open."""
        return len(self.open) - 1 - self.open[::-1].index(tag) if self.count.get(tag) else -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSE_PARAGRAPH and (depth := self._depth("p")) >= 0:
            self._leave(depth)
        named = dict(attrs)
        self.classes.update((named.get("class") or "").split())
        if tag in HEADINGS:
            self._heading = ["heading", ""]
            self.events.append(self._heading)
        elif tag == "hr":
            self.events.append(["break", ""])
        elif tag == "a" and named.get("href"):
            self._link = []
            self.links.append((named["href"], self._link))
            self.events.append(["link", named["href"]])
        self._is_data = tag == "script" and (named.get("type") or "").lower() == "application/ld+json"
        if tag not in VOID:
            self.open.append(tag)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if (depth := self._depth(tag)) >= 0:
            self._leave(depth)

    def handle_data(self, data: str) -> None:
        if any(self.count.get(tag) for tag in UNSEEN):
            if self._is_data and self.open[-1:] == ["script"]:
                self.data.append(data)
            return
        inside = self.open[-1] if self.open else ""
        self.texts.append((inside, data))
        if inside == "title":
            self.title += data
        if self._link is not None:
            self._link.append(data)
        if self._heading is not None:
            self._heading[1] += data

    def lines(self) -> list[str]:
        """Texts with white space collapsed, without empty ones."""
        return [line for _, t in self.texts if (line := squeeze(t))]


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _rows(pages: DataFrame, columns: list[str], schema: str, make: Callable[..., Iterator[tuple]], ended_only: bool = False) -> DataFrame:
    """Rows that make gives for each page; the first column named is the page's html."""
    types = [pa.field(f.name, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in pages.sparkSession.createDataFrame([], schema).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row for html, *rest in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True) for row in make(Page(html, ended_only), *rest)]
            cells = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cells, types, strict=True)], [t.name for t in types])

    return pages.select(*columns).mapInArrow(run, schema)


def visible_text(pages: DataFrame, ended_only: bool = False) -> DataFrame:
    """page_id and the collapsed text outside script and style; with ended_only, character references count only with their semicolon."""
    return _rows(pages, ["html", "page_id"], "page_id long, text string", lambda page, i: [(i, squeeze(" ".join(t for _, t in page.texts)))], ended_only)


#: Parameters in which redirect addresses carry where they lead.
REDIRECT = ("url", "u", "to", "target", "dest", "link")


def target(base: str | None, href: str) -> str:
    """A link resolved against its page; of a redirect address on the page's own host, where it leads."""
    try:
        url = urljoin(base or "", href.strip())
        parts = urlsplit(url)
        if parts.hostname and parts.hostname == urlsplit(base or "").hostname:
            for name in REDIRECT:
                for value in parse_qs(parts.query).get(name, ()):
                    if value.startswith(("http://", "https://")):
                        return value
        return url
    except ValueError:
        return ""


def distinct_links(page: Page, base: str | None) -> Iterator[tuple[int, str, str]]:
    """pos, url and label of a page's web links, each address once."""
    seen: set[str] = set()
    for href, label in page.links:
        url = target(base, href)
        if url.startswith(("http://", "https://")) and url not in seen:
            seen.add(url)
            yield len(seen) - 1, url, squeeze("".join(label))


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, url (resolved against the page, redirects followed in their text) and label of each distinct link, in page order."""

    return _rows(pages, ["html", "page_id", "url"], "page_id long, pos int, url string, label string", lambda page, i, base: ((i, *link) for link in distinct_links(page, base)))


def events(pages: DataFrame) -> DataFrame:
    """page_id, pos, kind (heading, break or link) and value, in page order."""
    return _rows(pages, ["html", "page_id"], "page_id long, pos int, kind string, value string", lambda page, i: [(i, n, kind, squeeze(value)) for n, (kind, value) in enumerate(page.events)])


def text_lines(pages: DataFrame) -> DataFrame:
    """page_id, pos and line: the visible texts in page order."""
    return _rows(pages, ["html", "page_id"], "page_id long, pos int, line string", lambda page, i: [(i, n, line) for n, line in enumerate(page.lines())])


def data_blocks(pages: DataFrame) -> DataFrame:
    """page_id, pos and json: the texts of JSON data scripts, as they stand."""
    return _rows(pages, ["html", "page_id"], "page_id long, pos int, json string", lambda page, i: [(i, n, block) for n, block in enumerate(page.data)])


def access_errors(pages: DataFrame, article_class: str = "entry-content") -> DataFrame:
    """page_id and is_error: the title says so, or the text does on a page without an article, which might quote it."""
    says = lambda t: any(x in t.lower() for x in ACCESS_ERRORS)
    return _rows(
        pages, ["html", "page_id"], "page_id long, is_error boolean",
        lambda page, i: [(i, says(squeeze(page.title)) or article_class not in page.classes and says(squeeze(" ".join(t for _, t in page.texts))))],
    )


#: What pages say instead of their content.
ACCESS_ERRORS = ("checking your browser", "verify you are human", "too many requests", "site unavailable", "just a moment")


def described_files(blocks: DataFrame) -> DataFrame:
    """page_id, name and size text of data blocks (page_id, json) whose type is a file; invalid JSON is passed over."""
    typed = blocks.withColumn("_v", F.try_parse_json("json"))
    get = lambda path: F.try_variant_get(F.col("_v"), path, "string")
    return typed.filter(get("$['@type']").isin(*FILE_TYPES)).select("page_id", get("$.name").alias("name"), get("$.contentSize").alias("size"))


def labelled_sizes(lines: DataFrame) -> DataFrame:
    """page_id, size_bytes and precision of pages whose lines (page_id, pos, line) state one size after File size.

    The size stands after the label or on the next line. A page that states differing sizes has none.
    """
    label = r"(?i)^file\s*size\s*:?\s*(.*)$"
    after = Window.partitionBy("page_id").orderBy("pos")
    stated = lines.withColumn("_next", F.lead("line").over(after)).filter(F.col("line").rlike(label))
    value = F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract("line", label, 1), F.lit("")), F.col("_next")), "^[: ]+", "")
    size, precision = parse_size(value)
    sizes = stated.select("page_id", size.alias("n"), precision.alias("p")).filter("n IS NOT NULL")
    one = sizes.groupBy("page_id").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("p").alias("precision"))
    return one.filter("lo = hi").select("page_id", F.col("lo").alias("size_bytes"), "precision")


#: What pages say when a host asks for fewer requests, restricts access, or cannot be reached.
LIMITED = ("too many requests",)
RESTRICTED = (
    "professional infrastructure", "premium status must not be used", "access restricted", "accès restreint", "use cdn credits",
    "captcha", "verify you are human", "checking your browser", "access denied",
)
UNREACHED = ("site unavailable", "unable to access this site")


def response_states(responses: DataFrame, rules: DataFrame) -> DataFrame:
    """responses (url, code, text, body) with state: limited, restricted, unknown, missing or present.

    text is the page's visible text, body its source. rules say what a host's own pages look like: domain,
    missing (texts that say a file is gone) and present (a pattern in the body of a page that offers one).
    A rule holds for its domain and those below it. In this order: a host that limits requests; one that
    restricts access, whatever else the page says; a gateway that did not reach the host; a code other
    than 200, 404 and 410; the host's own word that the file is gone; and with code 200 the host's own
    evidence that it is there. All else is unknown: no code alone says that a file is there or gone.
    """
    host = F.expr("lower(try_parse_url(url, 'HOST'))")
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # The rule of the longest domain; a join on domains, so rules may be a large table.
    ruled = responses.select("url").distinct().select("url", F.posexplode(F.when(host.isNotNull(), domains)).alias("_at", "domain")).join(rules, "domain")
    ruled = ruled.groupBy("url").agg(F.min_by(F.struct("missing", "present"), "_at").alias("_rule"))
    text = F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))
    says = lambda phrases: F.lit(False) if not phrases else F.exists(F.array(*map(F.lit, phrases)), lambda x: F.contains(text, x))
    code = F.coalesce("code", F.lit(0))
    gone = F.coalesce(F.exists("_rule.missing", lambda x: F.contains(text, x)), F.lit(False))
    there = F.coalesce(F.regexp_like(F.coalesce("body", F.lit("")), F.col("_rule.present")), F.lit(False))
    state = (
        F.when((code == 429) | F.contains("url", F.lit("/429.html")) | says(LIMITED), F.lit("limited"))
        .when(code.isin(401, 403) | says(RESTRICTED), F.lit("restricted")).when(says(UNREACHED), F.lit("unknown"))
        .when(~code.isin(200, 404, 410), F.lit("unknown")).when(gone, F.lit("missing")).when((code == 200) & there, F.lit("present")).otherwise(F.lit("unknown"))
    )
    return responses.join(ruled, "url", "left").withColumn("state", state).select(*responses.columns, "state")


def embedded_json(text: Column, path: str) -> Column:
    """A value of a JSON text as string; null where the text is no JSON."""
    return F.try_variant_get(F.try_parse_json(text), path, "string")


def expand_base64(text: Column, most: int = 500_000) -> Column:
    """Strictly decoded UTF-8; empty for invalid or overlong input."""
    raw = F.try_to_binary(F.when(F.length(text) <= most, text), F.lit("base64"))
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), F.lit(""))


class PageLinks:
    """The links of one page as a table: pos, url and label, in page order and each address once."""

    def eval(self, html: str | None, url: str | None) -> Iterator[tuple[int, str, str]]:
        yield from distinct_links(Page(html), url)


class PageLines:
    """The visible texts of one page as a table: pos and line."""

    def eval(self, html: str | None) -> Iterator[tuple[int, str]]:
        yield from enumerate(Page(html).lines())


def register_page_functions(spark: SparkSession) -> None:
    """Makes page_links(html, url) and page_lines(html) table functions of the session's SQL, to be called for each row by LATERAL.

    Rows go to and from Python as Arrow batches.
    """
    spark.udtf.register("page_links", F.udtf(PageLinks, returnType="pos int, url string, label string", useArrow=True))
    spark.udtf.register("page_lines", F.udtf(PageLines, returnType="pos int, line string", useArrow=True))
