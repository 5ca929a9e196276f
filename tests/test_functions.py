"""Scalar functions on the cases that decide them."""

from __future__ import annotations

import json
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallystone.functions import dates, html, text, urls, versions


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column.alias("v")).collect()]


def test_title_keys_differ():
    assert text.import_title("Pokémon&#39;s Quest II FPKG") == "pokemon s quest ii"
    assert text.strict_title("Pokémon's Quest II PKG Download") == "pokemons quest ii"
    assert text.relaxed_title("Quest  VII × Straße") == "quest7xstrasse"
    assert text.relaxed_title("Mega v X") == "megavx" and text.strict_title(None) is None
    assert text.import_title("Big&amp;Small download") == "big and small download" and text.strict_title("PKG") == "pkg" and text.strict_title("a PS4 download pkg") == "a"


#: Titles with their words for the import key, and for the strict key where that differs.
TITLES = [
    ("Été PS4 pkg", "ete", None), ("FPKG", "fpkg", None), (" FPKG", "", None), ("Big download", "big download", None), ("Big PS4 download", "big", None), ("Big pkg download pkg", "big", None),
    ("II &amp; x", "ii and x", None), ("a & b", "a and b", None), ("it's", "it s", "its"), ("4×4", "4 4", "4x4"), ("ﬁn", "fin", None), ("a-b_c", "a b_c", None), ("Straße (2)", "strasse 2", None),
    ("ǅ İ", "dz i", None), ("download PS4", "download", None), ("  ", "", None), ("pkg x pkg", "pkg x", None), ("Big download x", "big download x", None),
]


@pytest.mark.parametrize(("title", "words", "strict"), TITLES)
def test_title_keys(title, words, strict):
    assert " ".join(text.title_words(title, "")) == words and " ".join(text.title_words(title, text.DROPPED)) == (words if strict is None else strict)


def test_group_key(spark):
    cases = [("Big & Small FPKG", "big and small"), ("Été: 2 pkg download", "été 2"), (None, None), ("  ", ""), ("PKG", "pkg"), (" PKG", ""), ("Big download", "big download"), ("Big PS4 Download pkg", "big"), ("a-b×c", "a b×c"), ("pkg x", "pkg x"), ("日本 ps4", "日本")]
    assert values(spark, [(t,) for t, _ in cases], "t string", text.group_key(F.col("t"))) == [want for _, want in cases]


def test_versions(spark):
    cases = [("1.10", "1.9", 1), ("1", "1.0", 0), ("1.0.1", "1.0", 1), ("x", "1", 0), (None, "1", 0), ("2", "10", -1), ("1.0.0.0.0.0.0.1", "1", 1), ("1.2.3.4.5.6.7", "1.2.3.4.5.6.8", -1), ("0.0", "0", 0), ("007", "7.0", 0)]
    cases += [("1" + "0" * 30, "9" * 30, 1), ("2." + "9" * 40, "2." + "9" * 39 + "8", 1), ("1.", "1", 0), ("", "1", 0), ("0", "0.1", -1), ("10.0", "1", 1)]
    got = values(spark, [(a, b) for a, b, _ in cases], "a string, b string", versions.compare_versions(F.col("a"), F.col("b")))
    assert got == [c[2] for c in cases]


@pytest.mark.parametrize(("target", "label", "variant", "conflict", "want"), [
    ("", "9.00", None, False, "unchecked"), ("9", "9.00", None, False, "invalid"), ("9.00", None, None, False, "unknown"), ("9.00", "9.00", None, True, "unknown"),
    ("9.03", "9.00", None, False, "fits"), ("8.00", "9.00", None, False, "not-listed"), ("9.03", "9.00", "fix", False, "not-listed"), ("7.55", "5.05/6.72/7.xx", None, False, "fits"),
    ("8.00", "5.05/6.72/7.xx", None, False, "not-listed"), ("6.72", "5.05+", None, False, "fits"), ("5.05", "5.05-9.00", None, False, "unknown"), ("9.00", "9.xx+", None, False, "unknown"),
])
def test_requirements(spark, target, label, variant, conflict, want):
    got = values(spark, [(target, label, variant, conflict)], "t string, l string, v string, c boolean", versions.requirement_state(F.col("t"), F.col("l"), F.col("v"), F.col("c")))
    assert got == [want]


def test_sizes(spark):
    rows = [("1.5 GB",), ("1 GiB",), ("123 bytes",), ("about 5 MB",), (None,), ("0 B",), ("2.0 B",)]
    size, precision = versions.parse_size(F.col("t"))
    assert values(spark, rows, "t string", size) == [1_500_000_000, 1 << 30, 123, None, None, 0, 2]
    assert values(spark, rows, "t string", precision) == ["estimated", "estimated", "exact", None, None, "exact", "estimated"]
    assert values(spark, [(0,), (999,), (1000,), (1_250_000,), (None,)], "n long", versions.format_size(F.col("n"))) == ["0 B", "999 B", "1 KB", "1.25 MB", None]
    assert values(spark, [("9007199254740991",), ("9007199254740992",), ("-1",), ("1e3",), (None,)], "t string", versions.safe_integer(F.col("t"))) == [2**53 - 1, None, None, None, None]


def test_checksums(spark):
    rows = [({"md5": "A" * 32, "sha1": "b" * 40}, 5, "exact"), ({"md5": "a" * 31}, 5, "exact"), ({"sha256": "c" * 64}, 5, "estimated")]
    got = values(spark, rows, "c map<string,string>, s long, p string", versions.strongest_checksum(F.col("c"), F.col("s"), F.col("p")))
    assert got == ["sha1:" + "b" * 40 + ":5", None, None]


def test_partial_dates(spark):
    rows = [(2020, None, None), (2020, 2, None), (2020, 2, 30), (2020, 13, None), (None, 1, 1), (2030, 1, 1)]
    date, label = dates.start_of_period(F.col("y"), F.col("m"), F.col("d"), F.lit("2025-01-01").cast("date"))
    assert values(spark, rows, "y int, m int, d int", label) == ["2020", "2020-02", None, None, None, None]
    assert [str(x) for x in values(spark, rows, "y int, m int, d int", date)[:2]] == ["2020-01-01", "2020-02-01"]
    ends = [("Mar 5, 2020", None, None, 2020, 3), ("Q1 2020", None, None, 2020, None), ("2020", None, None, 2020, 3), ("", "YYYYMMMM", None, 2020, 2), ("", "YYYYMMMMDD", 1_583_366_400, 2020, 3), ("TBD", None, None, 2020, 1), ("2012", None, None, 2012, 1), ("2026", None, None, 2026, 1)]
    end = dates.end_of_period(*(F.col(c) for c in ("h", "p", "e", "y", "m")), F.lit("2025-01-01").cast("date"))
    assert [x and str(x) for x in values(spark, ends, "h string, p string, e long, y int, m int", end)] == ["2020-03-05", "2020-03-31", "2020-12-31", "2020-02-29", "2020-03-05", None, None, None]


def test_what_qualifies(spark):
    rows = [(48, ""), (48, "Cancelled"), (9, ""), (None, None)]
    assert values(spark, rows, "p int, s string", dates.qualifies(F.col("p"), [48, 49], F.col("s"))) == [True, False, False, False]
    numbers = [(1.5,), (float("nan"),), (float("inf"),), (None,), (-1.0,), (11.0,)]
    assert values(spark, numbers, "n double", versions.finite(F.col("n"), 0, 10)) == [1.5, None, None, None, None, None]


def test_urls(spark):
    rows = [("HTTPS://WWW.Example.org/a/?utm_source=x&b=2&a=1#top",), ("//example.org/x",), ("ftp://example.org",), ("http://u:p@example.org/",), (None,), ("https://example.org.evil.test/",)]
    assert values(spark, rows, "u string", urls.canonical_key(F.col("u"))) == ["example.org/a?a=1&b=2", "example.org/x", None, None, None, "example.org.evil.test"]
    assert values(spark, rows, "u string", urls.in_domain(F.coalesce(urls.domain(F.col("u")), F.lit("")), "example.org")) == [True, True, True, True, False, False]
    group, part = urls.multipart(F.col("u"))
    names = [("x.part03.rar",), ("y.7z.001",), ("z.rar",), (None,)]
    assert values(spark, names, "u string", group) == ["x", "y.7z", None, None] and values(spark, names, "u string", part) == [3, 1, None, None]
    assert values(spark, [("https://example.org/d/a%20b.pkg?x",), ("https://example.org/d/",)], "u string", urls.file_name(F.col("u"))) == ["a b.pkg", None]


def test_regions(spark):
    join = lambda c: F.array_join(c, "/")
    rows = [("us, Europe",), ("The Last of Us",), ("x [US] EUR",), ("Region: Japan; y",), (None,)]
    assert values(spark, rows, "t string", join(text.region_tokens(F.col("t")))) == ["", "", "EUR/USA", "JPN", ""]
    assert values(spark, rows[:1], "t string", join(text.parse_regions(F.col("t")))) == ["EUR/USA"]


#: Texts and the codes in them.
REGION_TEXTS = [
    ("for us and USA", "USA"), ("usa eur", ""), ("KOR1 KOR", "KOR"), ("(us)", "USA"), ("[Japan, UK & EU]", "EUR/JPN/UK"), ("{us", ""), ("us}", ""), ("] us (", ""), ("(a] [us)", "USA"),
    ("Region: us", "USA"), ("region = Japan; us", "JPN"), ("REGION-Asia/JP", "ASIA/JPN"), ("Region: us  EU", "USA"), ("Region: us.", ""), ("Region: us\nEU", "USA"), ("Region: us Region: Japan", "JPN"),
    ("my_region_:_us", "USA"), ("regional: us", ""), ("Region: us (EU)", "EUR/USA"), ("EUR_USA", "EUR/USA"), (None, ""), ("", ""),
]


def test_region_tokens(spark):
    got = values(spark, [(t,) for t, _ in REGION_TEXTS], "t string", F.array_join(text.region_tokens(F.col("t")), "/"))
    assert [x or "" for x in got] == [want for _, want in REGION_TEXTS]


#: Labels and what their brackets require.
REQUIREMENT_LABELS = [
    ("Update (9.00)", "9.00"), ("(FW 5.05 / 6.72 / 7.xx)", "5.05/6.72/7.xx"), ("(firmware9.00+)", "9.00+"), ("(5.05-9.00)", "5.05/9.00"), ("(5.05 – 9.00)", "5.05–9.00"), ("(5.05+6.72)", "5.05+6.72"),
    ("(v1.05) (fix 9.00)", "9.00"), ("(9.00) (5.05)", "9.00"), ("(9.00++)", None), ("(9)", None), ("[9.00]", None), ("(x (9.00))", "9.00"), ("9.00)", None), ("(9.00", None), ("(/9.00)", None), ("", None), (None, None),
]


def test_stated_requirements(spark):
    assert values(spark, [(t,) for t, _ in REQUIREMENT_LABELS], "t string", text.stated_requirement(F.col("t"))) == [want for _, want in REQUIREMENT_LABELS]

def details(spark, labels, of_file=False, made=None):
    made = made or (lambda c: text.label_details(c, of_file))
    df = spark.createDataFrame([(x,) for x in labels], "t string").coalesce(1)
    return [{k: v for k, v in r.asDict().items() if v is not None} for r in df.select(*(c.alias(n) for n, c in made(F.col("t")).items())).collect()]


def test_label_details(spark):
    labels = ["Game (v1.00) CUSA12345 EUR", "Update v1.05 / update 1.05 [9.00]", "Update 1.05 and v1.06", "Base game + DLCs", "patch 1.2", "Some patch v1.10.2", "Fix patch 3", "Backport (fix 5.05 – 9.xx)", "dlcpack usa EUR", None, "Version 2.50 CUSA00001 cusa00002", "fix update (FW 5.05-6.72+)", "updates"]
    want = [
        {"kind": "base", "version": "1.00", "product_code": "CUSA12345", "region": "EUR"}, {"kind": "update", "version": "1.05"}, {"kind": "update"}, {"kind": "bundle"}, {"kind": "update"},
        {"kind": "patch", "version": "1.10.2"}, {"kind": "fix"}, {"kind": "fix", "variant": "Backport / fix", "requirement": "5.05–9.xx"}, {"kind": "dlc"}, {}, {"version": "2.50"}, {"kind": "update", "requirement": "5.05/6.72+"}, {},
    ]
    assert details(spark, labels) == want
    assert details(spark, ["Update_v1.05_[5.05-9.00]_EUR"], of_file=True) == [{"kind": "update", "version": "1.05", "requirement": "5.05/9.00"}]
    files = details(spark, ["Base-game v1.00 [9.00] CUSA12345", "my_base v1.0 v1.0", "UPDATE v1.0 v1.1 BACKPORT", "x DLCs"], made=text.file_details)
    assert files == [{"kind": "base", "version": "1.00", "product_code": "CUSA12345", "requirement": "9.00"}, {"version": "1.0"}, {"kind": "update", "variant": "Backport / fix"}, {"kind": "dlc"}]
    listed = values(spark, [("base", "Game"), (None, "Game"), ("dlc", "DLC  content"), ("update", "Install guide"), ("base", None)], "k string, l string", text.is_listed_label(F.col("k"), F.col("l")))
    assert listed == [True, False, False, False, True]
    assert values(spark, [("DLC (12) pack",), ("12 dlc",), (None,)], "t string", text.item_count(F.col("t"))) == [12, None, None]
    assert values(spark, [("v7 release",), ("v1.05 v7",), ("v2.",)], "t string", text.stated_version(F.col("t"), whole_numbers=True)) == ["7", "1.05", None]
    assert values(spark, [("A PS4 game",), ("ps45",)], "t string", text.names_platform(F.col("t"))) == [True, False]
    assert values(spark, [("https://a.example.org/x",), ("http://a.example.org/x",), ("https://b.a.example.org/",), (None,)], "u string", urls.is_catalogue_page(F.col("u"), ["a.example.org"])) == [True, False, False, False]


def test_embedded_json_and_base64(spark):
    assert values(spark, [(json.dumps({"k": 5}),), ("{bad",), (None,)], "t string", html.embedded_json(F.col("t"), "$.k")) == ["5", None, None]
    assert values(spark, [("aMOpbGxv",), ("%%%",), (None,)], "t string", html.expand_base64(F.col("t"))) == ["héllo", "", ""]


def test_links_and_text(spark):
    page = '<p>Hi <script>no()</script>there</p><a href="/b?x=1">B <b>link</b></a><a href="/b?x=1">again</a><a href="mailto:x">m</a>'
    df = spark.createDataFrame([(1, "https://example.org/a", page), (2, None, None)], "page_id long, url string, html string")
    assert [(r.pos, r.url, r.label) for r in html.links(df).collect()] == [(0, "https://example.org/b?x=1", "B link")]
    assert {r.page_id: r.text for r in html.visible_text(df).collect()} == {1: "Hi there B link again m", 2: ""}


def test_page_rules(spark):
    """The tree's rules, redirects, data scripts, stated sizes and access errors."""
    page = html.Page("<title>t</title><p>a<div>b</div></i>c<br>d<script>no</script><script type='application/ld+json'>{\"@type\": 1}</script>")
    assert [t for t in page.texts] == [("title", "t"), ("p", "a"), ("div", "b"), ("", "c"), ("", "d")] and page.data == ['{"@type": 1}']
    assert html.target("https://x.example.org/a", "/go?url=https%3A%2F%2Ff.example.org%2F1") == "https://f.example.org/1" and html.target("https://x.example.org/a", "https://y.example.org/?url=https://z.example.org/") == "https://y.example.org/?url=https://z.example.org/"
    bodies = [
        "<b>File size</b><i>: 1.5 GB</i><script type='application/ld+json'>{\"@type\":\"MediaObject\",\"name\":\"a.pkg\",\"contentSize\":\"5 MB\"}</script>", "<p>File size: 1 GB</p><p>File Size 2 GB</p>", "<p>limit 5 GB</p>",
        "<title>Just a moment...</title><div class='entry-content'>x</div>", "<div class='x entry-content'>they wrote: too many requests</div>", "too many requests", None, "<script type='application/ld+json'>{bad</script>",
    ]
    df = spark.createDataFrame([(n, "https://example.org/", b) for n, b in enumerate(bodies)], "page_id long, url string, html string")
    assert [tuple(r) for r in html.labelled_sizes(html.text_lines(df)).collect()] == [(0, 1_500_000_000, "estimated")]
    assert [tuple(r) for r in html.described_files(html.data_blocks(df)).collect()] == [(0, "a.pkg", "5 MB")]
    assert {r.page_id for r in html.access_errors(df).filter("is_error").collect()} == {3, 5}
    deep = spark.createDataFrame([(1, None, "<div><a href=/x>" * 3000)], "page_id long, url string, html string")
    assert html.links(deep).count() == 0 and html.events(deep).count() == 3000


def test_requirements_equal_the_card(spark):
    """The rules again, one after another, on random labels."""
    rng = random.Random(11)
    token = lambda: rng.choice(["5.05", "6.72", "9.00", "7.xx", "9.xx+", "5.05+", "5.05-9.00", " 9.00 ", "x", ""])
    rows = [(rng.choice(["", "9", "9.00", "7.55", "5.05", "10.50", None]), rng.choice([None, "/".join(token() for _ in range(rng.randint(1, 3)))]), rng.choice([None, "", "fix"]), rng.choice([None, False, False, True])) for _ in range(600)]

    def want(target, label, variant, conflict):
        if not target:
            return "unchecked"
        if not re.fullmatch(r"\d{1,2}\.\d{2}", target):
            return "invalid"
        if conflict or not label:
            return "unknown"
        parts, said = label.split("/"), []
        for part in parts:
            m = re.fullmatch(r"(\d{1,2})\.(\d{2}|xx)(\+)?", part.strip())
            if not m or m[2] == "xx" and m[3]:
                said.append(None)
            elif m[2] == "xx":
                said.append(target.split(".")[0] == m[1])
            else:
                a, b = (int(x.replace(".", "")) for x in (target, m[1] + m[2]))
                said.append(a >= b if m[3] or len(parts) == 1 and not variant else a == b)
        return "fits" if True in said else "unknown" if None in said else "not-listed"

    got = values(spark, rows, "t string, l string, v string, c boolean", versions.requirement_state(F.col("t"), F.col("l"), F.col("v"), F.col("c")))
    assert got == [want(*r) for r in rows] and set(got) == {"unchecked", "invalid", "unknown", "fits", "not-listed"}


def test_parts_and_sizes_on_random_names(spark):
    rng = random.Random(12)
    cases = {
        "a.part1.rar": ("a", 1), "b.c.PART012.rar": ("b.c", 12), ".part1.rar": ("", 1), "a.7z.001": ("a.7z", 1), "a.b.zip.120": ("a.b.zip", 120), "a.PKG.007": ("a.PKG", 7), "a.7z.": (None, None), "a.part.rar": (None, None),
        "a.rar": (None, None), "a.part3.zip": (None, None), "a.7z.01": (None, None), "a.iso.001": (None, None), "7z.001": (None, None), "a.part1.rar.zip": (None, None), "part1.rar": (None, None), "": (None, None),
    }
    group, number = urls.multipart(F.col("u"))
    names = [(n,) for n in cases]
    assert list(zip(values(spark, names, "u string", group), values(spark, names, "u string", number), strict=True)) == list(cases.values())
    sizes = [(f"{rng.randint(0, 9999)}{rng.choice(['', '.5', '.25'])} {rng.choice(['B', 'bytes', 'KB', 'MiB', 'GB', 'TiB', 'XB', ''])}",) for _ in range(200)]
    unit = {"B": 1, "bytes": 1, "KB": 1000, "MiB": 2**20, "GB": 10**9, "TiB": 2**40}

    def size(t):
        n, u = t.split(" ")
        n_bytes = int(Fraction(n) * unit[u]) if u in unit else 2**53
        return n_bytes if n_bytes < 2**53 else None

    assert values(spark, sizes, "t string", versions.parse_size(F.col("t"))[0]) == [size(t) for (t,) in sizes]


GONE, RULES = "the requested thing is gone", "domain string, missing array<string>, present string"


@pytest.mark.parametrize(("url", "code", "text", "body", "want"), [
    ("https://a.example.org/x", 200, GONE.upper(), "", "missing"), ("https://a.example.org/x", 404, f"Sorry,  {GONE}.", "", "missing"), ("https://a.example.org/x", 410, GONE, "", "missing"),
    ("https://b.a.example.org/x", 410, GONE, "", "missing"), ("https://a.example.org.evil.test/x", 404, GONE, "", "unknown"), ("https://example.net/x", 404, GONE, "", "unknown"),
    ("https://a.example.org/x", 404, "not found", "", "unknown"), ("https://a.example.org/x", 500, GONE, "", "unknown"), ("https://a.example.org/x", 200, "hello", GONE, "unknown"),
    ("https://a.example.org/x", 200, "Site Unavailable. " + GONE, "", "unknown"), ("https://a.example.org/x", 429, GONE, "", "limited"), ("https://a.example.org/429.html", 200, "", "", "limited"),
    ("https://a.example.org/x", 200, "Too many\n requests", "", "limited"), ("https://a.example.org/x", 403, GONE, "", "restricted"), ("https://a.example.org/x", 200, "complete the CAPTCHA, " + GONE, "", "restricted"),
    ("https://example.net/x", 200, "get it", "<a id='get'>", "present"), ("https://example.net/x", 404, "get it", "<a id='get'>", "unknown"), ("https://a.example.org/x", 200, "get it", "<a id='get'>", "unknown"),
    ("https://example.net/x", 200, "removed by its owner", "<a id='get'>", "missing"), (None, 200, "x", "", "unknown"), ("https://example.net/x", None, None, None, "unknown"), ("no url", 200, None, None, "unknown"),
])
def test_response_states(spark, url, code, text, body, want):
    """A host's own words and marks count for it and its subdomains only; no code decides alone; restriction beats missing."""
    rules = spark.createDataFrame([("a.example.org", [GONE], None), ("example.net", ["removed by its owner"], "id='get'"), ("example.org", ["never asked"], None)], RULES)
    df = spark.createDataFrame([(url, code, text, body, 7)], "url string, code int, text string, body string, state_of int")
    out = html.response_states(df, rules)
    assert out.first().state == want and out.columns == ["url", "code", "text", "body", "state_of", "state"]


def test_response_states_without_rules(spark):
    df = spark.createDataFrame([("https://example.net/x", 200, GONE, "")] * 2, "url string, code int, text string, body string")
    assert [r.state for r in html.response_states(df, spark.createDataFrame([], RULES)).collect()] == ["unknown", "unknown"]
