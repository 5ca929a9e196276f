"""Operators on small frames: ties, unknowns, conflicts, state and guards."""

from __future__ import annotations

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallystone.operators import coverage, evidence, facets, grouping, identity, incremental, links, recommend, sizing
from tallystone.plans import checks
from tallystone.sources import sinks, tables


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_entity_grouping_equals_the_sequential_rule(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("abc"), rng.choice([None, 1, 2, 3])) for i in range(200)]
    owner, want = {}, {}
    for i, key, ref in rows:
        if ref is not None:
            owner.setdefault(key, ref)
    for i, key, ref in rows:
        want[i] = key if ref is None or ref == owner[key] else f"{key}|{ref}"
    df = spark.createDataFrame(rows, "pos int, key string, ref int").repartition(3)
    assert by(grouping.entity_groups(df, "key", "ref", ["pos"]), "pos", "entity_key") == want


def test_evidence(spark):
    one = lambda *a: F.array(*map(F.lit, a)) if a else F.array().cast("array<string>")
    cases = [((), ([], "unknown")), ((one("A"),), (["A"], "identified")), ((one("A", "B"), one()), (["A", "B"], "multiple")), ((one("A", "B"), one("B")), (["B"], "identified")), ((one("A"), one("B")), ([], "conflict"))]
    for sources, want in cases:
        codes, status = evidence.intersect_evidence(list(sources) or [one()])
        row = spark.range(1).select(codes.alias("c"), status.alias("s")).first()
        assert (row.c, row.s) == want


def test_label_conflict_takes_the_last(spark):
    rows = [("k", "base", None, 1), ("k", "base", "", 2), ("c", "base", None, 1), ("c", "dlc", None, 2)]
    out = {r.key: r for r in evidence.label_conflict(spark.createDataFrame(rows, "key string, kind string, region string, pos int"), "key", ["kind", "region"], ["pos"]).collect()}
    assert not out["k"].conflict and out["k"].region == "" and out["c"].conflict and out["c"].kind is None


def test_carry_forward_replaces_whole_context(spark):
    rows = [(1, 1, "A", False), (1, 2, None, False), (1, 3, None, True), (1, 4, "B", False), (1, 5, None, False)]
    out = evidence.carry_forward(spark.createDataFrame(rows, "doc int, pos int, said string, stop boolean"), "doc", ["pos"], F.col("stop"), F.col("said"))
    assert by(out, "pos", "context") == {1: "A", 2: "A", 3: None, 4: "B", 5: "B"}


def test_hierarchy(spark):
    edges = [(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 99), (7, 7), (8, 3)] + [(100 + i, 100 + i - 1 if i else None) for i in range(35)]
    got = by(identity.hierarchy_roots(spark.createDataFrame(edges, "node long, parent long")), "node", "root")
    assert {k: got[k] for k in range(1, 9)} == {1: 1, 2: 1, 3: 1, 4: None, 5: None, 6: None, 7: None, 8: 1} and got[134] == 100
    chain = [(i, i - 1 if i % 1001 else None) for i in range(1, 3003)] + [(5000, 5001), (5001, 5002), (5002, 5000), (5003, 5002)]
    got = by(identity.hierarchy_roots(spark.createDataFrame([(n, None if n in (1, 1001, 2002) else up) for n, up in chain], "node long, parent long")), "node", "root")
    assert all(got[n] == (1 if n < 1001 else 1001 if n < 2002 else 2002) for n in range(1, 3003)) and {got[n] for n in range(5000, 5004)} == {None}
    assert identity.hierarchy_roots(spark.createDataFrame([], "node long, parent long")).count() == 0
    # Repeated rows are one edge, and of several parents the smallest counts.
    twice = [(1, None)] + [(n, n - 1) for n in range(2, 20)] * 2 + [(30, 9), (30, 5), (31, None), (31, 30), (32, 99)] * 2
    got = identity.hierarchy_roots(spark.createDataFrame(twice, "node long, parent long"))
    assert got.count() == 22 and by(got, "node", "root") == {**dict.fromkeys(range(1, 20), 1), 30: 1, 31: 1, 32: None}
    aliased = identity.with_aliases(spark.createDataFrame([(2, 1), (3, 1)], "node long, parent long"), spark.createDataFrame([(2, 3)], "node long, target long"))
    assert by(aliased, "node", "parent") == {2: 3, 3: 1}


def test_tiers_stop_at_the_first_with_candidates(spark):
    ref = spark.createDataFrame([("x", "rx", 1, 1, False), ("y", "ry", 2, 2, False), ("y", "ry", 3, 3, True), ("z", "rz", 5, 4, False), ("z", "rz", 4, 4, False), ("q", "rx", 9, 9, False)], "strict string, relaxed string, ref_id long, root_id long, on_platform boolean")
    names = spark.createDataFrame([("one", "x", "rx", False), ("amb", "y", "rx", False), ("plat", "y", "rx", True), ("root", "z", "-", False), ("loose", "-", "rz", False), ("none", "-", "-", False), ("two", "-", "rx", False)], "name_id string, strict string, relaxed string, has_codes boolean")
    out = {r.name_id: (r.tier, r.ref_id, r.status) for r in identity.tiered_match(names, [(k, identity.candidate_index(ref, k)) for k in ("strict", "relaxed")]).collect()}
    assert out == {"one": (1, 1, "matched"), "amb": (1, None, "ambiguous"), "plat": (1, 3, "matched"), "root": (1, 4, "matched"), "loose": (2, 4, "matched"), "none": (None, None, "unmatched"), "two": (2, None, "ambiguous")}
    known = names.withColumn("known_id", F.when(F.col("name_id") == "amb", 3).when(F.col("name_id") == "one", 77).cast("long"))
    halves = known.withColumns({"ls": F.when(F.col("name_id") == "none", "x").otherwise("-"), "rs": F.when(F.col("name_id") == "none", "x"), "lr": F.lit("-"), "rr": F.lit(None).cast("string")})
    keys = ("strict", "relaxed")
    full = identity.tiered_match(halves, [(k, identity.candidate_index(ref, k)) for k in keys], ref.select("ref_id"), [("ls", "rs"), ("lr", "rr")], [identity.candidate_lists(ref, k) for k in keys])
    out = {r.name_id: (r.tier, r.ref_id, r.candidates) for r in full.collect()}
    assert out["amb"] == (0, 3, []) and out["one"] == (1, 1, []) and out["none"] == (3, 1, []) and out["two"] == (2, None, [1, 9])
    loose = spark.createDataFrame([("x", 1, None, False), ("x", 2, 2, False)] + [("many", i, i, False) for i in range(30)], "strict string, ref_id long, root_id long, on_platform boolean")
    out = {r.name_id: (r.status, r.candidates) for r in identity.tiered_match(names.withColumn("strict", F.when(F.col("name_id") == "two", "many").otherwise(F.col("strict"))), [("strict", identity.candidate_index(loose, "strict"))], lists=[identity.candidate_lists(loose, "strict")]).collect()}
    assert out["one"] == ("ambiguous", [1, 2]) and out["two"] == ("ambiguous", list(range(20)))
    left, right = identity.name_halves(F.col("t"))
    assert [tuple(r) for r in spark.createDataFrame([("A b (C d) ",), ("A (b) c",), (None,)], "t string").select(left, right).collect()] == [("A b", "C d"), (None, None), (None, None)]


def test_overrides(spark):
    """Each decision, with sources that still overlap and with others; unavailable ids; malformed decisions raise once they are met."""
    entries = spark.createDataFrame([(n, ["p1", "p2"], 1) for n in "abcdefg"] + [("h", None, 4)], "name string, sources array<string>, ref_id long")
    schema = "name string, sources array<string>, ref_id long, status string, canonical_id string, canonical_name string, type string"
    rows = [
        ("a", ["p2"], 7, None, None, None, None), ("b", ["moved"], 7, None, None, None, None), ("c", ["p1"], 99, None, None, None, None), ("d", ["p1"], None, "non_game", None, None, None),
        ("e", ["p1"], None, "identified", "local:a-1", "Name", "main"), ("f", ["p1"], 7, "review", None, None, None), ("h", ["p1"], 7, None, None, None, None), ("z", ["p1"], None, None, None, None, None),
    ]
    ref = spark.createDataFrame([(7,), (7,), (1,)], "ref_id long")
    out = {r.name: tuple(r)[1:] for r in identity.guarded_override(entries, spark.createDataFrame(rows, schema), ref, ("main",)).collect()}
    assert out == {
        "a": (7, None, "override", None), "b": (None, None, "review", "sources changed"), "c": (None, None, "review", "reviewed id unavailable"), "d": (None, None, "non_game", None),
        "e": (None, "local:a-1", "local", None), "f": (None, None, "review", None), "g": (1, None, "unreviewed", None), "h": (None, None, "review", "sources changed"),
    }
    for bad in (("a", ["p1"], None, None, None, None, None), ("a", ["p1"], None, "identified", "local:A", "Name", "main"), ("a", ["p1"], None, "identified", "local:a", "", "main"), ("a", ["p1"], None, "identified", "local:a", "Name", "other")):
        with pytest.raises(Exception, match="malformed reviewed identity for a"):
            identity.guarded_override(entries, spark.createDataFrame([bad], schema), ref, ("main",)).collect()


def test_link_rules(spark):
    """First rule by its order, with and without a path; names that only end alike; addresses without a rule or a host."""
    rules = spark.createDataFrame([(2, "example.org", None, "all", "g"), (1, "example.org", "^/f/", "files", "g"), (3, "a.example.org", None, "late", "g"), (4, "example.net", "[0-9]$", "ids", "n")], "ord int, domain string, path string, label string, grp string")
    cases = {
        "https://example.org/f/1": ("files", "g"), "https://a.example.org/x": ("all", "g"), "https://www.A.Example.org/f/": ("all", "g"), "https://example.org.evil.test/f/1": ("example.org.evil.test", "other"),
        "https://badexample.org/": ("badexample.org", "other"), "https://x.example.net/a1": ("ids", "n"), "https://x.example.net/a": ("x.example.net", "other"), "nothing": ("", "other"),
    }
    df = spark.createDataFrame([(u, 1) for u in [*cases, "https://example.org/f/1"]] + [(None, 2)], "url string, ord int")
    out = links.classified(df, rules)
    assert {r.url: (r.label, r.grp) for r in out.collect()} == {**cases, None: ("", "other")} and out.count() == len(cases) + 2 and out.columns == ["url", "ord", "label", "grp"]
    assert {r.label for r in links.classified(df, rules.limit(0), ("Other", "rest")).collect()} == {"Other"}


def test_resolve_and_summary(spark):
    matches = spark.createDataFrame([("a", 1, None), ("b", 2, "2024"), ("c", 3, None), ("d", None, None), ("e", 4, None)], "name_id string, ref_id long, reviewed_at string")
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, None)], "node long, root long")
    done = identity.resolve(matches, roots, spark.createDataFrame([(1, "game"), (3, "dlc")], "id long, type string"), ["game"], ["dlc"])
    assert by(done, "name_id", "outcome") == {"a": "identified", "b": "identified", "c": "non_game", "d": "review", "e": "review"}
    local = done.withColumn("canonical_id", F.col("canonical_id").cast("string")).unionByName(spark.createDataFrame([("f", None, "2024", "local:x", "identified")], "name_id string, ref_id long, reviewed_at string, canonical_id string, outcome string"))
    row = identity.outcome_summary(local).first()
    assert row.asDict() == {"listings": 6, "identified": 3, "unique_games": 2, "non_game": 1, "unresolved": 2, "reviewed": 2, "local_games": 1, "editions": 1, "duplicates": 1}
    assert row.identified + row.non_game + row.unresolved == row.listings


def test_reconcile(spark):
    ref, cat = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,), (3,), (None,)], "k int")
    out = coverage.reconcile(ref, cat, "k")
    assert by(out, "k", "state") == {1: "gap", 2: "matched", 3: "outside"}
    row = coverage.invariant(out, ref, cat, "k").first()
    assert (row.local_difference, row.reference_difference) == (0, 0)


def test_recommend(spark):
    rows = [("f", "1.0", 1), ("f", "1.1", 2), ("g", "1.0", 3), ("h", None, 4)]
    df = spark.createDataFrame(rows, "fam string, v string, pos int")
    assert by(recommend.newest_flag(df, ["fam"], "v", F.lit(True)), "pos", "newest") == {1: False, 2: True, 3: False, 4: False}
    assert by(recommend.best_per_family(df, ["fam"], [F.desc_nulls_last("v"), F.asc("pos")]), "fam", "pos") == {"f": 2, "g": 3, "h": 4}
    good = ("cusa12345", "eu", None, "https://example.org", " s  t ", False, None)
    keys = [good, *(good[:i] + (x,) + good[i + 1 :] for i, x in ((0, "ABCD12345"), (0, None), (1, None), (1, " "), (3, ""), (5, True), (6, 2), (6, 0)))]
    df = spark.createDataFrame(keys, "p string, r string, e string, u string, s string, c boolean, n int").coalesce(1)
    assert [r[0] for r in df.select(recommend.family_key(*(F.col(c) for c in df.columns))).collect()] == ['["CUSA12345","EUR","","https://example.org","S T"]'] + [None] * 8


def test_family_choice_equals_the_plain_rule(spark):
    rng = random.Random(6)
    rows = [(rng.choice("gh"), rng.choice(["f1", "f2", "f3", None]), rng.choice(["base", "update", "dlc", "fix"]), rng.choice([None, "1.0", "1.1", "1.10", "x"]), rng.choice([None, "v"]), rng.randint(0, 2), n, rng.random() < 0.7) for n in range(120)]
    rows += [("solo", "f", "update", "1.0", None, 0, 200, True), ("none", "f", "base", "1.0", None, 0, 201, False)]
    version = lambda v: tuple(map(int, v.split("."))) if v and v != "x" else None

    def choose(of):
        return min((r for r in of if r[7]), key=lambda r: (version(r[3]) is None, [-x for x in version(r[3]) or ()] + [0] * 4, r[4] is not None, r[5], r[6]), default=None)

    def plain(game, wanted):
        families = {}
        for r in rows:
            if r[0] == game and r[1] and r[2] in ("base", "update", "dlc"):
                families.setdefault(r[1], []).append(r)
        found = []
        for name, of in families.items():
            if not any(r[2] == "base" for r in of):
                continue
            base = choose([r for r in of if r[2] == "base"])
            update = base and choose([r for r in of if r[2] == "update" and version(r[3]) and (not version(base[3]) or [*version(r[3]), 0, 0][:3] > [*version(base[3]), 0, 0][:3])])
            found.append(((name != wanted, base[5] if base else 100, update is None, of[0][6]), (name, base and base[6], update and update[6], sum(r[2] == "dlc" for r in of) if base else 0)))
        return min(found)[1] if found else None

    df = spark.createDataFrame(rows, "game string, family string, kind string, version string, variant string, host_rank int, pos int, fits boolean").repartition(3)
    for wanted in (None, "f2", "gone"):
        choice = None if wanted is None else spark.createDataFrame([("g", wanted), ("h", wanted)], "game string, family string")
        out = {r.game: tuple(r)[1:] for r in recommend.choose_families(df, F.col("fits"), choice).collect()}
        assert out == {g: plain(g, wanted) for g in ("g", "h", "none")}


def test_views_and_orders(spark):
    rows = spark.createDataFrame([("a", "s", "EUR", "base"), ("a", "s", "EUR", "dlc"), ("a", "t", "EUR", "dlc")], "game string, source string, region string, kind string")
    out = facets.recommendation_context(rows, F.col("source") == "s", F.lit(True), F.col("kind") == "dlc")
    assert sorted((r.kind, r.in_view) for r in out.collect()) == [("base", False), ("dlc", True)]
    names = spark.createDataFrame([("b",), ("Á",), ("a",), ("A",), ("#",)], "n string")
    assert [r.n for r in names.orderBy(facets.name_order("n")).collect()] == ["#", "a", "A", "Á", "b"]
    assert [r.n for r in names.orderBy(*facets.section_order(F.col("n"))).collect()][0] == "#"
    assert spark.range(1).select(facets.folded(F.lit("Straße ΟΔΟΣ"))).first()[0] == "strasse οδοσ"
    df, seen, last = spark.range(23).withColumn("k", F.col("id") % 4), [], None
    while page := facets.page_after(df, [("k", True), ("id", False)], last, 5).collect():
        seen += [(r.k, r.id) for r in page]
        last = seen[-1]
    assert seen == sorted(((i % 4, i) for i in range(23)), key=lambda x: (-x[0], x[1]))


def test_facets_of_regions_and_hosts(spark):
    rows = spark.createDataFrame([(["EUR"], False), (["EUR", "USA"], True), ([], False), (None, None), ([], True)], "r array<string>, c boolean")
    want = {"": [True] * 5, "EUR": [True, False, False, False, False], "unknown": [False, False, True, True, False]}
    for facet, hits in want.items():
        assert [r[0] for r in rows.coalesce(1).select(facets.region_facet(F.col("r"), F.col("c"), facet)).collect()] == hits
    hosts = spark.createDataFrame([("p",), ("t1",), ("t2",), ("x",), (None,)], "d string").coalesce(1)
    assert [r[0] for r in hosts.select(recommend.domain_rank(F.col("d"), "p", ["t1", "p", "t2"])).collect()] == [0, 1, 3, 10, 10]
    assert [r[0] for r in hosts.select(recommend.domain_rank(F.col("d"), None, ["t2"])).collect()] == [10, 10, 1, 10, 10]
    scopes = spark.createDataFrame([("A one", ["x"], True, False, ["EUR"]), ("B two", ["ONE"], False, False, []), ("C", [], True, True, [])], "name string, listings array<string>, catalogued boolean, outside boolean, regions array<string>")
    pick = lambda *a: {r.name[0] for r in facets.scope_filter(scopes, *a).collect()}
    assert (pick("all"), pick("gaps"), pick("matched"), pick("outside", "", "EUR"), pick("all", " one "), pick("all", "", "EUR")) == ({"A", "B"}, {"B"}, {"A"}, {"C"}, {"A", "B"}, {"A"})


def test_totals_and_sizes(spark):
    rows = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "links array<string>")
    assert tuple(coverage.totals(rows, "links").first()) == (3, 2) and tuple(coverage.totals(rows.limit(0), "links").first()) == (0, 0)
    assert sizing.known_bytes(spark.createDataFrame([(5,), (5,), (None,)], "size_bytes long")).first()[0] == 10


def test_listings(spark):
    listings = grouping.valid_listings(spark.createDataFrame([(1, "A"), (2, " "), (3, None), (4, "https://x.example.org"), (5, "A"), (6, "//y")], "id int, name string"))
    assert {r.id for r in listings.collect()} == {1, 5}
    alive = spark.createDataFrame([(5,), (5,)], "id int")
    assert [tuple(r) for r in grouping.claims(listings, alive, "id", ["name"], ["id"]).collect()] == [(5, "A")]
    assets = spark.createDataFrame([("k", None, 2, "b", "m2"), ("k", None, 1, "a", "m1")], "x string, y string, pos int, url string, meta string")
    row = grouping.release_groups(assets, ["x", "y"], "pos", "url", ["meta"]).first()
    assert (row.assets, row.meta, row.n_assets) == (["a", "b"], "m1", 2)
    assert by(grouping.release_rows(assets, ["x", "y"], "pos"), "url", "place") == {"a": 1, "b": 2}


def test_eligible_titles_in_reference_order(spark):
    games = spark.createDataFrame([(1, "game", "", 1), (2, "game", "", 1), (3, "dlc", "", 1), (4, "game", "Cancelled", 1), (5, "game", "", None), (6, "game", "", 6), (7, "game", "", 3)], "id long, type string, status string, r long")
    dates = spark.createDataFrame([(1, "2014-01-01", "b"), (2, "2013-05-05", "x"), (2, "2013-05-05", "a"), (3, "2014-01-01", "c")], "id long, day string, label string")
    from tallystone.functions import text

    kept, reasons = coverage.eligible(games, games.select(F.col("id").alias("node"), F.col("r").alias("root")), dates, F.col("type") == "game", text.is_unreleased(F.col("status")))
    assert [tuple(r) for r in kept.collect()] == [(1, [1, 2], "2013-05-05", "a")]
    assert by(reasons, "reason", "n") == {"unresolved parent": 1, "type out of scope": 2, "unreleased status": 1, "no qualifying date": 1}
    assert coverage.dates_of(games.select("id"), dates).count() == 8


def test_pages_are_clamped(spark):
    df = spark.range(70)
    pick = lambda p: [r.id for r in facets.paginate(df, [F.asc("id")], p, 50).collect()]
    assert pick(1) == list(range(50, 70)) == pick(9) and pick(-3) == list(range(50)) and facets.paginate(df.limit(0), [F.asc("id")], 2, 50).count() == 0


def test_unknown_sizes_are_not_zero(spark):
    rows = [(1, "s:5", "a", 5, "exact"), (2, "s:5", "b", 5, "exact"), (3, None, "c", 0, "exact"), (4, None, "d", None, None), (5, None, "c", 7, "estimated")]
    row = sizing.deduplicated_bytes(spark.createDataFrame(rows, "pos int, checksum_id string, key string, size_bytes long, precision string"), ["pos"]).first()
    assert (row.known_bytes, row.known, row.unknown, row.estimated, row.duplicates) == (5, 2, 1, 0, 2)


def test_incremental(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), rng.choice(["missing", "present", "limited"])) for i in range(60)]
    state, last = {}, {}
    for _, k, s in rows:
        last[k] = s
        if state.get(k) != "missing" or s == "present":
            state[k] = s
    df = spark.createDataFrame(rows, "pos int, k string, s string")
    assert by(incremental.sticky_fold(df, "k", ["pos"], "s", "missing", "present"), "k", "state") == state
    queue = spark.createDataFrame([("x", "done")], "k string, status string")
    assert by(incremental.enqueue(queue, spark.createDataFrame([("x",), ("y",), ("y",)], "k string"), "k"), "k", "status") == {"x": "done", "y": "pending"}
    old = spark.createDataFrame([("x", 1, "unknown"), ("y", 1, "known"), ("z", 2, "unknown")], "k string, revision int, s string")
    assert set(by(incremental.invalidate(old, 2, F.col("s") == "unknown"), "k", "s")) == {"y", "z"}
    assert incremental.budget_per_key(100, 7) == 14 and incremental.budget_per_key(3, 7) == 1


def test_holds_retries_and_batches(spark):
    holds = spark.createDataFrame([("a", 1, "x")], "source string, at long, reason string")
    more = incremental.hold_sources(holds, spark.createDataFrame([("a", 5, "y"), ("b", 7, "z"), ("b", 6, "w")], "source string, at long, reason string"), "source")
    assert by(more, "source", "reason") == {"a": "x", "b": "w"}
    queue = spark.createDataFrame([("a", "pending"), ("c", "pending"), ("c", "done")], "source string, status string")
    assert [tuple(r) for r in incremental.runnable(queue, more, "source").collect()] == [("c", "pending")]
    state = spark.createDataFrame([("a", "held"), ("a", "known"), ("b", "held")], "source string, status string")
    markers = spark.createDataFrame([], "marker string")
    for reason, left in (("other", 3), ("x", 2)):
        kept, now, marked = incremental.retry_once(state, more, markers, "m1", "source", "a", reason)
        assert kept.count() == left and now.count() == left - 1 and [r.marker for r in marked.collect()] == ["m1"]
    again = incremental.retry_once(state, more, marked, "m1", "source", "a", "x")
    assert again == (state, more, marked)
    assert incremental.run_batches(lambda n: (1, 1), minutes=0) == 0
    steps = iter([(5, 2), (3, 1), (3, 0), (9, 9)])
    assert incremental.run_batches(lambda n: next(steps)) == 3 and incremental.run_batches(lambda n: (1, 1), most=7) == 7


def test_sticky_states_take_frames_in_any_order(spark, tmp_path):
    import pandas as pd

    from tallystone.streaming import states

    rng = random.Random(3)
    rows = [(n, datetime(2024, 1, 1) + timedelta(hours=rng.randint(0, 40)), rng.choice([1, 1, 1, 2]), rng.choice(["error", "signup", "view"])) for n in range(300)]
    folder = str(tmp_path / "ev")
    for part in range(3):
        spark.createDataFrame(rows[part::3], "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([(999, datetime(2025, 1, 1), 1, "view")], "event_id long, ts timestamp, user_id long, event_type string").write.parquet(folder + ".bak")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    got = by(states.sticky_from_files(spark, folder), "user_id", "state")
    assert got == by(incremental.sticky_fold(spark.read.parquet(folder), "user_id", ["ts", "event_id"], "event_type", "error", "signup"), "user_id", "state")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    frame = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type"])
    assert len(states.deciding(frame, "error", "signup")) <= 6


def test_shared_folder_is_required_on_a_cluster(spark):
    class Session:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)
            master = "spark://host:7077"

    with pytest.raises(tables.NoSharedFolder):
        tables.working_dir(Session)


def test_checks_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (1, ""), (2, None)], "id int, name string")
    assert by(checks.violations(df, {"named": F.col("name") != "", "positive": F.col("id") > 0}), "rule", "n") == {"named": 2}
    with pytest.raises(checks.BrokenInvariant):
        checks.require_none(checks.duplicates(df, ["id"]), "id is a key")
    stamp = spark.createDataFrame([("abc",), (None,)], "t string").select(sinks.content_stamp(F.col("t")).alias("s"), sinks.surrogate_id("p", F.col("t"), F.lit("x")).alias("i")).collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert stamp[0].s == sha(b"abc")[:16] and stamp[1].s is None and stamp[0].i == "p-" + sha(b"abc\nx")[:20]
    assert sinks.markdown_table([{"a": 1, "b": "x"}], ["a", "b"]) == "| a | b |\n| - | - |\n| 1 | x |"
    assert sinks.fingerprint(df).first() == sinks.fingerprint(df.repartition(3).orderBy(F.desc("id"))).first() != sinks.fingerprint(df.union(df)).first()
    assert tables.read_optional(spark, str(tmp_path / "none"), "a int, b string").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"name": "n", "page_url": "https://example.org/p", "download_links": {"main": ["https://example.org/a", "https://example.org/b"]}, "release_links": [{"url": "https://example.org/a", "kind": "base"}]}]')
    rows = tables.read_json_array(spark, str(tmp_path / "list.json"))
    assert rows.first().release_links[0].kind == "base" and [(r.pos, r.url[-1]) for r in tables.explode_links(rows).collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "env.json").write_text('{"records": [{"id": 1}, {"id": 2}], "checked": {"u": {"at": "x"}}}')
    assert tables.read_envelope(spark, str(tmp_path / "env.json"), "id: int").count() == 2
    assert tables.read_keyed(spark, str(tmp_path / "env.json"), "checked", "at: string").first().key == "u"
    (tmp_path / "map.xml").write_text("<urlset><url><loc>https://example.org/x</loc><lastmod>2020</lastmod></url></urlset>")
    assert tables.read_sitemap(spark, str(tmp_path / "map.xml")).first().url == "https://example.org/x"


def test_families_are_chosen_in_one_pass(spark):
    """Releases are read and their keys made once; the choice is that of a plain walk, bases and updates without a version too."""
    import random

    from tallystone.operators import recommend

    rnd = random.Random(8)
    pick = lambda pos: (rnd.randint(1, 40), rnd.choice(["f", "g", None]), rnd.choice(["base", "update", "update", "dlc", "note"]), rnd.choice(["1.0", "1.10", "1.9", "2", "02.00", None]), rnd.choice([None, "x"]), rnd.randint(0, 3), pos)
    data = [pick(pos) for pos in range(600)]
    rows = spark.createDataFrame(data, "game long, family string, kind string, version string, variant string, host_rank int, pos long")
    chosen = recommend.choose_families(rows, F.lit(True))
    assert chosen._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    v = lambda r: {"1.0": (1,), "1.10": (1, 10), "1.9": (1, 9), "2": (2,), "02.00": (2,), None: None}[r[3]]
    better = lambda r: (v(r) is not None, v(r) or (), not r[4], -r[5], -r[6])
    want = {}
    for game, family in {r[:2] for r in data if r[1]}:
        kinds = {k: [r for r in data if r[:3] == (game, family, k)] for k in ("base", "update", "dlc")}
        if kinds["base"]:
            base = max(kinds["base"], key=better)
            newer = [r for r in kinds["update"] if v(r) is not None and (v(base) is None or v(r) > v(base))]
            update = max(newer, key=better)[6] if newer else None
            first = min(r[6] for part in kinds.values() for r in part)
            want[game] = min(want.get(game, ((1000,),)), ((base[5], update is None, first), family, base[6], update, len(kinds["dlc"])))
    assert {tuple(r) for r in chosen.collect()} == {(game, *w[1:]) for game, w in want.items()}
