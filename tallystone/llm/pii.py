"""Surrogates for personal data, in DataFrame operations only.

Entities are found by one pattern and replaced by keyed surrogates. An entity is made of units: a
name of given names and a surname, an address of its local part and its domain, anything else of
itself. The same unit gets the same surrogate everywhere, so that ``Mr Smith`` and ``Mr. John
Smith`` keep one surname and the addresses of one domain keep one domain (coreference); different
units of a kind get different ones (distinctness). A surrogate keeps its unit's type and format:
punctuation, letter case, digit groups, script, the gender of a name, and how far a card's or an
IBAN's check digits are off (not at all, for valid ones). It is drawn from an HMAC of the unit and a
try number under the caller's key, so that who has not the key cannot find units by trial. Units whose
surrogates collide, with one another or with a real unit, take the next try until none do. Later
tries of words and secrets have more letters, and much later ones of numbers more digits, so that no kind
runs out of values, not even secrets of symbols alone. Only the few units that moved have a try
number other than 0, kept in a table.

Found are: secrets after a word that names them; e-mail addresses; IPv4 addresses; IBANs; card
numbers whose check digit holds; social security numbers; telephone numbers with a country code, in
brackets, in groups, or ten digits after a word for telephone; names after a title, or of a known given name and a surname.
Other names, and numbers without these forms, are not found. Every pattern is linear: repeats are
bounded or possessive, and words are only read from their start.

Defined cases: null texts stay null and empty texts empty. A text without entities is unchanged.
Null doc_ids are kept, and repeated rows are changed alike. Extra input columns are kept, except
that a column n_entities is replaced.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import shared_dir, written

#: Titles by the gender they state; the last ones state none.
TITLES = {
    "m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Don", "Господин", "г-н", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Sra", "Madame", "Mme", "Mademoiselle", "Doña", "Госпожа", "г-жа", "Κυρία"),
    "": ("Dr", "Prof", "Professor", "Доктор"),
}
#: Given names that stand in for others, by script and gender.
GIVEN = {
    "latin": {"m": ("Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Leon", "Marco", "Nils", "Oscar", "Paul"), "f": ("Alma", "Bella", "Clara", "Diana", "Elena", "Freya", "Greta", "Helena", "Irma", "Julia", "Klara", "Lena", "Maria", "Nora", "Olga", "Paula")},
    "cyrillic": {"m": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Лев"), "f": ("Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Ирина", "Лидия")},
}
#: Further given names by which a name without a title is known.
KNOWN = {
    "m": (
        "John", "James", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Peter", "Hans", "Jürgen", "Klaus", "Wolfgang", "Stefan",
        "Andreas", "Pierre", "Michel", "Jacques", "François", "José", "Juan", "Carlos", "Luis", "Miguel", "Antonio", "Александр", "Дмитрий", "Сергей", "Андрей", "Алексей",
    ),
    "f": (
        "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Anna", "Ursula", "Monika", "Petra", "Sabine", "Marie", "Isabelle",
        "Nathalie", "Sophie", "Claire", "Carmen", "Isabel", "Laura", "Lucía", "Мария", "Наталья", "Ольга", "Татьяна", "Светлана",
    ),
}
_by_gender = {g: tuple(dict.fromkeys(n for by in GIVEN.values() for n in by[g])) + KNOWN[g] for g in "mf"}
_titles = "|".join(t for g in TITLES.values() for t in g)
_given = "|".join(dict.fromkeys(n for g in _by_gender.values() for n in g))
#: Sixteen letters of each script for the digits of a digest, by the script's name in patterns; Latin stands for all others.
LETTERS = {"Cyrillic": "бвгдзклмнпрстфхш", "Greek": "βγδζθκλμνξπρστφχ", "Armenian": "բգդզթժլխծկհձղճմյ", "Hebrew": "אבגדהוזחטילמנסעפ", "Arabic": "ابتثجحخدذرزسشصضط"}
_LATIN, _HEX = "bcdfghjklmnprstv", "0123456789abcdef"
_start, _end = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: A name does not begin after a hyphen inside a word.
_alone = r"(?<![\p{L}\p{N}]|[\p{L}\p{N}]-)"
_word = r"\p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)?"
_head = r"(?i:(?<![\p{L}\p{N}])(?:password|passwd|pwd|token|secret|api[_-]?key)\s{0,9}[=:]\s{0,9}\"?)"

#: Each type's pattern (Java syntax). The order decides where two could begin at one place.
PATTERNS: dict[str, str] = {
    "secret": _head + r"[^\s\",;]{8,}+",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}+\.){1,9}\p{L}{2,63}+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\d.+])\d(?:[ -]?\d){12,18}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": (
        r"(?<![\d.])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+\d(?:[ .()-]{0,2}\d){6,14}|\(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4}"
        r"|0\d(?:[ .-]\d{2}){4}|0\d{2,4}[ /-]\d{5,8}|(?<=(?i:tel|phone|mobile|cell|fax|call|telefon|teléfono|téléphone)[:. ]{1,3})[2-9]\d{9})(?!\d)"
    ),
    "name": (
        rf"{_alone}(?:(?:{_titles})\.? ){{1,2}}{_word}(?: {_word}){{0,2}}{_end}"
        rf"|{_alone}(?=\p{{Lu}})(?:{_given})(?:-\p{{Lu}}\p{{Ll}}++)?(?: (?:{_given})(?:-\p{{Lu}}\p{{Ll}}++)?){{0,1}} {_word}{_end}"
    ),
}
ANY = "|".join(PATTERNS.values())
#: A cheap first look: no pattern can match a text without one of these.
HINT = rf"@|\d{{3}}|\d\.\d|\d[ -]\d|(?i:password|passwd|pwd|token|secret|api[_-]?key)|{_start}(?:(?=\p{{Lu}})(?:{_given}|{_titles})|г-)"
#: Tries of a given name that take one from the list, and of a number that keep its length; later ones make a word up or add digits.
LISTED = 6


def entity_type(entity: Column) -> Column:
    """The first type whose pattern matches the whole entity; null for what only looks like one."""
    cases = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in PATTERNS.items():
        whole = entity.rlike(rf"^(?:{pattern})$")
        # Long numbers that are no cards are often counters or references, and stay.
        whole = whole & (luhn(entity) == 0) if name == "card" else whole | entity.rlike(r"^\d{10}$") if name == "phone" else whole
        cases = cases.when(whole, F.lit(name))
    return cases


def normalised(text: Column, kind: Column) -> Column:
    """Spellings of one unit: letter case of words and grouping of numbers do not matter."""
    digits = F.regexp_replace(text, r"[^\d+]", "")
    return (
        F.when(kind.isin("local", "domain", "surname", "given-m", "given-f"), F.lower(text))
        .when(kind.isin("card", "phone", "ssn"), digits).when(kind == "iban", F.replace(text, F.lit(" "))).otherwise(text)
    )


def _title(entity: Column) -> Column:
    return F.regexp_extract(entity, rf"^(?:(?:{_titles})\.? ){{1,2}}", 0)


def _units(entity: Column, kind: Column, title: Column) -> Column:
    """The units of an entity as structs of kind, id and text."""
    unit = lambda k, ident, text: F.struct(k.alias("kind"), F.concat_ws(":", k, ident).alias("id"), text.alias("text"))
    words = F.split(F.substr(entity, F.char_length(title) + 1), " ")
    # A title that states a gender decides it, else the given name; else it is taken as male.
    stated = F.when(title.rlike(rf"{_start}(?:{'|'.join(TITLES['f'])})\.? "), F.lit("given-f")).when(title.rlike(rf"{_start}(?:{'|'.join(TITLES['m'])})\.? "), F.lit("given-m"))
    given = lambda w: F.coalesce(stated, F.when(F.substring_index(w, "-", 1).isin(*_by_gender["f"]), F.lit("given-f")), F.lit("given-m"))
    name = F.transform(words, lambda w, i: F.when(i == F.size(words) - 1, unit(F.lit("surname"), F.lower(w), w)).otherwise(unit(given(w), F.lower(w), w)))
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    email = F.array(unit(F.lit("local"), F.lower(entity), local), unit(F.lit("domain"), F.lower(domain), domain))
    return F.when(kind == "name", name).when(kind == "email", email).when(kind.isNull(), F.array().cast("array<struct<kind:string,id:string,text:string>>")).otherwise(F.array(unit(kind, normalised(entity, kind), entity)))


def parts_of(found: Column) -> Column:
    """Each entity of an array with its kind, title and units; no units where it is none after all."""
    typed = F.transform(found, lambda e: F.struct(e.alias("entity"), entity_type(e).alias("kind"), _title(e).alias("title")))
    return F.transform(typed, lambda x: F.struct(x["entity"].alias("entity"), x["kind"].alias("kind"), x["title"].alias("title"), _units(x["entity"], x["kind"], x["title"]).alias("units")))


def _keyed(message: Column, key: str) -> Column:
    """HMAC-SHA-512 of a text, as hex digits."""
    raw = key.encode()
    raw = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 512))), 512)


def _drawn(digest: Column) -> Column:
    """A digest with the digits and Latin letters that it stands for, so that each is made once."""
    return F.struct(digest.alias("digest"), F.translate(digest, "abcdef", "258147").alias("digits"), F.translate(digest, _HEX, _LATIN).alias("low"))


def _is(script: str, text: Column, whole: bool = False) -> Column:
    return text.rlike(rf"^\p{{Is{script}}}$" if whole else rf"\p{{Is{script}}}")


def _masked(text: Column, draw: Column) -> Column:
    """text with each digit and letter replaced by one of its kind and script, drawn from a digest."""
    at = lambda source, i: F.substring(draw[source], (i % 128) + 1, 1)

    def one(c: Column, i: Column) -> Column:
        out = F.when(c.rlike(r"^\d$"), at("digits", i)).when(c.rlike(r"^[A-Z]$"), F.upper(at("low", i))).when(c.rlike(r"^[a-z]$"), at("low", i)).when(~c.rlike(r"^\p{L}$"), c)
        for script, letters in LETTERS.items():
            letter = F.translate(at("digest", i), _HEX, letters)
            out = out.when(_is(script, c, True), F.when(c == F.lower(c), letter).otherwise(F.upper(letter)))
        return out.when(c.rlike(r"^\p{Lu}$"), F.upper(at("low", i))).otherwise(at("low", i))

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def _over_digits(entity: Column, draw: Column, skip: Column | int) -> Column:
    """entity with its digits after the first skip ones replaced, by their place among the digits."""
    step = F.aggregate(
        F.split(entity, ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("n")),
        lambda acc, c: F.struct(
            F.concat(acc["s"], F.when(c.rlike(r"^\d$") & (acc["n"] >= skip), F.substring(draw["digits"], acc["n"] + 1, 1)).otherwise(c)).alias("s"),
            (acc["n"] + F.when(c.rlike(r"^\d$"), F.lit(1)).otherwise(F.lit(0))).alias("n"),
        ),
    )
    return step["s"]


def luhn(number: Column) -> Column:
    """Luhn sum modulo 10 of a text's digits, right to left."""
    plain = F.reverse(F.regexp_replace(number, r"\D", ""))
    digits = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(digits, F.lit(0), lambda s, x: s + x) % 10


def iban_rest(iban: Column) -> Column:
    """An IBAN's number modulo 97, which is 1 for valid ones."""
    plain = F.replace(iban, F.lit(" "))
    moved = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    value = lambda c: F.when(c.rlike(r"^\d$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    values = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), value)
    return F.aggregate(values, F.lit(0), lambda s, x: (s * F.when(x > 9, 100).otherwise(10) + x) % 97)


def made(units: Column, key: str, tries: Callable[[Column], Column]) -> Column:
    """The surrogates of an array of units, at the try number that tries gives for each id."""
    seeded = F.transform(units, lambda u: F.struct(u["kind"].alias("kind"), u["text"].alias("text"), u["id"].alias("id"), tries(u["id"]).alias("n")))
    drawn = F.transform(seeded, lambda u: F.struct(u["kind"].alias("kind"), u["text"].alias("text"), u["n"].alias("n"), _drawn(_keyed(F.concat_ws("|", u["id"], u["n"].cast("string")), key)).alias("draw")))
    return F.transform(drawn, lambda u: _surrogate(u["text"], u["kind"], u["draw"], u["n"]))


def _surrogate(text: Column, kind: Column, draw: Column, n: Column) -> Column:
    digest, cyrillic = draw["digest"], _is("Cyrillic", text)
    other = text.rlike("|".join(rf"\p{{Is{x}}}" for x in LETTERS if x != "Cyrillic"))  # scripts without listed names
    # From the third try on words and secrets grow by a letter per try, and numbers by a digit once they kept colliding.
    added = F.substring(digest, F.lit(65), F.least(n - 1, F.lit(60)))
    more = F.translate(added, _HEX, _LATIN)
    for script, letters in LETTERS.items():
        more = F.when(_is(script, text), F.translate(added, _HEX, letters)).otherwise(more)
    more = F.when(n > 1, more).otherwise(F.lit(""))
    digits = F.when(n >= LISTED, F.substring(draw["digits"], F.lit(65), F.least(n - LISTED + 1, F.lit(60)))).otherwise(F.lit(""))
    word = F.concat(_masked(text, draw), more)
    label, last = F.regexp_extract(text, r"^([^.]+)", 1), F.lower(F.regexp_extract(text, r"([^.]+)$", 1))
    domain = F.concat(F.lower(_masked(label, draw)), more, F.lit(".example."), last)
    secret_head = F.regexp_extract(text, "^" + _head, 0)
    secret = F.concat(secret_head, _masked(F.substr(text, F.char_length(secret_head) + 1), draw), more)
    octet = lambda i: F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("int")
    ip = F.concat(F.concat_ws(".", (1 + octet(0) % 223).cast("string"), *((octet(i) % 256).cast("string") for i in (1, 2, 3))), F.when(digits != "", F.concat(F.lit("."), digits)).otherwise(""))
    # A card keeps its first digit. The last one is set so that a valid number stays valid and
    # another stays as far off as it was.
    card = F.transform(F.array(F.concat(_over_digits(text, draw, 1), digits)), lambda c: F.concat(F.substr(c, F.lit(1), F.char_length(c) - 1), F.pmod(F.right(c, F.lit(1)).cast("int") - luhn(c) + luhn(text), F.lit(10)).cast("string")))[0]
    blank = F.concat(F.left(text, F.lit(2)), F.lit("00"), _masked(F.substr(text, F.lit(5)), draw), digits)
    check = lambda x: F.pmod(iban_rest(text) - iban_rest(x), F.lit(97))
    iban = F.transform(F.array(blank), lambda x: F.concat(F.left(x, F.lit(2)), F.lpad((check(x) + F.when(check(x) < 2, 97).otherwise(0)).cast("string"), 2, "0"), F.substr(x, F.lit(5))))[0]
    # A telephone number keeps its country code: all digits before a separator, else one for +1 and +7, two for others.
    code = F.regexp_extract(text, r"^\+(\d{1,3})(?=[ .(-])", 1)
    skip = F.when(~text.startswith("+"), 0).when(code != "", F.char_length(code)).when(text.rlike(r"^\+[17]"), 1).otherwise(2)
    nth = lambda names, at: F.element_at(F.array(*map(F.lit, names)), F.conv(F.substring(digest, at, 6), 16, 10).cast("int") % len(names) + 1)
    pick = lambda names: F.when(text.contains("-"), F.concat(nth(names, 1), F.lit("-"), nth(names, 7))).otherwise(nth(names, 1))
    listed = F.coalesce(*(F.when((kind == f"given-{g}") & (cyrillic if s == "cyrillic" else ~cyrillic), pick(names)) for s, by in GIVEN.items() for g, names in by.items()))
    return (
        F.when(kind == "local", F.lower(word)).when(kind == "surname", word).when(kind == "domain", domain).when(kind.startswith("given"), F.when((n < LISTED) & ~other, listed).otherwise(word))
        .when(kind == "secret", secret).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", F.concat(_over_digits(text, draw, skip), digits))
        .when(kind == "ssn", F.concat(_over_digits(text, draw, 0), digits)).when(kind == "iban", iban).otherwise(text)
    )


def found_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def units(docs: DataFrame) -> DataFrame:
    """Every unit of docs (text), once: id, kind and one spelling of its text."""
    found = docs.select(F.explode(F.array_distinct(found_in(F.col("text")))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))
    parts = found.select(F.explode(parts_of(F.array("entity"))[0]["units"]).alias("u"))
    return parts.groupBy("u.id", "u.kind").agg(F.min("u.text").alias("text"))


def collisions(known: DataFrame, key: str, folder: str) -> DataFrame | None:
    """id and tries of the units that need a try number above 0; None if there are none.

    Surrogates are compared in normal form, local parts within their domain. Of the units that share
    one the smallest id keeps it; one that equals a real unit moves on, but for given names, whose
    surrogates are meant to be usual ones. Each round moves only those. Surrogates grow with the try
    number, so the rounds come to an end whatever the units are.
    """
    moved: DataFrame | None = None
    real = known.filter("NOT kind LIKE 'given%'").select(F.col("id").alias("made"), F.lit(True).alias("is_real"))
    for n in itertools.count():
        rows = known.withColumn("tries", F.lit(0)) if moved is None else known.join(moved, "id", "left").withColumn("tries", F.coalesce("tries", F.lit(0)))
        one = F.array(F.struct("kind", "text", "id"))
        new = rows.select("id", "kind", "tries", made(one, key, lambda _: F.col("tries"))[0].alias("new"))
        scope = F.when(F.col("kind") == "local", F.concat(F.lit("@"), F.substring_index("id", "@", -1))).otherwise(F.lit(""))
        named = new.select("id", "tries", F.concat(F.concat_ws(":", "kind", normalised(F.col("new"), F.col("kind"))), scope).alias("made"))
        owners = named.groupBy("made").agg(F.min("id").alias("owner"), F.count("*").alias("n")).join(real, "made", "left")
        bad = named.join(owners.filter("n > 1 OR is_real"), "made").filter("is_real OR id <> owner").select("id", (F.col("tries") + 1).alias("tries"))
        bad = written(bad, f"{folder}/tries-{n}")
        if bad.isEmpty():
            return moved
        moved = bad if moved is None else written(moved.join(bad.select("id"), "id", "left_anti").unionByName(bad), f"{folder}/moved-{n}")
    return moved


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """docs with entities in text replaced, and n_entities (long) added.

    key is a secret; with it surrogates stay the same from run to run. Spark shows it in plans and event logs.

    Texts are cut at the entities and joined again with the surrogates between, so a replacement
    never touches another part of the text.
    """
    folder = shared_dir(docs.sparkSession)
    hinted = docs.filter(F.col("text").rlike(HINT))
    known = written(units(hinted.select("text")), f"{folder}/units")
    moved = collisions(known, key, folder)
    rows = docs.withColumn("__found", F.when(F.col("text").rlike(HINT), found_in(F.col("text"))))
    tries = None
    if moved is not None:
        # Documents that hold a moved unit get a map of try numbers; others are not joined to any. Rows without an id are told apart by their text.
        part = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0))
        ids = F.explode(F.array_distinct(F.flatten(F.transform(parts_of(F.array_distinct(found_in(F.col("text")))), lambda x: F.transform(x["units"], lambda u: u["id"])))))
        held = hinted.select(F.col("doc_id").alias("__id"), part.alias("__part"), ids.alias("id")).join(moved, "id").distinct()
        maps = held.groupBy("__id", "__part").agg(F.map_from_entries(F.collect_list(F.struct("id", "tries"))).alias("__tries"))
        rows = rows.withColumn("__own", part).join(maps, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__part")), "left").drop("__id", "__part", "__own")
        tries = F.col("__tries")
    number = lambda ident: F.lit(0) if tries is None else F.coalesce(F.try_element_at(tries, ident), F.lit(0))
    rows = rows.withColumn("__new", F.transform(parts_of(F.col("__found")), lambda x: F.struct(x["kind"].alias("kind"), F.when(x["kind"].isNull(), x["entity"]).otherwise(F.concat(x["title"], F.call_function("array_join", made(x["units"], key, number), F.when(x["kind"] == "email", "@").otherwise(" ")))).alias("new"))))
    rest = F.split(F.col("text"), ANY, -1)
    woven = F.array_join(F.zip_with(rest, F.col("__new.new"), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    n = F.coalesce(F.size(F.array_compact(F.col("__new.kind"))), F.lit(0)).cast("long")
    return rows.withColumns({"n_entities": F.greatest(n, F.lit(0).cast("long")), "text": F.when(n > 0, woven).otherwise(F.col("text"))}).drop("__found", "__new", "__tries")
