"""Personal data: detection and keyed surrogates, with DataFrame functions only.

An entity's surrogate is a keyed permutation of its characters within their classes: digits stay digits, vowels
vowels, capitals capitals, letters of a script in that script; separators, country codes, titles and the endings that
carry a longer name's gender stay. A two-half Feistel network F gives the permutation, and the surrogate is
F⁻¹(s(F(x))), where s moves the first character on by one. Every letter belongs to a class of two or more, so this is
a bijection without fixed points on each format: distinct entities get distinct surrogates and none keeps its value,
in the whole corpus, with no table of entities and no shuffle; one entity gets one surrogate wherever it stands,
whatever its case or separators. ``collisions`` checks that over a corpus. Each word of a name is permuted on its own.
Names are found beside titles; where a text has such a name, its other mentions there, the full name or the surname
without a title, get the same surrogate. The check columns count both sides in each row.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Titles before names, by the gender that they tell; the titles stay in the text.
TITLES = {
    "m": ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Don", "Г-н", "Κος", "Κύριος", "السيد"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Sra", "Srta", "Madame", "Mme", "Mademoiselle", "Mlle", "Doña", "Г-жа", "Κα", "Κυρία", "السيدة", "الآنسة"],
    "": ["Dr", "Prof", "Δρ", "الدكتور", "الدكتورة"],
}
# Titles behind names.
TITLES_BEHIND = ["先生", "女士", "小姐", "さん", "様", "씨"]
_NAME = r"(?:\p{Lu}[\p{L}\p{M}'’-]+|[\p{Lo}][\p{Lo}\p{M}]+)"
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_BEHIND = "|".join(TITLES_BEHIND)
#: In this order; the first that matches at a place wins. Group-free, as the texts are split by them.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z]|-[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\)|[ .-]?[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.? {_NAME}(?: {_NAME})?|(?<!\p{{L}})[\p{{IsHan}}\p{{IsHangul}}]{{1,4}}(?:{_BEHIND})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without this, an @ or a title has no entity; the test is cheap.
NUMERIC = r"[0-9][0-9. ()-]{5}|[A-Z][0-9]{2}"
# Classes of basic letters and of Greek and Cyrillic ones; a surrogate's character is of the original's class.
CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ"]
#: First and last code points of letters without case; such a letter is moved within its range.
RANGES = ((0x05D0, 0x05EA), (0x0621, 0x063A), (0x0641, 0x064A), (0x0671, 0x06D3), (0x0904, 0x0939), (0x0E01, 0x0E2E), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x3400, 0x4DBF), (0x4E00, 0x9FEF), (0xAC00, 0xD7A3))
ROUNDS = 3


def _other_classes(taken: set[str]) -> list[str]:
    """Classes of all other letters with case up to U+1FFF: for each script, and for Latin common letters and rare ones
    apart, one of small letters and one of their capitals in the same order, and one of letters without a partner."""
    small: dict[str, list[str]] = {}
    alone: dict[str, list[str]] = {}
    for c in map(chr, range(0x80, 0x2000)):
        if c in taken or unicodedata.category(c) not in ("Lu", "Ll"):
            continue
        group = unicodedata.name(c).split()[0] + ("" if ord(c) < 0x180 else "+")
        if len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c and c.upper() not in taken:
            small.setdefault(group, []).append(c)
        elif c.lower() == c or len(c.lower()) > 1 or c.lower().upper() != c or c.lower() in taken or ord(c.lower()) >= 0x2000:
            alone.setdefault("", []).append(c)
    pairs = [["".join(cs), "".join(c.upper() for c in cs)] for cs in small.values() if len(cs) > 1]
    rest = alone.get("", []) + [x for cs in small.values() if len(cs) == 1 for c in cs for x in (c, c.upper())]
    return [c for pair in pairs for c in pair] + ["".join(rest)]


CLASSES += _other_classes(set("".join(CLASSES)))
_ALL = "".join(CLASSES)
#: By place in ``_ALL``, four digits each: where the character's class begins, and its size.
_STARTS = "".join(f"{sum(map(len, CLASSES[:k])) + 1:4}" * len(c) for k, c in enumerate(CLASSES))
_SIZES = "".join(f"{len(c):4}" * len(c) for c in CLASSES)


def _char(text: Column, at: Column) -> Column:
    return F.substring(text, at, F.lit(1))


def _once(value: Column, work) -> Column:
    """``work(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), work), 1)


def _moved(c: Column, by: Column) -> Column:
    """The character ``by`` places on in its class; a letter of no class counts as the basic one that its code names,
    other characters stay."""
    number = lambda table, at: F.trim(F.substring(F.lit(table), at * 4 - 3, F.lit(4))).cast("int")

    def place(at: Column) -> Column:
        start, size = number(_STARTS, at), number(_SIZES, at)
        return _char(F.lit(_ALL), start + F.pmod(at - start + by, size).cast("int"))

    def by_code(code: Column) -> Column:
        letter = lambda x: F.decode(F.unhex(F.lpad(F.hex(x), 8, "0")), "UTF-32")
        out = F.when(F.rlike(c, F.lit(r"\p{L}")), _char(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.pmod(code + by, F.lit(26)) + 1).cast("int"))).otherwise(c)
        for lo, hi in RANGES:
            out = F.when(code.between(lo, hi), letter(F.pmod(code - lo + by, F.lit(hi - lo + 1)) + lo)).otherwise(out)
        return out

    listed = _once(F.instr(F.lit(_ALL), c), lambda at: F.when(at > 0, place(F.greatest(at, F.lit(1)))))
    return F.coalesce(listed, _once(F.ascii(c).cast("long"), by_code))


def _each(text: Column, work) -> Column:
    """``work(character, place from 0)`` of each character, joined."""
    return F.array_join(F.transform(F.split(text, ""), lambda c, k: F.when(c == "", c).otherwise(work(c, k))), "")


#: The steps of F⁻¹ ∘ s ∘ F: (side, sign, number of the round); s moves the first character only, by its sign.
_STEPS = [(n % 2, 1, n) for n in range(1, ROUNDS + 1)] + [(1, 1, 0)] + [(n % 2, -1, n) for n in range(ROUNDS, 0, -1)]


def permuted(text: Column, key: str, kind: Column) -> Column:
    """A keyed bijection of strings that keeps each character's class and has no fixed point where the first
    character belongs to a class.

    Each round moves every character of one half by a keyed function of the other half, blind to case.
    """
    cut = F.floor((F.length(text) + 1) / 2).cast("int")
    halves = F.struct(F.substring(text, F.lit(1), cut).alias("l"), F.substring(text, cut + 1, F.length(text)).alias("r"))
    steps = F.array(*(F.struct(F.lit(side == 1).alias("left"), F.lit(sign).alias("sign"), F.lit(n).alias("n")) for side, sign, n in _STEPS))

    def step(v: Column, s: Column) -> Column:
        own, other = F.when(s["left"], v["l"]).otherwise(v["r"]), F.when(s["left"], v["r"]).otherwise(v["l"])
        seed = F.concat(F.lit(f"{key}|"), kind, s["n"].cast("string"), F.lit("|"), F.length(own).cast("string"), F.lit("|"), F.lower(other))

        def shift(pad: Column, k: Column) -> Column:
            keyed = F.conv(F.substring(pad, F.pmod(k * 4, F.lit(128)) + 1, F.lit(4)), 16, 10).cast("long")
            return F.when(s["n"] > 0, keyed).when(k == 0, 1).otherwise(0) * s["sign"]

        new = _once(F.sha2(seed, 512), lambda pad: _each(own, lambda c, k: _moved(c, shift(pad, k))))
        return _once(new, lambda x: F.struct(F.when(s["left"], x).otherwise(v["l"]).alias("l"), F.when(s["left"], v["r"]).otherwise(x).alias("r")))

    return F.aggregate(steps, halves, step, lambda v: F.concat(v["l"], v["r"]))


def _refilled(form: Column, places: Column, chars: Column) -> Column:
    """``form`` with what matches ``places``, single characters, replaced in order by ``chars``."""
    cut = F.split(F.regexp_replace(form, places, F.lit("\x01")), "\x01", -1)
    return F.array_join(F.transform(cut, lambda p, k: F.when(k == 0, p).otherwise(F.concat(_char(chars, k), p))), "")


def _luhn(digits: Column) -> Column:
    """The check digit of a string of digits."""
    n = F.length(digits)
    value = lambda k: _char(digits, k + 1).cast("int") * F.when(F.pmod(n - k, F.lit(2)) == 1, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda t, k: t + value(k) - F.when(value(k) > 9, 9).otherwise(0))
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))


def _ip(text: Column, key: str) -> Column:
    """Octets shifted by a keyed function of the others, and the last moved on: a bijection without fixed point."""
    part = lambda k: F.element_at(F.split(text, r"\."), k).cast("int")
    digest = lambda *x: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *x), 256), 1, 6), 16, 10).cast("long")
    last = F.pmod(part(4) - 1 + 1 + F.pmod(digest(part(1), part(2), part(3)), F.lit(253)), F.lit(254)) + 1
    keep = (part(4) < 1) | (part(4) > 254)
    low = F.when(keep, part(4)).otherwise(last)
    third = F.pmod(part(3) + 1 + F.pmod(digest(part(1), part(2), F.lit("c")), F.lit(255)), F.lit(256))
    second = F.pmod(part(2) + 1 + F.pmod(digest(part(1), F.lit("b")), F.lit(255)), F.lit(256))
    return F.concat_ws(".", part(1), second, third, low)


def kind_of(found: Column) -> Column:
    """The first kind whose pattern is the whole match."""
    out = F.lit("name")
    for kind, pattern in reversed(PATTERNS.items()):
        bare = pattern
        out = F.when(F.rlike(found, F.lit(rf"^(?:{bare})$")), F.lit(kind)).otherwise(out)
    return out


def _name(words: Column, key: str) -> Column:
    """Each word permuted on its own. The last letter of four or more, which often tells the gender, and an ``'s``
    behind it stay."""
    ends = r"^(.+?)((?<=\p{L}{3})[\p{Lu}\p{Ll}]['’]s|(?<=\p{L}{3})[\p{Lu}\p{Ll}]['’]?-*|['’]s|['’-]*)$"

    def word(w: Column) -> Column:
        return _once(F.struct(F.regexp_extract(w, ends, 1).alias("form"), F.regexp_extract(w, ends, 2).alias("back")), filled)

    def filled(v: Column) -> Column:
        core = F.regexp_replace(v["form"], r"[^\p{L}\p{N}]", "")
        return F.concat(_refilled(v["form"], F.lit(r"[\p{L}\p{N}]"), permuted(core, key, F.lit("name"))), v["back"])

    return F.array_join(F.transform(F.split(words, " "), word), " ")


def bare_name(found: Column) -> Column:
    """A match without the title before or behind it; other matches stay."""
    return F.regexp_replace(F.regexp_replace(found, rf"^(?:{_TITLE})\.? ", ""), f"(?<=[\\p{{IsHan}}\\p{{IsHangul}}])(?:{_BEHIND})$", "")


def other_mentions(found: Column) -> Column:
    """A pattern of the full names and surnames among the matches, without titles, as written or in capitals; null
    where there is none of two characters or more."""
    names = F.filter(found, lambda m: F.rlike(m, F.lit(f"^(?:{PATTERNS['name']})$")))
    bare = F.transform(names, lambda m: F.regexp_replace(bare_name(m), r"['’]s$|['’-]+$", ""))
    both = F.array_distinct(F.concat(bare, F.transform(bare, lambda m: F.substring_index(m, " ", -1))))
    both = F.array_distinct(F.concat(both, F.transform(both, lambda m: F.upper(m))))
    # longer ones first: a full name before its surname; names are letters, apostrophes and hyphens only
    sized = F.reverse(F.array_sort(F.transform(both, lambda m: F.struct(F.length(m).alias("n"), m.alias("m")))))
    some = F.array_join(F.transform(F.filter(sized, lambda x: x["n"] > 1), lambda x: x["m"]), "|")
    return F.when(some != "", F.concat(F.lit(r"(?<!\p{L})(?:"), some, F.lit(r")(?!\p{L})")))


def surrogate(found: Column, key: str) -> Column:
    """The replacement of one match: what stays in front and behind by its kind, and the permuted rest."""
    n = F.length(found)
    code = F.regexp_extract(found, r"^(\+[0-9]{1,3}(?=[ .(-]))", 1)
    title = F.regexp_extract(found, rf"^((?:{_TITLE})\.? )", 1)

    def whole(kind: Column) -> Column:
        front = F.when(kind == "phone", code).when(kind == "iban", F.substring(found, 1, 2)).otherwise("")
        # an address keeps its last domain label, a card its check digit for now
        back = F.when(kind == "email", F.concat(F.lit("."), F.substring_index(found, ".", -1))).when(kind == "card", _char(found, n)).otherwise("")
        return _once(F.struct(kind.alias("kind"), front.alias("front"), back.alias("back")), filled)

    def filled(v: Column) -> Column:
        form = F.substring(found, F.length(v["front"]) + 1, n - F.length(v["front"]) - F.length(v["back"]))
        core = F.regexp_replace(form, r"[^\p{L}\p{N}]", "")
        new = F.struct(core.alias("old"), permuted(core, key, v["kind"]).alias("new"))
        check = lambda x: F.pmod(v["back"].cast("int") + _luhn(x["new"]) - _luhn(x["old"]), F.lit(10)).cast("string")
        return _once(new, lambda x: F.concat(v["front"], _refilled(form, F.lit(r"[\p{L}\p{N}]"), x["new"]), F.when(v["kind"] == "card", check(x)).otherwise(v["back"])))

    kind = kind_of(found)
    bare = bare_name(found)
    named = F.concat(title, _name(bare, key), F.substring(found, F.length(title) + F.length(bare) + 1, n))
    return _once(kind, lambda k: F.when(k == "ip", _ip(found, key)).when(k == "name", named).otherwise(whole(k)))


def _replaced(docs: DataFrame, text: Column, key: str, keep: dict[str, Column]) -> DataFrame:
    """Columns ``keep``, and ``__text`` with surrogates, ``__m`` the entities and ``__s`` their surrogates."""
    none = F.expr("cast(array() as array<string>)")
    named = docs.select(*(c.alias(n) for n, c in keep.items()), text.alias("__text"))
    text = F.col("__text")
    titles = [t + end for ts in TITLES.values() for t in ts for end in (" ", ". ")] + TITLES_BEHIND
    hinted = reduce(lambda a, t: a | F.contains(text, F.lit(t)), titles, F.contains(text, F.lit("@")) | F.rlike(text, F.lit(NUMERIC)))
    hinted = F.coalesce(hinted, F.lit(False))
    found = named.withColumn("__m", F.when(hinted, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none))
    found = found.withColumn("__p", F.when(F.size("__m") > 0, F.concat(F.lit(f"{ANY}|"), other_mentions(F.col("__m")))))
    found = found.withColumn("__m", F.when(F.col("__p").isNotNull(), F.regexp_extract_all(text, F.col("__p"), F.lit(0))).otherwise(F.col("__m")))
    made = found.withColumn("__s", F.transform("__m", lambda m: surrogate(m, key)))
    parts = F.when(F.col("__p").isNotNull(), F.split(text, F.col("__p"), -1)).otherwise(F.split(F.when(F.size("__m") > 0, text), ANY, -1))
    joined = F.array_join(F.transform(parts, lambda p, k: F.concat(p, F.coalesce(F.try_element_at(F.col("__s"), k + 1), F.lit("")))), "")
    return made.select(*keep, F.when(F.size("__m") > 0, joined).otherwise(text).alias("__text"), "__m", "__s")


def _entity(found: Column) -> Column:
    return F.lower(bare_name(found))


def replace_pii(docs: DataFrame, key: str = "driftlens", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the text with surrogates, n_entities, n_distinct, n_surrogates.

    ``n_distinct`` and ``n_surrogates`` count distinct entities and distinct surrogates of the row, names by what
    stands beside the title, and are equal. Other mentions of a name count as entities.
    Null texts stay null with counts 0; texts without entities stay as they are; texts of any length are read whole.
    Repeated rows are treated each; an empty table gives no rows; other columns, whatever their names, are not read.
    No shuffle: one projection of the scan.
    """
    made = _replaced(docs, docs[text_col], key, {"__id": docs[id_col].cast("long")})
    distinct = lambda c: F.size(F.array_distinct(F.transform(c, _entity))).cast("long")
    return made.select(
        F.col("__id").alias(id_col), F.col("__text").alias(text_col), F.size("__m").cast("long").alias("n_entities"),
        distinct("__m").alias("n_distinct"), distinct("__s").alias("n_surrogates"),
    )


def with_surrogates(docs: DataFrame, key: str = "driftlens", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns in their order, whatever their names, with surrogates in the text."""
    names = [f"__k{k}" for k in range(len(docs.columns))]
    made = _replaced(docs, docs[text_col], key, {n: docs[c] for n, c in zip(names, docs.columns, strict=True) if c != text_col})
    return made.select(*((F.col("__text") if c == text_col else F.col(n)).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def collisions(docs: DataFrame, key: str = "driftlens", text_col: str = "text") -> DataFrame:
    """(surrogate, entities) of surrogates that stand for several entities of the corpus, or for themselves: none is
    expected. Pairs are made distinct before they are shuffled by surrogate."""
    made = _replaced(docs, docs[text_col], key, {})
    each = made.select(F.explode(F.arrays_zip("__m", "__s")).alias("x"))
    bare = lambda c: F.regexp_replace(_entity(F.col(c)), r"['’]s$|[^\p{L}\p{N}@.]", "")
    pairs = each.select(bare("x.__m").alias("entity"), bare("x.__s").alias("surrogate")).distinct()
    found = pairs.groupBy("surrogate").agg(F.count(F.lit(1)).alias("entities"), F.max(F.col("entity") == F.col("surrogate")).alias("same"))
    return found.where("entities > 1 or same").select("surrogate", "entities")
