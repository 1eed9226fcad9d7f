"""Text functions as Column expressions: normal forms, stems, surfaces, aliases, transliteration.

All stay in the JVM.  Character classes are spelled out, as Java's ``\\w`` and
``\\s`` are ASCII only; ``(?iu)`` is needed for Cyrillic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

# --- fixed values -----------------------------------------------------------
WORD = "[A-Za-zА-Яа-яЁё0-9]+(?:[-'][A-Za-zА-Яа-яЁё0-9]+)*"
LETTERS = "[A-Za-zА-Яа-яЁё]+(?:[-'][A-Za-zА-Яа-яЁё]+)*"
#: White space as Unicode has it.
WS = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
_OPEN, _CLOSE = '["«“]', '["»”]'
ALIAS = rf"{_OPEN}(.+?){_CLOSE}|\((.+?)\)"
# --- end of fixed values ----------------------------------------------------
_ENDING = "|".join(sorted(V.ENDINGS, key=len, reverse=True))


def quoted(value: str) -> str:
    """A string as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lits(values: list[str]) -> Column:
    """An array of strings; parsed as one expression, as every literal on its own is a call to the JVM."""
    return F.expr(f"array({', '.join(map(quoted, values))})")


def one_of(c: Column, values: list[str]) -> Column:
    return F.array_contains(lits(values), c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed, and stands in the plan, once."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def strip(c: Column, chars: str = " ,;") -> Column:
    """Leading and trailing characters of a set removed."""
    return F.trim(c, F.lit(chars))


def collapse(c: Column) -> Column:
    """White space runs turned into one space, and trimmed."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def normalize(c: Column) -> Column:
    """Lower case, ё as е, quote marks deleted, anything else but letters and digits one space."""
    x = F.lower(F.translate(c, "Ёё", "Ее"))
    x = F.regexp_replace(x, "[«»“”\"'`´]", "")
    return F.trim(F.regexp_replace(x, "[^0-9a-zа-я]+", " "))


def tokens(c: Column) -> Column:
    return tokens_of(normalize(c))


def tokens_of(normal: Column) -> Column:
    """Tokens of a text that is normalised already."""
    return F.filter(F.split(normal, " "), lambda t: t != "")


def stem(token: Column) -> Column:
    """A normalised token without its longest listed ending that leaves four letters; Latin and digits stay."""
    return F.when(token.rlike("^[a-z0-9]*$"), token).otherwise(F.regexp_replace(token, f"^(.{{4,}}?)(?:{_ENDING})$", "$1"))


def key_of(toks: Column) -> Column:
    return F.array_join(F.transform(toks, stem), " ")


def key(c: Column) -> Column:
    """Stemmed tokens joined by a space: what a surface is looked up by."""
    return key_of(tokens(c))


def unique_by(values: Column, by: Callable[[Column], Column]) -> Column:
    """The first value of each key, in order; values with an empty key are left out."""
    keyed = F.filter(F.transform(values, lambda v: F.struct(v.alias("v"), by(v).alias("k"))), lambda x: x.k != "")
    none = F.array().cast("array<struct<v:string,k:string>>")
    first = F.aggregate(keyed, none, lambda a, x: F.when(F.exists(a, lambda y: y.k == x.k), a).otherwise(F.concat(a, F.array(x))))
    return F.transform(first, lambda x: x.v)


def unique_clean(values: Column) -> Column:
    """Cleaned values, one for each normal form."""
    return unique_by(F.transform(values, lambda v: strip(collapse(v))), normalize)


def compact(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-zА-Яа-яЁё0-9]+", "")


def is_place(c: Column) -> Column:
    """Whether a surface names nothing but a place."""
    n = normalize(c)
    t = tokens_of(n)
    rest = F.array_join(F.slice(t, 2, 1 << 20), " ")
    meaningful = F.array_join(F.filter(t, lambda x: ~one_of(x, V.ADMIN_WORDS)), " ")
    return (
        F.when(n == "", False)
        .when(one_of(n, V.PLACES), True)
        .when((F.get(t, F.lit(0)) == "город") & one_of(rest, V.CITIES), True)
        .when((F.get(t, F.lit(0)) == "республика") & one_of(rest, V.REPUBLICS), True)
        .when(one_of(F.try_element_at(t, F.lit(-1)), V.REGION_KINDS), one_of(n, V.REGIONS))
        .otherwise((meaningful == "") | one_of(meaningful, V.PLACES))
    )


def is_significant(c: Column) -> Column:
    """Whether a surface is telling enough to be looked for."""
    n = normalize(c)
    t = tokens_of(n)
    one = F.get(t, F.lit(0))
    padded = F.concat(F.lit(" "), n, F.lit(" "))
    noisy = F.lit(False)
    for phrase in V.NOISY_PHRASES:
        noisy = noisy | padded.contains(phrase)
    number = n.rlike("^[0-9]+$")
    for prefix in V.NUMBER_PREFIXES:
        number = number | n.startswith(prefix)
    return (
        F.when(is_place(c) | one_of(n, V.GENERIC) | noisy | number, False)
        .when(compact(c).rlike("^[A-ZА-ЯЁ0-9]{3,}$"), True)
        .when(F.size(t) == 0, False)
        .when(F.size(t) >= 2, ~F.forall(t, lambda x: x.rlike("^[a-z]{1,5}$")) & (F.size(F.filter(t, lambda x: F.length(x) >= 2)) >= 2))
        .otherwise(~one.rlike("^(?:[a-z]{1,3}|[а-я]{1,4})$"))
    )


def is_significant_form(c: Column) -> Column:
    """The laxer test of runtime forms: three characters."""
    return F.length(F.replace(normalize(c), F.lit(" "), F.lit(""))) >= 3


def split_list(c: Column) -> Column:
    """Parts between commas and semicolons."""
    return F.filter(F.transform(F.split(c, "[;,]"), collapse_edges), lambda p: p != "")


def collapse_edges(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def extract_aliases(c: Column) -> Column:
    """Quoted and bracketed parts, their list items, and quotes within them."""
    whole = F.regexp_extract_all(c, F.lit(ALIAS), F.lit(0))
    raw = F.transform(whole, lambda m: F.regexp_extract(m, rf"(?s)^.(.*).$", 1))
    each = F.transform(raw, lambda r: F.concat(split_list(r), F.filter(F.regexp_extract_all(r, F.lit(rf"{_OPEN}(.+?){_CLOSE}"), F.lit(1)), lambda q: collapse(q) != "")))
    return unique_clean(F.flatten(each))


def strip_aliases(c: Column) -> Column:
    """The text without its quoted and bracketed parts."""
    return strip(F.regexp_replace(F.regexp_replace(c, ALIAS, ""), WS + "+", " "))


def capitalize_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def _replace_letters(c: Column) -> Column:
    for cyrillic, latin in V.TO_LATIN.items():
        c = F.replace(c, F.lit(cyrillic), F.lit(latin))
    return c


def to_latin(c: Column, keep_unknown: bool) -> Column:
    """Cyrillic letters in Latin; other characters stay or, for names in the registry, go."""
    low = F.regexp_replace(F.lower(c), "[^а-яё-]", "") if not keep_unknown else c
    if keep_unknown:  # only Cyrillic letters are lower-cased
        low = F.translate(c, "".join(V.TO_LATIN).upper(), "".join(V.TO_LATIN))
    return capitalize_first(_replace_letters(low))


def latin_variants(c: Column, keep_unknown: bool = True) -> Column:
    """Latin spellings: letter by letter, and with a softer "sht"."""
    plain = to_latin(c, keep_unknown)
    soft = capitalize_first(F.replace(F.lower(plain), F.lit("sht"), F.lit("st")))
    both = F.array(plain, F.when(F.lower(plain).contains("sht"), soft).otherwise(F.lit("")))
    return unique_clean(both)


def to_cyrillic(c: Column) -> Column:
    """A Latin surface in Cyrillic, digraphs first; empty for anything else."""
    low = normalize(c)
    out = low
    for latin, cyrillic in V.LATIN_DIGRAPHS:
        out = F.replace(out, F.lit(latin), F.lit(cyrillic))
    for latin, cyrillic in V.TO_CYRILLIC.items():
        out = F.replace(out, F.lit(latin), F.lit(cyrillic))
    return F.when(low.rlike("^[a-z0-9 ]+$"), capitalize_first(out)).otherwise(F.lit(""))


def transliterations(values: Column) -> Column:
    """Spellings of each value in the other script."""

    def one(v: Column) -> Column:
        latin = F.when(v.rlike("[А-Яа-яЁё]"), latin_variants(v)).otherwise(F.array().cast("array<string>"))
        return F.concat(latin, F.when(v.rlike("[A-Za-z]"), F.filter(F.array(to_cyrillic(v)), lambda x: x != "")).otherwise(F.array().cast("array<string>")))

    return unique_clean(F.flatten(F.transform(values, one)))


def acronym(c: Column, stops: list[str], by_length_first: bool) -> Column:
    """Initials of the words that aren't stop words, if there are 2 to 8; else empty.

    The registry drops one-letter words before it counts words, the matcher after.
    """
    words = F.filter(tokens(c), lambda t: ~one_of(t, stops) & ((F.length(t) > 1) | F.lit(not by_length_first)))
    initials = F.upper(F.array_join(F.transform(F.filter(words, lambda t: F.length(t) > 1), lambda t: F.substring(t, 1, 1)), ""))
    return F.when((F.size(words) >= 2) & F.length(initials).between(2, 8), initials).otherwise(F.lit(""))


def person_variants(name: Column) -> Column:
    """Orders of a person's name: surname, first name, patronymic."""
    t = tokens(name)
    orders2 = [(1, 0), (0, 1)]
    orders3 = [(1, 2, 0), (1, 0, 2), (0, 1, 2), (0, 2, 1)]
    pick = lambda order: F.concat_ws(" ", *[F.get(t, F.lit(i)) for i in order])
    none = F.array().cast("array<string>")
    two = F.array(*[pick(o) for o in orders2])
    return F.array_distinct(F.when(F.size(t) < 2, none).when(F.size(t) == 2, two).otherwise(F.concat(two, F.array(*[pick(o) for o in orders3]))))


def latin_components(surfaces: Column) -> Column:
    """Latin words of four characters or more."""
    words = F.flatten(F.transform(surfaces, lambda s: F.regexp_extract_all(s, F.lit(WORD), F.lit(0))))
    return F.array_distinct(F.filter(words, lambda w: w.rlike("^[A-Za-z][A-Za-z0-9-]{3,}$")))


def combined_status(statuses: Column, entity_type: Column) -> Column:
    """The label of all statuses together."""
    both = (entity_type == "organization") & F.array_contains(statuses, "terrorist_extremist") & F.array_contains(statuses, "undesirable_organization")
    left = F.when(both, F.array_except(statuses, lits(["terrorist_extremist", "undesirable_organization"]))).otherwise(statuses)
    left = F.when(F.array_contains(left, "terrorist_extremist"), F.array_except(left, lits(["extremist"]))).otherwise(left)
    label = F.create_map(*[F.lit(x) for kv in V.STATUS_LABELS.items() for x in kv])
    ordered = F.transform(in_order(left), lambda s: F.element_at(label, s))
    all_ = F.concat(F.when(both, lits([V.TERRORIST_UNDESIRABLE_LABEL])).otherwise(F.array().cast("array<string>")), ordered)
    listed = F.concat(F.array_join(F.slice(all_, 1, F.greatest(F.size(all_) - 1, F.lit(1))), ", "), F.lit(" и "), F.try_element_at(all_, F.lit(-1)))
    return F.when(F.size(all_) == 0, F.lit(V.NO_STATUS_LABEL)).when(F.size(all_) == 1, F.get(all_, F.lit(0))).otherwise(listed)


def in_order(statuses: Column) -> Column:
    """Known statuses once each, in their fixed order."""
    return F.filter(lits(V.STATUS_ORDER), lambda s: F.array_contains(statuses, s))


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)
