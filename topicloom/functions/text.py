"""Column functions on names and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An optional sign, then digits with single underscores between them, blanks around.
INT_PATTERN = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
#: What Python's float() takes, without underscores.
FLOAT_PATTERN = r"(?i)^\s*[+-]?((([0-9]+\.?[0-9]*)|(\.[0-9]+))(e[+-]?[0-9]+)?|nan|inf|infinity)\s*$"


def clean_name(name: Column, has_prefix: bool = False, has_extension: bool = False) -> Column:
    """Lower-cased name with - _ . as blanks; the first or last token can be dropped. Repeated blanks inside are kept."""
    spaced = F.translate(name, "-_.", "   ")
    tokens = F.split(spaced, " ", -1)
    if has_prefix:
        tokens = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    if has_extension:
        tokens = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.trim(F.lower(F.array_join(tokens, " ")))


def rdf_name(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit("-"))


def file_name(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def is_int(value: Column) -> Column:
    return F.coalesce(value.cast("string").rlike(INT_PATTERN), F.lit(False))


def is_float(value: Column) -> Column:
    return F.coalesce(value.cast("string").rlike(FLOAT_PATTERN), F.lit(False))


def strip_special(text: Column) -> Column:
    """Only word characters (any script) without _, single blanks, lower case."""
    kept = F.regexp_replace(text, r"(?U)[^\w\s]", "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(kept, "_", ""), r"(?U)\s+", " ")))


# Fixed value: the words of a column name.
NAME_WORDS = "([a-z][a-z1-9]*|[1-9]+|[A-Z](?:[a-z1-9]+|[A-Z1-9]+))"


def name_words(name: Column) -> Column:
    """The words of a column name, lower-case: camel case, capitals, lower case and digits 1-9 are split."""
    return F.transform(F.regexp_extract_all(name, F.lit(NAME_WORDS), F.lit(1)), F.lower)


def without_urls(text: Column) -> Column:
    """The blank-separated words that hold no http://, joined by blanks."""
    return F.array_join(F.filter(F.split(text, r"\s+"), lambda w: ~F.contains(w, F.lit("http://"))), " ")


def value_text(value: Column) -> Column:
    """Lower-cased words without links; null gives an empty text."""
    words = F.split(F.lower(F.coalesce(value.cast("string"), F.lit(""))), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~F.contains(w, F.lit("http"))), " ")


# The singular rules, words without a plural and irregular pairs of the public inflection library (MIT
# licence), by which names are looked up. The first pattern that occurs in a word is replaced, whatever its case.
SINGULARS = (
    ("(database)s$", "$1"), ("(quiz)zes$", "$1"), ("(matr)ices$", "$1ix"), ("(vert|ind)ices$", "$1ex"), ("(passer)sby$", "$1by"), ("^(ox)en", "$1"), ("(alias|status)(es)?$", "$1"),
    ("(octop|vir)(us|i)$", "$1us"), ("^(a)x[ie]s$", "$1xis"), ("(cris|test)(is|es)$", "$1is"), ("(shoe)s$", "$1"), ("(o)es$", "$1"), ("(bus)(es)?$", "$1"), ("(m|l)ice$", "$1ouse"),
    ("(x|ch|ss|sh)es$", "$1"), ("(m)ovies$", "$1ovie"), ("(s)eries$", "$1eries"), ("([^aeiouy]|qu)ies$", "$1y"), ("([lr])ves$", "$1f"), ("(tive)s$", "$1"), ("(hive)s$", "$1"), ("([^f])ves$", "$1fe"),
    ("(t)he(sis|ses)$", "$1hesis"), ("(s)ynop(sis|ses)$", "$1ynopsis"), ("(p)rogno(sis|ses)$", "$1rognosis"), ("(p)arenthe(sis|ses)$", "$1arenthesis"), ("(d)iagno(sis|ses)$", "$1iagnosis"),
    ("(b)a(sis|ses)$", "$1asis"), ("(a)naly(sis|ses)$", "$1nalysis"), ("([ti])a$", "$1um"), ("(n)ews$", "$1ews"), ("(ss)$", "$1"), ("s$", ""),
)
UNCOUNTED = ("equipment", "fish", "information", "jeans", "money", "rice", "series", "sheep", "species")
IRREGULAR = (("person", "people"), ("man", "men"), ("human", "humans"), ("child", "children"), ("sex", "sexes"), ("move", "moves"), ("cow", "kine"), ("zombie", "zombies"))


def singular_rules() -> list[tuple[str, str]]:
    """Patterns and what the first that occurs is replaced by: words without a plural stay, irregular pairs (a later one first) go before the endings."""
    stay = [(rf"(?i)\b({w})$", "$1") for w in UNCOUNTED]
    pairs = []
    for one, many in IRREGULAR:
        alike = [(f"(?i)({x[0]}){x[1:]}$", f"$1{one[1:]}") for x in (many, one)] if one[0] == many[0] else [(f"(?i){x}$", one) for x in (many, one)]
        pairs = alike + pairs
    return [*stay, *pairs, *((f"(?i){p}", r) for p, r in SINGULARS)]


def singular(word: Column) -> Column:
    """An English noun's singular, by endings: words that these rules do not know come out as the rules have it (gas: ga)."""
    out = None
    for pattern, ending in singular_rules():
        replaced = F.regexp_replace(word, pattern, ending)
        out = F.when(word.rlike(pattern), replaced) if out is None else out.when(word.rlike(pattern), replaced)
    return out.otherwise(word)


#: All characters but those of a kind; scripts other than Latin count.
CHARACTER_KINDS = {"digit": r"[^\p{Nd}]", "alpha": r"[^\p{L}]", "space": r"[^\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\p{Z}]"}


def character_features(text: Column) -> dict[str, Column]:
    """The length of a text, and counts and shares of digits, letters and white space."""
    length, out = F.length(text), {"n_chars": F.length(text)}
    for kind, others in CHARACTER_KINDS.items():
        out[f"n_{kind}"] = F.length(F.regexp_replace(text, others, ""))
        out[f"share_{kind}"] = F.when(length > 0, out[f"n_{kind}"] / length).otherwise(0.0)
    return out
