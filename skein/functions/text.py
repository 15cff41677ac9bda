"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCENTED, PLAIN = "áéíóúüñ", "aeiouun"
TOKEN = r"\b([a-z][a-z0-9_-]{2,})\b"
LIGHT = r"(?U)[\w-]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, even where ``use`` has it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def worked_out(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once a row: a generator of one row, into which no later projection is merged."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def first_set(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def fold(text: Column) -> Column:
    """Lower case without the accents of Spanish, a dotted capital I as one letter. Replacing letter by letter costs less than ``translate``, which looks up every character."""
    out = F.lower(F.replace(text, F.lit("İ"), F.lit("i")))
    for accented, plain in zip(ACCENTED, PLAIN, strict=True):
        out = F.replace(out, F.lit(accented), F.lit(plain))
    return out


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def fold_squeeze(text: Column) -> Column:
    return squeeze(fold(text))


def canon(text: Column) -> Column:
    """Folded text in ASCII: letters and digits beyond it become ``Z``, other signs a space. Regular expressions of all engines agree on it."""
    return F.regexp_replace(F.regexp_replace(fold(text), r"[^\x00-\x7F\p{L}\p{N}]", " "), r"[^\x00-\x7F]", "Z")


def compare_key(text: Column) -> Column:
    """Folded words of letters and digits, for comparison."""
    return squeeze(F.regexp_replace(fold(text), r"[^a-z0-9\s]", " "))


def dedup_text(text: Column) -> Column:
    """A comparison key that also leaves out the scheme and ``www.`` of an address."""
    bare = F.regexp_replace(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"^https?://", ""), r"^www\.", "")
    return F.trim(F.regexp_replace(bare, r"[^a-z0-9]+", " "))


def words(terms: Sequence[str]) -> Column:
    return F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")


def tokenize(text: Column, stopwords: Sequence[str] = ()) -> Column:
    """Folded words of three characters and more that begin with a letter, without the stop words."""
    found = F.regexp_extract_all(fold(text), F.lit(TOKEN), 1)
    if not stopwords:
        return found
    stops = frozenset(s.lower().translate(str.maketrans(ACCENTED, PLAIN)).strip() for s in stopwords)
    return F.filter(found, lambda t: ~t.isin(*sorted(stops)))


def tokenize_plain(text: Column, stopwords: Sequence[str] = ()) -> Column:
    """Like :func:`tokenize`, but of the comparison key: hyphens and underscores part words."""
    return tokenize(compare_key(text), stopwords)


def tokenize_light(text: Column) -> Column:
    """Lower-case words of three characters and more, hyphens within."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(LIGHT), 0), F.lower), lambda t: F.length(t) > 2)


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by a space."""
    if n == 1:
        return tokens

    def grams(t: Column) -> Column:
        last = F.size(t) - (n - 1)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(last > 0, runs).otherwise(F.array().cast("array<string>"))

    return let(tokens, grams)


def first_of(parts: Column, most: int | None) -> Column:
    return parts if most is None else F.slice(parts, 1, most)


def event_sentences(text: Column, most: int | None = 80) -> Column:
    """The first ``most`` sentences of 45 to 500 characters, all with ``None``; one ends before a capital or a digit."""
    parts = F.split(squeeze(text), r"(?<=[.!?¿¡])\s+(?=[A-ZÁÉÍÓÚÑ0-9¿¡])")
    return first_of(F.filter(parts, lambda s: F.length(s).between(45, 500)), most)


def sentences(text: Column, most: int | None = 80) -> Column:
    """The first ``most`` sentences of 25 characters and more, all with ``None``."""
    return first_of(F.filter(F.split(squeeze(text), r"(?<=[.!?¿¡])\s+"), lambda s: F.length(s) >= 25), most)


def quoted(term: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else f"\\{c}" for c in term)


def count_word(text: Column, term: str) -> Column:
    """How often ``term`` stands in lower-case ``text`` with word boundaries around it."""
    return F.regexp_count(text, F.lit(rf"(?U)\b{quoted(term.lower())}\b"))


def count_words(text: Column, terms: Sequence[str]) -> Column:
    """An array of :func:`count_word` of each term. Terms without signs are found in one pass, as no two of them share a place."""
    single = sorted({t.lower() for t in terms if t and all(c.isalnum() or c == "_" for c in t)})
    rest = [t for t in terms if t.lower() not in single]
    found = F.regexp_extract_all(text, F.lit(rf"(?U)\b(?:{'|'.join(single)})\b"), 0) if single else words(())
    one = [lambda v, t=t: count_word(v["x"], t) if t in rest else F.size(F.filter(v["f"], lambda w: w == t.lower())) for t in terms]
    return let(F.struct(text.alias("x"), found.alias("f")), lambda v: F.array(*[f(v) for f in one])) if terms else F.array().cast("array<int>")


def count_substring(text: Column, term: str) -> Column:
    """How often ``term`` is in ``text``, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def markers_in(text: Column, terms: Sequence[str]) -> Column:
    """Those of the terms, in their order, that lower-case ``text`` has anywhere."""
    return let(text, lambda x: F.filter(words(terms), lambda t: F.contains(x, t)))


def markers_as_words(text: Column, terms: Sequence[str]) -> Column:
    """Those of the terms, in their order, that lower-case ``text`` has as words."""
    return let(text, lambda x: F.filter(F.array(*[F.when(x.rlike(rf"(?U)\b{quoted(t.lower())}\b"), F.lit(t)) for t in terms]), lambda t: t.isNotNull()))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays as sets, empty strings apart: 1 if both are empty, 0 if one is."""
    x, y = (F.array_distinct(F.filter(c, lambda t: t != "")) for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(union, F.lit(1)))
