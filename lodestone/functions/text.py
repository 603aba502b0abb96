"""Text expressions: tokens, n-grams, sentences, names. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]{2,}"
SENTENCE = r"[^.!?]+[.!?]*"
PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def tokens(text: Column, stop: Sequence[str] = ()) -> Column:
    """Lower-cased tokens of two or more word characters, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, though lambdas inside body may name it again and again."""
    return F.transform(F.array(value), body)[0]


def ngrams(terms: Column, sizes: Sequence[int] = (1, 2)) -> Column:
    """All runs of the given sizes, joined by a space; stop words must be out already."""

    def joined(t: Column) -> Column:
        return F.concat(*[t if n == 1 else F.when(F.size(t) >= n, _grams(t, n)).otherwise(F.array().cast("array<string>")) for n in sizes])

    return let(terms, joined)


def _grams(terms: Column, n: int) -> Column:
    """Adjacent terms, each run of n made of one of n - 1 and the term after it."""
    out = terms
    for k in range(1, n):
        out = F.zip_with(F.slice(out, 1, F.size(terms) - k), F.slice(terms, k + 1, F.size(terms) - k), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def runs(ordered: Column) -> Column:
    """(value, n): the values of a sorted array and how often each occurs."""

    def ends(a: Column) -> Column:
        last = F.size(a) - 1
        return F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (a[i] != a[F.least(i + 1, last)]))

    def counted(a: Column, e: Column) -> Column:
        return F.transform(e, lambda i, j: F.struct(a[i].alias("value"), (i - F.when(j > 0, e[F.greatest(j - 1, F.lit(0))]).otherwise(-1)).alias("n")))

    return let(ordered, lambda a: F.when(F.size(a) > 0, let(ends(a), lambda e: counted(a, e))))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences in order."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), strip), lambda s: s != "")


def piece_count(text: Column) -> Column:
    """Tokens that aren't white space: words and single signs."""
    return F.size(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def normalize_name(name: Column) -> Column:
    """Lower case, without signs but / and -, white space collapsed."""
    return collapse(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_\s/-]", ""))


def clean_name(name: Column, edges: Sequence[str]) -> Column:
    """White space collapsed, function words at either end and possessives dropped, punctuation stripped."""
    words = "|".join(edges)
    out = collapse(name)
    out = F.regexp_replace(out, rf"(?i)^(?:(?:{words}) )+(?=\S)", "")
    out = F.regexp_replace(out, rf"(?i)(?<=\S)(?: (?:{words}))+$", "")
    return F.regexp_replace(F.regexp_replace(out, "['’]s\\b", ""), r"^[\p{Punct}\s]+|[\p{Punct}\s]+$", "")


def safe_filename(name: Column) -> Column:
    """The last part of a path with unsafe signs as _, without spaces and dots at its ends; "document" if nothing is left."""
    base = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"[^A-Za-z0-9._ -]", "_")
    out = F.regexp_replace(base, r"^[ .]+|[ .]+$", "")
    return F.when(out == "", "document").otherwise(out)


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def looks_technical(name: Column) -> Column:
    return name.rlike(r"API|SDK|\d")


def inner_capitals(name: Column) -> Column:
    return F.substring(name, 2, 1 << 30).rlike(r"\p{Lu}")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector over its length; a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v.cast("array<double>")).otherwise(F.transform(v.cast("array<double>"), lambda x: x / norm))
