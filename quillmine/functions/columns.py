"""Column helpers: tokens, similarity, entropy, ages. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def pick(key: Column, table: dict[str, float], default: float | None = None) -> Column:
    """table[key] as nested CASE, so that no join is needed for a rule table."""
    out = None
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)) if out is None else out.when(key == name, F.lit(value))
    return out.otherwise(F.lit(default))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column, pattern: str = "[a-z0-9_]{3,}") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def space_tokens(text: Column) -> Column:
    """Distinct lower-case tokens between ASCII white space."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\r\\f]+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of a string's characters."""

    def over(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
        return -F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda s, c: s + share(c) * F.log2(share(c)))

    return F.when(F.length(text) > 0, let(F.filter(F.split(text, ""), lambda c: c != ""), over)).otherwise(F.lit(0.0))


def strip_private(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?is)<private>.*?</private>", "[PRIVATE]"))


def content_hash(text: Column) -> Column:
    """SHA-256 of the stripped, lower-cased text; null for blanks."""
    bare = F.lower(F.regexp_replace(text, "^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$", ""))
    return F.when(bare != "", F.sha2(bare, 256))


def fts_query(text: Column, most: int = 12) -> Column:
    words = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-zÀ-ÿ0-9_]{3,}"), F.lit(0)), lambda t: ~F.lower(t).isin(*rules.FTS_STOPWORDS))
    return F.array_join(F.transform(F.slice(words, 1, most), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def relative_age(epoch: Column, now: int) -> Column:
    d = F.lit(now) - epoch
    steps = ((3600, 60, "m"), (86400, 3600, "h"), (7 * 86400, 86400, "d"), (30 * 86400, 7 * 86400, "w"), (365 * 86400, 30 * 86400, "mo"))
    out = F.when(epoch.isNull() | (epoch == 0), "?").when(d < 0, "just now")
    for limit, unit, name in steps:
        n = F.floor(d / unit)
        out = out.when(d < limit, F.concat((F.greatest(n, F.lit(1)) if name == "m" else n).cast("string"), F.lit(f"{name} ago")))
    return out.otherwise(F.concat(F.floor(d / (365 * 86400)).cast("string"), F.lit("y ago")))


def preview(output: Column, whole: int = 800, edge: int = 8) -> Column:
    """A short output whole; else its first and last lines around a marker, cut at whole characters."""

    def cut(lines: Column) -> Column:
        n = F.size(lines)
        text = F.array_join(F.concat(F.slice(lines, F.lit(1), F.lit(edge)), F.array(F.concat(F.lit("... ["), (n - 2 * edge).cast("string"), F.lit(" lines omitted] ..."))), F.slice(lines, F.greatest(F.lit(1), n - edge + 1), F.lit(edge))), "\n")
        return let(text, lambda t: F.when(F.length(t) > whole, F.concat(F.substring(t, 1, whole), F.lit("…"))).otherwise(t))

    return F.when(F.length(output) <= whole, output).otherwise(let(F.split(output, "\n", -1), cut))
