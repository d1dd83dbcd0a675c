"""Column builders: text, hashing, set similarity, bins and small mappings.  All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------------------
STRIP_CHARS = " ,;:."
PK_KEYWORDS = (
    "metabolism", "excretion", "absorption", "serum concentration", "bioavailability", "clearance", "cyp", "transporter", "protein binding",
)
PD_KEYWORDS = (
    "activities", "therapeutic efficacy", "adverse effect", "risk", "receptor binding", "analgesic", "sedative", "hypotensive", "bleeding",
    "qtc", "arrhythmia", "bradycardia", "tachycardia", "cns depressant", "hypertension", "anticoagulant", "hemorrhage", "myopathy",
    "sedation", "nephrotoxicity", "effectiveness",
)
TRUE_TEXT, FALSE_TEXT = ("true", "1"), ("false", "0", "")
# ---------------------------------------------------------------------------------------------


def hash32(*parts: str | Column) -> Column:
    """First 32 bits of the md5 of the parts joined by ``:`` (a plain string is a literal)."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def unit(*parts: str | Column) -> Column:
    """A keyed uniform number in [0, 1): the same for the same parts, whatever the partitioning."""
    return hash32(*parts) / F.lit(4294967296.0)


def hash_order(*parts: str | Column) -> Column:
    """A keyed random order: the whole md5 as text."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.md5(text.cast("binary"))


def pair_lo(a: str | Column, b: str | Column) -> Column:
    return F.least(a, b)


def pair_hi(a: str | Column, b: str | Column) -> Column:
    return F.greatest(a, b)


def _quoted(name: Column) -> Column:
    """A literal regular expression of a string, even if it holds the end-of-quote mark."""
    return F.concat(F.lit(r"(?iu)\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def normalize_text(text: Column, *names: Column) -> Column:
    """Remove the names one after the other (any case, anywhere), strip punctuation and blanks at
    both ends, then collapse white space.  Null or empty names are skipped."""
    out = text
    for name in names:
        blank = name.isNull() | (name == "")
        out = F.when(blank, out).otherwise(F.call_function("regexp_replace", out, _quoted(F.coalesce(name, F.lit("x"))), F.lit("")))
    return F.regexp_replace(F.btrim(out, F.lit(STRIP_CHARS)), r"(?U)\s+", " ")


def keyword_hits(text: Column, words: Sequence[str]) -> Column:
    """Words contained in the text (any case), in the order of the list."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))


def keyword_label(pk: Column, pd: Column) -> Column:
    """Mixed, PK, PD or Unknown from two hit lists."""
    return F.when((F.size(pk) > 0) & (F.size(pd) > 0), "Mixed").when(F.size(pk) > 0, "PK").when(F.size(pd) > 0, "PD").otherwise("Unknown")


def pk_first_label(pk: Column, pd: Column) -> Column:
    return F.when(F.size(pk) > 0, "PK").when(F.size(pd) > 0, "PD").otherwise("Unknown")


def ab_from_name(name: Column) -> Column:
    return F.when(name.isNull() | (F.trim(name) == ""), "B").otherwise("A")


def text_to_bool(value: Column) -> Column:
    """true/1, false/0/blank in any case; other text raises.  Null stays null."""
    low = F.lower(F.trim(value))
    return (
        F.when(value.isNull(), F.lit(None).cast("boolean")).when(low.isin(*TRUE_TEXT), True).when(low.isin(*FALSE_TEXT), False)
        .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), value)).cast("boolean"))
    )


def substituted(value: Column, other: Column, merged: dict[str, str], unknown: str = "?") -> Column:
    """``other`` where the value is ``unknown``; then each value of ``merged`` gives way to its stand-in."""
    out = F.when(value == unknown, other).otherwise(value)
    return reduce(lambda rest, kv: F.when(out == kv[0], kv[1]).otherwise(rest), merged.items(), out)


def first_by_keyword(text: Column, table: Sequence[tuple[str, Column]], default: Column) -> Column:
    """The value of the first keyword of an ordered table that the text contains."""
    low = F.lower(text)
    return reduce(lambda rest, kv: F.when(F.contains(low, F.lit(kv[0])), kv[1]).otherwise(rest), reversed(list(table)), default)


def tanimoto(a: Column, b: Column) -> Column:
    """Common over all elements of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def pair_similarity(aa: Column, bb: Column, ab: Column, ba: Column) -> Column:
    """The better of the straight and the crossed mean similarity of two pairs."""
    return F.greatest((aa + bb) / 2, (ab + ba) / 2)


def softmax_yes(no: Column, yes: Column) -> Column:
    return 1 / (1 + F.exp(no - yes))


def bin_index(value: Column, edges: Column) -> Column:
    """Bin of a value among sorted edges (the first is the lower end): edges[1:] below it, clamped."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 1, F.lit(0)))
    return F.when(F.size(edges) < 2, 0).otherwise(F.least(F.size(F.filter(inner, lambda e: e < value)), F.size(edges) - 2))


def one_hot(value: Column, vocabulary: Sequence[str]) -> Column:
    """A unit vector over the vocabulary; unknown values take its last place."""
    last = vocabulary[-1]
    known = F.when(value.isin(*vocabulary), value).otherwise(F.lit(last))
    return F.array(*[(known == v).cast("double") for v in vocabulary])


def row_normalised(xs: Column) -> Column:
    total = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    return F.when(total == 0, xs).otherwise(F.transform(xs, lambda x: x / total))


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping places of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("bigint")


def slug(name: Column) -> Column:
    return F.lower(F.replace(F.replace(name, F.lit("/"), F.lit("__")), F.lit("."), F.lit("-")))


def short_slug(name: Column, keep: int = 60) -> Column:
    return F.right(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-"), F.lit(keep))


def with_full_stop(text: Column) -> Column:
    """Close a text with a full stop unless it ends in one of ``.!?``; blank text stays blank."""
    t = F.trim(text)
    return F.when(t == "", t).when(F.right(t, F.lit(1)).isin(".", "!", "?"), t).otherwise(F.concat(t, F.lit(".")))


def percentile_edges(bins: int = 10) -> list[float]:
    return [i / bins for i in range(bins + 1)]


def mask_chain(text: Column, patterns: Sequence[str], token: str) -> Column:
    """Replace each pattern in turn (whole words, any case), then merge neighbouring tokens, first
    over blanks and then over commas and semicolons."""
    out = text
    for p in patterns:
        out = F.regexp_replace(out, r"(?iu)\b" + p + r"\b", token.replace("$", r"\$"))
    t = token.replace("[", r"\[").replace("]", r"\]")
    out = F.regexp_replace(out, f"({t})(\\s+{t})+", token)
    return F.regexp_replace(out, f"({t})(?:\\s*[,;]\\s*{t})+", token)
