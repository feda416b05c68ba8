"""Free-text answers to label vectors, as native expressions.

Every pattern runs with the flags that make Java regexes read text the way the
published values assume: Unicode case folding and classes, and ``.`` stopping at
a newline only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit import fixed_values as V

FLAGS = "(?iudU)"
# white space by Unicode, and the four separators that count as such
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _rx(pattern: str) -> str:
    return FLAGS + pattern


def strip(text: Column) -> Column:
    """Trim all Unicode white space, not only the ASCII blank."""
    return F.btrim(text, F.lit(_SPACES))  # reads the ends only; a regex would try every space in between


def strip_thinking(text: Column) -> Column:
    """Remove the first think block with the space after it, then trim."""
    return strip(F.regexp_replace(text, r"(?sU)\A(.*?)<think>.*?</think>\s*", "$1"))


# -- reading long texts -------------------------------------------------------
# A regex walks a text character by character; a substring search is many times
# faster. Every pattern here begins with one of a few literal beginnings, so a text
# without any of them is not searched at all, and others are searched from just before the
# first of them.

BEGINNINGS = {
    "verdict": ["hemorrhage"],
    "subtypes": ["subtype"],
    "refusal": ["as an ai", "i can", "i am ", "i 'm unable", "consult ", "seek medical", "not a ", "unable to"],
    "IPH": ["iph", "intra"],
    "IVH": ["ivh", "intra"],
    "SAH": ["sah", "sub"],
    "EDH": ["edh", "epidural", "extra"],
    "SDH": ["sdh", "sub"],
}
# more than the context looked at before a mention
MARGIN = V.CONTEXT_BEFORE + 8
# Letters that fold to ASCII ones only under Unicode case rules; such a text is always searched whole.
_FOLDING = ["\u0130", "\u0131", "\u017f", "\u212a"]


def _contains_any(text: Column, words: Sequence[str]) -> Column:
    found = text.contains(words[0])
    for w in words[1:]:
        found = found | text.contains(w)
    return found


def folding(text: Column) -> Column:
    return _contains_any(text, _FOLDING)


def searchable(text: Column, low: Column, odd: Column, beginnings: Sequence[str]) -> Column:
    """The text if it holds one of the beginnings, else null.

    ``low`` is the lower-cased text and ``odd`` its ``folding`` flag.
    """
    return F.when(odd | _contains_any(low, beginnings), text)


def tail(text: Column, low: Column, odd: Column, beginnings: Sequence[str]) -> Column:
    """The text from shortly before the first beginning on; null if there is none."""
    found = F.filter(F.array(*[F.locate(b, low) for b in beginnings]), lambda p: p > 0)
    start = F.when(odd, F.lit(1)).otherwise(F.greatest(F.array_min(found) - MARGIN, F.lit(1)))
    return F.when(odd | _contains_any(low, beginnings), F.substring(text, start, F.lit(2**31 - 1)))


def _part(text: Column, name: str, low: Column | None = None, odd: Column | None = None) -> Column:
    return tail(text, F.lower(text) if low is None else low, folding(text) if odd is None else odd, BEGINNINGS[name])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def passes_gate(answer: Column) -> Column:
    """True unless the answer starts with NO; an unclear or missing answer passes."""
    return F.coalesce(~F.upper(strip(answer)).startswith("NO"), F.lit(True))


def verdict(text: Column, low: Column | None = None, odd: Column | None = None) -> Column:
    """The verdict line as 1 / 0 / -1, or null when absent or unknown.

    Here and below, ``low`` and ``odd`` spare lower-casing a text again for each reading.
    """
    return _verdict(_part(text, "verdict", low, odd))


def _verdict(part: Column) -> Column:
    value = F.lower(strip(F.regexp_extract(part, _rx(V.VERDICT_LINE), 1)))
    return _let(
        value,
        lambda v: F.when(v.rlike("^" + V.UNCERTAIN_WORDS), F.lit(-1))
        .when(v.rlike("^" + V.POSITIVE_WORDS), F.lit(1))
        .when(v.rlike("^" + V.NEGATIVE_WORDS), F.lit(0)),
    )


def subtypes_line(text: Column, low: Column | None = None, odd: Column | None = None) -> Column:
    """The raw value of the subtypes line; empty when blank, null when absent."""
    return _subtypes_line(_part(text, "subtypes", low, odd))


def _subtypes_line(part: Column) -> Column:
    line = F.nullif(F.regexp_extract(part, _rx(V.SUBTYPES_LINE), 0), F.lit(""))
    return _let(line, lambda found: strip(F.regexp_extract(found, _rx(V.SUBTYPES_LINE), 1)))


def refused(text: Column, low: Column | None = None, odd: Column | None = None) -> Column:
    return _refused(_part(text, "refusal", low, odd))


def _refused(part: Column) -> Column:
    return F.coalesce(part.rlike(_rx(V.REFUSAL)), F.lit(False))


def mentions(text: Column, pattern: str) -> Column:
    """Array of (start, end) character offsets of every match, zero-based.

    The pieces between matches and the matches themselves add up to the text, so a
    running sum of their lengths yields the offsets without a Python regex.
    """
    hits = F.regexp_extract_all(text, F.lit(_rx(pattern)), F.lit(0))
    gaps = F.split(text, _rx(pattern), -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<b:int,e:int>>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        return F.struct(
            end.alias("at"),
            F.concat(acc["out"], F.array(F.struct(begin.alias("b"), end.alias("e")))).alias("out"),
        )

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def scan_mentions(text: Column, pattern: str) -> Column:
    """Free-text reading of one label: 1, 0 (only negated mentions), -1 (hedged) or null.

    The first mention that is not negated decides; if all are negated the label is 0.
    """

    def read(m: Column) -> Column:
        lo = F.greatest(m["b"] - V.CONTEXT_BEFORE, F.lit(0))
        context = F.substring(text, lo + 1, m["e"] + V.CONTEXT_AFTER - lo)
        before = F.substring(text, lo + 1, m["b"] - lo + V.NEGATION_REACH)
        return (
            F.when(before.rlike(_rx(V.NEGATION)), F.lit(0))
            .when(context.rlike(_rx(V.HEDGE)), F.lit(-1))
            .otherwise(F.lit(1))
        )

    readings = F.transform(mentions(text, pattern), read)
    deciding = F.filter(readings, lambda r: r != 0)
    scanned = F.when(F.size(deciding) > 0, F.element_at(deciding, 1)).when(F.size(readings) > 0, F.lit(0))
    # one search spares the offset arithmetic on texts without a mention
    return F.when(text.rlike(_rx(pattern)), scanned)


def parse(
    df: DataFrame,
    text: str,
    patterns: Mapping[str, str] = V.SUBTYPE_PATTERNS,
    beginnings: Mapping[str, Sequence[str]] = BEGINNINGS,
) -> DataFrame:
    """Append any_hem, one column per label, refused, parsed and method.

    Structured answers (a readable verdict line) win; otherwise labels are read from
    prose; otherwise a global negative makes everything absent; otherwise failed.
    Patterns for other labels may come with their ``beginnings``; without them the
    whole text is searched.
    """
    keys = list(patterns)
    t = F.col(text)

    def part(name: str, cut: Callable = searchable) -> Column:
        return cut(t, F.col("__low"), F.col("__odd"), beginnings[name]) if name in beginnings else t

    staged = (
        df.withColumn("__low", F.lower(t))
        .withColumn("__odd", folding(t))
        .withColumn("__noun", part("verdict"))
        .withColumn("__hem", _verdict(part("verdict", tail)))
        .withColumn("__line", _subtypes_line(part("subtypes", tail)))
        .withColumn("__refused", _refused(part("refusal", tail)))
        .withColumn("__hedged", F.col("__line").rlike(_rx(V.HEDGE)))
    )
    structured = F.col("__hem").isNotNull()
    has_line = F.col("__line").isNotNull()
    # prose is scanned only where it is used: no verdict, or a verdict without a label line
    needs_scan = ~structured | (~has_line & (F.col("__hem") != 0))
    staged = staged.withColumns({f"__part_{k}": F.when(needs_scan, part(k, tail)) for k in keys})
    staged = staged.withColumns({f"__scan_{k}": scan_mentions(F.col(f"__part_{k}"), p) for k, p in patterns.items()})
    scans = F.array(*[F.col(f"__scan_{k}") for k in keys])
    staged = staged.withColumns(
        {
            "__pos": F.exists(scans, lambda v: F.coalesce(v == 1, F.lit(False))),
            "__unc": F.exists(scans, lambda v: F.coalesce(v == -1, F.lit(False))),
        }
    )
    prose = ~structured & (F.col("__pos") | F.col("__unc"))
    negative = (
        ~structured
        & ~F.col("__pos")
        & ~F.col("__unc")
        & ~F.col("__refused")
        & F.coalesce(F.col("__noun").rlike(_rx(V.GLOBAL_NEGATIVE)), F.lit(False))
    )

    def label(k: str) -> Column:
        listed = F.when(
            F.col("__line").rlike(_rx(patterns[k])), F.when(F.col("__hedged"), F.lit(-1)).otherwise(F.lit(1))
        ).otherwise(F.lit(0))
        return (
            F.when(structured & (F.col("__hem") == 0), F.lit(0))
            .when(structured & has_line, listed)
            .when(structured | prose, F.col(f"__scan_{k}"))
            .when(negative, F.lit(0))
        )

    any_hem = (
        F.when(structured, F.col("__hem"))
        .when(prose, F.when(F.col("__pos"), F.lit(1)).otherwise(F.lit(-1)))
        .when(negative, F.lit(0))
    )
    method = (
        F.when(structured, F.lit("structured")).when(prose | negative, F.lit("fallback")).otherwise(F.lit("failed"))
    )
    return staged.select(
        *[F.col(c) for c in df.columns],
        any_hem.alias("any_hem"),
        *[label(k).alias(k) for k in keys],
        F.col("__refused").alias("refused"),
        (structured | prose | negative).alias("parsed"),
        method.alias("method"),
    )


def response_class(text: Column, sections: Sequence[str] = V.REPORT_SECTIONS) -> Column:
    """refused_modality / refused_quality / refused_other / answered."""
    found = sum((text.contains(s).cast("int") for s in sections), F.lit(0))
    return (
        F.when(text.contains(V.MODALITY_REFUSAL), F.lit("refused_modality"))
        .when(text.contains(V.QUALITY_REFUSAL), F.lit("refused_quality"))
        .when(text.contains(V.ERROR_TAG), F.lit("refused_other"))
        .when(found < V.MIN_REPORT_SECTIONS, F.lit("refused_other"))
        .otherwise(F.lit("answered"))
    )
