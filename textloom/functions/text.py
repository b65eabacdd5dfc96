"""Column helpers for text: white space, words, sentences, counts and rounding, with one meaning everywhere.

White space is spelt out, because the engines' ``\\s`` classes differ; word
characters and word boundaries are ASCII.  Patterns here are valid for Java and,
where no look-around is used, for RE2.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Inside of a character class: all Unicode white space, no-break space and byte order mark included.
SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{SPACE}]"
NWS = f"[^{SPACE}]"
#: The same sets for Java alone: a range or two settles nearly every character, where the plain classes ask ten predicates.
SWIFT_WS, SWIFT_NWS = rf"[[\x00-\x20\x7F-\x{{10FFFF}}]&&{WS}]", f"[!-~{NWS}]"
#: Any character but a line's end.
DOT = r"[^\n\r\x{2028}\x{2029}]"
WORD = "[A-Za-z0-9_]"
#: ASCII word boundaries, as look-around.
BEGIN, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

COLON_LIST = f":{WS}*{WORD}+{DOT}*?,{WS}*{WORD}+{DOT}*?,{WS}*(?:and{WS}+)?{WORD}+"


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator of one row, which filters and projections aren't moved through.

    So a costly value is computed once, however often later expressions use it.
    """
    one = F.struct(*[c.alias(k) for k, c in columns.items()])
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(one)))


def quoted(text: str) -> str:
    """A literal for a pattern, in Java and in RE2."""
    return "".join("\\" + c if c in r".*+?^${}()|[]\/-" else c for c in text)


def swift(pattern: str) -> str:
    """A pattern for Java that matches the same, with white space looked up faster."""
    return pattern.replace(NWS, SWIFT_NWS).replace(WS, SWIFT_WS)


#: The characters of WS themselves.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(swift(pattern)))


def word_count(c: Column) -> Column:
    return count_matches(c, f"{NWS}+")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"{SWIFT_NWS}+"), F.lit(0))


def sentences(c: Column, marks: str = ".!?") -> Column:
    """Pieces after a closing mark and white space, trimmed; empty ones left out."""
    # white space is sought first, the mark before it then: marks are looked for at few places
    return F.filter(F.transform(F.split(c, f"{SWIFT_WS}(?<=[{marks}]{WS}){SWIFT_WS}*"), trim), lambda s: s != "")


INDIC_MARKS = ".!?।॥"


def sentences_of(c: Column, lang: Column) -> Column:
    return F.when(lang == "en", sentences(c)).otherwise(sentences(c, INDIC_MARKS))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n+"), trim), lambda s: s != "")


def comma_count(c: Column) -> Column:
    return count_matches(c, "[,،、]")


def count_sub(text: Column, part: Column | str) -> Column:
    """Occurrences of a plain substring that don't overlap."""
    part = F.lit(part) if isinstance(part, str) else part
    return F.floor((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part))


def count_subs(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [count_sub(text, p) for p in parts])


def count_listed(text: Column, parts: Column) -> Column:
    """Like count_subs, for an array column."""
    return F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + count_sub(text, p))


def rounded(c: Column, digits: int) -> Column:
    """Half up, as floor(x + 1/2)."""
    k = 10**digits
    return F.floor(c.cast("double") * k + 0.5).cast("double") / k


def per_thousand(n: Column, words: Column, digits: int = 2) -> Column:
    return rounded(n / (words / F.lit(1000.0)), digits)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.cast("double"))


def mean(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, total(xs) / F.size(xs)).otherwise(F.lit(0.0))


def variation(xs: Column, average: Column, more_than: int) -> Column:
    """Population deviation over mean; 0 for too few values or a zero mean."""
    spread = F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - average) * (x - average)) / F.size(xs))
    return F.when((F.size(xs) > more_than) & (average != 0), spread / average).otherwise(F.lit(0.0))


def fold_digits(c: Column, zeros: list[int]) -> Column:
    """Digits of the given blocks as ASCII."""
    return F.translate(c, "".join(chr(z + d) for z in zeros for d in range(10)), "".join(str(d) for _ in zeros for d in range(10)))


def digit_runs(c: Column, zeros: list[int]) -> Column:
    return F.regexp_extract_all(fold_digits(c, zeros), F.lit("[0-9]+"), F.lit(0))


def missing(need: Column, have: Column) -> Column:
    """Elements of ``need`` that ``have`` lacks, with multiplicity."""

    def numbered(xs: Column) -> Column:
        ordered = F.array_sort(xs)
        return F.transform(ordered, lambda x, i: F.struct(x.alias("x"), (i - F.array_position(ordered, x) + 1).alias("k")))

    return F.transform(F.array_except(numbered(need), numbered(have)), lambda s: s["x"])
