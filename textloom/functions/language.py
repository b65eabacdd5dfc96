"""Noise removal and language identification by script."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed import CALIBRATED, HINGLISH_MARKERS, LANGUAGES, SCRIPT_FAMILY, SCRIPT_RANGES
from .text import NWS, SPACE, WS, count_matches, settled, swift

# Fixed values. Ordered replacements that leave prose: (pattern, replacement).
NOISE = [
    (r"```[\s\S]*?```", " "),
    (r"`[^`\n]*`", " "),
    (r"!\[[^\]]*\]\([^)]*\)", " "),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"<[^>]+>", " "),
    (rf"https?://{NWS}+", " "),
    (rf"{NWS}+@{NWS}+\.{NWS}+", " "),
    (r"[ \t]{2,}", " "),
]
#: Without any of these, a replacement has nothing to find: a plain search spares most texts the pattern.
HINTS = [("```",), ("`",), ("![",), ("[",), ("<",), ("://",), ("@",), ("  ", "\t")]

#: Scripts in the order in which they are looked up; the Latin one is counted apart and comes last.
SCRIPTS = [s for s in SCRIPT_RANGES if s != "Latin"]
#: Scripts of several languages, and the one that is assumed.
SHARED = {"Devanagari": "hi", "Bengali": "bn", "Arabic": "ur"}
NAMES = {code: name for code, name, _, _ in LANGUAGES} | {"en": "English"}
SCRIPT_OF = {code: script for code, _, script, _ in LANGUAGES}


def strip_noise(c: Column) -> Column:
    """Prose only: code, images, link targets, tags, addresses and runs of blanks go."""
    c = F.coalesce(c, F.lit(""))

    def step(c: Column, pattern: str, to: str, hints: tuple[str, ...]) -> Column:
        # behind a lambda the text so far is worked out once, though it is used twice
        found = lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(h)) for h in hints])
        once = F.transform(F.array(c), lambda x: F.when(found(x), F.regexp_replace(x, swift(pattern), to)).otherwise(x))
        return F.get(once, F.lit(0))

    for (pattern, to), hints in zip(NOISE, HINTS):
        c = step(c, pattern, to, hints)
    return c


def in_script(script: str) -> str:
    lo, hi = SCRIPT_RANGES[script]
    return rf"[\x{{{lo:04X}}}-\x{{{hi:04X}}}&&\p{{L}}]"


def letters(c: Column) -> Column:
    """Letters, as what is left of the text without others: one match for each gap, not for each letter."""
    return F.length(F.regexp_replace(c, r"\P{L}+", ""))


#: All scripts but Latin lie from here on; most texts have none of them.
WIDE = r"[\x{0600}-\x{10FFFF}]"


def _language_of(script: str) -> str:
    return SHARED.get(script) or next(code for code, _, s, _ in LANGUAGES if s == script)


def detect(df: DataFrame, prose: str = "prose") -> DataFrame:
    """Adds language, confidence and ambiguous for a column of prose.

    The script with most letters wins; of equals, the one that comes first in the text, Latin last.
    """
    text = F.col(prose)
    low = F.lower(text)
    tally = []
    for script in SCRIPTS:
        n = count_matches(text, in_script(script))
        first = F.regexp_instr(text, F.lit(in_script(script)))
        tally.append(F.struct(n.alias("n"), (-F.when(n > 0, first).otherwise(F.lit(1 << 30))).cast("int").alias("early"), F.lit(script).alias("script")))
    latin = F.struct(F.length(F.regexp_replace(text, "[^A-Za-z]+", "")).alias("n"), F.lit(-(1 << 29)).cast("int").alias("early"), F.lit("Latin").alias("script"))
    out = settled(df, _letters=letters(text), _top=F.when(text.rlike(WIDE), F.array_max(F.array(*tally, latin))).otherwise(latin))
    # a plain search first, and the marker before its edges: few texts hold one at all
    marks = sum((F.when(F.contains(low, F.lit(m)), low.rlike(swift(f"{m}(?<!{NWS}{m})(?:{WS}|\\z|[,.!?])")).cast("int")).otherwise(F.lit(0)) for m in HINGLISH_MARKERS), F.lit(0))
    out = out.withColumn("_hinglish", F.when(F.col("_top.script") == "Latin", marks).otherwise(F.lit(0)))
    by_script = F.create_map(*[F.lit(x) for s in SCRIPTS for x in (s, _language_of(s))])
    code = F.coalesce(by_script[F.col("_top.script")], F.when(F.col("_hinglish") >= 3, F.lit("hinglish")).otherwise(F.lit("en")))
    none = F.col("_letters") == 0
    return settled(
        out,
        language=F.when(none, F.lit("en")).otherwise(code),
        confidence=F.when(none, F.lit(0.0)).otherwise(F.col("_top.n") / F.greatest(F.col("_letters"), F.lit(1))),
        ambiguous=~none & F.col("_top.script").isin(list(SHARED)),
    ).drop("_letters", "_top", "_hinglish")


def script_ratio(c: Column, script: str) -> Column:
    """Share of a text's letters that are in a script's range; 0 without letters."""
    n = letters(c)
    return F.when(n == 0, F.lit(0.0)).otherwise(count_matches(c, in_script(script)) / F.greatest(n, F.lit(1)))


def script_ratio_for(c: Column, lang: Column) -> Column:
    """script_ratio for each row's language; an unknown language counts as Hindi."""
    classes = F.create_map(*[F.lit(x) for code, script in SCRIPT_OF.items() for x in (code, in_script(script))])
    n = letters(c)
    hits = F.regexp_count(c, F.coalesce(classes[lang], F.lit(in_script("Devanagari"))))
    return F.when(n == 0, F.lit(0.0)).otherwise(hits / F.greatest(n, F.lit(1)))


def lexicon(table: dict[str, list[str]], lang: Column) -> Column:
    """The list of the language, else of its family, else none: a lookup in a constant map."""
    lists = {code: table.get(code) or table.get(SCRIPT_FAMILY.get(code, "hi"), []) for code in SCRIPT_OF}
    known = F.create_map(*[x for code, words in lists.items() if words for x in (F.lit(code), F.array(*map(F.lit, words)))])
    return F.coalesce(known[lang], F.array().cast("array<string>"))


def calibrated(lang: Column) -> Column:
    return lang.isin(list(CALIBRATED))


def declared_language(c: Column) -> Column:
    """The primary part of a language tag."""
    return F.lower(F.substring_index(F.coalesce(c, F.lit("")), "-", 1))


__all__ = ["SPACE", "strip_noise", "detect", "script_ratio", "script_ratio_for", "lexicon", "calibrated", "declared_language"]
