"""Deterministic clean-up on masked text, with an account of its edits.

Mechanics (stray spaces, redundant commas) for every language, openers and stock
phrases for English, one calque for Hindi if asked for.  Everything else is only
suggested, or declined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import counts, fixed, text as T
from ..functions.counts import COMMAS, SPACED


def _apply(df: DataFrame, column: str, count: str, steps: list[tuple[str, str]]) -> DataFrame:
    for i, (pattern, to) in enumerate(steps):
        n = T.count_matches(F.col(column), pattern)
        df = df.withColumn(count, n if i == 0 else F.col(count) + n).withColumn(column, F.regexp_replace(column, pattern, to))
    return df


def mechanics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds cleaned, n_spaces and n_commas: the two mechanical steps on unmasked text."""
    df = df.withColumn("cleaned", F.coalesce(F.col(text), F.lit("")))
    return _apply(_apply(df, "cleaned", "n_spaces", SPACED), "cleaned", "n_commas", COMMAS)


EDITS = "array<struct<rule:string,count:int>>"
#: Names of the edits, and of their counts.
RULES = [("sp_punct_1k", "spaces"), ("comma_1k", "commas"), ("openers", "openers"), ("phrases", "replaced"), ("prep_calque_1k", "through")]


def suggestions(text: Column) -> Column:
    """Stock phrases that a writer should decide on."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, fixed.SUGGESTIONS)), lambda p: F.contains(low, p))


def apply_rules(df: DataFrame, text: str = "text", lang: str = "language", aggressive: bool = False) -> DataFrame:
    """Adds cleaned, changed, edits (rule and count) and suggestions."""
    kept = df.columns
    df = df.withColumn("_source", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_rules", counts.clean_up("_source", F.col(lang), F.lit(aggressive)))
    done = [(rule, F.col(f"_rules.{name}")) for rule, name in RULES]
    edits = F.array_compact(F.array(*[F.when(n > 0, F.struct(F.lit(rule).alias("rule"), n.alias("count"))) for rule, n in done]))
    return df.withColumn("cleaned", F.col("_rules.text")).withColumns({"changed": F.col("cleaned") != F.col("_source"), "edits": edits.cast(EDITS), "suggestions": suggestions(F.col("_source"))}).select(
        *kept, "cleaned", "changed", "edits", "suggestions"
    )
