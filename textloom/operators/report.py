"""Reports: noise removal, language, features, score, flags, verdict and defects of each document.

One pass over the rows: English measures see a null text in other rows, and the other
way round, which costs next to nothing, and each row takes the report of its language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, language, text as T
from . import english, indic


def verdict_band(likeness: Column, words: Column) -> Column:
    """Three bands, and none for short texts."""
    return (
        F.when(words < fixed.LEAST_WORDS, F.lit("unknown"))
        .when(likeness <= fixed.HUMAN_TO, F.lit("human"))
        .when(likeness <= fixed.MIXED_TO, F.lit("mixed"))
        .otherwise(F.lit("ai"))
    )


def display_band(likeness: Column) -> Column:
    """The band of the number alone, without the length rule."""
    return F.when(likeness <= fixed.HUMAN_TO, F.lit("human")).when(likeness <= fixed.MIXED_TO, F.lit("mixed")).otherwise(F.lit("ai"))


LABELS = {"unknown": "Too short to judge", "human": "Reads as human-written", "mixed": "Mixed signals", "ai": "Reads as AI or machine-translated"}


def plain(number: Column) -> Column:
    """A number without a needless fraction."""
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))


def observation_flags() -> Column:
    """Fired observation rules as flags, worded with their numbers."""
    phrase = {
        "nominalisation": F.concat(plain(F.col("nominal_1k")), F.lit(" nominalisations per 1000 words")),
        "contractions": F.lit("no contractions anywhere"),
        "impersonal": F.concat(plain(F.col("person_1k")), F.lit(" first/second-person words per 1000")),
        "adverbial-leads": F.concat(F.floor(F.col("lead_frac") * 100 + 0.5).cast("string"), F.lit("% of sentences open with an adverbial lead")),
        "uniform-rhythm": F.concat(F.lit("sentence-length variation "), plain(F.col("x_sent_cv"))),
    }
    return F.array_compact(F.array(*[F.when(F.array_contains("observed", k), indic.flag("warn", k, p)) for k, p in phrase.items()])).cast(indic.FLAG)


COMMON = ["words", "n_sents", "score", "ai_likeness", "objective", "all_passed", "flags", "verdict", "label", "failing", "targets", "defects", "calibrated"]


def _closing(df: DataFrame, bands: list, kept: list[str]) -> DataFrame:
    failing = F.array_compact(F.array(*[F.when(~F.col(f"ok_{k}"), F.lit(k)) for k, *_ in bands]))
    chased = F.array(*[F.lit(k) for k in english.objective_weights(bands)])
    df = T.settled(df, failing=failing).withColumn("targets", F.array_intersect("failing", chased))
    ids = F.concat(
        F.transform("failing", lambda k: F.concat(F.lit("param:"), k)),
        F.transform("flags", lambda f: F.concat(F.lit("flag:"), f["kind"], F.lit(":"), f["phrase"])),
    )
    return df.withColumn("defects", F.array_distinct(ids)).select(*kept, *COMMON)


def evaluate(df: DataFrame, text: str = "text", lang: str | None = None) -> DataFrame:
    """Adds language (found if ``lang`` is None) and the report's columns.

    The score measures prose; English observations look at the raw text.  The verdict is
    withheld (null) where bands weren't measured for the language.  A null language is
    found, and a null text is empty.
    """
    df = T.settled(df, _prose=language.strip_noise(F.col(text)))
    if lang is None:
        df = language.detect(df, "_prose")
    else:
        # a language that isn't given is found; the others' texts aren't looked at
        df = T.settled(df, _given=F.col(lang)).withColumn("_unknown", F.when(F.col("_given").isNull(), F.col("_prose")))
        found = language.detect(df.drop("language"), "_unknown") if "language" in df.columns else language.detect(df, "_unknown")
        given = F.col("_given").isNotNull()
        df = found.withColumns(
            {"language": F.coalesce("_given", "language"), "confidence": F.when(given, F.lit(1.0)).otherwise(F.col("confidence")), "ambiguous": ~given & F.col("ambiguous")}
        ).drop("_given", "_unknown")
    kept = [c for c in df.columns if c != "_prose"]
    own = {c: f"_kept_{c}" for c in kept}  # measures may be named like columns of the table
    df = df.withColumnsRenamed(own)
    is_en = F.col("_kept_language") == "en"
    df = df.withColumns({"_en": F.when(is_en, F.col("_prose")), "_raw": F.when(is_en, F.col(own[text])), "_other": F.when(~is_en, F.col("_prose")), "_code": F.col("_kept_language")}).drop("_prose")
    df = _english(df)
    df = _indic(df)
    df = df.withColumn("_report", F.when(is_en, F.col("_report_en")).otherwise(F.col("_report_other")))
    return df.select(*[F.col(v).alias(k) for k, v in own.items()], "_report.*")


def _packed(df: DataFrame, bands: list, name: str, kept: list[str]) -> DataFrame:
    """The report as one struct column."""
    df = _closing(df, bands, kept)
    return T.settled(df, **{name: F.struct(*COMMON)}).select(*kept, name)


def _english(df: DataFrame) -> DataFrame:
    kept = df.columns
    en = english.score(english.features(df, "_en"), fixed.ENGLISH_BANDS)
    en = T.settled(english.observations(en, "_raw"), flags=observation_flags())
    silent = (F.col("tell_1k") == 0) & (F.col("colon_lists_1k") == 0)
    overrides = (silent | (F.size("flags") > 0)) & (F.col("ai_likeness") <= fixed.HUMAN_TO)
    band = verdict_band(F.col("ai_likeness"), F.col("words"))
    en = en.withColumns({"verdict": F.when(overrides, F.lit("mixed")).otherwise(band), "calibrated": F.lit(True)}).withColumn(
        "label",
        F.when(overrides, F.when(F.size("flags") > 0, F.lit("Not judged human — unscored signals disagree")).otherwise(F.lit("No stock AI vocabulary found"))).otherwise(_named(F.col("verdict"))),
    )
    return _packed(en, fixed.ENGLISH_BANDS, "_report_en", kept)


def _indic(df: DataFrame) -> DataFrame:
    kept = df.columns
    other = english.score(indic.features(df, "_other", "_code"), fixed.INDIC_BANDS)
    other = T.settled(other, flags=indic.flags(F.col("_other"), F.col("_code"), F.col("purity"), F.col("words")))
    measured = language.calibrated(F.col("_code"))
    other = other.withColumns({"calibrated": measured, "verdict": F.when(measured, verdict_band(F.col("ai_likeness"), F.col("words")))}).withColumn("label", _named(F.col("verdict")))
    return _packed(other, fixed.INDIC_BANDS, "_report_other", kept)


def _named(verdict: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[verdict]


def verdict_rollup(df: DataFrame, text: str = "text", by: str = "lang") -> DataFrame:
    """Documents, mean likeness and mean words by stored language, found language and verdict."""
    report = evaluate(df, text)
    return report.groupBy(by, "language", F.coalesce("verdict", F.lit("withheld")).alias("verdict")).agg(
        F.count("*").alias("n_docs"),
        T.rounded(F.avg("ai_likeness"), 2).alias("mean_likeness"),
        F.sum("words").alias("words"),
    )
