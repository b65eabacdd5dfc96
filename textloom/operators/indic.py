"""Measures for Indic languages: features, flags and sentence flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, indic_lexicon as lists, language, text as T
from .english import rhythm

FEATURES = [
    "words", "n_sents", "purity", "latin", "danda_frac", "mech_1k", "sp_punct_1k", "hyphen_1k", "verb_final",
    "calque_1k", "conn_1k", "formal_1k", "rel_1k", "prep_calque_1k", "comma_1k", "mean_len", "sent_cv", "para_cv",
]
SPACED_PUNCT = f"{T.WS}+[,.।;:!?]"
MECHANICS = [SPACED_PUNCT, " {2,}", rf"[,;:][^{T.SPACE}0-9]", "[ा-ौ]{3,}", f"्{T.WS}"]


def bounded(phrase: Column, after: str) -> Column:
    """Pattern of a phrase between white space or edges; the edges are consumed, so neighbours share none."""
    safe = F.regexp_replace(phrase, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit(f"(^|{T.WS})"), safe, F.lit(f"({T.WS}|\\z|[{after}])"))


def lower_all(xs: Column) -> Column:
    return F.transform(xs, F.lower)


def features(df: DataFrame, prose: str = "prose", lang: str = "language") -> DataFrame:
    """Adds the Indic features for each row's language; an unknown one is measured as Hindi."""
    kept = df.columns
    code = F.when(F.col(lang).isin(list(language.SCRIPT_OF)), F.col(lang)).otherwise(F.lit("hi"))
    df = T.settled(df, _t=T.trim(F.coalesce(F.col(prose), F.lit(""))), _code=code)
    df = T.settled(
        df,
        _low=F.lower("_t"),
        _sents=T.sentences(F.col("_t"), T.INDIC_MARKS),
        _toks=T.tokens(F.col("_t")),
        words=F.greatest(F.lit(1), T.word_count(F.col("_t"))).cast("long"),
    )
    lens, paras = F.transform("_sents", T.word_count), F.transform(F.split("_t", "\n"), T.word_count)
    df = rhythm(df.withColumns({"_lens": F.filter(lens, lambda n: n > 1), "_paras": F.filter(paras, lambda n: n > 3)}))
    t, low, words, sents = F.col("_t"), F.col("_low"), F.col("words"), F.col("_sents")
    n = F.size(sents)
    of = lambda table: language.lexicon(table, F.col("_code"))
    edge = r"""[ ,.।॥!?:;"'()]+"""
    ends = F.transform(
        F.filter(F.transform(sents, lambda s: T.tokens(F.regexp_replace(s, r"[ .।॥!?]+\z", ""))), lambda w: F.size(w) >= 4),
        lambda w: F.regexp_replace(F.element_at(w, -1), rf"^{edge}|{edge}\z", ""),
    )
    df = df.withColumns({"_ends": ends, "_verbs": of(lists.VERB_ENDINGS), "_counts": F.array(*[T.count_matches(t, p) for p in MECHANICS])})
    final = F.size(F.filter("_ends", lambda e: F.exists("_verbs", lambda v: F.endswith(e, v))))
    relative = F.aggregate(of(lists.RELATIVE_MARKERS), F.lit(0).cast("long"), lambda a, m: a + F.regexp_count(t, bounded(m, ",।॥.")))
    listed = lambda table: T.per_thousand(T.count_listed(low, lower_all(of(table))), words)
    out = df.withColumns(
        {
            "n_sents": n.cast("long"),
            "purity": T.rounded(language.script_ratio_for(t, F.col("_code")), 3),
            "latin": T.rounded(F.size(F.filter("_toks", lambda w: w.rlike(r"^[A-Za-z][A-Za-z'.-]*\z"))) / F.greatest(F.size("_toks"), F.lit(1)), 3),
            "danda_frac": T.rounded(F.when(n > 0, F.size(F.filter(sents, lambda s: F.substring(s, -1, 1).isin("।", "॥"))) / n).otherwise(F.lit(0.0)), 3),
            "mech_1k": T.per_thousand(F.aggregate("_counts", F.lit(0), lambda a, x: a + x), words),
            "sp_punct_1k": T.per_thousand(F.element_at("_counts", 1), words),
            "hyphen_1k": T.per_thousand(T.count_matches(t, f"{T.WS}-{T.WS}"), words),
            "verb_final": T.rounded(F.when(F.size("_ends") > 0, final / F.size("_ends")).otherwise(F.lit(1.0)), 3),
            "calque_1k": listed(lists.CALQUES),
            "conn_1k": listed(lists.CONNECTIVES),
            "formal_1k": listed(lists.FORMAL_MARKERS),
            "rel_1k": T.per_thousand(relative, words),
            "prep_calque_1k": listed(lists.PREP_CALQUES),
            "comma_1k": T.per_thousand(T.count_matches(t, "[,،]"), words),
            "mean_len": T.rounded(F.col("_mean"), 1),
            "sent_cv": T.rounded(F.col("_sent_cv"), 3),
            "para_cv": T.rounded(F.col("_para_cv"), 3),
        }
    )
    return out.select(*kept, *FEATURES)


FLAG = "array<struct<severity:string,kind:string,phrase:string>>"


def flag(severity: str, kind: str, phrase: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), phrase.alias("phrase"))


def flags(prose: Column, lang: Column, purity: Column, words: Column) -> Column:
    """Literal defects, none of which moves the score."""
    low = F.lower(prose)
    none = F.array().cast(FLAG)
    of = lambda table: language.lexicon(table, lang)
    calques = F.transform(F.filter(of(lists.CALQUES), lambda p: F.contains(low, F.lower(p))), lambda p: flag("warn", "calque", p))
    connectives = F.transform(F.filter(of(lists.CONNECTIVES), lambda p: T.count_sub(low, F.lower(p)) >= 2), lambda p: flag("warn", "connective", p))
    formal = F.filter(of(lists.FORMAL_MARKERS), lambda p: F.contains(low, F.lower(p)))
    register = F.when(F.size(formal) >= 3, F.array(flag("note", "register", F.array_join(F.slice(formal, 1, 5), ", ")))).otherwise(none)

    def level(name: str) -> Column:
        table = {code: levels.get(name, []) for code, levels in lists.HONORIFICS.items()}
        return F.when(F.exists(language.lexicon(table, lang), lambda p: F.regexp_like(prose, bounded(p, ",।."))), F.lit(name))

    used = F.array_compact(F.array(*map(level, ("formal", "informal", "intimate"))))
    honorific = F.when(F.size(used) > 1, F.array(flag("error", "honorific", F.array_join(used, " + ")))).otherwise(none)
    script = reduce(lambda out, kv: F.when(lang == kv[0], F.lit(kv[1])).otherwise(out), language.SCRIPT_OF.items(), F.lit("Devanagari"))
    percent = F.floor(purity * 100 + 0.5).cast("string")
    mixed = F.when((purity < 0.85) & (words > 30), F.array(flag("error", "script", F.concat(percent, F.lit("% "), script)))).otherwise(none)
    return F.concat(calques, connectives, register, honorific, mixed)


def flagged_sentences(df: DataFrame, key: str, prose: str = "prose", lang: str = "language") -> DataFrame:
    """One row per sentence: key, idx, hits; no score."""
    rows = df.select(key, F.col(lang).alias("_lang"), F.posexplode(T.sentences(F.coalesce(F.col(prose), F.lit("")), T.INDIC_MARKS)).alias("idx", "sentence")).withColumn("_low", F.lower("sentence"))

    def hits(kind: str, table: dict[str, list[str]]) -> Column:
        return F.transform(F.filter(language.lexicon(table, F.col("_lang")), lambda p: F.contains(F.col("_low"), F.lower(p))), lambda p: F.concat(F.lit(f"{kind}:"), p))

    spaced = F.when(F.col("sentence").rlike(SPACED_PUNCT), F.array(F.lit("mechanics:space before punctuation"))).otherwise(F.array().cast("array<string>"))
    found = F.concat(hits("prep-calque", lists.PREP_CALQUES), hits("calque", lists.CALQUES), hits("connective", lists.CONNECTIVES), spaced)
    return rows.select(key, F.col("idx").cast("long").alias("idx"), "sentence", found.alias("hits"))


BANDS = fixed.INDIC_BANDS
