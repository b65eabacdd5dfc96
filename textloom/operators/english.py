"""English measures: features, scores, sentence flags and unscored observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import counts, fixed, text as T

FEATURES = ["words", "n_sents", "mean_len", "sent_cv", "para_cv", "rep_open", "filler_1k", "tell_1k", "em_dash_1k", "passive_ratio", "ttr", "colon_lists_1k"]

#: Two words with at least two more behind them, at the start of a trimmed sentence.
OPENING = T.swift(rf"\A({T.NWS}++{T.WS}++{T.NWS}++){T.WS}++{T.NWS}++{T.WS}++{T.NWS}")


def repeated_share(xs: Column, times: int = 3) -> Column:
    """Share of the elements whose value occurs so many times or more, from one pass over the sorted array."""
    start = F.struct(F.lit(None).cast("string").alias("at"), F.lit(0).alias("run"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["at"] == x, a["run"] + 1).otherwise(F.lit(1))
        more = F.when(run == times, F.lit(times)).when(run > times, F.lit(1)).otherwise(F.lit(0))
        return F.struct(x.alias("at"), run.alias("run"), (a["n"] + more).alias("n"))

    hits = F.aggregate(F.array_sort(xs), start, step, lambda a: a["n"])
    return F.when(F.size(xs) > 0, hits / F.size(xs)).otherwise(F.lit(0.0))


def rhythm(df: DataFrame) -> DataFrame:
    """Adds _mean, sent_cv and para_cv (unrounded) from _lens and _paras, the words of sentences and lines."""
    df = df.withColumns({"_mean": T.mean(F.col("_lens")), "_pmean": T.mean(F.col("_paras"))})
    return df.withColumns({"_sent_cv": T.variation(F.col("_lens"), F.col("_mean"), 2), "_para_cv": T.variation(F.col("_paras"), F.col("_pmean"), 3)})


def features(df: DataFrame, prose: str = "prose") -> DataFrame:
    """Adds the English features as columns.  Stages keep costly arrays from being computed again."""
    kept = df.columns
    df = T.settled(df, _t=T.trim(F.coalesce(F.col(prose), F.lit(""))))
    df = T.settled(df.withColumn("_n", counts.prose_counts("_t")), _low=F.lower("_t"), words=F.greatest(F.lit(1), F.col("_n.words")).cast("long"))
    df = rhythm(df.withColumns({"_lens": F.col("_n.lens"), "_paras": F.col("_n.lines")}))
    df = df.withColumns({"_toks": T.tokens(F.col("_low")), "_sents": T.sentences(F.col("_t"))})
    opens = F.transform(
        F.filter("_sents", lambda s: s.rlike(OPENING)),
        lambda s: F.lower(F.array_join(T.tokens(F.regexp_extract(s, OPENING, 1)), " ")),
    )
    df = df.withColumn("_opens", opens)
    n = F.col("_n.sents")
    words = F.col("words")
    out = df.withColumns(
        {
            "n_sents": n.cast("long"),
            "mean_len": T.rounded(F.col("_mean"), 1),
            "sent_cv": T.rounded(F.col("_sent_cv"), 3),
            "para_cv": T.rounded(F.col("_para_cv"), 3),
            "rep_open": T.rounded(repeated_share(F.col("_opens")), 3),
            "filler_1k": T.per_thousand(T.count_subs(F.col("_low"), fixed.FILLER), words),
            "tell_1k": T.per_thousand(T.count_subs(F.col("_low"), fixed.TELLS), words),
            "em_dash_1k": T.per_thousand(T.count_subs(F.col("_t"), ["—", " - "]), words),
            "passive_ratio": T.rounded(F.when(n > 0, F.col("_n.passives") / n).otherwise(F.lit(0.0)), 3),
            "ttr": T.rounded(F.when(F.size("_toks") > 0, F.size(F.array_distinct("_toks")) / F.size("_toks")).otherwise(F.lit(0.0)), 3),
            "colon_lists_1k": T.per_thousand(F.col("_n.colon_lists"), words),
        }
    )
    return out.select(*kept, *FEATURES)


def norm(value: Column, good: float, bad: float, lower_is_better: bool) -> Column:
    """Linear from bad (0) to good (100), clamped."""
    if good == bad:
        return F.lit(100.0)
    if lower_is_better:
        value, good, bad = -value, -good, -bad
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - F.lit(bad)) / F.lit(good - bad))) * 100


def score(df: DataFrame, bands: list[tuple[str, float, float, bool, float]]) -> DataFrame:
    """Adds s_<parameter>, ok_<parameter>, score, ai_likeness, all_passed and objective for feature columns."""
    df = T.settled(df, **{k: F.col(k) for k, *_ in bands})
    raw = {k: norm(F.col(k), good, bad, low) for k, good, bad, low, _ in bands}
    df = T.settled(df, **{f"s_{k}": T.rounded(v, 1) for k, v in raw.items()}, **{f"ok_{k}": v >= fixed.TARGET for k, v in raw.items()})
    composite = reduce(lambda a, b: a + b, [F.col(f"s_{k}") * w for k, *_, w in bands])
    weights = objective_weights(bands)
    weighed = reduce(lambda a, b: a + b, [F.col(f"s_{k}") * w for k, w in weights.items()])
    return df.withColumn("_composite", composite).withColumns(
        {
            "score": T.rounded(F.col("_composite"), 1),
            "ai_likeness": T.rounded(100 - F.col("_composite"), 1),
            "all_passed": reduce(lambda a, b: a & b, [F.col(f"ok_{k}") for k, *_ in bands]),
            "objective": T.rounded(100 - weighed / sum(weights.values()), 1),
        }
    ).drop("_composite")


def objective_weights(bands: list[tuple[str, float, float, bool, float]]) -> dict[str, float]:
    """Weights of the parameters that are chased, made to sum to one, to three decimals."""
    kept = {k: w for k, *_, w in bands if k not in fixed.NOT_CHASED}
    if len(kept) == len(bands):
        return kept
    return {k: int(w / sum(kept.values()) * 1000 + 0.5) / 1000 for k, w in kept.items()}


def flagged_sentences(df: DataFrame, key: str, prose: str = "prose") -> DataFrame:
    """One row per sentence: key, idx, hits (type and phrase); no score, by design."""
    rows = df.select(key, F.posexplode(T.sentences(F.coalesce(F.col(prose), F.lit("")))).alias("idx", "sentence")).withColumn("_low", F.lower("sentence"))

    def hits(kind: str, phrases: list[str]) -> Column:
        named = F.array(*map(F.lit, phrases))
        return F.transform(F.filter(named, lambda p: F.contains(F.col("_low"), p)), lambda p: F.concat(F.lit(f"{kind}:"), p))

    scaffold = F.when(F.col("sentence").rlike(T.COLON_LIST), F.array(F.lit("scaffold:colon-led list"))).otherwise(F.array().cast("array<string>"))
    found = F.concat(hits("tell", fixed.TELLS), hits("filler", fixed.FILLER), scaffold)
    return rows.select(key, F.col("idx").cast("long").alias("idx"), "sentence", found.alias("hits"))


OBSERVATIONS = ["x_words", "x_sents", "x_sent_cv", "nominal_1k", "contraction_1k", "person_1k", "lead_frac"]
RULES = ["nominalisation", "contractions", "impersonal", "adverbial-leads", "uniform-rhythm"]


def observations(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the unscored observations on the raw text, and ``observed``: the rules that fire."""
    kept = df.columns
    raw = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_n", counts.raw_counts(raw)).withColumn("_lens", F.col("_n.lens")).withColumn("_mean", T.mean(F.col("_lens")))
    words = F.greatest(F.lit(1), F.col("_n.words"))
    n = F.col("_n.sents")
    df = T.settled(
        df,
        x_words=F.col("_n.words").cast("long"),
        x_sents=n.cast("long"),
        x_sent_cv=T.rounded(T.variation(F.col("_lens"), F.col("_mean"), 2), 3),
        nominal_1k=T.per_thousand(F.col("_n.nominal"), words, 1),
        contraction_1k=T.per_thousand(F.col("_n.contractions"), words, 1),
        person_1k=T.per_thousand(F.col("_n.person"), words, 1),
        lead_frac=T.rounded(F.when(n > 0, F.col("_n.leads") / n).otherwise(F.lit(0.0)), 3),
    )
    long, many = F.col("x_words") > 150, F.col("x_sents") > 5
    fires = [
        F.col("nominal_1k") > 30,
        (F.col("contraction_1k") == 0) & long,
        (F.col("person_1k") < 5) & long,
        (F.col("lead_frac") > 0.2) & many,
        (F.col("x_sent_cv") < 0.3) & many,
    ]
    fired = F.array_compact(F.array(*[F.when(f, F.lit(r)) for f, r in zip(fires, RULES)]))
    return df.withColumn("observed", fired).select(*kept, *OBSERVATIONS, "observed")
