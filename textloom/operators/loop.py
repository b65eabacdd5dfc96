"""The bounded candidate loop over a table of replies, and the leaderboard.

Documents are independent, so each call is one DataFrame stage over all documents
that are still running: mask, read the reply, gates, report, accept or reject.  The
number of stages is the number of calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import spans, text as T
from ..plans.shared import small_batches, written
from . import cleanup, gates, replies, report

#: Stop at this objective, after so many calls, or so many rejections in a row; a pass must gain so much.
TARGET, MAX_CALLS, MIN_GAIN, MAX_REJECTS = 30, 5, 2.0, 2
PASS = ["doc_id", "n", "kind", "accepted", "rejected_by", "text", "objective", "ai_likeness", "defect_count"]
_EVAL = ["objective", "ai_likeness", "defects", "targets", "flags"]


def _evaluated(df: DataFrame, text: str, known: str, prefix: str) -> DataFrame:
    """Adds the report of a text; where it is the ``known`` one, that is what ``now_`` columns hold, and nothing is measured."""
    kept = df.columns
    df = T.settled(df, _new=F.when(~F.col(text).eqNullSafe(F.col(known)), F.coalesce(text, F.lit(""))))
    # the report has columns of its own that df may hold from an earlier one
    held = {c: f"_held_{c}" for c in report.COMMON if c in kept}
    out = report.evaluate(df.withColumnsRenamed(held), "_new", "language")
    found = [F.when(F.col("_new").isNotNull(), F.col(c)).otherwise(F.col(f"now_{c}")).alias(f"{prefix}{c}") for c in _EVAL]
    return out.select(*[F.col(held.get(c, c)).alias(c) for c in kept], *found)


def _gain(prefix: str):
    """Gate 9: the objective falls enough or a defect goes; where bands weren't measured, only defects count."""
    fewer = F.size("now_defects") - F.size(f"{prefix}defects") >= 1
    return F.when(F.col("calibrated"), (F.col("now_objective") - F.col(f"{prefix}objective") >= MIN_GAIN) | fewer).otherwise(fewer)


def run_loop(spark: SparkSession, docs: DataFrame, answers: DataFrame, max_calls: int = MAX_CALLS, target: float = TARGET, aggressive: bool = False) -> DataFrame:
    """Passes of each document.  docs: doc_id, text, glossary; answers: doc_id, call (from 0), reply.

    A missing reply counts as a failed call.
    """
    with small_batches(spark):
        return _passes(spark, docs, answers, max_calls, target, aggressive)


def _passes(spark: SparkSession, docs: DataFrame, answers: DataFrame, max_calls: int, target: float, aggressive: bool) -> DataFrame:
    first = report.evaluate(docs.select("doc_id", "text", "glossary"), "text")
    first = first.select("doc_id", F.col("text").alias("original"), "glossary", "language", "calibrated", *[F.col(c).alias(f"now_{c}") for c in _EVAL])
    ruled = cleanup.apply_rules(first, "original", "language", aggressive).drop("edits", "suggestions")
    ruled = _evaluated(ruled, "cleaned", "original", "new_")
    better = F.when(F.col("calibrated"), F.col("new_objective") < F.col("now_objective")).otherwise(F.size("new_defects") <= F.size("now_defects"))
    ruled = written(spark, ruled.withColumn("accepted", F.col("changed") & better), "loop-rules")
    passes = ruled.select(
        "doc_id", F.lit(0).alias("n"), F.lit("rules").alias("kind"), "accepted", F.lit(None).cast("string").alias("rejected_by"), F.col("cleaned").alias("text"),
        F.col("new_objective").alias("objective"), F.col("new_ai_likeness").alias("ai_likeness"), F.size("new_defects").alias("defect_count"),
    )
    pick = lambda c: F.when(F.col("accepted"), F.col(f"new_{c}")).otherwise(F.col(f"now_{c}")).alias(f"now_{c}")
    state = ruled.select(
        "doc_id", "original", "glossary", "language", "calibrated", F.when(F.col("accepted"), F.col("cleaned")).otherwise(F.col("original")).alias("current"), *map(pick, _EVAL), F.lit(0).alias("rejects")
    )
    for call in range(max_calls):
        done = F.when(F.col("calibrated"), F.col("now_objective") <= target).otherwise(F.size("now_defects") == 0)
        idle = (F.size("now_targets") == 0) & (F.size("now_flags") == 0)
        state = state.where(~done & ~idle & (F.col("rejects") < MAX_REJECTS))
        step = state.join(answers.where(F.col("call") == call).select("doc_id", "reply"), "doc_id", "left")
        step = step.withColumns({"_got": replies.read_reply("reply"), "_mask": spans.mask("current")})
        bad = F.col("reply").isNull()
        malformed = ~bad & (~F.col("_got.ok") | replies.looks_like_envelope(F.col("_got.text")))
        step = step.withColumns(
            {
                "predecessor": F.col("current"),
                "candidate_masked": F.when(~bad & ~malformed, F.col("_got.text")),
                "original_masked": F.col("_mask.masked"),
                "raws": F.col("_mask.raws"),
                "targeted": F.col("now_targets"),
                "_early": F.when(bad, F.lit("provider")).when(malformed, F.lit("malformed reply")),
            }
        ).drop("_got", "_mask", "reply")
        step = gates.run_gates(step)
        failed = F.coalesce(F.col("_early"), F.when(F.col("gate") < 9, F.concat(F.lit("gate "), F.col("gate").cast("string"), F.lit(" ("), F.col("gate_name"), F.lit(")"))))
        # what has failed isn't scored: it counts as the current text, which says nothing
        step = step.withColumn("_failed", failed).withColumn("_try", F.when(F.col("_failed").isNull(), F.col("candidate")).otherwise(F.col("current")))
        step = _evaluated(step, "_try", "current", "new_")
        traded = F.size(gates.defects_gained(F.col("now_defects"), F.col("new_defects"))) > 0
        why = F.coalesce(F.col("_failed"), F.when(traded, F.lit("gate 8 (defect-trade)")), F.when(~_gain("new_"), F.lit("gate 9 (no gain)")))
        step = written(spark, step.withColumn("rejected_by", why).withColumn("accepted", why.isNull()), f"loop-{call}")
        scored = F.col("accepted") | (F.col("rejected_by") == "gate 9 (no gain)")
        passes = passes.unionByName(
            step.select(
                "doc_id", F.lit(call + 1).alias("n"), F.lit("model").alias("kind"), "accepted", "rejected_by",
                F.when(scored, F.col("candidate")).alias("text"), F.when(scored, F.col("new_objective")).alias("objective"),
                F.when(scored, F.col("new_ai_likeness")).alias("ai_likeness"), F.when(scored, F.size("new_defects")).alias("defect_count"),
            )
        )
        state = step.select(
            "doc_id", "original", "glossary", "language", "calibrated", F.when(F.col("accepted"), F.col("candidate")).otherwise(F.col("current")).alias("current"), *map(pick, _EVAL),
            F.when(F.col("accepted"), F.lit(0)).otherwise(F.col("rejects") + 1).alias("rejects"),
        )
    return passes.select(*PASS)


def leaderboard(passes: DataFrame, calibrated: str = "calibrated") -> DataFrame:
    """The best accepted pass of each document: least key, then fewest defects, then earliest."""
    key = F.when(F.col(calibrated), F.col("objective")).otherwise(F.col("defect_count").cast("double"))
    order = Window.partitionBy("doc_id").orderBy(key, "defect_count", "n")
    ranked = passes.where("accepted").withColumn("place", F.row_number().over(order))
    return ranked.where("place = 1").drop("place")


def finish(docs: DataFrame, passes: DataFrame) -> DataFrame:
    """Each document's outcome: its best accepted pass, else the input text (n is null then).  docs: doc_id, text."""
    best = leaderboard(passes).select("doc_id", "n", F.col("text").alias("_won"), "objective", "defect_count")
    return docs.join(best, "doc_id", "left").select("doc_id", "n", F.coalesce("_won", "text").alias("output"), "objective", "defect_count")


def translation_checks(df: DataFrame, source: str = "source", reply: str = "reply") -> DataFrame:
    """Checks of a translated reply: readable, no envelope, as many tokens as the masked source; the text unmasked."""
    kept = df.columns
    df = df.withColumns({"_mask": spans.mask(source), "_got": replies.read_reply(reply)})
    same = F.size(gates.mask_tokens(F.col("_mask.masked"))) == F.size(gates.mask_tokens(F.coalesce("_got.text", F.lit(""))))
    why = F.when(~F.col("_got.ok"), F.col("_got.why")).when(replies.looks_like_envelope(F.col("_got.text")), F.lit("envelope")).when(~same, F.lit("token count"))
    return df.withColumn("why", why).withColumn("translated", F.when(why.isNull(), gates.unmask(F.col("_got.text"), F.col("_mask.raws")))).select(*kept, "why", "translated")


def score_log(entries: DataFrame) -> DataFrame:
    """One row per run and detector from (run_id, detector, side, score, lang, note, at): last score of each side, and their difference."""
    fine = entries.where(F.col("run_id").isNotNull() & F.col("detector").isNotNull() & F.col("side").isin("before", "after") & F.col("score").isNotNull() & ~F.isnan("score"))
    last = lambda side: T.rounded(F.max_by(F.when(F.col("side") == side, F.col("score")), F.when(F.col("side") == side, F.col("at"))), 1)
    out = fine.groupBy("run_id", "detector").agg(
        F.min_by("lang", "at").alias("lang"), F.min("at").alias("at"), last("before").alias("before"), last("after").alias("after"), F.max_by("note", F.when(F.col("note").isNotNull(), F.col("at"))).alias("note")
    )
    return out.withColumn("delta", T.rounded(F.col("after") - F.col("before"), 1))
