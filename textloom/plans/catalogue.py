"""Queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, language, spans, text as T
from ..operators import cleanup, english, gates, indic, loop, replies, report
from ..sources import pages as web
from . import oracle as O
from .seeds import SNIPPETS, indic_rows, quote, revision_pairs, seeded_docs
from .shared import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded_docs(spark, sf_dir).withColumn("prose", language.strip_noise(F.col("text")))


def _english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return english.features(_prose(spark, sf_dir))


EN = O.english_features(O.SEEDED, "doc_id, lang")
EN_SCORED = O.score(EN, fixed.ENGLISH_BANDS, "doc_id, lang, words, n_sents, tell_1k, colon_lists_1k, para_cv, passive_ratio")
IND = O.indic_features(O.INDIC, "id, code")
IND_SCORED = O.score(IND, fixed.INDIC_BANDS, "id, code, words, purity")


@query(f"SELECT doc_id, length(prose)::BIGINT AS n_chars, md5(prose) AS prose_md5 FROM ({O.SEEDED})")
def noise_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prose(spark, sf_dir).select("doc_id", F.length("prose").cast("long").alias("n_chars"), F.md5("prose").alias("prose_md5"))


_LANG_SQL = O.detect(f"SELECT 'd' || doc_id AS row_id, prose FROM ({O.SEEDED}) UNION ALL SELECT 'i' || id, prose FROM ({O.INDIC})", "row_id")


@query(f"SELECT row_id, language, {O.rounded('confidence', 6)} AS confidence, ambiguous FROM ({_LANG_SQL})")
def lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _prose(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("row_id"), "prose")
    rows = indic_rows(spark).select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("row_id"), language.strip_noise(F.col("text")).alias("prose"))
    return language.detect(docs.unionByName(rows)).select("row_id", "language", T.rounded(F.col("confidence"), 6).alias("confidence"), "ambiguous")


@query(
    f"SELECT d.lang, l.language, count(*)::BIGINT AS n_docs, sum((d.lang <> l.language)::INT)::BIGINT AS n_disagree "
    f"FROM ({O.SEEDED}) d JOIN ({O.detect('SELECT doc_id, prose FROM (' + O.SEEDED + ')', 'doc_id')}) l USING (doc_id) GROUP BY ALL"
)
def lang_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.detect(_prose(spark, sf_dir))
    return found.groupBy("lang", "language").agg(F.count("*").alias("n_docs"), F.sum((F.col("lang") != F.col("language")).cast("long")).alias("n_disagree"))


@query("SELECT id, " + ", ".join(f"{O.rounded(O.script_ratio('prose', s), 6)} AS {s.lower()}" for s in fixed.SCRIPT_RANGES) + f" FROM ({O.INDIC})")
def script_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indic_rows(spark).withColumn("prose", language.strip_noise(F.col("text")))
    return rows.select("id", *[T.rounded(language.script_ratio(F.col("prose"), s), 6).alias(s.lower()) for s in fixed.SCRIPT_RANGES])


@query(
    f"SELECT doc_id, {O.words('prose')}::BIGINT AS words, len({O.sentences('prose')})::BIGINT AS n_english, len({O.sentences('prose', T.INDIC_MARKS)})::BIGINT AS n_indic, "
    f"len(list_filter(list_transform(string_split_regex(prose, '\n+'), lambda s: {O.trim('s')}), lambda s: s <> ''))::BIGINT AS paragraphs, {O.matches('prose', '[,،、]')}::BIGINT AS commas FROM ({O.SEEDED})"
)
def word_sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("prose")
    counts = {"words": T.word_count(c), "n_english": F.size(T.sentences(c)), "n_indic": F.size(T.sentences(c, T.INDIC_MARKS)), "paragraphs": F.size(T.paragraphs(c)), "commas": T.comma_count(c)}
    return _prose(spark, sf_dir).select("doc_id", *[v.cast("long").alias(k) for k, v in counts.items()])


def _measure(name: str, columns: list[str]):
    """A query of some English features of all seeded documents; Catalyst drops what isn't asked for."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _english(spark, sf_dir).select("doc_id", *columns)

    run.__name__ = name
    query(f"SELECT doc_id, {', '.join(columns)} FROM ({EN})")(run)


_measure("rhythm_cv", ["n_sents", "mean_len", "sent_cv", "para_cv"])
_measure("repeated_openings", ["rep_open"])
_measure("lexicon_density", ["words", "filler_1k", "tell_1k", "em_dash_1k"])
_measure("passive_ratio", ["passive_ratio"])
_measure("type_token_ratio", ["ttr"])
_measure("colon_lists", ["colon_lists_1k"])


def _hits(kind: str, phrases: list[str]) -> str:
    return f"list_transform(list_filter([{', '.join(map(quote, phrases))}], lambda p: contains(low, p)), lambda p: '{kind}:' || p)"


@query(
    f"SELECT doc_id, idx, md5(sentence) AS sentence_md5, array_to_string(hits, '|') AS hits FROM (SELECT doc_id, idx, sentence, list_concat(list_concat({_hits('tell', fixed.TELLS)}, {_hits('filler', fixed.FILLER)}), "
    f"CASE WHEN regexp_matches(sentence, {quote(T.COLON_LIST)}) THEN ['scaffold:colon-led list'] ELSE []::VARCHAR[] END) AS hits FROM (SELECT *, lower(sentence) AS low FROM "
    f"(SELECT doc_id, (unnest(range(len(s))))::BIGINT AS idx, unnest(s) AS sentence FROM (SELECT doc_id, {O.sentences('prose')} AS s FROM ({O.SEEDED})))))"
)
def sentence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = english.flagged_sentences(_prose(spark, sf_dir), "doc_id")
    return rows.select("doc_id", "idx", F.md5("sentence").alias("sentence_md5"), F.array_join("hits", "|").alias("hits"))


@query(f"SELECT * FROM ({IND})")
def indic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indic.features(_indic(spark)).select("id", "code", *indic.FEATURES)


def _indic(spark: SparkSession) -> DataFrame:
    known = F.when(F.col("lang").isin(list(language.SCRIPT_OF)), F.col("lang")).otherwise(F.lit("hi"))
    return indic_rows(spark).select("id", "text", known.alias("code"), known.alias("language"), language.strip_noise(F.col("text")).alias("prose"))


@query(f"SELECT id, code, {', '.join(f's_{k}, ok_{k}' for k, *_ in fixed.INDIC_BANDS)}, score, ai_likeness, all_passed FROM ({IND_SCORED})")
def indic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = english.score(indic.features(_indic(spark)), fixed.INDIC_BANDS)
    return scored.select("id", "code", *[f"{p}_{k}" for k, *_ in fixed.INDIC_BANDS for p in ("s", "ok")], "score", "ai_likeness", "all_passed")


@query()
def indic_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indic.features(_indic(spark))
    found = indic.flags(F.col("prose"), F.col("language"), F.col("purity"), F.col("words"))
    return rows.select("id", F.explode(found).alias("f")).select("id", "f.*")


def _listed_hits(kind: str, table: dict[str, list[str]]) -> str:
    return f"list_transform(list_filter({O.lexicon(table)}, lambda p: contains(low, lower(p))), lambda p: '{kind}:' || p)"


@query(
    f"SELECT id, idx, md5(sentence) AS sentence_md5, array_to_string(list_concat(list_concat({_listed_hits('prep-calque', indic.lists.PREP_CALQUES)}, {_listed_hits('calque', indic.lists.CALQUES)}), "
    f"list_concat({_listed_hits('connective', indic.lists.CONNECTIVES)}, CASE WHEN regexp_matches(sentence, {quote(indic.SPACED_PUNCT)}) THEN ['mechanics:space before punctuation'] ELSE []::VARCHAR[] END)), '|') AS hits "
    f"FROM (SELECT *, lower(sentence) AS low FROM (SELECT id, code, (unnest(range(len(s))))::BIGINT AS idx, unnest(s) AS sentence FROM (SELECT id, code, {O.sentences('prose', T.INDIC_MARKS)} AS s FROM ({O.INDIC}))))"
)
def indic_sentence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indic.flagged_sentences(_indic(spark), "id")
    return rows.select("id", "idx", F.md5("sentence").alias("sentence_md5"), F.array_join("hits", "|").alias("hits"))


OBS = O.observations(O.SEEDED, "doc_id")
_FIRES = (
    "[CASE WHEN nominal_1k > 30 THEN 'nominalisation' END, CASE WHEN contraction_1k = 0 AND x_words > 150 THEN 'contractions' END, "
    "CASE WHEN person_1k < 5 AND x_words > 150 THEN 'impersonal' END, CASE WHEN lead_frac > 0.2 AND x_sents > 5 THEN 'adverbial-leads' END, "
    "CASE WHEN x_sent_cv < 0.3 AND x_sents > 5 THEN 'uniform-rhythm' END]"
)


@query(f"SELECT *, array_to_string(list_filter({_FIRES}, lambda r: r IS NOT NULL), '|') AS observed FROM ({OBS})")
def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = english.observations(seeded_docs(spark, sf_dir))
    return rows.select("doc_id", *english.OBSERVATIONS, F.array_join("observed", "|").alias("observed"))


@query(f"SELECT doc_id, {', '.join(f's_{k}, ok_{k}' for k, *_ in fixed.ENGLISH_BANDS)}, score, ai_likeness, all_passed, {O.verdict('ai_likeness', 'words')} AS band FROM ({EN_SCORED})")
def english_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = english.score(_english(spark, sf_dir), fixed.ENGLISH_BANDS)
    return scored.select("doc_id", *[f"{p}_{k}" for k, *_ in fixed.ENGLISH_BANDS for p in ("s", "ok")], "score", "ai_likeness", "all_passed", report.verdict_band(F.col("ai_likeness"), F.col("words")).alias("band"))


# The report of rows found to be English; none of the driver's documents is in another script, and no row is Hinglish by chance
_REPORT = (
    f"SELECT e.*, l.language, o.* EXCLUDE (doc_id), list_filter({_FIRES}, lambda r: r IS NOT NULL) AS fired FROM ({EN_SCORED}) e "
    f"JOIN ({O.detect('SELECT doc_id, prose FROM (' + O.SEEDED + ')', 'doc_id')}) l USING (doc_id) JOIN ({OBS}) o USING (doc_id)"
)
_VERDICT = f"CASE WHEN ((tell_1k = 0 AND colon_lists_1k = 0) OR len(fired) > 0) AND ai_likeness <= {fixed.HUMAN_TO} THEN 'mixed' ELSE {O.verdict('ai_likeness', 'words')} END"


@query(f"SELECT lang, language, verdict, count(*)::BIGINT AS n_docs, {O.rounded('avg(ai_likeness)', 2)} AS mean_likeness, sum(words)::BIGINT AS words FROM (SELECT *, {_VERDICT} AS verdict FROM ({_REPORT})) GROUP BY ALL")
def verdict_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.verdict_rollup(seeded_docs(spark, sf_dir))


@query(
    f"SELECT quality, toxic, verdict, count(*)::BIGINT AS n_docs, {O.rounded('avg(ai_likeness)', 2)} AS mean_likeness FROM (SELECT r.*, {_VERDICT} AS verdict FROM ({_REPORT}) r) JOIN labels USING (doc_id) GROUP BY ALL"
)
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = report.evaluate(seeded_docs(spark, sf_dir)).select("doc_id", "ai_likeness", "verdict")
    rows = scored.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    return rows.groupBy("quality", "toxic", "verdict").agg(F.count("*").alias("n_docs"), T.rounded(F.avg("ai_likeness"), 2).alias("mean_likeness"))


_FAILING = "list_filter([" + ", ".join(f"CASE WHEN NOT ok_{k} THEN '{k}' END" for k, *_ in fixed.ENGLISH_BANDS) + "], lambda k: k IS NOT NULL)"


@query(
    f"SELECT doc_id, objective, ai_likeness, array_to_string({_FAILING}, '|') AS failing, array_to_string(list_filter({_FAILING}, lambda k: k <> 'passive_ratio'), '|') AS targets, "
    f"(len({_FAILING}) + len(fired))::BIGINT AS n_defects, display AS display_band FROM (SELECT *, CASE WHEN ai_likeness <= 30 THEN 'human' WHEN ai_likeness <= 60 THEN 'mixed' ELSE 'ai' END AS display FROM ({_REPORT}))"
)
def objective_and_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.evaluate(seeded_docs(spark, sf_dir))
    return rows.select("doc_id", "objective", "ai_likeness", F.array_join("failing", "|").alias("failing"), F.array_join("targets", "|").alias("targets"), F.size("defects").cast("long").alias("n_defects"), report.display_band(F.col("ai_likeness")).alias("display_band"))


_LABEL = (
    f"CASE WHEN ((tell_1k = 0 AND colon_lists_1k = 0) OR len(fired) > 0) AND ai_likeness <= {fixed.HUMAN_TO} THEN CASE WHEN len(fired) > 0 THEN 'Not judged human — unscored signals disagree' ELSE 'No stock AI vocabulary found' END "
    f"ELSE CASE {O.verdict('ai_likeness', 'words')} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in report.LABELS.items()) + " END END"
)


@query(f"SELECT doc_id, label, true AS calibrated, unnest(defects) AS defect FROM (SELECT *, {_LABEL} AS label FROM ({O.english_report(O.SEEDED_SQL, 'text')}))")
def defect_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.evaluate(seeded_docs(spark, sf_dir)).select("doc_id", "label", "calibrated", F.explode("defects").alias("defect"))


@query(f'SELECT doc_id, kind, raw, canonical, start, stop AS "end" FROM ({O.spans(O.SEEDED_SQL, "text")})')
def span_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seeded_docs(spark, sf_dir).select("doc_id", F.explode(spans.spans("text")).alias("s"))
    return rows.select("doc_id", "s.*")


@query(f"SELECT doc_id, md5(text) AS text_md5 FROM ({O.SEEDED_SQL})")
def mask_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = seeded_docs(spark, sf_dir).select("doc_id", spans.mask("text").alias("m"))
    return masked.select("doc_id", F.md5(gates.unmask(F.col("m.masked"), F.col("m.raws"))).alias("text_md5"))


_ZEROS = "".join(chr(z + d) for z in fixed.DIGIT_ZEROS for d in range(10))
_ASCII = "0123456789" * len(fixed.DIGIT_ZEROS)


@query(
    f"SELECT row_id, array_to_string(regexp_extract_all(translate(text, {quote(_ZEROS)}, '{_ASCII}'), '[0-9]+'), '|') AS runs FROM (SELECT 'd' || doc_id AS row_id, text FROM ({O.SEEDED_SQL}) UNION ALL SELECT 'i' || id, text FROM ({O.INDIC_SQL}))"
)
def digit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = seeded_docs(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("row_id"), "text")
    rows = docs.unionByName(indic_rows(spark).select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("row_id"), "text"))
    return rows.select("row_id", F.array_join(T.digit_runs(F.col("text"), fixed.DIGIT_ZEROS), "|").alias("runs"))


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed_columns = {"language": F.lit("en"), "glossary": F.array(F.lit("pact"), F.lit(" plan ")), "targeted": F.array(F.lit("comma_1k"), F.lit("para_cv"))}
    return revision_pairs(spark, sf_dir).withColumns(fixed_columns)


_RUNS = "list_sort(regexp_extract_all({}, '[0-9]+'))"


@query(
    "SELECT doc_id, edit, coalesce(sum(greatest(a - b, 0)), 0)::BIGINT AS n_missing, coalesce(sum(greatest(b - a, 0)), 0)::BIGINT AS n_extra FROM (SELECT doc_id, edit, run, sum(a) AS a, sum(b) AS b FROM ("
    f"SELECT doc_id, edit, unnest({_RUNS.format('original')}) AS run, 1 AS a, 0 AS b FROM ({O.REVISIONS}) UNION ALL SELECT doc_id, edit, unnest({_RUNS.format('candidate')}), 0, 1 FROM ({O.REVISIONS})) GROUP BY ALL) GROUP BY ALL"
)
def span_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (T.digit_runs(F.col(c), fixed.DIGIT_ZEROS) for c in ("original", "candidate"))
    return _revisions(spark, sf_dir).select("doc_id", "edit", F.size(T.missing(a, b)).cast("long").alias("n_missing"), F.size(T.missing(b, a)).cast("long").alias("n_extra"))


_PROBLEMS = O.span_problems(O.REVISIONS, "original", "candidate")


@query(f"SELECT doc_id, edit, problem FROM ({_PROBLEMS}) JOIN ({O.REVISIONS}) USING (doc_id)")
def span_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _revisions(spark, sf_dir).withColumns({"a": spans.spans("original"), "b": spans.spans("candidate")})
    return rows.select("doc_id", "edit", F.explode(gates.span_problems(F.col("a"), F.col("b"))).alias("problem"))


_HEDGED = fixed.HEDGES["en"]


def _hedge_sql(c: str, group: list[str]) -> str:
    return " + ".join(O.matches(f"lower({c})", rf"(^|[^\p{{L}}]){T.quoted(h)}([^\p{{L}}]|$)") for h in group)


_LOST = ", ".join(f"CASE WHEN {_hedge_sql('candidate', g)} < {_hedge_sql('original', g)} THEN {quote('/'.join(g))} END" for g in gates.hedge_classes(_HEDGED))


_LOST_LIST = f"list_filter([{_LOST}], lambda x: x IS NOT NULL)"
_HEDGE_SQL = f"SELECT doc_id, edit, array_to_string({_LOST_LIST}, '|') AS lost FROM ({O.REVISIONS})"
# what the edits do to claims, by their construction: one turns the only hedged claim into a bare one, if it opens a sentence
_BARE = f"CASE WHEN edit = 8 AND regexp_matches(candidate, {quote(f'[.!?]{T.WS}+It will reduce')}) THEN 'reduce' ELSE '' END"


@query(_HEDGE_SQL)
def hedge_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _revisions(spark, sf_dir).select("doc_id", "edit", F.array_join(gates.hedges_lost(F.col("original"), F.col("candidate")), "|").alias("lost"))


@query(f"SELECT doc_id, edit, {_BARE} AS bare FROM ({O.REVISIONS})")
def claim_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _revisions(spark, sf_dir).select("doc_id", "edit", F.array_join(spans.claims("original", "candidate", "language"), "|").alias("bare"))


_LENGTH_SQL = (
    f"SELECT doc_id, edit, CASE WHEN w > 0 AND (n / w < 0.75 OR n / w > 1.25) THEN 'length-original' WHEN p > 0 AND (n / p < 0.85 OR n / p > 1.15) THEN 'length-pass' END AS gate "
    f"FROM (SELECT doc_id, edit, {O.words('original')}::DOUBLE AS w, {O.words('predecessor')}::DOUBLE AS p, {O.words('candidate')}::DOUBLE AS n FROM ({O.REVISIONS}))"
)


@query(_LENGTH_SQL)
def gate_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _revisions(spark, sf_dir).select("doc_id", "edit", gates.length_gate(F.col("original"), F.col("predecessor"), F.col("candidate")).alias("gate"))


_LOCKED_SQL = f"SELECT doc_id, edit, array_to_string(list_filter(['pact', 'plan'], lambda g: contains(original, g) AND NOT contains(candidate, g)), '|') AS lost FROM ({O.REVISIONS})"


@query(_LOCKED_SQL)
def gate_locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _revisions(spark, sf_dir).select("doc_id", "edit", F.array_join(gates.locked_lost(F.col("original"), F.col("candidate"), F.col("glossary")), "|").alias("lost"))


@query(
    "SELECT id, after_ratio < least(before_ratio, 0.85) - 0.02 AS falls FROM (SELECT id, CASE code "
    + " ".join(f"WHEN {quote(c)} THEN {O.script_ratio('text', s)}" for c, s in language.SCRIPT_OF.items())
    + " END AS before_ratio, CASE code "
    + " ".join(f"WHEN {quote(c)} THEN {O.script_ratio(chr(40) + 'text || repeat(' + quote(' words in English') + ', id::INT % 4))', s)}" for c, s in language.SCRIPT_OF.items())
    + f" END AS after_ratio FROM ({O.INDIC}))"
)
def gate_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.concat("text", F.expr("repeat(' words in English', cast(id % 4 as int))"))
    return _indic(spark).select("id", gates.script_falls(F.col("text"), mixed, F.col("language")).alias("falls"))


def _paras(c: str) -> str:
    pieces = f"list_filter(list_transform(string_split_regex({c}, '\n+'), lambda s: {O.trim('s')}), lambda s: s <> '')"
    return f"list_transform({pieces}, lambda s: {O.words('s')})"


_GAMING_SQL = (
    "SELECT doc_id, edit, CASE WHEN dropped > 2 AND gained < dropped * 0.4 THEN 'comma-strip' WHEN len(list_filter(np, lambda n: n < 15 AND n < least_old)) > 0 THEN 'para-stub' "
    "WHEN len(list_filter(np, lambda n: n > 120 AND n > most_old)) > 0 THEN 'para-slab' END AS gate FROM (SELECT *, coalesce(list_min(op), 0) AS least_old, coalesce(list_max(op), 0) AS most_old FROM "
    f"(SELECT doc_id, edit, {O.matches('predecessor', '[,،、]')} - {O.matches('candidate', '[,،、]')} AS dropped, len({O.sentences('candidate')}) - len({O.sentences('predecessor')}) AS gained, "
    f"{_paras('original')} AS op, {_paras('candidate')} AS np FROM ({O.REVISIONS})))"
)


@query(_GAMING_SQL)
def gate_gaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("original"), F.col("candidate")
    return _revisions(spark, sf_dir).select("doc_id", "edit", gates.gaming(o, F.col("predecessor"), c, F.col("language"), F.col("targeted")).alias("gate"))


def _numbered(values):
    """(value, how many equal ones came up to here) for each of an array."""
    return F.transform(values, lambda x, i: F.struct(x.alias("x"), F.size(F.filter(F.slice(values, 1, i + 1), lambda y: y == x)).alias("k")))


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the reply is made from masked text, as a model would see it: the candidate's values that the original has bear its tokens
    rows = _revisions(spark, sf_dir).withColumns({"_o": spans.mask("original"), "_c": spans.mask("candidate")})
    rows = T.settled(rows, original_masked=F.col("_o.masked"), raws=F.col("_o.raws"), _own=_numbered(F.col("_o.raws")), _new=_numbered(F.col("_c.raws")))

    def token(s):
        at = F.array_position("_own", s)
        return F.when(at > 0, F.concat(F.lit(fixed.MASK_OPEN), (at - 1).cast("string"), F.lit(fixed.MASK_CLOSE))).otherwise(s["x"])

    rows = T.settled(rows, candidate_masked=gates.unmask(F.col("_c.masked"), F.transform("_new", token)))
    return gates.run_gates(rows.drop("_o", "_c", "_own", "_new", "candidate"))


# gates on figures by the edits' construction (one changes a figure), the others by their own SQL
_CHAIN = (
    "SELECT doc_id, edit, left(g, 1)::INT AS gate, substr(g, 3) AS gate_name FROM (SELECT doc_id, edit, CASE WHEN edit = 2 THEN '1 placeholder' WHEN h.lost <> '' THEN '3 hedge' WHEN c.bare <> '' THEN '3 claim' "
    "WHEN n.gate IS NOT NULL THEN '4 ' || n.gate WHEN l.lost <> '' THEN '5 locked' WHEN p.gate IS NOT NULL THEN '7 ' || p.gate ELSE '9 passed' END AS g "
    f"FROM ({_HEDGE_SQL}) h JOIN (SELECT doc_id, {_BARE} AS bare FROM ({O.REVISIONS})) c USING (doc_id) JOIN (SELECT doc_id, gate FROM ({_LENGTH_SQL})) n USING (doc_id) "
    f"JOIN (SELECT doc_id, lost FROM ({_LOCKED_SQL})) l USING (doc_id) JOIN (SELECT doc_id, gate FROM ({_GAMING_SQL})) p USING (doc_id))"
)


@query(_CHAIN)
def gate_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("doc_id", "edit", "gate", "gate_name")


@query(
    "SELECT doc_id, edit, len(list_filter(b.defects, lambda d: NOT list_contains(a.defects, d)))::BIGINT AS n_gained, "
    f"a.objective - b.objective >= {loop.MIN_GAIN} OR len(a.defects) - len(b.defects) >= 1 AS gains "
    f"FROM ({O.REVISIONS}) JOIN ({O.english_report(O.REVISIONS, 'original')}) a USING (doc_id) JOIN ({O.english_report(O.REVISIONS, 'candidate')}) b USING (doc_id)"
)
def defect_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _revisions(spark, sf_dir).select("doc_id", "edit", "original", "candidate", "language")
    # both texts of a row in turn, without a join: ids may repeat
    before = report.evaluate(rows, "original", "language").select("doc_id", "edit", "candidate", "language", F.col("defects").alias("before"), F.col("objective").alias("was"))
    both = report.evaluate(before, "candidate", "language").withColumnRenamed("defects", "after")
    gained, fewer = gates.defects_gained(F.col("before"), F.col("after")), F.size("before") - F.size("after")
    return both.select("doc_id", "edit", F.size(gained).cast("long").alias("n_gained"), ((F.col("was") - F.col("objective") >= loop.MIN_GAIN) | (fewer >= 1)).alias("gains"))


_LISTED = (
    "SELECT doc_id, problem, 0 AS place, CASE WHEN problem LIKE 'missing %' THEN 0 ELSE 1 END AS side FROM ({problems}) "
    "UNION ALL SELECT doc_id, 'hedge: ' || unnest({lost}), 1, 0 FROM ({rows}) UNION ALL SELECT doc_id, 'claim: ' || bare, 2, 0 FROM (SELECT doc_id, {bare} AS bare FROM ({rows})) WHERE bare <> '' "
    "UNION ALL SELECT doc_id, 'locked: ' || unnest(list_filter(['pact', 'plan'], lambda g: contains(original, g) AND NOT contains(candidate, g))), 3, 0 FROM ({rows}) "
    "UNION ALL SELECT doc_id, 'length', 4, 0 FROM (SELECT doc_id, {w}::DOUBLE AS w, {n}::DOUBLE AS n FROM ({rows})) WHERE w > 0 AND (n < w * 0.7 OR n > w * 1.4)"
).format(problems=_PROBLEMS, lost=_LOST_LIST, rows=O.REVISIONS, bare=_BARE, w=O.words("original"), n=O.words("candidate"))


@query(
    "SELECT doc_id, edit, coalesce(n_errors, 0) = 0 AS ok, coalesce(problems, '') AS problems "
    f"FROM ({O.REVISIONS}) LEFT JOIN (SELECT doc_id, string_agg(problem, '|' ORDER BY place, side, problem) AS problems, count(*) FILTER (NOT regexp_matches(problem, '^(missing|new) number:')) AS n_errors FROM ({_LISTED}) GROUP BY doc_id) USING (doc_id)"
)
def protected_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gates.check_protected(_revisions(spark, sf_dir))
    return rows.select("doc_id", "edit", "ok", F.array_join("problems", "|").alias("problems"))


_PRESENT = ", ".join(f"CASE WHEN {O.matches('lower(text)', rf'(^|[^\p{{L}}]){T.quoted(h)}([^\p{{L}}]|$)')} > 0 THEN {quote(h)} END" for h in _HEDGED)


@query(
    "SELECT doc_id, kind, string_agg(raw, '|' ORDER BY start) AS items FROM (SELECT doc_id, kind, raw, min(start) AS start, row_number() OVER (PARTITION BY doc_id, kind ORDER BY min(start)) AS place "
    f"FROM ({O.spans(O.SEEDED_SQL, 'text')}) GROUP BY doc_id, kind, raw) WHERE place <= 25 GROUP BY ALL "
    f"UNION ALL SELECT doc_id, 'hedge', array_to_string(found[1:20], '|') FROM (SELECT doc_id, list_filter([{_PRESENT}], lambda h: h IS NOT NULL) AS found FROM ({O.SEEDED_SQL})) WHERE len(found) > 0"
)
def protected_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gates.protected_values(seeded_docs(spark, sf_dir)).select("doc_id", F.explode("protected").alias("p"))
    return rows.select("doc_id", "p.kind", F.array_join("p.items", "|").alias("items"))


_SQL_SPACES = rf"([^{T.SPACE}])[ \t]+([,;:!?।॥])"
_SQL_STOP = rf"([^{T.SPACE}.0-9])[ \t]+\.({T.WS}|$)"


@query(
    "SELECT doc_id, md5(c4) AS cleaned_md5, (n1 + n2)::BIGINT AS n_spaces, (k1 + k2 + k3)::BIGINT AS n_commas FROM ("
    + f"SELECT *, {O.matches('c3', rf',({T.WS}*[)\]])')} AS k3, regexp_replace(c3, {quote(rf',({T.WS}*[)\]])')}, '\\1', 'g') AS c4 FROM ("
    + f"SELECT *, {O.matches('c2b', ',{2,}')} AS k2, regexp_replace(c2b, ',{{2,}}', ',', 'g') AS c3 FROM (".replace("{{2,}}", "{2,}")
    + f"SELECT *, {O.matches('c2', f',{T.WS}*([।॥])')} AS k1, regexp_replace(c2, {quote(f',{T.WS}*([।॥])')}, '\\1', 'g') AS c2b FROM ("
    + f"SELECT *, {O.matches('c1', _SQL_STOP)} AS n2, regexp_replace(c1, {quote(_SQL_STOP)}, '\\1.\\2', 'g') AS c2 FROM ("
    + f"SELECT doc_id, {O.matches('text', _SQL_SPACES)} AS n1, regexp_replace(text, {quote(_SQL_SPACES)}, '\\1\\2', 'g') AS c1 FROM ({O.SEEDED_SQL}))))))"
)
def cleanup_mechanics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleanup.mechanics(seeded_docs(spark, sf_dir))
    return rows.select("doc_id", F.md5("cleaned").alias("cleaned_md5"), F.col("n_spaces").cast("long").alias("n_spaces"), F.col("n_commas").cast("long").alias("n_commas"))


@query()
def cleanup_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleanup.apply_rules(seeded_docs(spark, sf_dir).withColumn("language", F.lit("en")))
    edits = F.array_join(F.transform("edits", lambda e: F.concat(e["rule"], F.lit(":"), e["count"].cast("string"))), "|")
    return rows.select("doc_id", F.md5("cleaned").alias("cleaned_md5"), "changed", edits.alias("edits"), F.array_join("suggestions", "|").alias("suggestions"))


@query()
def candidate_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two calls over scripted replies: the text without its stock phrases, then a reply that drops a line's end."""
    docs = seeded_docs(spark, sf_dir)
    plain = F.lit(None).cast("string")
    masked = spans.mask("text")
    for i, snippet in enumerate(SNIPPETS):
        if snippet:
            plain = F.when(F.pmod("doc_id", F.lit(len(SNIPPETS))) == i, F.replace(F.col("m.masked"), F.lit("Moreover, it"), F.lit("It"))).otherwise(plain)
    rows = docs.select("doc_id", "text", masked.alias("m"))
    first = rows.select("doc_id", F.lit(0).alias("call"), F.to_json(F.struct(F.coalesce(plain, F.col("m.masked")).alias("text"))).alias("reply"))
    second = rows.select("doc_id", F.lit(1).alias("call"), F.concat(F.lit("```json\n{\"text\": \""), F.lit("cut off")).alias("reply"))
    passes = loop.run_loop(spark, docs.select("doc_id", "text", F.array().cast("array<string>").alias("glossary")), first.unionByName(second), max_calls=2)
    return passes.select("doc_id", "n", "kind", "accepted", "rejected_by", "objective", "defect_count", F.md5("text").alias("text_md5"))


_PASSES = (
    "SELECT doc_id, n::INT AS n, ((doc_id + n) % 3 <> 0) AS accepted, ((doc_id * 7 + n * 13) % 50)::DOUBLE AS objective, ((doc_id + n * n) % 4)::INT AS defect_count, doc_id % 2 = 0 AS calibrated FROM documents CROSS JOIN range(6) AS r(n)"
)


@query(
    f"SELECT doc_id, n, objective, defect_count FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN calibrated THEN objective ELSE defect_count END, defect_count, n) AS place FROM ({_PASSES}) WHERE accepted) WHERE place = 1"
)
def candidate_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("n"))
    d, n = F.col("doc_id"), F.col("n")
    passes = docs.withColumns({"accepted": (d + n) % 3 != 0, "objective": ((d * 7 + n * 13) % 50).cast("double"), "defect_count": ((d + n * n) % 4).cast("int"), "calibrated": d % 2 == 0})
    return loop.leaderboard(passes).select("doc_id", "n", "objective", "defect_count")


@query(
    "SELECT d.doc_id, coalesce(b.n, -1)::INT AS n, md5(CASE WHEN b.n IS NULL THEN coalesce(d.text, '') ELSE 'pass ' || b.n END) AS output_md5 FROM documents d LEFT JOIN (SELECT doc_id, n FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY doc_id ORDER BY CASE WHEN calibrated THEN objective ELSE defect_count END, defect_count, n) AS place FROM ({_PASSES}) WHERE accepted AND doc_id % 5 > 0) WHERE place = 1) b USING (doc_id)"
)
def loop_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes; documents with no accepted pass fall back to their text."""
    docs = table(spark, sf_dir, "documents", "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d, n = F.col("doc_id"), F.col("n")
    passes = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("n")).withColumns(
        {"accepted": ((d + n) % 3 != 0) & (d % 5 > 0), "objective": ((d * 7 + n * 13) % 50).cast("double"), "defect_count": ((d + n * n) % 4).cast("int"), "calibrated": d % 2 == 0, "text": F.concat(F.lit("pass "), n.cast("string"))}
    )
    return loop.finish(docs, passes).select("doc_id", F.coalesce("n", F.lit(-1)).alias("n"), F.md5("output").alias("output_md5"))


_SCORES = ['{"a": [{"score": 0.%d}]}', '{"a": [{"score": "0.%d"}]}', '{"a": [{"other": 0.%d}]}', '{"a": [{"score": %d}]}', "no JSON %d"]


@query(
    f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN {O.rounded("('0.' || (doc_id % 90 + 10))::DOUBLE * 100", 1)} WHEN 3 THEN ((doc_id % 90 + 10) * 100)::DOUBLE END AS score, "
    "CASE doc_id % 5 WHEN 0 THEN '0.' || (doc_id % 90 + 10) WHEN 1 THEN '0.' || (doc_id % 90 + 10) WHEN 3 THEN (doc_id % 90 + 10)::VARCHAR END AS dug FROM documents WHERE (doc_id % 90 + 10) % 10 > 0"
)
def reply_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers at a path of detector replies: numbers, quoted numbers, other keys, no JSON."""
    n = F.pmod("doc_id", F.lit(90)) + 10
    made = F.lit(None).cast("string")
    for i, form in enumerate(_SCORES):
        made = F.when(F.pmod("doc_id", F.lit(5)) == i, F.format_string(form, n)).otherwise(made)
    rows = table(spark, sf_dir, "documents", "doc_id").where(n % 10 > 0)
    return rows.select("doc_id", replies.score_at(made, "a.0.score").alias("score"), replies.dig(made, "a.0.score").alias("dug"))


_STATUS = [401, 403, 429, 503, 529, 404, 0, 500]


@query(
    "SELECT doc_id, CASE WHEN s IN (401, 403) THEN 'rejected' WHEN s IN (429, 503, 529) THEN 'quota' WHEN s <> 0 THEN 'http' WHEN doc_id % 2 = 0 THEN 'blocked' ELSE 'unknown' END AS kind "
    f"FROM (SELECT doc_id, {_STATUS}[doc_id % 8 + 1] AS s FROM documents)"
)
def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, _STATUS)), (F.pmod("doc_id", F.lit(8)) + 1).cast("int"))
    return table(spark, sf_dir, "documents", "doc_id").select("doc_id", replies.failure_kind(status, F.pmod("doc_id", F.lit(2)) == 0).alias("kind"))


@query(
    f"SELECT doc_id, 'About ' || doc_id AS title, '2020-01-' || (doc_id % 28 + 1) AS published, md5({O.trim("coalesce(text, '')")}) AS content_md5 FROM documents"
)
def proxied_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id").cast("string")
    day = (F.pmod("doc_id", F.lit(28)) + 1).cast("string")
    body = F.concat(F.lit("Title: About "), d, F.lit("\n\nPublished Time: 2020-01-"), day, F.lit("\n\nMarkdown Content:\n"), F.coalesce("text", F.lit("")))
    got = web.proxied(body)
    return table(spark, sf_dir, "documents", "doc_id").select("doc_id", got["title"].alias("title"), got["published"].alias("published"), F.md5(got["content"]).alias("content_md5"))


_ENTRIES = (
    "SELECT 'r' || (doc_id // 4) AS run_id, 'd' || (doc_id % 3) AS detector, CASE WHEN doc_id % 2 = 0 THEN 'before' ELSE 'after' END AS side, "
    "((doc_id * 37) % 1000)::DOUBLE / 10 AS score, doc_id AS moment FROM documents"
)


@query(
    f"SELECT run_id, detector, before, after, {O.rounded('after - before', 1)} AS delta FROM (SELECT run_id, detector, {O.rounded('b', 1)} AS before, {O.rounded('a', 1)} AS after FROM "
    f"(SELECT run_id, detector, arg_max(score, moment) FILTER (side = 'before') AS b, arg_max(score, moment) FILTER (side = 'after') AS a FROM ({_ENTRIES}) GROUP BY ALL))"
)
def score_log_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    entries = table(spark, sf_dir, "documents", "doc_id").select(
        F.concat(F.lit("r"), F.floor(d / 4).cast("string")).alias("run_id"), F.concat(F.lit("d"), (d % 3).cast("string")).alias("detector"),
        F.when(d % 2 == 0, F.lit("before")).otherwise(F.lit("after")).alias("side"), (((d * 37) % 1000).cast("double") / 10).alias("score"),
        F.col("lang"), F.lit(None).cast("string").alias("note"), F.timestamp_seconds(d).alias("at"),
    )
    return loop.score_log(entries).select("run_id", "detector", "before", "after", "delta")


_REPLIES = ['{{"text": "{}", "changes": [1]}}', '```json\n{{"text": "{}\n\nsecond", "changes": []}}\n```', "{}", '{{"text": "{}', '{{"other": "{}"}}', "  "]


@query()
def reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), '["\\\\{}]', "").alias("body"))
    made = F.lit("")
    for i, r in enumerate(_REPLIES):
        head, _, tail = r.replace("{{", "\0").replace("}}", "\1").partition("{}")
        real = lambda s: s.replace("\0", "{").replace("\1", "}")
        made = F.when(F.pmod("doc_id", F.lit(len(_REPLIES))) == i, F.concat(F.lit(real(head)), F.col("body") if "{}" in r else F.lit(""), F.lit(real(tail)))).otherwise(made)
    rows = docs.select("doc_id", replies.read_reply(made).alias("r"), replies.looks_like_envelope(made).alias("envelope"))
    return rows.select("doc_id", "r.ok", F.md5("r.text").alias("text_md5"), "r.n_changes", "r.repaired", "r.plain", "r.why", "envelope")


# a plain reply is taken as it is, trimmed; without its tokens it fails if there were any
@query(
    f"SELECT doc_id, why, CASE WHEN why IS NULL THEN md5(t) END AS translated_md5 FROM (SELECT doc_id, t, CASE WHEN t = '' THEN 'empty' WHEN doc_id % 2 = 1 AND coalesce(n, 0) > 0 THEN 'token count' END AS why "
    f"FROM (SELECT doc_id, {O.trim('text')} AS t, n FROM ({O.SEEDED_SQL}) LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({O.spans(O.SEEDED_SQL, 'text')}) GROUP BY doc_id) USING (doc_id)))"
)
def translation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seeded_docs(spark, sf_dir).select("doc_id", F.col("text").alias("source"), spans.mask("text").alias("m"))
    reply = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("m.masked")).otherwise(F.regexp_replace("m.masked", gates.TOKEN, ""))
    out = loop.translation_checks(rows.withColumn("reply", reply).drop("m"))
    return out.select("doc_id", "why", F.md5("translated").alias("translated_md5"))


@query()
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seeded_docs(spark, sf_dir).select("doc_id", F.posexplode(replies.chunks("text")).alias("pos", "chunk"))
    return rows.select("doc_id", "pos", F.octet_length("chunk").alias("n_bytes"), F.md5("chunk").alias("chunk_md5"))


@query()
def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = web.articles(spark, table(spark, sf_dir, "pages", "page_id"))
    return rows.select("page_id", "title", "description", F.md5("content").alias("content_md5"), "words", "declared", "language", "disagrees")


@query()
def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id").select("page_id", F.col("html").alias("body"), web.article("html").alias("a")).select("page_id", "body", "a.content")
    # each page is parsed once; routes differ in what they return
    reached = F.pmod("page_id", F.lit(3))
    routes = F.array(*[F.struct(F.lit(r).alias("route"), F.when(reached >= i, F.col("content")).otherwise(F.lit("")).alias("content")) for i, r in ((2, "direct"), (1, "proxy"), (0, "mirror"))])
    found = web.first_route(pages.select("page_id", "body", F.explode(routes).alias("r")).select("page_id", "body", "r.route", "r.content"))
    return found.select("page_id", "route", "attempts", "words", F.md5("content").alias("content_md5"))


_URL = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?://', '') WHEN 2 THEN 'ftp://' || regexp_replace(url, '^https?://', '') WHEN 3 THEN 'not a url at all' WHEN 4 THEN ' ' ELSE 'localhost:8080/x' END"


@query(
    f"SELECT page_id, t <> '' AND scheme IN ('', 'http', 'https') AND host <> '' AND NOT regexp_matches(host, {quote(f'[{T.SPACE}%]')}) AND (contains(host, '.') OR lower(host) = 'localhost') AS accepted FROM ("
    r"SELECT page_id, t, lower(regexp_extract(t, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_replace(regexp_replace(regexp_extract(regexp_replace(t, '^[A-Za-z][A-Za-z0-9+.-]*:/*', ''), '^([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '') AS host "
    f"FROM (SELECT page_id, {O.trim(_URL)} AS t FROM pages))"
)
def page_url_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("page_id", web.accepted_address(F.col("u")).alias("accepted"))


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("url", "^https?://", "")
    made = {0: F.col("url"), 1: bare, 2: F.concat(F.lit("ftp://"), bare), 3: F.lit("not a url at all"), 4: F.lit(" "), 5: F.lit("localhost:8080/x")}
    u = F.lit(None).cast("string")
    for i, c in made.items():
        u = F.when(F.pmod("page_id", F.lit(6)) == i, c).otherwise(u)
    return table(spark, sf_dir, "pages", "page_id").select("page_id", u.alias("u"))


@query()
def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("page_id", web.address("u").alias("a")).select("page_id", "a.*")


#: What the bench runs, and the flagship.
HEADLINE = ["noise_strip", "lang_id", "rhythm_cv", "lexicon_density", "sentence_flags", "observations", "english_score", "verdict_rollup", "mask_roundtrip", "hedge_diff", "gate_chain", "cleanup_mechanics", "cleanup_english", "page_articles"]
FLAGSHIP = verdict_rollup
