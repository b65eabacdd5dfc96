"""DuckDB SQL for the measures, written apart from the Spark expressions (RE2 has no look-around)."""

from __future__ import annotations

from ..functions import fixed, indic_lexicon as lists, language, text as T
from .seeds import INDIC_SQL, REVISIONS_SQL, SEEDED_SQL, quote as q

WS, NWS, WORD = T.WS, T.NWS, T.WORD


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, {q(NWS + '+')}))"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def sentences(x: str, marks: str = ".!?") -> str:
    cut = f"string_split(regexp_replace({x}, {q(f'([{marks}]){WS}+')}, '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {trim('s')}), lambda s: s <> '')"


def count_sub(x: str, part: str) -> str:
    return f"((length({x}) - length(replace({x}, {part}, ''))) // length({part}))"


def count_subs(x: str, parts: list[str]) -> str:
    return "(" + " + ".join(count_sub(x, q(p)) for p in parts) + ")"


def matches(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def rounded(x: str, digits: int) -> str:
    k = 10**digits
    return f"(floor(({x})::DOUBLE * {k} + 0.5) / {k})"


def per1k(n: str, w: str = "words", digits: int = 2) -> str:
    return rounded(f"({n}) / ({w} / 1000.0::DOUBLE)", digits)


def mean(xs: str) -> str:
    return f"(CASE WHEN len({xs}) > 0 THEN list_sum({xs})::DOUBLE / len({xs}) ELSE 0.0 END)"


def variation(xs: str, m: str, least: int) -> str:
    spread = f"sqrt(list_sum(list_transform({xs}, lambda v: (v - {m}) * (v - {m}))) / len({xs}))"
    return f"(CASE WHEN len({xs}) > {least} AND {m} <> 0 THEN {spread} / {m} ELSE 0.0 END)"


def strip_noise(x: str) -> str:
    for pattern, to in language.NOISE:
        x = f"regexp_replace({x}, {q(pattern)}, {q(to.replace('$', chr(92)))}, 'g')"
    return x


def letters_only(x: str) -> str:
    return rf"regexp_replace({x}, '\P{{L}}', '', 'g')"


def _class(script: str) -> str:
    lo, hi = fixed.SCRIPT_RANGES[script]
    return rf"\x{{{lo:04X}}}-\x{{{hi:04X}}}"


def script_ratio(x: str, script: str) -> str:
    n = f"length({letters_only(x)})"
    return f"(CASE WHEN {n} = 0 THEN 0.0 ELSE length(regexp_replace({letters_only(x)}, '[^{_class(script)}]', '', 'g'))::DOUBLE / greatest({n}, 1) END)"


def detect(source: str, key: str) -> str:
    """key, language, confidence, ambiguous for a query with key and prose."""
    scripts = ", ".join(f"({q(s)}, {q('[^' + _class(s) + ']')}, {q('^[^' + _class(s) + ']*')}, {i})" for i, s in enumerate(language.SCRIPTS))
    pick = " ".join(f"WHEN {q(s)} THEN {q(language._language_of(s))}" for s in language.SCRIPTS)
    marks = " + ".join(f"regexp_matches(low, {q(f'(^|{WS}){m}({WS}|$|[,.!?])')})::INT" for m in fixed.HINGLISH_MARKERS)
    return f"""
SELECT {key}, CASE WHEN n_letters = 0 THEN 'en' WHEN top <> 'Latin' THEN CASE top {pick} END WHEN hinglish >= 3 THEN 'hinglish' ELSE 'en' END AS language,
  CASE WHEN n_letters = 0 THEN 0.0 ELSE n / greatest(n_letters, 1) END AS confidence,
  n_letters > 0 AND top IN ({", ".join(q(s) for s in language.SHARED)}) AS ambiguous
FROM (
  SELECT {key}, any_value(n_letters) AS n_letters, any_value(hinglish) AS hinglish, arg_max(script, (n, -early)) AS top, max(n)::DOUBLE AS n
  FROM (
    SELECT {key}, n_letters, hinglish, script, length(regexp_replace(lets, outside, '', 'g')) AS n,
      CASE WHEN length(regexp_replace(lets, outside, '', 'g')) > 0 THEN length(regexp_extract(lets, before)) ELSE 1073741824 END AS early
    FROM (SELECT {key}, {letters_only('prose')} AS lets, length({letters_only('prose')}) AS n_letters, ({marks}) AS hinglish FROM (SELECT *, lower(prose) AS low FROM ({source})))
    CROSS JOIN (VALUES {scripts}) AS s(script, outside, before, place)
    UNION ALL
    SELECT {key}, length({letters_only('prose')}), ({marks}), 'Latin', {matches('prose', '[A-Za-z]')}, 536870912 FROM (SELECT *, lower(prose) AS low FROM ({source}))
  ) GROUP BY {key}
)"""


PASSIVE = rf"(?i)\b(?:{fixed.BE_AND_GET}){WS}+(?:{WORD}+ly{WS}+)?{WORD}+(?:{fixed.PARTICIPLE_ENDINGS})\b"


def english_features(source: str, keep: str) -> str:
    """The columns ``keep`` and all English features for a query with those and prose."""
    opens = f"list_transform(list_filter(sents, lambda s: {words('s')} > 3), lambda s: lower(array_to_string(regexp_extract_all(s, {q(NWS + '+')})[1:2], ' ')))"
    return f"""
SELECT {keep}, words::BIGINT AS words, len(sents)::BIGINT AS n_sents, {rounded('m', 1)} AS mean_len,
  {rounded(variation('lens', 'm', 2), 3)} AS sent_cv, {rounded(variation('paras', 'pm', 3), 3)} AS para_cv,
  {rounded("CASE WHEN len(opens) > 0 THEN coalesce(list_sum(list_filter(map_values(list_histogram(opens)), lambda v: v >= 3)), 0)::DOUBLE / len(opens) ELSE 0 END", 3)} AS rep_open,
  {per1k(count_subs('low', fixed.FILLER))} AS filler_1k, {per1k(count_subs('low', fixed.TELLS))} AS tell_1k,
  {per1k(count_subs('t', ['—', ' - ']))} AS em_dash_1k,
  {rounded(f"CASE WHEN len(sents) > 0 THEN {matches('t', PASSIVE)}::DOUBLE / len(sents) ELSE 0 END", 3)} AS passive_ratio,
  {rounded("CASE WHEN len(toks) > 0 THEN len(list_distinct(toks))::DOUBLE / len(toks) ELSE 0 END", 3)} AS ttr,
  {per1k(matches('t', T.COLON_LIST))} AS colon_lists_1k
FROM (SELECT *, {mean('lens')} AS m, {mean('paras')} AS pm, {opens} AS opens FROM (
  SELECT *, list_filter(list_transform(sents, lambda s: {words('s')}), lambda n: n > 1) AS lens,
    list_filter(list_transform(string_split(t, chr(10)), lambda s: {words('s')}), lambda n: n > 3) AS paras,
    regexp_extract_all(low, {q(NWS + '+')}) AS toks
  FROM (SELECT *, lower(t) AS low, {sentences('t')} AS sents, greatest(1, {words('t')}) AS words FROM (SELECT *, {trim("coalesce(prose, '')")} AS t FROM ({source})))))"""


def norm(value: str, good: float, bad: float, low: bool) -> str:
    if low:
        value, good, bad = f"-({value})", -good, -bad
    return f"(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({value})::DOUBLE - ({bad!r})::DOUBLE) / ({good - bad!r})::DOUBLE)) * 100)"


def score(source: str, bands: list, keep: str) -> str:
    parts = ", ".join(f"{rounded(norm(k, g, b, low), 1)} AS s_{k}, {norm(k, g, b, low)} >= {fixed.TARGET} AS ok_{k}" for k, g, b, low, _ in bands)
    from ..operators.english import objective_weights

    composite = " + ".join(f"s_{k} * {w!r}::DOUBLE" for k, *_, w in bands)
    weights = objective_weights(bands)
    weighed = " + ".join(f"s_{k} * {w!r}::DOUBLE" for k, w in weights.items())
    return f"""
SELECT {keep}, {", ".join(f's_{k}, ok_{k}' for k, *_ in bands)}, {rounded('c', 1)} AS score, {rounded('100 - c', 1)} AS ai_likeness,
  {" AND ".join(f'ok_{k}' for k, *_ in bands)} AS all_passed, {rounded(f'100 - (o) / {sum(weights.values())!r}::DOUBLE', 1)} AS objective
FROM (SELECT *, {composite} AS c, {weighed} AS o FROM (SELECT *, {parts} FROM ({source})))"""


def observations(source: str, keep: str) -> str:
    nominal = f"len(list_filter(toks, lambda w: length(w) > 6 AND regexp_matches(w, '(?:{fixed.NOMINAL_ENDINGS})s?$')))"
    lead = f"len(list_filter(sents, lambda s: regexp_matches(s, {q(rf'(?i)^(?:{fixed.RUN_UPS})')})))"
    return f"""
SELECT {keep}, len(toks)::BIGINT AS x_words, len(sents)::BIGINT AS x_sents, {rounded(variation('lens', 'm', 2), 3)} AS x_sent_cv,
  {per1k(nominal, 'n', 1)} AS nominal_1k, {per1k(matches('t', rf"(?i)\b{WORD}+'(?:{fixed.CONTRACTION_ENDINGS})\b"), 'n', 1)} AS contraction_1k,
  {per1k(matches('t', rf"\b(?:{fixed.ADDRESS_WORDS})\b"), 'n', 1)} AS person_1k,
  {rounded(f"CASE WHEN len(sents) > 0 THEN {lead}::DOUBLE / len(sents) ELSE 0 END", 3)} AS lead_frac
FROM (SELECT *, {mean('lens')} AS m, greatest(1, len(toks)) AS n FROM (
  SELECT *, list_filter(list_transform(sents, lambda s: {words('s')}), lambda n: n > 1) AS lens
  FROM (SELECT *, {sentences('t')} AS sents, regexp_extract_all(lower(t), '[a-z'']+') AS toks FROM (SELECT *, coalesce(text, '') AS t FROM ({source})))))"""


def lexicon(table: dict[str, list[str]]) -> str:
    """The list of each code as a CASE on ``code``."""
    rows = []
    for code in language.SCRIPT_OF:
        found = table.get(code) or table.get(fixed.SCRIPT_FAMILY.get(code, "hi"), [])
        if found:
            rows.append(f"WHEN {q(code)} THEN [{', '.join(map(q, found))}]")
    return f"(CASE code {' '.join(rows)} ELSE []::VARCHAR[] END)"


def _bounded(p: str, after: str) -> str:
    return f"{q(f'(^|{WS})')} || {p} || {q(f'({WS}|$|[{after}])')}"


def indic_features(source: str, keep: str) -> str:
    """For a query with keep, prose and code."""
    from ..operators.indic import MECHANICS, SPACED_PUNCT

    listed = lambda table: per1k(f"list_sum(list_transform(list_concat([''], {lexicon(table)}), lambda p: CASE WHEN p = '' THEN 0 ELSE {count_sub('low', 'lower(p)')} END))")
    ratio = "CASE code " + " ".join(f"WHEN {q(c)} THEN {script_ratio('t', s)}" for c, s in language.SCRIPT_OF.items()) + " END"
    relative = f"list_sum(list_transform(list_concat([''], {lexicon(lists.RELATIVE_MARKERS)}), lambda p: CASE WHEN p = '' THEN 0 ELSE len(regexp_extract_all(t, {_bounded('p', ',।॥.')})) END))"
    edge = r"""[ ,.।॥!?:;"'()]+"""
    ends = f"list_transform(list_filter(list_transform(sents, lambda s: regexp_extract_all(regexp_replace(s, '[ .।॥!?]+$', ''), {q(NWS + '+')})), lambda w: len(w) >= 4), lambda w: regexp_replace(w[-1], {q(f'^{edge}|{edge}$')}, '', 'g'))"
    final = f"len(list_filter(ends, lambda e: len(list_filter({lexicon(lists.VERB_ENDINGS)}, lambda v: suffix(e, v))) > 0))"
    return f"""
SELECT {keep}, words::BIGINT AS words, len(sents)::BIGINT AS n_sents, {rounded(ratio, 3)} AS purity,
  {rounded(f"len(list_filter(toks, lambda w: regexp_matches(w, {q(r"^[A-Za-z][A-Za-z'.-]*$")})))::DOUBLE / greatest(len(toks), 1)", 3)} AS latin,
  {rounded("CASE WHEN len(sents) > 0 THEN len(list_filter(sents, lambda s: right(s, 1) IN ('।', '॥')))::DOUBLE / len(sents) ELSE 0 END", 3)} AS danda_frac,
  {per1k(" + ".join(matches('t', p) for p in MECHANICS))} AS mech_1k, {per1k(matches('t', SPACED_PUNCT))} AS sp_punct_1k,
  {per1k(matches('t', f'{WS}-{WS}'))} AS hyphen_1k,
  {rounded(f"CASE WHEN len(ends) > 0 THEN {final}::DOUBLE / len(ends) ELSE 1 END", 3)} AS verb_final,
  {listed(lists.CALQUES)} AS calque_1k, {listed(lists.CONNECTIVES)} AS conn_1k, {listed(lists.FORMAL_MARKERS)} AS formal_1k,
  {per1k(relative)} AS rel_1k, {listed(lists.PREP_CALQUES)} AS prep_calque_1k, {per1k(matches('t', '[,،]'))} AS comma_1k,
  {rounded('m', 1)} AS mean_len, {rounded(variation('lens', 'm', 2), 3)} AS sent_cv, {rounded(variation('paras', 'pm', 3), 3)} AS para_cv
FROM (SELECT *, {mean('lens')} AS m, {mean('paras')} AS pm, {ends} AS ends FROM (
  SELECT *, list_filter(list_transform(sents, lambda s: {words('s')}), lambda n: n > 1) AS lens,
    list_filter(list_transform(string_split(t, chr(10)), lambda s: {words('s')}), lambda n: n > 3) AS paras
  FROM (SELECT *, lower(t) AS low, {sentences('t', T.INDIC_MARKS)} AS sents, regexp_extract_all(t, {q(NWS + '+')}) AS toks, greatest(1, {words('t')}) AS words
    FROM (SELECT *, {trim("coalesce(prose, '')")} AS t FROM ({source})))))"""


def verdict(likeness: str, n: str) -> str:
    return f"CASE WHEN {n} < {fixed.LEAST_WORDS} THEN 'unknown' WHEN {likeness} <= {fixed.HUMAN_TO} THEN 'human' WHEN {likeness} <= {fixed.MIXED_TO} THEN 'mixed' ELSE 'ai' END"


SEEDED = f"SELECT doc_id, lang, text, {strip_noise('text')} AS prose FROM ({SEEDED_SQL})"
INDIC = f"SELECT id, lang, text, CASE WHEN lang IN ({', '.join(map(q, language.SCRIPT_OF))}) THEN lang ELSE 'hi' END AS code, {strip_noise('text')} AS prose FROM ({INDIC_SQL})"
REVISIONS = REVISIONS_SQL


def re2(pattern: str) -> str:
    """A pattern with white space spelt out, inside and outside of classes."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        if pattern[i] == "\\":
            out += (T.SPACE if inside else WS) if pattern[i + 1] == "s" else pattern[i : i + 2]
            i += 2
            continue
        inside = pattern[i] == "[" or (inside and pattern[i] != "]")
        out += pattern[i]
        i += 1
    return out


def canonical(kind: str) -> str:
    low = f"lower({trim('raw')})"
    if kind == "url":
        return f"rtrim({low}, '.,;:!?''\"')"
    if kind in ("dosage", "price", "percent"):
        bare = f"replace(regexp_replace({low}, {q(WS + '+')}, '', 'g'), ',', '')"
        return f"regexp_replace({bare}, '^(rs\\.?|inr)', '₹')"
    return f"replace({low}, ',', '')" if kind == "number" else low


def spans(source: str, text: str) -> str:
    """doc_id, kind, raw, canonical, start, stop: for each kind in turn, matches that touch no span of an earlier kind."""
    ctes = [f"src AS (SELECT doc_id, {text} AS t FROM ({source}))"]
    for i, (kind, pattern) in enumerate(fixed.SPANS):
        marked = f"string_split(regexp_replace(t, {q(re2(pattern))}, chr(1) || '\\0' || chr(2), 'g'), chr(1))"
        pieces = f"SELECT doc_id, parts[1] AS head, unnest(parts[2:]) AS piece, unnest(range(1, len(parts))) AS i FROM (SELECT doc_id, {marked} AS parts FROM src) WHERE len(parts) > 1"
        cut = f"SELECT doc_id, head, i, split_part(piece, chr(2), 1) AS raw, split_part(piece, chr(2), 2) AS rest FROM ({pieces})"
        at = f"SELECT doc_id, raw, length(head) + sum(length(raw) + length(rest)) OVER (PARTITION BY doc_id ORDER BY i) - length(raw) - length(rest) AS start FROM ({cut})"
        ctes.append(f"m{i} AS (SELECT doc_id, '{kind}' AS kind, raw, {canonical(kind)} AS canonical, start::INT AS start, (start + length(raw))::INT AS stop FROM ({at}))")
        free = f" WHERE NOT EXISTS (SELECT 1 FROM c{i - 1} c WHERE c.doc_id = m{i}.doc_id AND c.start < m{i}.stop AND m{i}.start < c.stop)" if i else ""
        ctes.append(f"c{i} AS (SELECT * FROM m{i}{free}" + (f" UNION ALL SELECT * FROM c{i - 1})" if i else ")"))
    return f"WITH {', '.join(ctes)} SELECT * FROM c{len(fixed.SPANS) - 1}"


def span_problems(source: str, before: str, after: str) -> str:
    """doc_id, problem: one row for each value missing or new, with multiplicity."""
    side = lambda text, a, b: f"SELECT doc_id, kind || ':' || canonical AS v, {a} AS a, {b} AS b FROM ({spans(source, text)})"
    counts = f"SELECT doc_id, v, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM ({side(before, 1, 0)} UNION ALL {side(after, 0, 1)}) GROUP BY ALL"
    return (
        f"WITH n AS ({counts}) SELECT doc_id, 'missing ' || v AS problem FROM (SELECT doc_id, v, unnest(range(greatest(a - b, 0))) FROM n) "
        "UNION ALL SELECT doc_id, 'new ' || v FROM (SELECT doc_id, v, unnest(range(b)) FROM n WHERE a = 0)"
    )


def plain(x: str) -> str:
    return f"(CASE WHEN {x} = floor({x}) THEN floor({x})::BIGINT::VARCHAR ELSE {x}::VARCHAR END)"


FIRED = (
    "list_filter([CASE WHEN nominal_1k > 30 THEN 'flag:nominalisation:' || " + plain("nominal_1k") + " || ' nominalisations per 1000 words' END, "
    "CASE WHEN contraction_1k = 0 AND x_words > 150 THEN 'flag:contractions:no contractions anywhere' END, "
    "CASE WHEN person_1k < 5 AND x_words > 150 THEN 'flag:impersonal:' || " + plain("person_1k") + " || ' first/second-person words per 1000' END, "
    "CASE WHEN lead_frac > 0.2 AND x_sents > 5 THEN 'flag:adverbial-leads:' || floor(lead_frac * 100 + 0.5)::BIGINT::VARCHAR || '% of sentences open with an adverbial lead' END, "
    "CASE WHEN x_sent_cv < 0.3 AND x_sents > 5 THEN 'flag:uniform-rhythm:sentence-length variation ' || " + plain("x_sent_cv") + " END], lambda f: f IS NOT NULL)"
)


def english_report(source: str, text: str) -> str:
    """doc_id, words, tell_1k, colon_lists_1k, ai_likeness, objective, fired, defects of texts taken as English."""
    keep = "doc_id, words, tell_1k, colon_lists_1k, para_cv, passive_ratio"
    texts = f"SELECT doc_id, {text} AS text, {strip_noise(text)} AS prose FROM ({source})"
    failing = ", ".join(f"CASE WHEN NOT ok_{k} THEN 'param:{k}' END" for k, *_ in fixed.ENGLISH_BANDS)
    return (
        f"SELECT doc_id, words, tell_1k, colon_lists_1k, ai_likeness, objective, {FIRED} AS fired, list_concat(list_filter([{failing}], lambda p: p IS NOT NULL), {FIRED}) AS defects "
        f"FROM ({score(english_features(texts, 'doc_id'), fixed.ENGLISH_BANDS, keep)}) JOIN ({observations(texts, 'doc_id')}) USING (doc_id)"
    )
