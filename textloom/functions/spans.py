"""Protected spans and claim checks: Arrow-batched Python, since claiming spans depends on order.

Patterns are matched with ASCII ``\\w``, ``\\d`` and ``\\b``, and with white space spelt out.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as D

from .fixed import CLAIM_VERBS, HEDGES, MASK_CLOSE, MASK_OPEN, OPENERS, REPLACEMENTS, SPANS

SPACE = r"\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def js(pattern: str, flags: int = 0) -> re.Pattern:
    """Compile with explicit white space inside and outside of classes."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
            i += 2
        elif two == r"\S":
            out.append(f"[^{SPACE}]")
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            inside = pattern[i] == "[" or (inside and pattern[i] != "]")
            out.append(pattern[i])
            i += 1
    return re.compile("".join(out), flags | re.ASCII)


_SPANS = [(kind, js(p.removeprefix("(?i)"), re.I if p.startswith("(?i)") else 0)) for kind, p in SPANS]
#: A plain search spares most texts the pattern: each match has one of these in it.
_HINTS = {"url": "://", "email": "@", "percent": "%"}
_TEN = re.compile("[6-9][0-9]{9}")
_BLANK = js(r"\s+")


def struct(**fields: D.DataType) -> D.StructType:
    """A row type; types are built without a session, so that workers can import the functions."""
    return D.StructType([D.StructField(k, v) for k, v in fields.items()])


TEXT, INT, FLAG = D.StringType(), D.IntegerType(), D.BooleanType()
TEXTS = D.ArrayType(TEXT)
SPAN_TYPE = D.ArrayType(struct(kind=TEXT, raw=TEXT, canonical=TEXT, start=INT, end=INT))


def canonical(kind: str, raw: str) -> str:
    """A value's form for comparison; units are never converted."""
    s = raw.strip().lower()
    if kind == "url":
        return s.rstrip(".,;:!?'\"")
    if kind in ("dosage", "price", "percent"):
        s = _BLANK.sub("", s).replace(",", "")
        return re.sub(r"^rs\.?|^inr", "₹", s)
    return s.replace(",", "") if kind == "number" else s


def find_spans(text: str | None) -> list[tuple[str, str, str, int, int]]:
    """Each kind is matched on the whole text; what touches a span of an earlier kind is dropped."""
    text = text or ""
    taken = bytearray(len(text))
    out = []
    for kind, pattern in _SPANS:
        if _HINTS.get(kind, "") not in text or kind == "phone" and not _TEN.search(text):
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            if a < b and not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                out.append((kind, m[0], canonical(kind, m[0]), a, b))
    return sorted(out, key=lambda s: s[3])


def mask_text(text: str | None) -> tuple[str, list[str], list[tuple]]:
    """Text with numbered tokens for its spans, the spans' raw values, the spans."""
    text = text or ""
    found = find_spans(text)
    parts, at = [], 0
    for i, (_, _, _, a, b) in enumerate(found):
        parts.append(f"{text[at:a]}{MASK_OPEN}{i}{MASK_CLOSE}")
        at = b
    return "".join(parts) + text[at:], [s[1] for s in found], found


spans = F.udf(find_spans, SPAN_TYPE, useArrow=True)
mask = F.udf(mask_text, struct(masked=TEXT, raws=TEXTS, spans=SPAN_TYPE), useArrow=True)


def _claim_patterns(lang: str) -> tuple[re.Pattern, dict[str, tuple[re.Pattern, re.Pattern]]]:
    hedge = "|".join(re.escape(h).replace(r"\ ", " ") for h in HEDGES.get(lang, HEDGES["en"]))
    verbs = "|".join(CLAIM_VERBS)
    hedged = js(rf"(?:{hedge})\s+(?:\w+\s+){{0,3}}?({verbs})\b", re.I)
    by_verb = {
        v: (
            js(rf"(?:^|[.!?]\s+)(?:(?!(?:{hedge}))[\w,'\"() -]){{0,60}}?\b{v}\b", re.I),
            js(rf"(?:{hedge})\s+(?:\w+\s+){{0,3}}?{v}\b", re.I),
        )
        for v in CLAIM_VERBS
    }
    return hedged, by_verb


_CLAIMS: dict[str, tuple] = {}


def bare_claims(before: str | None, after: str | None, lang: str | None) -> list[str]:
    """Verbs whose claim had a hedge close before them and now stands as a plain statement."""
    lang = lang if lang in HEDGES else "en"
    if lang not in _CLAIMS:
        _CLAIMS[lang] = _claim_patterns(lang)
    hedged, by_verb = _CLAIMS[lang]
    after = after or ""
    out: list[str] = []
    for verb in dict.fromkeys(m[1].lower() for m in hedged.finditer(before or "")):
        bare, still = by_verb[verb]
        if bare.search(after) and not still.search(after):
            out.append(verb)
    return out


claims = F.udf(bare_claims, TEXTS, useArrow=True)

_AFTER_END = r"(^|[.!?][\"')\]]?\s+|\n\s*)"
_OPENERS = [js(_AFTER_END + re.escape(p).replace(r"\ ", " ") + r",\s+(\S)", re.I) for p in OPENERS]
_REPLACED = [(js(rf"\b{re.escape(p)}\b".replace(r"\ ", " "), re.I), to) for p, to in REPLACEMENTS]
_BLANKS = re.compile(r"[ \t]{2,}")
_SMALL_START = js(_AFTER_END + r"([a-z])")
CLEAN_TYPE = struct(text=TEXT, openers=INT, replaced=INT)


def clean_english_text(text: str | None) -> tuple[str, int, int]:
    """Openers deleted and phrases replaced, with counts; blanks and sentence starts are tidied in any case."""
    out, openers, replaced = text or "", 0, 0
    low = out.lower()  # a plain search first: few texts hold a phrase at all
    for phrase, pattern in zip(OPENERS, _OPENERS):
        if phrase in low:
            out, n = pattern.subn(lambda m: m[1] + m[2].upper(), out)
            openers, low = openers + n, out.lower()
    for (phrase, _), (pattern, to) in zip(REPLACEMENTS, _REPLACED):
        if phrase in low:
            out, n = pattern.subn(to, out)
            replaced, low = replaced + n, out.lower()
    out = _SMALL_START.sub(lambda m: m[1] + m[2].upper(), _BLANKS.sub(" ", out))
    return out, openers, replaced


clean_english = F.udf(clean_english_text, CLEAN_TYPE, useArrow=True)
