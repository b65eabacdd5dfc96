"""Counts of English texts and of paragraphs: Arrow-batched Python, whose string methods take a fraction of Java's time a match.

Only whole numbers come from here; ratios and rounding stay column expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as D

from . import fixed, text as T
from .spans import INT, TEXT, clean_english_text, mask_text, struct

#: str.split takes the first ones for white space, and not the last.
_ODD = "\x1c\x1d\x1e\x1f\x85\ufeff"


def python(pattern: str) -> re.Pattern:
    """A pattern of the columns' for Python; case is ignored in ASCII only, as in Java."""
    return re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), pattern).replace(r"\z", r"\Z"), re.ASCII)


_WORD = python(f"{T.NWS}+")
_CUTS = {marks: python(f"{T.WS}(?<=[{marks}]{T.WS}){T.WS}*") for marks in (".!?", T.INDIC_MARKS)}
_COLON_LIST = python(T.COLON_LIST)
_PASSIVE = python(rf"(?i){T.BEGIN}(?:{fixed.BE_AND_GET}){T.WS}+(?:{T.WORD}+ly{T.WS}+)?{T.WORD}+(?:{fixed.PARTICIPLE_ENDINGS}){T.END}")
_CONTRACTION = python(rf"(?i){T.BEGIN}{T.WORD}+'(?:{fixed.CONTRACTION_ENDINGS}){T.END}")
_PERSON = python(rf"{T.BEGIN}(?:{fixed.ADDRESS_WORDS}){T.END}")
_RUN_UP = python(rf"(?i)(?:{fixed.RUN_UPS.replace(chr(92) + 'b', T.END)})")
_LETTERS = re.compile("[a-z']+")
_NOMINAL = tuple(e + s for e in fixed.NOMINAL_ENDINGS.split("|") for s in ("", "s"))


def words_in(text: str):
    """The function that counts words in this text and parts of it."""
    if any(c in text for c in _ODD):
        return lambda s: len(_WORD.findall(s))
    return lambda s: len(s.split())


def cut(text: str, marks: str = ".!?") -> list[str]:
    return [s for piece in _CUTS[marks].split(text) if (s := piece.strip(T.SPACES))]


def count_prose(text: str | None) -> tuple[int, int, list[int], list[int], int, int]:
    """Of a trimmed text: words, sentences, words of sentences over 1 and of lines over 3, passives, colon lists."""
    text = text or ""
    count, sents = words_in(text), cut(text)
    lens = [n for s in sents if (n := count(s)) > 1]
    lines = [n for s in text.split("\n") if (n := count(s)) > 3]
    return count(text), len(sents), lens, lines, len(_PASSIVE.findall(text)), len(_COLON_LIST.findall(text)) if ":" in text else 0


def count_raw(text: str | None) -> tuple[int, int, list[int], int, int, int, int]:
    """Of a raw text: words, sentences, words of sentences over 1, nominalisations, contractions, address, leads."""
    text = text or ""
    count, sents, toks = words_in(text), cut(text), _LETTERS.findall(text.lower())
    lens = [n for s in sents if (n := count(s)) > 1]
    nominal = sum(len(w) > 6 and w.endswith(_NOMINAL) for w in toks)
    contractions = len(_CONTRACTION.findall(text)) if "'" in text else 0
    return len(toks), len(sents), lens, nominal, contractions, len(_PERSON.findall(text)), sum(_RUN_UP.match(s) is not None for s in sents)


def _lines(text: str) -> list[int]:
    count = words_in(text)
    return [n for s in text.split("\n") if (n := count(s)) > 0]


def _commas(text: str) -> int:
    return text.count(",") + text.count("،") + text.count("、")


def uneven(original: str | None, predecessor: str | None, candidate: str | None, lang: str | None, commas: bool | None, paras: bool | None) -> str | None:
    """Name of a degenerate edit, or null; ``commas`` and ``paras`` say which of the checks are asked for."""
    if candidate is None:
        return None
    if commas and predecessor is not None:
        dropped = _commas(predecessor) - _commas(candidate)
        if dropped > 2:
            marks = ".!?" if lang == "en" else T.INDIC_MARKS
            if len(cut(candidate, marks)) - len(cut(predecessor, marks)) < dropped * 0.4:
                return "comma-strip"
    if not paras:
        return None
    old = [] if original is None else _lines(original)
    new = old if candidate == original else _lines(candidate)
    if new:
        if min(new) < min(15, min(old, default=0)):
            return "para-stub"
        if max(new) > max(120, max(old, default=0)):
            return "para-slab"
    return None


# Fixed values. (pattern, replacement) of stray spaces before punctuation, and of redundant commas.
SPACED = [(f"({T.NWS})[ \\t]+([,;:!?।॥])", "$1$2"), (f"([^{T.SPACE}.0-9])[ \\t]+\\.(?={T.WS}|\\z)", "$1.")]
COMMAS = [(f",{T.WS}*([।॥])", "$1"), (",{2,}", ","), (rf",({T.WS}*[)\]])", "$1")]
HINDI_THROUGH = (f"{T.WS}*के{T.WS}+माध्यम{T.WS}+से", " से")
#: Whatever a step changes has this in it: a quick search spares most texts the pattern.
_HINTS = [r"[ \t][,;:!?।॥]", r"[ \t]\.", "[।॥]", ",,", r"[)\]]"]
_STEPS = [(re.compile(hint), python(p), re.sub(r"\$(\d)", r"\\\1", to)) for hint, (p, to) in zip(_HINTS, SPACED + COMMAS)]
_THROUGH = python(HINDI_THROUGH[0])
_TOKEN = re.compile(f"{fixed.MASK_OPEN}([0-9]+){fixed.MASK_CLOSE}")


def unmasked(masked: str, raws: list[str]) -> str:
    """Tokens replaced by their values, in one pass; unknown tokens stay."""
    known = {str(i): raw for i, raw in enumerate(raws)}
    return _TOKEN.sub(lambda m: known.get(m[1], m[0]), masked)


def clean(text: str | None, lang: str | None, aggressive: bool | None) -> tuple[str, int, int, int, int, int]:
    """The text after the rules, which don't see its protected spans, and how often each rule was used."""
    masked, raws, _ = mask_text(text)
    used = [0] * len(_STEPS)
    for i, (hint, pattern, to) in enumerate(_STEPS):
        if hint.search(masked):
            masked, used[i] = pattern.subn(to, masked)
    openers = replaced = through = 0
    if lang == "en":
        masked, openers, replaced = clean_english_text(masked)
    elif lang == "hi" and aggressive:
        masked, through = _THROUGH.subn(HINDI_THROUGH[1], masked)
    return unmasked(masked, raws), sum(used[: len(SPACED)]), sum(used[len(SPACED) :]), openers, replaced, through


INTS = D.ArrayType(INT)
clean_up = F.udf(clean, struct(text=TEXT, spaces=INT, commas=INT, openers=INT, replaced=INT, through=INT), useArrow=True)
prose_counts = F.udf(count_prose, struct(words=INT, sents=INT, lens=INTS, lines=INTS, passives=INT, colon_lists=INT), useArrow=True)
raw_counts = F.udf(count_raw, struct(words=INT, sents=INT, lens=INTS, nominal=INT, contractions=INT, person=INT, leads=INT), useArrow=True)
uneven_edit = F.udf(uneven, TEXT, useArrow=True)
