"""Reading model replies: fenced or damaged JSON, or plain prose; refusing rather than guessing."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.spans import FLAG, INT, TEXT, TEXTS, js, struct

_FENCE = js(r"^```(?:json)?\s*", re.I)
_FENCE_END = js(r"```\s*$")
_ENVELOPE_KEYS = js(r'"\s*(?:text|changes)\s*"\s*:')
_TEXT_KEY = js(r'"text"\s*:\s*"')
_ESCAPES = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
REPLY = struct(ok=FLAG, text=TEXT, n_changes=INT, repaired=FLAG, plain=FLAG, why=TEXT)


def strip_fence(raw: str) -> str:
    return _FENCE_END.sub("", _FENCE.sub("", raw.strip())).strip()


def escape_controls(s: str) -> str:
    """Line ends and tabs inside of string literals, escaped as JSON asks for."""
    # literals alternate with what is between them; a literal is a quote, escapes or other characters, a quote
    return re.sub(r'"(?:\\.|[^"\\])*(?:"|\Z)', lambda m: re.sub(r"(\\.)|([\n\r\t])", lambda c: c[1] or _ESCAPES[c[2]], m[0], flags=re.S), s, flags=re.S)


def read_json(s: str):
    """The value of the whole string or of its outermost braces, each as it is or with controls escaped; else None."""
    a, b = s.find("{"), s.rfind("}")
    for part in [s] + [s[a : b + 1]] * (-1 < a < b):
        for attempt in (part, escape_controls(part)):
            try:
                return json.loads(attempt)
            except ValueError:
                continue
    return None


def read_reply_text(raw: str | None) -> tuple[bool, str | None, int, bool, bool, str | None]:
    s = strip_fence(raw or "")
    if not s:
        return False, None, 0, False, False, "empty"
    got = read_json(s)
    if isinstance(got, dict) and isinstance(got.get("text"), str) and got["text"].strip():
        changes = got.get("changes")
        return True, got["text"], len(changes) if isinstance(changes, list) else 0, False, False, None
    if s[0] in "{[" or _ENVELOPE_KEYS.search(s):
        # lift the value by hand, as far as it goes
        if m := _TEXT_KEY.search(s):
            body = re.match(r'(?:\\.|[^"\\])*', s[m.end() :], re.S)[0]
            text = re.sub(r"\\(.)", lambda c: {"n": "\n", "t": "\t"}.get(c[1], c[1]), body, flags=re.S)
            if text.strip():
                return True, text, 0, True, False, None
        return False, None, 0, False, False, "unreadable JSON"
    return True, s, 0, False, True, None


read_reply = F.udf(read_reply_text, REPLY, useArrow=True)


def looks_like_envelope(c: Column) -> Column:
    t = T.trim(F.coalesce(c, F.lit("")))
    return t.rlike(r"^[{\[]") | t.rlike(rf'"{T.WS}*changes{T.WS}*"{T.WS}*:{T.WS}*\[') | t.startswith("```")


def dig(c: Column, path: str) -> Column:
    """The value at a dotted path with array indices, as text."""
    return F.get_json_object(c, _steps(path))


def _steps(path: str) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))


def score_at(c: Column, path: str, percent: bool = False) -> Column:
    """A detector's number at a path, in percent to one decimal; null where there is no JSON number (a quoted one is none)."""
    found = F.try_variant_get(F.try_parse_json(c), _steps(path), "variant")
    number = F.schema_of_variant(found).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    n = F.when(number, F.try_variant_get(found, "$", "double"))
    return T.rounded(n if percent else n * 100, 1)


def failure_kind(status: Column, blocked: Column) -> Column:
    """Why a call failed: rejected, quota, http, blocked or unknown."""
    return (
        F.when(status.isin(401, 403), F.lit("rejected"))
        .when(status.isin(429, 503, 529), F.lit("quota"))
        .when(F.coalesce(status, F.lit(0)) != 0, F.lit("http"))
        .when(blocked, F.lit("blocked"))
        .otherwise(F.lit("unknown"))
    )


_PARTS = js(r"(?<=[.!?।॥\n])\s+")


def chunk_text(text: str | None, limit: int = 450) -> list[str]:
    """Pieces that end at sentences, greedily joined up to so many UTF-8 bytes."""
    out, cur = [], ""
    for part in _PARTS.split(text or ""):
        if cur and len(f"{cur} {part}".encode()) > limit:
            out.append(cur)
            cur = part
        else:
            cur = f"{cur} {part}" if cur else part
    return out + [cur] * bool(cur)


chunks = F.udf(chunk_text, TEXTS, useArrow=True)

# Fixed values. Backends: id, kind, needs a key, local, translates only.
BACKENDS = [
    ("rules", "none", False, False, False),
    ("gemini", "gemini", True, False, False),
    ("anthropic", "anthropic", True, False, False),
    ("openai", "openai", True, False, False),
    ("groq", "openai", True, False, False),
    ("openrouter", "openai", True, False, False),
    ("together", "openai", True, False, False),
    ("deepseek", "openai", True, False, False),
    ("mistral", "openai", True, False, False),
    ("ollama", "openai", False, True, False),
    ("lmstudio", "openai", False, True, False),
    ("mymemory", "mymemory", False, False, True),
]


def backends(spark, keys: list[str] = ()):
    """The registry with its usability: ready, no key needed, local, or needs a key."""
    rows = [(i, kind, need, local, only, "needs key" if need and i not in keys else "ready" if need else "local — must be running" if local else "no key needed") for i, kind, need, local, only in BACKENDS]
    return spark.createDataFrame(rows, "id string, kind string, needs_key boolean, local boolean, translate_only boolean, status string")
