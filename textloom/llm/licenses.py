"""Licence scan by sentence rules.

A text is cut into sentences.  A sentence, normalised, that a map holds as a known licence
sentence gets its identifier, and one that names a licence gets it by a pattern; so does
each run of whole lines in a sentence, since headings, comments and lists often lack a
full stop.  Identifier
sequences are then matched, left to right and longest rule first, against rules that
list identifiers in order.  Sentences without a rule are reported as such.

Works on each text alone: no shuffle.  Null and empty texts have status ``none``.  Very
long texts are scanned whole, in time that grows with their length: each line is looked
at with at most ``LONGEST`` characters after it.  Repeated rows and ids each get a row,
and an empty table gives none.  Only id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, clean, rows_of, to_batch

# What may precede "licensed under": a subject, unless it denies or conditions.
_SUBJECT = r"(?:(?!(?:if|unless|until|when|whether|no|none|not|nothing|neither|never|nor)\b)(?:(?!\b(?:not|no|if|unless)\b)[^.!?;:])+? (?:is|are) (?:also )?)?"
# Wording of public licences, normalised; patterns of statements that name one.
SENTENCES: list[tuple[str, str]] = [
    ("spdx", r"spdx-license-identifier: ?(?P<name>[\w.+-]+)"),
    ("named-mit", _SUBJECT + r"(?:licensed|released|distributed|available) under the (?:terms of the )?(?:mit|expat)(?: license)?"),
    ("named-apache", _SUBJECT + r"(?:licensed|released|distributed|available) under the (?:terms of the )?apache(?: software)? license,? (?:version |v)?(?P<name>\d(?:\.\d)?)(?: \(the \"license\"\))?"),
    ("named-gpl", _SUBJECT + r"(?:licensed|released|distributed|available) under the (?:terms of the )?(?:gnu )?(?P<kind>lesser |affero )?(?:general public license|gpl),? (?:version |v)?(?P<name>\d(?:\.\d)?)(?P<later>,? or \(?at your option\)? any later version| or later)?"),
    ("named-cc", _SUBJECT + r"(?:licensed|released|distributed|available) under (?:a |the )?(?:cc|creative commons)[ -](?P<name>(?:by|zero|0)(?:-(?:nc|sa|nd))*)[ -](?P<version>\d\.\d)(?: international)?(?: license)?"),
    ("named-cc0", _SUBJECT + r"(?:licensed|released|dedicated|available) (?:under|to the public domain under) cc0(?:[ -]1\.0)?"),
    ("named-bsd", _SUBJECT + r"(?:licensed|released|distributed|available) under the (?:terms of the )?(?P<name>[23])-clause bsd license"),
    ("named-mpl", r"(?:this source code form is subject to|" + _SUBJECT + r"(?:licensed|released|distributed|available) under) the (?:terms of the )?mozilla public license,? (?:version |v\. ?|v)?(?P<name>\d\.\d)"),
    ("named-isc", _SUBJECT + r"(?:licensed|released|distributed|available) under the isc license"),
    ("named-unlicense", r"(?:this is free and unencumbered software released into the public domain|" + _SUBJECT + r"released under the unlicense)"),
    ("mit-grant", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the \"software\"\), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-warranty", r"the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("mit-liability", r"in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"),
    ("bsd-grant", r"redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-endorse", r"neither the name of .+? nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-warranty", r"this software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc-grant", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-warranty", r"the software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("apache-use", r"you may not use this file except in compliance with the license"),
    ("apache-copy", r"you may obtain a copy of the license at"),
    ("apache-url", r"(?:you may obtain a copy of the license at )?https?://www\.apache\.org/licenses/license-2\.0(?:\.txt)?"),
    ("apache-unless", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied"),
    ("apache-see", r"see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-free", r"this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version (?P<name>\d) of the license, or \(at your option\) any later version"),
    ("gpl-hope", r"this program is distributed in the hope that it will be useful, but without any warranty"),
    ("copyright", r"(?:copyright|©)(?: \(c\)| ©)?.*"),
]
# Ordered sentence identifiers of each licence; names in braces come from the sentences.
RULES: list[tuple[tuple[str, ...], str]] = [
    (("mit-grant", "mit-notice", "mit-warranty", "mit-liability"), "MIT"),
    (("mit-grant", "mit-notice", "mit-warranty"), "MIT"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"), "BSD-2-Clause"),
    (("isc-grant", "isc-warranty"), "ISC"),
    (("named-apache", "apache-use", "apache-copy", "apache-url", "apache-unless", "apache-see"), "Apache-{name}"),
    (("named-apache", "apache-use", "apache-url", "apache-unless", "apache-see"), "Apache-{name}"),
    (("named-apache", "apache-use", "apache-copy", "apache-url"), "Apache-{name}"),
    (("named-apache", "apache-use", "apache-url"), "Apache-{name}"),
    (("gpl-free", "gpl-hope"), "GPL-{name}.0-or-later"),
    (("gpl-free",), "GPL-{name}.0-or-later"),
    (("spdx",), "{name}"),
    (("named-mit",), "MIT"),
    (("named-apache",), "Apache-{name}"),
    (("named-gpl",), "{kind}GPL-{name}{later}"),
    (("named-cc",), "CC-{name}-{version}"),
    (("named-cc0",), "CC0-1.0"),
    (("named-bsd",), "BSD-{name}-Clause"),
    (("named-mpl",), "MPL-{name}"),
    (("named-isc",), "ISC"),
    (("named-unlicense",), "Unlicense"),
]

def _plain(pattern: str) -> str | None:
    """The sentence that a pattern stands for, if it is one without alternatives."""
    bare = re.sub(r"\\([()\".])", "", pattern)
    return None if re.search(r"[\\()\[\]|*+?.{}^$]", bare) else re.sub(r"\\(.)", r"\1", pattern)


#: Known sentences by their normalised text, and patterns of those that hold names or have several forms.
EXACT = {text: key for key, pattern in SENTENCES if (text := _plain(pattern))}
_NAMED = [(key, re.compile(pattern)) for key, pattern in SENTENCES if _plain(pattern) is None and key != "copyright"]
_COPYRIGHT = next(re.compile(pattern) for key, pattern in SENTENCES if key == "copyright")
_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[0]))
_TRIGGER = re.compile(r"licen[sc]e|copyright|©|spdx|redistribut|permission|public domain|warrant|unencumbered", re.I)
#: A statement reaches over lines of so many characters together when normalised, or is one line of any length.
LONGEST = 2000
_END = re.compile(r"(?:[.!?;]|(?<!dentifier):)(?=[\s\"')]|$)|\n[\s#*/;%|]*\n")
_LEAD = re.compile(r"^(?:\s*<!--)?[\s#*/;%>|+-]*(?:\(?(?:\d{1,2}|[a-z])[.)]\s+)?[\s*-]*")
# How known sentences begin.
_OPENING = re.compile(
    r"spdx-|permission |the (?:above|software) |in no event|redistribution|neither the|this (?:software|program|source|is free)|you may|https?:|unless required|see the|copyright|©"
    r"|.*?(?:licensed|released|distributed|available|dedicated) (?:under|to) "
)
_TAIL = re.compile(r"\s*(?:\*+/|-->)\s*$")
_SPACE = re.compile(r"\s+(?:[#*/;%>|]+\s+)?")


def normalise_sentence(sentence: str) -> str:
    """Lower case, one space between words, straight quotes, no comment signs or final marks."""
    s = sentence.lower().replace("“", '"').replace("”", '"').replace("licence", "license").replace("``", '"').replace("''", '"')
    return _SPACE.sub(" ", _LEAD.sub("", _TAIL.sub("", s))).strip(" .!?:;")


def _recognised(run: str, ends: list[int]) -> tuple[int, str, dict[str, str]] | None:
    """The longest known sentence from the run's start to one of its lines' ends: which end, identifier, names."""
    for k in range(len(ends) - 1, -1, -1):
        if (key := EXACT.get(run[: ends[k]])) is not None:
            return k, key, {}
    best = None
    for key, pattern in _NAMED:
        m = pattern.match(run)
        if m is None:
            continue
        for k in range(len(ends) - 1, -1, -1):
            if best and k <= best[0]:
                break
            if ends[k] <= m.end() and (found := m if ends[k] == m.end() else pattern.fullmatch(run, 0, ends[k])):
                best = k, key, {name: v or "" for name, v in found.groupdict().items()}
                break
    if best is None and _COPYRIGHT.match(run):
        return 0, "copyright", {}  # takes any wording, so it ends with its line
    return best


def sentences(text: str) -> Iterator[tuple[int, str]]:
    """Offset and text of each sentence: up to a mark before white space, or a blank line."""
    start = 0
    for m in _END.finditer(text):
        if text[start : m.end()].strip():
            yield start, text[start : m.end()]
        start = m.end()
    if text[start:].strip():
        yield start, text[start:]


def _statements(sentence: str) -> Iterator[tuple[int, tuple[str, dict[str, str]]]]:
    """Known statements in runs of a sentence's lines, left to right and longest first; each line is normalised once."""
    edges = [0, *(m.end() for m in re.finditer(r"\n", sentence)), len(sentence)]
    lines = [normalise_sentence(sentence[a:b]) for a, b in zip(edges, edges[1:])]
    i = 0
    while i < len(lines):
        if not lines[i]:
            i += 1
            continue
        run, ends = lines[i], [len(lines[i])]
        for j in range(i + 1, len(lines)):
            if len(run) + len(lines[j]) > LONGEST:
                break
            run = f"{run} {lines[j]}" if lines[j] else run
            ends.append(len(run))
        found = _recognised(run, ends) if _OPENING.match(run) else None
        if found is None:
            i += 1
            continue
        k, key, names = found
        if key == "spdx":  # identifiers keep their case
            names = {"name": re.search(r"(?i)identifier:\s*([\w.+-]+)", sentence[edges[i] :])[1].rstrip(".")}
        yield edges[i], (key, names)
        i += k + 1


def identify(text: str) -> list[tuple[int, str, dict[str, str]]]:
    """Known sentences in order; others near licence words as ``unknown``."""
    out: list[tuple[int, str, dict[str, str]]] = []
    for at, sentence in sentences(text):
        if not _TRIGGER.search(sentence) and not re.search(r"(?i)compliance|hope that|liable", sentence):
            continue
        hits = list(_statements(sentence))
        out += [(at + i, *found) for i, found in hits] or [(at, "unknown", {})]
    return out


def _name(pattern: str, values: dict[str, str]) -> str:
    kind = {"lesser": "L", "affero": "A"}.get(values.get("kind", "").strip(), "")
    later = ("-or-later" if values.get("later") else "-only") if "later" in values else ""
    name = values.get("name", "").upper() if "version" in values else values.get("name", "")
    if pattern.startswith("{kind}") and "." not in name:
        name += ".0"
    if pattern.startswith("Apache") and "." not in name:
        name += ".0"
    return pattern.format(kind=kind, name=name, version=values.get("version", ""), later=later)


def match_rules(found: list[tuple[int, str, dict[str, str]]]) -> tuple[list[str], int]:
    """Licences in order of appearance, and known sentences outside any rule (copyright lines aside)."""
    keys = [k for _, k, _ in found if k != "copyright"]
    values = [v for _, k, v in found if k != "copyright"]
    out, loose, i = [], 0, 0
    while i < len(keys):
        for ids, name in _BY_LENGTH:
            if tuple(keys[i : i + len(ids)]) == ids:
                merged: dict[str, str] = {}
                for v in values[i : i + len(ids)]:
                    merged |= v
                if (licence := _name(name, merged)) not in out:
                    out.append(licence)
                i += len(ids)
                break
        else:
            loose += keys[i] != "unknown"
            i += 1
    return out, loose


_ROW = pa.schema([("id", pa.int64()), ("licenses", pa.string()), ("identifiers", pa.string()), ("n_sentences", pa.int64()), ("status", pa.string())])


def scan_text(text: str | None) -> tuple[str, str, int, str]:
    """Licences (joined by semicolons), identifier sequence, known sentences, status: rule, partial, unknown or none."""
    if not text or not _TRIGGER.search(text):
        return "", "", 0, "none"
    found = identify(text)
    names, loose = match_rules(found)
    known = [k for _, k, _ in found if k != "unknown"]
    status = "rule" if names else "partial" if loose else "unknown" if found else "none"
    return ";".join(names), " ".join(k for _, k, _ in found), len(known), status


def scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, licenses, identifiers, n_sentences, status."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = rows_of(batch, "id", "text")
            yield to_batch(_ROW, [ids, *zip(*map(scan_text, texts))] if ids else [[]] * len(_ROW))

    bounded_batches(spark)
    return clean(docs, id=id_col, text=text_col).mapInArrow(run, "id long, licenses string, identifiers string, n_sentences long, status string").withColumnRenamed("id", id_col)
