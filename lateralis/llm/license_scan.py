"""License scan: ordered signature rules over whole texts.

A rule is a regex over ASCII-lower-cased text, a label, a priority and a confidence. Before it is
tried, words must occur that each of its matches has; those of a name are read off its regex. Rules are
written out from a table of licenses and a table of phrasings, from their short identifiers and the phrasings in which
those name a license, and from a table of license texts. Overlapping detections are resolved in the order of priority,
length, place and rule: one that lies within an accepted interval is suppressed. Four base phrases are matched as word sequences,
whatever stands between the words, and are never suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lateralis.llm.shared import documents_of, smaller_batches
from lateralis.llm.wordhash import IS_WORD, LOWER, blocks, buffers, runs

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label, how the license is named (regex).
LICENSES = [
    ("gpl", r"(?:gnu )?general public licen[cs]e|gnu gpl|gpl"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e|lgpl"),
    ("agpl", r"(?:gnu )?affero general public licen[cs]e|agpl"),
    ("gfdl", r"(?:gnu )?free documentation licen[cs]e|gfdl"),
    ("apache", r"apache(?: software)? licen[cs]e"),
    ("mit", r"mit(?:/x11)? licen[cs]e|expat licen[cs]e"),
    ("x11", r"x11 licen[cs]e"),
    ("isc", r"isc licen[cs]e"),
    ("bsd-2-clause", r"(?:simplified|2-clause|two-clause|freebsd) bsd licen[cs]e|bsd-2-clause"),
    ("bsd-3-clause", r"(?:new|modified|revised|3-clause|three-clause) bsd licen[cs]e|bsd-3-clause"),
    ("bsd-4-clause", r"(?:original|4-clause|four-clause) bsd licen[cs]e|bsd-4-clause"),
    ("bsd", r"bsd(?:-style)? licen[cs]e"),
    ("mpl", r"mozilla public licen[cs]e|mpl"),
    ("epl", r"eclipse public licen[cs]e"),
    ("cddl", r"common development and distribution licen[cs]e|cddl"),
    ("cpl", r"common public licen[cs]e"),
    ("eupl", r"european union public licen[cs]e|eupl"),
    ("osl", r"open software licen[cs]e"),
    ("afl", r"academic free licen[cs]e"),
    ("artistic", r"artistic licen[cs]e"),
    ("zlib", r"zlib(?:/libpng)? licen[cs]e"),
    ("boost", r"boost software licen[cs]e"),
    ("unlicense", r"the unlicense|unlicense\.org"),
    ("wtfpl", r"wtfpl|do what the fuck you want to public licen[cs]e"),
    ("cc0", r"cc0|creative commons zero"),
    ("cc-by-nc-nd", r"cc[ -]by[ -]nc[ -]nd|attribution[ -]noncommercial[ -]noderiv\w*"),
    ("cc-by-nc-sa", r"cc[ -]by[ -]nc[ -]sa|attribution[ -]noncommercial[ -]sharealike"),
    ("cc-by-nc", r"cc[ -]by[ -]nc|attribution[ -]noncommercial"),
    ("cc-by-nd", r"cc[ -]by[ -]nd|attribution[ -]noderiv\w*"),
    ("cc-by-sa", r"cc[ -]by[ -]sa|attribution[ -]sharealike"),
    ("cc-by", r"cc[ -]by|creative commons attribution"),
    ("creative-commons", r"creative commons(?: licen[cs]e)?"),
    ("ofl", r"(?:sil )?open font licen[cs]e"),
    ("odbl", r"open database licen[cs]e|odbl"),
    ("python", r"python software foundation licen[cs]e|psf licen[cs]e"),
    ("php", r"php licen[cs]e"),
    ("ruby", r"ruby licen[cs]e"),
    ("openssl", r"openssl licen[cs]e"),
    ("postgresql", r"postgresql licen[cs]e"),
    ("ms-pl", r"microsoft public licen[cs]e|ms-pl"),
    ("rail", r"(?:open)?rail(?:-m)? licen[cs]e"),
]
#: name, regex around {name}, priority, confidence, a keyword besides the license's own.
PHRASINGS = [
    ("spdx", r"spdx-license-identifier\s*:\s*(?:{name})", 100, 0.99, "spdx"),
    ("licensed", r"licen[cs]ed\s+under\s+(?:the\s+|a\s+)?(?:terms\s+of\s+)?(?:the\s+)?(?:{name})", 90, 0.97, "licen"),
    ("released", r"(?:released|published|available)\s+under\s+(?:the\s+|a\s+)?(?:{name})", 88, 0.95, "under"),
    ("distributed", r"distributed\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?(?:{name})", 86, 0.95, "distributed"),
    ("terms", r"(?:subject\s+to|according\s+to|under)\s+the\s+terms\s+of\s+(?:the\s+)?(?:{name})", 84, 0.95, "terms"),
    ("published", r"(?:{name})\s+as\s+published\s+by", 82, 0.95, "published"),
    ("see", r"see\s+(?:the\s+)?(?:{name})", 70, 0.8, "see"),
    ("label", r"licen[cs]e\s*[:=]\s*[\"']?(?:the\s+)?(?:{name})", 80, 0.9, "licen"),
    ("bare", r"(?:{name})", 40, 0.6, ""),
]
#: label, its short identifiers (regex); they name a license only in the phrasings below, as many are words of their own.
IDENTIFIERS = [
    ("gpl", r"gpl"), ("lgpl", r"lgpl"), ("agpl", r"agpl"), ("gfdl", r"gfdl"), ("apache", r"apache"), ("mit", r"mit"), ("x11", r"x11"), ("isc", r"isc"),
    ("bsd-2-clause", r"bsd-2-clause"), ("bsd-3-clause", r"bsd-3-clause"), ("bsd-4-clause", r"bsd-4-clause"), ("bsd", r"bsd|0bsd"), ("mpl", r"mpl"),
    ("epl", r"epl"), ("cddl", r"cddl"), ("cpl", r"cpl"), ("eupl", r"eupl"), ("osl", r"osl"), ("afl", r"afl"), ("artistic", r"artistic"), ("zlib", r"zlib"),
    ("boost", r"bsl"), ("unlicense", r"unlicense"), ("wtfpl", r"wtfpl"), ("cc0", r"cc0"), ("cc-by-nc-nd", r"cc-by-nc-nd"), ("cc-by-nc-sa", r"cc-by-nc-sa"),
    ("cc-by-nc", r"cc-by-nc"), ("cc-by-nd", r"cc-by-nd"), ("cc-by-sa", r"cc-by-sa"), ("cc-by", r"cc-by"), ("ofl", r"ofl"), ("odbl", r"odbl"),
    ("python", r"psf"), ("openssl", r"openssl"), ("postgresql", r"postgresql"), ("ms-pl", r"ms-pl"),
]
#: As ``PHRASINGS``, around an identifier.
IDENTIFIED = [
    ("spdx", r"spdx-license-identifier\s*:\s*\(?(?:{name})", 100, 0.99, "spdx"),
    ("label", r"licen[cs]e\s*[:=]\s*[\"']?(?:the\s+)?(?:{name})", 79, 0.85, "licen"),
    ("licensed", r"licen[cs]ed\s+(?:under|as)\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?(?:{name})", 78, 0.85, "licen"),
    ("released", r"(?:released|distributed|available)\s+under\s+(?:the\s+)?(?:{name})", 77, 0.8, "under"),
    ("adjective", r"(?:{name})[\s-]+licen[cs]ed", 76, 0.8, "licen"),
    ("versioned", r"(?:{name})(?=-v?[0-9]\.[0-9])", 60, 0.8, "-"),
]
VERSION = r"(?:(?:\s*,?\s*\(?(?:version\s+|v\.?\s*)?|-v?)(?P<version>[0-9](?:\.[0-9]+)*)\b)?"
#: label, regex, keywords, priority, confidence: notices that name no license.
NOTICES = [
    ("all-rights-reserved", r"all\s+rights\s+reserved", ("rights",), 60, 0.9),
    ("copyright-notice", r"copyright\s+(?:\(c\)|©|[0-9]{4})[^\n]{0,80}", ("copyright",), 30, 0.5),
    ("public-domain", r"(?:in|into|to)\s+the\s+public\s+domain", ("public", "domain"), 60, 0.85),
    ("no-warranty", r"without\s+warranty\s+of\s+any\s+kind", ("warranty",), 20, 0.4),
    ("confidential", r"confidential\s+and\s+proprietary", ("proprietary",), 65, 0.9),
]
#: label, how the text of the license (or its notice) runs; anything but letters and digits may stand between words.
BODIES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify"),
    ("lgpl", "this library is free software you can redistribute it and or modify"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("zlib", "altered source versions must be plainly marked as such"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


@dataclass(frozen=True)
class Rule:
    """``names``: sets of keywords; whatever ``pattern`` matches has all ``keywords`` and all of one set."""

    label: str
    pattern: re.Pattern
    keywords: tuple[bytes, ...]
    names: tuple[tuple[bytes, ...], ...]
    priority: int
    confidence: float


class Present(dict):
    """Whether a keyword, or one of several sets of keywords, occurs in a text; found out once."""

    def __init__(self, low: bytes):
        self.low = low

    def __missing__(self, key: bytes | tuple) -> bool:
        self[key] = key in self.low if isinstance(key, bytes) else any(all(self[k] for k in each) for each in key)
        return self[key]


def words_in(name: str) -> tuple[tuple[bytes, ...], ...]:
    """Of each alternative of a name the literals that no match is without: what stands in no group and no class."""
    while (bare := re.sub(r"\(\?:[^()]*\)\??", " ", name)) != name:
        name = bare
    found = []
    for alternative in name.split("|"):
        literals = re.sub(r"\[[^]]*\]|\\w\*", " ", alternative).replace("\\.", ".").split()
        found.append(tuple(k.encode() for k in sorted({x for x in literals if len(x) > 1}, key=lambda x: (-len(x), x))))
    return tuple(found)


def rules() -> list[Rule]:
    """All rules, highest priority first; of equal priority, in the order of the tables."""
    out = []
    named = [(how, who) for hows, names in ((PHRASINGS, LICENSES), (IDENTIFIED, IDENTIFIERS)) for how in hows for who in names]
    for (_, phrase, priority, confidence, keyword), (label, name) in named:
        spaced = name.replace("[ -]", r"(?:\s+|-)").replace(" ", r"\s+")
        regex = r"(?<![a-z0-9])" + phrase.replace("{name}", spaced) + r"(?![a-z0-9])" + VERSION
        keywords = (keyword.encode(),) if keyword else ()
        out.append(Rule(label, re.compile(regex.encode()), keywords, words_in(name), priority, confidence))
    for label, regex, keywords, priority, confidence in NOTICES:
        out.append(Rule(label, re.compile(regex.encode()), tuple(k.encode() for k in keywords), ((),), priority, confidence))
    for label, body in BODIES:
        words = sorted(set(body.split()), key=lambda x: (-len(x), x))
        regex = r"(?<![a-z0-9])" + r"[^a-z0-9]+".join(body.split()) + r"(?![a-z0-9])"
        out.append(Rule(label, re.compile(regex.encode()), tuple(k.encode() for k in words), ((),), 85, 0.95))
    return sorted(out, key=lambda r: -r.priority)


def base_patterns() -> list[tuple[str, tuple[bytes, ...], re.Pattern]]:
    gap, inside = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
    out = []
    for phrase, label in BASE.items():
        words = phrase.encode().split()
        out.append((label, tuple(words), re.compile(rb"(?<!" + inside + rb")" + gap.join(words) + rb"(?!" + inside + rb")")))
    return out


def detections(low: bytes, ordered: list[Rule]) -> list[tuple[int, int, str, int, float]]:
    """(start, end, label, priority, confidence) in bytes, overlaps resolved."""
    present = Present(low)
    found = []
    for rule in ordered:
        if present[rule.names] and all(present[k] for k in rule.keywords):
            for m in rule.pattern.finditer(low):
                version = m.groupdict().get("version")
                label = rule.label + (f"-{version.decode()}" if version else "")
                found.append((m.start(), m.end(), label, rule.priority, rule.confidence))
    kept: list[tuple[int, int, str, int, float]] = []
    starts: list[int] = []  # of the accepted intervals that lie in no other; their ends ascend too
    ends: list[int] = []
    for d in sorted(found, key=lambda d: (-d[3], d[0] - d[1], d[0])):
        at = bisect_right(starts, d[0])
        if at and ends[at - 1] >= d[1]:
            continue
        kept.append(d)
        first, last = bisect_left(starts, d[0]), bisect_right(ends, d[1])
        starts[first:max(first, last)], ends[first:max(first, last)] = [d[0]], [d[1]]
    return sorted(kept)


RESULT_TYPE = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "labels array<string>, detections array<struct<start:long,end:long,label:string,priority:int>>, score double"
)
RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
    ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())),
    ("detections", pa.list_(pa.struct([
        ("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))),
    ("score", pa.float64()),
])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document, ``RESULT_TYPE``: words, base phrases, all labels, detections in bytes, score.

    The score is one minus the product of (1 - confidence) over base places (0.9 each, label by label)
    and kept detections. Null texts are empty; repeated documents each get their row; other columns
    are ignored; an empty table gives no rows.
    """
    smaller_batches(docs.sparkSession)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered, base = rules(), base_patterns()
        for batch in blocks(batches):
            data, offsets = buffers(batch.column(1))
            low = LOWER[data]
            starts, _, ptr = runs(IS_WORD[low], offsets)
            rows = []
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                whole = low[offsets[i]:offsets[i + 1]].tobytes()
                places, labels = [], []
                for label, keywords, pattern in base:
                    if all(k in whole for k in keywords):
                        at = [offsets[i] + m.start() for m in pattern.finditer(whole)]
                        places += (np.searchsorted(starts, at) - ptr[i]).tolist()
                        labels += [label] if at else []
                kept = detections(whole, ordered)
                doubt = float(np.prod([0.1] * len(labels) + [1 - d[4] for d in kept]))
                rows.append({
                    "doc_id": doc_id, "n_words": int(ptr[i + 1] - ptr[i]), "n_base": len(places),
                    "first_word": min(places, default=None), "last_word": max(places, default=None),
                    "base_labels": sorted(labels), "labels": sorted({*labels, *(d[2] for d in kept)}),
                    "detections": [{"start": d[0], "end": d[1], "label": d[2], "priority": d[3]} for d in kept],
                    "score": 1 - doubt,
                })
            yield pa.RecordBatch.from_pylist(rows, RESULT)

    return documents_of(docs, key, text).mapInArrow(scanned, RESULT_TYPE)
