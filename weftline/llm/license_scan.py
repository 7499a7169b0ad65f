"""Operator 9: license scans by ordered signature rules.

A rule is a regular expression with a label, a priority and a keyword. A text's keywords, found by one pass of an
Aho-Corasick automaton, say which rules may match at all. Of overlapping detections, one that lies inside another of no
lower priority goes.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import ALNUM, LOWER, map_texts

#: Base phrases and their labels. Fixed values.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: str  # or several, with | between them, of which each text that the pattern matches holds one
    priority: int
    weight: float


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    label: str
    priority: int
    weight: float


#: Families: label; SPDX identifiers; name as a pattern; keyword of the name; words of the grant text as a pattern, or none; address, or none.
FAMILIES: tuple[tuple[str, tuple[str, ...], str, str, str | None, str | None], ...] = (
    ("mit", ("MIT", "MIT-0", "X11", "MIT-CMU"), r"(?:mit|x11|expat) licen[cs]e", "licen", r"permission is hereby granted,? free of charge,? to any person obtaining a copy", r"opensource\.org/licenses/mit"),
    ("apache", ("Apache-2.0", "Apache-1.1", "Apache-1.0"), r"apache (?:software )?licen[cs]e", "apache", r"licensed under the apache licen[cs]e,? version \d(?:\.\d)?", r"apache\.org/licenses"),
    ("gpl", ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-1.0-only"), r"(?<!lesser\s)(?<!affero\s)general public licen[cs]e", "general public", r"under the terms of the gnu general public licen[cs]e", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("lgpl", ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-2.0-only"), r"(?:lesser|library) general public licen[cs]e", "general public", r"under the terms of the gnu (?:lesser|library) general public licen[cs]e", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("agpl", ("AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL-1.0-only"), r"affero general public licen[cs]e", "affero", r"under the terms of the gnu affero general public licen[cs]e", r"gnu\.org/licenses/agpl"),
    ("bsd-3-clause", ("BSD-3-Clause", "BSD-3-Clause-Clear", "BSD-3-Clause-LBNL"), r"(?:new|modified|3[- ]clause) bsd licen[cs]e", "bsd", r"neither the name of .{1,80}? nor the names of its contributors", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-2-clause", ("BSD-2-Clause", "BSD-2-Clause-Patent", "BSD-2-Clause-Views"), r"(?:simplified|freebsd|2[- ]clause) (?:bsd )?licen[cs]e", "licen", r"redistribution and use in source and binary forms,? with or without modification", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd", ("BSD-4-Clause", "BSD-1-Clause", "0BSD"), r"bsd(?:[- ]style)? licen[cs]e", "bsd", None, None),
    ("mpl", ("MPL-1.0", "MPL-1.1", "MPL-2.0"), r"mozilla public licen[cs]e", "mozilla", r"subject to the terms of the mozilla public licen[cs]e", r"mozilla\.org/mpl"),
    ("epl", ("EPL-1.0", "EPL-2.0"), r"eclipse public licen[cs]e", "eclipse", r"made available under the terms of the eclipse public licen[cs]e", r"eclipse\.org/legal/epl"),
    ("edl", ("EDL-1.0",), r"eclipse distribution licen[cs]e", "eclipse", None, r"eclipse\.org/org/documents/edl"),
    ("cddl", ("CDDL-1.0", "CDDL-1.1"), r"common development and distribution licen[cs]e", "common development", None, r"opensource\.org/licenses/cddl"),
    ("cpl", ("CPL-1.0",), r"common public licen[cs]e", "common public", None, r"opensource\.org/licenses/cpl"),
    ("isc", ("ISC",), r"isc licen[cs]e", "isc", r"permission to use,? copy,? modify,? and/or distribute this software for any purpose", r"opensource\.org/licenses/isc"),
    ("unlicense", ("Unlicense",), r"the unlicense", "unlicense", r"free and unencumbered software released into the public domain", r"unlicense\.org"),
    ("wtfpl", ("WTFPL",), r"do what the f\w+ you want to public licen[cs]e", "do what the", None, r"wtfpl\.net"),
    ("zlib", ("Zlib", "zlib-acknowledgement"), r"zlib(?:/libpng)? licen[cs]e", "zlib", r"this software is provided 'as-is',? without any express or implied warranty", r"zlib\.net/zlib_license"),
    ("boost", ("BSL-1.0",), r"boost software licen[cs]e", "boost", r"distributed under the boost software licen[cs]e", r"boost\.org/license_1_0"),
    ("artistic", ("Artistic-1.0", "Artistic-2.0"), r"artistic licen[cs]e", "artistic", None, r"opensource\.org/licenses/artistic"),
    ("python", ("Python-2.0", "PSF-2.0"), r"(?:python software foundation|psf) licen[cs]e", "licen", None, r"docs\.python\.org/\d/license"),
    ("ruby", ("Ruby",), r"ruby licen[cs]e", "ruby", None, None),
    ("php", ("PHP-3.0", "PHP-3.01"), r"php licen[cs]e", "php", None, r"php\.net/license"),
    ("postgresql", ("PostgreSQL",), r"postgresql licen[cs]e", "postgresql", None, r"opensource\.org/licenses/postgresql"),
    ("openssl", ("OpenSSL",), r"openssl licen[cs]e", "openssl", None, r"openssl\.org/source/license"),
    ("ofl", ("OFL-1.0", "OFL-1.1"), r"(?:sil )?open font licen[cs]e", "open font", None, r"scripts\.sil\.org/ofl"),
    ("eupl", ("EUPL-1.1", "EUPL-1.2"), r"european union public licen[cs]e", "european union", None, r"eupl\.eu"),
    ("osl", ("OSL-2.1", "OSL-3.0"), r"open software licen[cs]e", "open software", None, r"opensource\.org/licenses/osl"),
    ("afl", ("AFL-2.1", "AFL-3.0"), r"academic free licen[cs]e", "academic free", None, r"opensource\.org/licenses/afl"),
    ("ncsa", ("NCSA",), r"university of illinois/ncsa open source licen[cs]e", "ncsa", None, r"opensource\.org/licenses/ncsa"),
    ("upl", ("UPL-1.0",), r"universal permissive licen[cs]e", "universal permissive", None, r"opensource\.org/licenses/upl"),
    ("ms-pl", ("MS-PL",), r"microsoft public licen[cs]e", "microsoft", None, r"opensource\.org/licenses/ms-pl"),
    ("ms-rl", ("MS-RL",), r"microsoft reciprocal licen[cs]e", "microsoft", None, r"opensource\.org/licenses/ms-rl"),
    ("mulan", ("MulanPSL-2.0",), r"mulan permissive software licen[cs]e", "mulan", None, r"license\.coscl\.org\.cn"),
    ("ecl", ("ECL-2.0",), r"educational community licen[cs]e", "educational community", None, None),
    ("sspl", ("SSPL-1.0",), r"server side public licen[cs]e", "server side", None, r"mongodb\.com/licensing/server-side"),
    ("busl", ("BUSL-1.1",), r"business source licen[cs]e", "business source", None, r"mariadb\.com/bsl"),
    ("elastic", ("Elastic-2.0",), r"elastic licen[cs]e", "elastic", None, r"elastic\.co/licensing"),
    ("cc0", ("CC0-1.0",), r"cc0|creative commons zero", "cc0|creative commons", r"no rights reserved", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by", ("CC-BY-1.0", "CC-BY-2.0", "CC-BY-2.5", "CC-BY-3.0", "CC-BY-4.0"), r"(?:cc[- ]by|creative commons attribution)(?: licen[cs]e)?(?![- ](?:sa|nc|nd|share|non|no))", "cc by|cc-by|creative commons", None, r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", ("CC-BY-SA-2.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0"), r"cc[- ]by[- ]sa|creative commons attribution[- ]share[- ]?alike", "cc by|cc-by|creative commons", None, r"creativecommons\.org/licenses/by-sa/"),
    ("cc-by-nc", ("CC-BY-NC-2.0", "CC-BY-NC-3.0", "CC-BY-NC-4.0"), r"cc[- ]by[- ]nc(?![- ](?:sa|nd))|creative commons attribution[- ]non[- ]?commercial", "cc by|cc-by|creative commons", None, r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd", ("CC-BY-ND-3.0", "CC-BY-ND-4.0"), r"cc[- ]by[- ]nd|creative commons attribution[- ]no[- ]?deriv", "cc by|cc-by|creative commons", None, r"creativecommons\.org/licenses/by-nd/"),
    ("cc-by-nc-sa", ("CC-BY-NC-SA-3.0", "CC-BY-NC-SA-4.0"), r"cc[- ]by[- ]nc[- ]sa", "cc by|cc-by|creative commons", None, r"creativecommons\.org/licenses/by-nc-sa/"),
    ("cc-by-nc-nd", ("CC-BY-NC-ND-3.0", "CC-BY-NC-ND-4.0"), r"cc[- ]by[- ]nc[- ]nd", "cc by|cc-by|creative commons", None, r"creativecommons\.org/licenses/by-nc-nd/"),
    ("gfdl", ("GFDL-1.2-only", "GFDL-1.3-only"), r"gnu free documentation licen[cs]e", "free documentation", None, r"gnu\.org/licenses/fdl"),
    ("odbl", ("ODbL-1.0",), r"open (?:data commons )?(?:open )?database licen[cs]e", "database", None, r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", ("ODC-By-1.0",), r"open data commons attribution licen[cs]e", "open data commons", None, r"opendatacommons\.org/licenses/by"),
    ("pddl", ("PDDL-1.0",), r"public domain dedication and licen[cs]e", "public domain", None, r"opendatacommons\.org/licenses/pddl"),
    ("public-domain", (), r"(?:in|into|to) the public domain", "public domain", None, None),
    ("proprietary", (), r"all rights reserved", "all rights", r"proprietary and confidential", None),
)
#: Kinds of a family's rules: priority and weight of each.
KINDS = {"spdx": (50, 1.0), "grant": (40, 0.95), "address": (30, 0.9), "version": (20, 0.85), "name": (10, 0.7)}


def rules() -> list[Rule]:
    """The rules of all families, in the order of priority: an identifier's tag, words of a grant, an address, a name with a version, a name."""
    out = []
    for label, tags, name, keyword, grant, address in FAMILIES:
        add = lambda kind, pattern, key: out.append(Rule(label, pattern, key, *KINDS[kind]))  # noqa: B023, E731
        for tag in tags:
            add("spdx", rf"spdx-license-identifier:\s*\(?{re.escape(tag.lower())}(?![\w.-])", "spdx")
            # a later identifier of a compound expression stands where it is named
            add("spdx", rf"spdx-license-identifier:\s*(?:[\w.+()-]+\s+(?:or|and|with)\s+)+\(?(?P<at>{re.escape(tag.lower())})(?![\w.-])", "spdx")
            add("spdx", rf"[\"']?licen[cs]e[\"']?\s*[:=]\s*[\"']{re.escape(tag.lower())}[\"']", "licen")
        if grant:
            add("grant", grant, grant_key(grant))
        if address:
            add("address", rf"https?://(?:www\.)?{address}", "://")
        add("version", rf"(?:{name}),?\s*\(?(?:v(?:ersion)?\.?\s*)?\d(?:\.\d+)*", keyword)
        add("name", rf"\b(?:{name})\b", keyword)
    return sorted(out, key=lambda r: -r.priority)


def grant_key(pattern: str) -> str:
    """The longest run of plain letters and spaces in a pattern."""
    plain = re.sub(r"\(\?.*?\)|\[.*?\]|.[?*+]|\\.|\.\{.*?\}\??", "\0", pattern)
    return max(re.split(r"[^a-z ]", plain), key=len).strip()


def blanks(pattern: str) -> str:
    """A rule's pattern with any white space for a blank, which in a class is one of its choices."""
    return pattern.replace("[- ]", r"(?:-|\s+)").replace(" ", r"\s+")


@lru_cache(maxsize=1)
def _compiled() -> tuple[ahocorasick.Automaton, list[tuple[Rule, re.Pattern]], dict[str, list[int]]]:
    by_key: dict[str, list[int]] = {}
    made = [(r, re.compile(blanks(r.pattern))) for r in rules()]
    for i, (r, _) in enumerate(made):
        for key in r.keyword.split("|"):
            by_key.setdefault(key, []).append(i)
    auto = ahocorasick.Automaton()
    for k in by_key:
        auto.add_word(k, k)
    auto.make_automaton()
    return auto, made, by_key


def detect(lowered: str) -> list[Detection]:
    """Detections that stand, by place. lowered: the text with A-Z in lower case."""
    auto, made, by_key = _compiled()
    found: list[Detection] = []
    for i in {i for k in {k for _, k in auto.iter(" ".join(lowered.split()))} for i in by_key[k]}:
        r, rx = made[i]
        at = "at" if "at" in rx.groupindex else 0
        found += [Detection(m.start(at), m.end(at), r.label, r.priority, r.weight) for m in rx.finditer(lowered) if m.end(at) > m.start(at)]
    return suppress(found)


def suppress(found: list[Detection]) -> list[Detection]:
    """Leaves out each detection that lies inside another of higher priority, or of the same and longer, or the same place and earlier by label."""
    order = sorted(set(found), key=lambda d: (-d.priority, d.start - d.end, d.start, d.label))
    starts = sorted({d.start for d in order})
    furthest = [-1] * (len(starts) + 1)  # a Fenwick tree: the largest end of kept ones by their start
    kept: list[Detection] = []
    for d in order:
        place = bisect_left(starts, d.start) + 1
        i, end = place, -1
        while i:
            end, i = max(end, furthest[i]), i & (i - 1)
        if end >= d.end:
            continue
        kept.append(d)
        while place < len(furthest):
            furthest[place] = max(furthest[place], d.end)
            place += place & -place
    return sorted(kept, key=lambda d: (d.start, d.end, d.label))


def places(text: bytes, phrases: dict[str, str]) -> tuple[int, list[tuple[int, str]]]:
    """How many words a text has, and at which word which phrase's label stands, by place."""
    w = text.translate(ALNUM).split()
    flat = b" " + b" ".join(w) + b" "
    out = []
    for phrase, label in phrases.items():
        needle, at, last, n = f" {phrase} ".encode(), flat.find(f" {phrase} ".encode()), 0, 0
        while at >= 0:
            n += flat.count(b" ", last, at)
            out.append((n, label))
            last, at = at, flat.find(needle, at + 1)
    return len(w), sorted(out)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None) -> DataFrame:
    """For each text: id, n_words, n_base, first_word, last_word, base_labels and labels array<string>, detections array of (start, end, label, priority, weight) in characters, score.

    score: how sure it is that the text is under some licence, one less the product of what each standing detection and base
    place leaves in doubt. Null and empty texts have no words, labels or detections and score 0; repeated rows stay.
    """
    phrases = phrases or BASE

    def run(texts: list[bytes]) -> dict:
        rows = []
        for x in texts:
            n, base = places(x, phrases)
            stands = detect(x.translate(LOWER).decode("utf-8", "replace"))
            base_labels = {label for _, label in base}
            doubt = 0.5 ** len(base)
            for d in stands:
                doubt *= 1 - d.weight
            rows.append((n, len(base), base[0][0] if base else None, base[-1][0] if base else None, sorted(base_labels), sorted(base_labels | {d.label for d in stands}), [{"start": d.start, "end": d.end, "label": d.label, "priority": d.priority, "weight": d.weight} for d in stands], 1 - doubt))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32()), ("weight", pa.float64())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), span, pa.float64())
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "detections", "score")
        return {k: pa.array(c, t) for k, c, t in zip(names, zip(*rows), kinds)}

    return map_texts(docs, run, "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, detections array<struct<start:bigint,end:bigint,label:string,priority:int,weight:double>>, score double", {id_col: F.col(f"`{id_col}`")}, text_col)
