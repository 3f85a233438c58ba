"""Licence scans by sentence rules.

A text is cut into sentences; each is normalised (lower case, comment marks and punctuation dropped,
spelling variants unified) and matched against the known licence sentences, which gives identifiers
and sometimes a version. The sequence of a document's identifiers is then matched against ordered
rules: the first rule whose identifiers follow one another names a licence and uses them up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_only

#: Every text that a pattern of SENTENCES matches held one of these before it was normalised, as that joins no letters. Fixed values.
HINTS = ("licen", "copyright", "(c)", "©", "\x01", "spdx", "gpl", "bsd", "wtfpl", "cc", "creative", "domain", "reserved", "permission", "redistribut", "warrant", "advertis", "endorse", "released", "distributed", "available", "provided", "covered", "python")

#: Known sentences after normalisation: (identifier, pattern). The first that matches counts. No pattern has two open
#: repetitions that can be tried against each other, so that a sentence takes time in proportion to its length. Fixed values.
SENTENCES = [
    ("Spdx", r"spdx license identifier (?P<v>[a-z0-9 .+-]+)"),
    ("ApacheUnder", r"(?:.* )?(?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of the )?apache (?:software )?license(?: version)?(?: (?P<v>\d(?:\.\d)?))?(?: the license)?"),
    ("ApacheNotUse", r"you may not use this file except in compliance with the license"),
    ("ApacheCopy", r"you may obtain a copy of the license at"),
    ("ApacheAsIs", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("ApacheSee", r"see the license for the specific language governing permissions and limitations under the license"),
    ("LesserUnder", r".*(?:under|of|covered by) (?:the )?(?:terms of the )?(?:gnu )?(?:lesser|library) general public license(?: as published by the free software foundation)?(?: either)?(?: version)?(?: (?P<v>\d(?:\.\d)?))?(?P<later>.* any later version)?.*|.*\blgpl(?: ?v)?(?: version)? ?(?P<v2>\d(?:\.\d)?)?"),
    ("AfferoUnder", r".*(?:under|of) (?:the )?(?:terms of the )?(?:gnu )?affero general public license(?: version)?(?: (?P<v>\d(?:\.\d)?))?(?:(?P<later>.* any later version)|.*)|.*\bagpl(?: ?v)? ?(?P<v2>\d(?:\.\d)?)?"),
    ("GeneralUnder", r".*(?:under|of|covered by) (?:the )?(?:terms of the )?(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version)?(?: (?P<v>\d(?:\.\d)?))?(?P<later>.* any later version)?.*|.*(?:under|of) (?:the )?(?:gnu )?gpl(?: ?v)?(?: version)? ?(?P<v2>\d(?:\.\d)?)?|(?>.*?(?:under|of) (?:the )?(?:gnu )?gpl(?: ?v)?(?: version)? ?(?P<v3>\d(?:\.\d)?)?)(?P<later2>.* any later version)"),
    ("GnuHope", r"this program is distributed in the hope that it will be useful but without any warranty.*"),
    ("GnuReceived", r"you should have received a copy of the gnu (?:lesser |affero )?general public license.*"),
    ("MozillaUnder", r".*(?:under|of|to) the (?:terms of the )?mozilla public license(?: version)?(?: v ?\.)? ?(?P<v>\d(?:\.\d)?)?"),
    ("EclipseUnder", r".*under the (?:terms of the )?eclipse public license(?: version)?(?: v)? ?(?P<v>\d(?:\.\d)?)?.*"),
    ("MitUnder", r".*(?:under|of|uses|use) (?:the )?(?:terms of the )?(?:mit|expat|x11) license.*|mit license|the mit license(?: mit)?"),
    ("MitGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .*"),
    ("MitNotice", r"the above copyright notice and this permission notice .* shall be included in all copies or substantial portions of the software"),
    ("IscUnder", r".*under (?:the )?(?:terms of the )?isc license|isc license|the isc license"),
    ("IscGrant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted .*"),
    ("BsdUnder", r".*(?:under|of) (?:the |a )?(?:terms of the )?(?P<v>[234]|two|three|four|new|modified|simplified|revised)?(?: clause)? ?bsd(?: (?P<v2>[234]))?(?: clause)?(?: style)?(?: license)?|(?:the )?(?:new |simplified )?bsd (?P<v3>[234])? ?(?:clause )?license"),
    ("BsdGrant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*"),
    ("BsdSource", r"(?:\d )?redistributions of source code must retain the above copyright notice.*"),
    ("BsdBinary", r"(?:\d )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("BsdAds", r"(?:\d )?all advertising materials mentioning features or use of this software must display.*"),
    ("BsdEndorse", r"(?>(?:\d )?neither the names? of .*? nor the names of ).* may be used to endorse or promote products.*"),
    ("CcUnder", r".*(?:under|is|of) (?:a |the )?(?:terms of the )?(?:creative commons|cc) (?P<kind>by(?: (?:nc|nd|sa))*|attribution(?: (?:non ?commercial|no ?deriv(?:ative)?s?|share ?alike))*)(?: (?:international|generic|unported))?(?: license)?(?: version)?(?: (?P<v>\d(?:\.\d)?))?.*|cc (?P<kind2>by(?: (?:nc|nd|sa))*)(?: (?P<v2>\d\.\d))?"),
    ("CcZero", r".*(?:cc0|cc zero|creative commons zero).*"),
    ("PublicDomain", r".*(?:released|dedicated|placed|is) (?:in|in to|into|to) the public domain.*|this is free and unencumbered software released into the public domain"),
    ("PythonUnder", r"(?:.*(?:under|of) )?(?:the )?(?:terms of the )?python software foundation license(?: agreement)?(?: version)?(?: v)? ?(?P<v>\d(?:\.\d)?)?"),
    ("UnlicenseUnder", r".*under the unlicense.*"),
    ("BoostUnder", r".*under the boost software license(?: version)? ?(?P<v>\d\.\d)?.*"),
    ("ZlibUnder", r".*under the zlib(?: libpng)? license.*"),
    ("WtfplUnder", r".*under the (?:wtfpl|do what the fuck you want to public license).*"),
    ("Reserved", r".*\ball rights reserved"),
    ("Copyright", r"(?:\(c\) |copyright ).*\d{4}.*|copyright \(c\).*"),
    ("AnyUnder", r"(?>.*?(?:licensed|released|distributed|available) under ).*licen[sc]e.*"),
]

#: Ordered rules: (identifiers in sequence, licence). {v}: the version that the first identifier carries. Fixed values.
RULES = [
    (("Spdx",), "{v}"),
    (("ApacheUnder", "ApacheNotUse", "ApacheCopy", "ApacheAsIs", "ApacheSee"), "Apache-{v}"),
    (("ApacheUnder",), "Apache-{v}"),
    (("LesserUnder", "GnuHope", "GnuReceived"), "LGPL-{v}"),
    (("LesserUnder",), "LGPL-{v}"),
    (("AfferoUnder", "GnuHope", "GnuReceived"), "AGPL-{v}"),
    (("AfferoUnder",), "AGPL-{v}"),
    (("GeneralUnder", "GnuHope", "GnuReceived"), "GPL-{v}"),
    (("GeneralUnder",), "GPL-{v}"),
    (("MozillaUnder",), "MPL-{v}"),
    (("EclipseUnder",), "EPL-{v}"),
    (("MitUnder", "MitGrant", "MitNotice"), "MIT"),
    (("MitGrant", "MitNotice"), "MIT"),
    (("MitGrant",), "MIT"),
    (("MitUnder",), "MIT"),
    (("IscUnder", "IscGrant"), "ISC"),
    (("IscGrant",), "ISC"),
    (("IscUnder",), "ISC"),
    (("BsdGrant", "BsdSource", "BsdBinary", "BsdAds", "BsdEndorse"), "BSD-4"),
    (("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"), "BSD-3"),
    (("BsdGrant", "BsdSource", "BsdBinary"), "BSD-2"),
    (("BsdGrant",), "BSD"),
    (("BsdUnder",), "BSD-{v}"),
    (("CcUnder",), "CC-{kind}-{v}"),
    (("CcZero",), "CC0"),
    (("PythonUnder",), "PSF-{v}"),
    (("UnlicenseUnder",), "Unlicense"),
    (("PublicDomain", "UnlicenseUnder"), "Unlicense"),
    (("PublicDomain",), "Public-domain"),
    (("BoostUnder",), "BSL-{v}"),
    (("ZlibUnder",), "Zlib"),
    (("WtfplUnder",), "WTFPL"),
    (("AnyUnder",), "Unknown"),
    (("Copyright", "Reserved"), "Proprietary"),
    (("Reserved",), "Proprietary"),
]

#: What says that a list of licences may follow, after normalisation, and their names and abbreviations there: (identifier, pattern). Fixed values.
GIVEN = r"\b(?:licensed|released|distributed|available|provided|covered) (?:\w+ ){0,3}?(?:under|by) "
_VERSION = r"(?: license)?(?: ?v(?:ersion)?)? ?(?P<v{}>\d(?:\.\d)?)?(?P<plus{}>\+)?(?P<later{}> or (?:any )?(?:later|newer)(?: version)?)?"
NAMES = [
    ("LesserUnder", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public license)" + _VERSION),
    ("AfferoUnder", r"(?:gnu )?(?:agpl|affero general public license)" + _VERSION),
    ("GeneralUnder", r"(?:gnu )?(?:gpl|general public license)" + _VERSION),
    ("MozillaUnder", r"(?:mpl|mozilla public license)" + _VERSION),
    ("EclipseUnder", r"(?:epl|eclipse public license)" + _VERSION),
    ("ApacheUnder", r"(?:apache|asl)(?: software)?(?: license)?" + _VERSION),
    ("PythonUnder", r"(?:psf|python software foundation license)" + _VERSION),
    ("BoostUnder", r"(?:bsl|boost(?: software)? license)" + _VERSION),
    ("BsdUnder", r"(?:(?P<v{}>[234]|two|three|four|new|modified|simplified|revised)(?: clause)? )?bsd(?: (?P<v2{}>[234])(?: clause)?)?"),
    ("CcUnder", r"cc (?P<kind{}>by(?: (?:nc|nd|sa))*)(?: (?P<v{}>\d\.\d))?"),
    ("CcZero", r"cc0"),
    ("IscUnder", r"isc"), ("ZlibUnder", r"zlib"), ("WtfplUnder", r"wtfpl"), ("UnlicenseUnder", r"unlicense"),
    ("MitUnder", r"(?:mit|expat|x11)"),
]

#: Number words and long names in versions and kinds. Fixed values.
SAME = {"two": "2", "simplified": "2", "three": "3", "new": "3", "modified": "3", "revised": "3", "four": "4", "attribution": "by", "noncommercial": "nc", "noderivatives": "nd", "noderivs": "nd", "sharealike": "sa"}

_CUT = re.compile(r"\n\s*\n|(?<=[.;!?])\s+(?=[^\s])|(?<=:)[ \t]*\n|\n(?=\s*+[*#/-]*+\s*+(?:\(c\)|copyright|spdx|licen|redistribution|permission|\d\.))", re.I)
_COMMENT = re.compile(r"(?m)^[^\S\n]*+(?:#+|//+|/?\*+/?|--|;+|%+|<!--|rem\b)\s?|-->|\*/")
_PUNCT = re.compile(r"(?<!\d)\.(?!\d)|\.(?=\s|$)|[,;:!?\"'`“”‘’\[\]{}<>()/\\*_=|-]+")
_PATTERNS = [(name, re.compile(p)) for name, p in SENTENCES]
_GIVEN = re.compile(GIVEN)
#: One alternation, so that names are taken from left to right; group names end in the number of their family.
_NAMES = re.compile("|".join(rf"(?P<f_{i}>\b{p.replace('{}', f'_{i}')}(?![a-z0-9]))" for i, (_, p) in enumerate(NAMES)))
_SPDX = re.compile(r"spdx-license-identifier:[ \t]*([^\n]*)", re.I)
_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*")


@dataclass(frozen=True)
class Found:
    licence: str
    start: int
    end: int
    sentences: str


def normal(sentence: str) -> str:
    s = _COMMENT.sub(" ", sentence).lower()
    s = s.replace("licence", "license").replace("(c)", " \x01 ").replace("©", " \x01 ")
    return " ".join(_PUNCT.sub(" ", s).split()).replace("\x01", "(c)")


def sentences(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, sentence); a line with a hint is a sentence of its own unless it goes on in the next."""
    at = 0
    for m in [*_CUT.finditer(text), None]:
        end = len(text) if m is None else m.start()
        if end > at:
            yield at, end, text[at:end]
        at = len(text) if m is None else m.end()


def expression(text: str) -> list[str]:
    """The licences of an SPDX expression; one with an exception keeps it: 'A WITH e'. What isn't an identifier or an operator ends it."""
    out, after = [], "OR"
    for m in re.finditer(r"[()]|\S+", text.replace("(", " ( ").replace(")", " ) ")):
        word = m[0]
        if word in "()":
            continue
        if word.upper() in ("OR", "AND", "WITH"):
            after = word.upper()
        elif not after or not _ID.fullmatch(word):
            break
        elif after == "WITH" and out:
            out[-1] += f" WITH {word}"
            after = ""
        else:
            out.append(word)
            after = ""
    return out


def listed_names(s: str) -> list[tuple[str, dict]]:
    """The licences that a normalised sentence names after 'licensed under' and the like, each (identifier, groups)."""
    given = _GIVEN.search(s)
    out: list[tuple[str, dict]] = []
    for m in _NAMES.finditer(s, given.end()) if given else ():
        i = m.lastgroup.rpartition("_")[2]
        g = {k.rpartition("_")[0].rstrip("23"): v for k, v in m.groupdict().items() if v and k.endswith(f"_{i}") and not k.startswith("f_")}
        if "plus" in g:
            g["later"] = g.pop("plus")
        if (NAMES[int(i)][0], g) not in out:
            out.append((NAMES[int(i)][0], g))
    return out


def identify(sentence: str) -> list[tuple[str, dict]]:
    """The known sentences that a sentence stands for: one, or as many as it lists licences."""
    low = sentence.lower()
    if not any(h in low for h in HINTS):
        return []
    if m := _SPDX.search(sentence):
        return [("Spdx", {"v": x}) for x in expression(m[1])]
    s = normal(sentence)
    names = listed_names(s)
    if len({n for n, _ in names}) > 1:
        return names
    for name, p in _PATTERNS:
        m = p.fullmatch(s)
        if m and not (names and name in ("AnyUnder", "Copyright", "Reserved")):
            return [(name, {k.rstrip("23"): v for k, v in m.groupdict().items() if v})]
    return names


def scan(text: str | None) -> list[Found]:
    """Licences of one text in order of place."""
    if not text:
        return []
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    seen: list[tuple[str, dict, int, int]] = []
    for start, end, s in sentences(text):
        # A wrapped sentence is tried whole; if it isn't known, its lines are tried one by one.
        known = identify(s)
        if known:
            seen += [(*k, start, end) for k in known]
        elif "\n" in s:
            at = start
            for line in s.split("\n"):
                seen += [(*k, at, at + len(line)) for k in identify(line)]
                at += len(line) + 1
    used, out = [False] * len(seen), []
    for names, licence in RULES:
        for i in range(len(seen) - len(names) + 1):
            if any(used[i : i + len(names)]) or tuple(x[0] for x in seen[i : i + len(names)]) != names:
                continue
            used[i : i + len(names)] = [True] * len(names)
            g = seen[i][1]
            words = lambda k: "-".join(SAME.get(w, w) for w in re.sub(r"non commercial|no derivs?|share alike|no derivatives", lambda m: m[0].replace(" ", ""), g.get(k, "")).split())  # noqa: E731, B023
            name = licence.replace("{v}", words("v") or "?").replace("{kind}", words("kind"))
            if names == ("Spdx",):
                name = g["v"]
            name = name.upper() if licence.startswith(("CC-", "{v}")) else name
            name = name.replace("-OR-LATER", "-or-later").replace("-ONLY", "-only")
            name = name.removesuffix("-?") + ("-or-later" if "later" in g else "")
            out.append(Found(name, seen[i][2], seen[i + len(names) - 1][3], " ".join(names)))
    return sorted(out, key=lambda f: (f.start, f.end))


def _scans(batches: Iterator) -> Iterator:
    for b in batches:
        found = [scan(t.as_py()) for t in b.column(1)]
        span = [[{"licence": f.licence, "start": f.start, "end": f.end, "sentences": f.sentences} for f in fs] for fs in found]
        kind = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("sentences", pa.string())]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(span, kind)], names=["doc_id", "found"])


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, licences (distinct, sorted), n_found, found (licence, start, end, sentences) of every row of ``docs``.

    start and end are places in the text. Null, empty and other texts without a licence have empty lists; texts are
    scanned whole, however long. Of sentences that several patterns match the first pattern counts. No rows in, no rows out.
    Repeated rows and null doc_ids are kept as they are; other columns are ignored.
    """
    rows = rows_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    out = rows.mapInArrow(_scans, "doc_id long, found array<struct<licence:string,start:long,end:long,sentences:string>>")
    return out.select("doc_id", F.array_sort(F.array_distinct(F.transform("found", lambda f: f["licence"]))).alias("licences"), F.size("found").alias("n_found"), "found")
