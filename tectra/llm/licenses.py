"""Licence scans by rules over recognised sentences, with column expressions alone.

A text falls apart into clauses in normal form, at hard marks (the end of a sentence, an empty line) and soft ones (the end of
a line or a clause, either side of an address). A run of clauses between marks, over soft ones alone, is looked up in a table
of known licence sentences, many of which may say the same and share an identifier. The identifiers that a text has, in order,
are matched against rules, each of which is a sequence of identifiers.

Licences come wrapped at some column, so a line feed with its comment prefix may be a blank within a known sentence as well
as the end of a notice of one line. Of the runs that begin at one clause the longest known one counts.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of published licences and of notices that name one, in normal form (lower case, runs of
# other characters than letters and digits as one blank). A sentence's id is its place, from 1.
SENTENCES = [
    "released under the mit license",
    "licensed under the mit license",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "licensed under the apache license version 2 0",
    "licensed under the apache license version 2 0 the license",
    "you may not use this file except in compliance with the license",
    "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "see the license for the specific language governing permissions and limitations under the license",
    "this work is licensed under the gnu general public license version 3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "see the gnu general public license for more details",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "licensed under cc by nc 4 0",
    "licensed under cc by 4 0",
    "licensed under cc by sa 4 0",
    "this work is licensed under a creative commons attribution 4 0 international license",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "this source code form is subject to the terms of the mozilla public license v 2 0",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "this is free and unencumbered software released into the public domain",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "see the gnu lesser general public license for more details",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "see the gnu affero general public license for more details",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this software is provided as is without any express or implied warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "distributed under the boost software license version 1 0",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which accompanies this distribution and is available at http www eclipse org legal epl v20 html",
    "licensed under the bsd 3 clause license",
    "licensed under the bsd 2 clause license",
    "licensed under the isc license",
    "licensed under the gnu general public license version 3",
    "licensed under the mozilla public license version 2 0",
]
# Rule, licence, ids of its sentences in order, whether the licence forbids commercial use.
RULES = [
    ("mit-notice", "MIT", [1], False),
    ("mit-notice-licensed", "MIT", [2], False),
    ("mit-text", "MIT", [3, 4, 5, 6], False),
    ("mit-grant", "MIT", [3, 4], False),
    ("apache-notice", "Apache-2.0", [7], False),
    ("apache-header", "Apache-2.0", [8, 9, 10, 11, 12], False),
    ("gpl3-notice", "GPL-3.0-only", [13], False),
    ("gpl3-header", "GPL-3.0-or-later", [14, 16, 17], False),
    ("gpl2-header", "GPL-2.0-or-later", [15, 16, 17], False),
    ("bsd2-text", "BSD-2-Clause", [18, 19, 20], False),
    ("bsd3-text", "BSD-3-Clause", [18, 19, 20, 21], False),
    ("isc-grant", "ISC", [22], False),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", [23], True),
    ("cc-by-notice", "CC-BY-4.0", [24], False),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", [25], False),
    ("cc-by-sentence", "CC-BY-4.0", [26], False),
    ("cc-by-nc-sentence", "CC-BY-NC-4.0", [27], True),
    ("mpl-header", "MPL-2.0", [28, 29], False),
    ("unlicense", "Unlicense", [30], False),
    ("lgpl21-header", "LGPL-2.1-or-later", [31, 33, 34], False),
    ("lgpl3-header", "LGPL-3.0-or-later", [32, 33, 34], False),
    ("lgpl3-program-header", "LGPL-3.0-or-later", [38, 16, 34], False),
    ("agpl3-header", "AGPL-3.0-or-later", [35, 16, 36], False),
    ("gpl2-only-header", "GPL-2.0-only", [37, 16, 17], False),
    ("zlib-text", "Zlib", [39, 40, 41], False),
    ("boost-notice", "BSL-1.0", [42], False),
    ("epl2-notice", "EPL-2.0", [43], False),
    ("epl2-notice-v", "EPL-2.0", [44], False),
    ("bsd3-notice", "BSD-3-Clause", [45], False),
    ("bsd2-notice", "BSD-2-Clause", [46], False),
    ("isc-notice", "ISC", [47], False),
    ("gpl3-notice-licensed", "GPL-3.0-only", [48], False),
    ("mpl2-notice", "MPL-2.0", [49], False),
]
# Identifiers that a source file's licence line may hold, and the parts of a Creative Commons name.
IDENTIFIERS = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0"]
CREATIVE_COMMONS = {"by": "attribution", "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
_KINDS = [["by"], ["by", "sa"], ["by", "nd"], ["by", "nc"], ["by", "nc", "sa"], ["by", "nc", "nd"]]


def _add(sentence: str, rule: str, license_: str, noncommercial: bool = False) -> None:
    """A rule of one sentence, unless the sentence is known."""
    if sentence not in SENTENCES:
        SENTENCES.append(sentence)
        RULES.append((rule, license_, [len(SENTENCES)], noncommercial))


for _name in IDENTIFIERS:
    _add("spdx license identifier " + re.sub("[^a-z0-9]+", " ", _name.lower()), f"identifier-{_name.lower()}", _name)
for _kind in _KINDS:
    _code, _nc = "-".join(_kind), "nc" in _kind
    _words = " ".join(CREATIVE_COMMONS[k] for k in _kind)
    _add(f"licensed under cc {' '.join(_kind)} 4 0", f"cc-{_code}-short", f"CC-{_code.upper()}-4.0", _nc)
    for _article in ("a", "the"):
        _add(f"this work is licensed under {_article} creative commons {_words} 4 0 international license", f"cc-{_code}-work-{_article}", f"CC-{_code.upper()}-4.0", _nc)

for _name in IDENTIFIERS:
    _add("license " + re.sub("[^a-z0-9]+", " ", _name.lower()), f"field-{_name.lower()}", _name)

# Openings and marks of published licence texts: rule, licence, its sentences in order.
TEXTS = [
    ("apache-text", "Apache-2.0", ["apache license version 2 0 january 2004", "terms and conditions for use reproduction and distribution"]),
    ("gpl3-text", "GPL-3.0-only", ["gnu general public license version 3 29 june 2007", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"]),
    ("gpl2-text", "GPL-2.0-only", ["gnu general public license version 2 june 1991", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"]),
    ("lgpl3-text", "LGPL-3.0-only", ["gnu lesser general public license version 3 29 june 2007", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"]),
    ("lgpl21-text", "LGPL-2.1-only", ["gnu lesser general public license version 2 1 february 1999", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"]),
    ("agpl3-text", "AGPL-3.0-only", ["gnu affero general public license version 3 19 november 2007", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"]),
    ("cc0-text", "CC0-1.0", ["creative commons legal code", "cc0 1 0 universal"]),
    ("cc0-deed", "CC0-1.0", ["the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law"]),
    ("wtfpl-text", "WTFPL", ["do what the fuck you want to public license version 2 december 2004", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"]),
    ("boost-text", "BSL-1.0", ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"]),
    ("0bsd-grant", "0BSD", ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"]),
]
# Names that notices give to licences, and those of the GNU licences: their initials, long names, versions.
NAMES = {
    "MIT": ["mit license", "mit licence"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache 2 0 license", "apache 2 0"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "bsd 2 clause"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "bsd 3 clause"],
    "ISC": ["isc license"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0", "mpl 2 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0", "epl 2 0"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0", "boost software license"],
    "Zlib": ["zlib license"],
    "Unlicense": ["unlicense", "unlicense license"],
    "WTFPL": ["wtfpl", "wtfpl license"],
    "CC0-1.0": ["cc0", "cc0 1 0", "cc0 1 0 universal", "cc0 1 0 universal license"],
}
GNU = [("GPL", "general", "2.0"), ("GPL", "general", "3.0"), ("LGPL", "lesser general", "2.1"), ("LGPL", "lesser general", "3.0"), ("AGPL", "affero general", "3.0")]
VERBS = ["licensed", "released", "distributed", "available"]
UNDER = ["under", "under the", "under the terms of the"]
LATER = [" or later", " or any later version", " or at your option any later version"]

for _code, _long, _version in GNU:
    _names = []
    for _v in dict.fromkeys([_version.replace(".", " "), _version.removesuffix(".0").replace(".", " ")]):
        _names += [f"gnu {_long} public license {how}{_v}" for how in ("version ", "v")]
        _names += [f"{who}{_code.lower()}{how}{_v}" for who in ("", "gnu ") for how in (" ", " v", "v")]
    NAMES[f"{_code}-{_version}-only"] = _names + [f"{n} license" for n in _names if "license" not in n]
    NAMES[f"{_code}-{_version}-or-later"] = [n + later for n in _names for later in LATER if later == LATER[0] or "version" in n]

#: Known sentences and their identifiers.
KNOWN = {s: k for k, s in enumerate(SENTENCES, 1)}


def _identifier(sentence: str) -> int:
    """That of a known sentence, or a new one."""
    return KNOWN.setdefault(sentence, max(KNOWN.values()) + 1)


for _rule, _license, _parts in TEXTS:
    RULES.append((_rule, _license, [_identifier(s) for s in _parts], False))
for _license, _names in NAMES.items():  # notices that say the same share an identifier
    _id = max(KNOWN.values()) + 1
    RULES.append((f"notice-{_license.lower()}", _license, [_id], False))
    for _sentence in (f"{verb} {under} {name}" for name in _names for verb in VERBS for under in UNDER):
        KNOWN.setdefault(_sentence, _id)

_BREAK = "\x1e"
_ENDS = r"[.!?][\x20\x09-\x0D]+|[\x0A\x0D]+"
_OTHER = "[^A-Za-z0-9\x1e]+"


def sentences(text: Column) -> Column:
    """Sentences in normal form. One ends at marks before white space, and at the end of a line;
    what holds no letter or digit is none."""
    plain = F.regexp_replace(F.concat(F.coalesce(text, F.lit("")), F.lit(" ")), _ENDS, _BREAK)
    plain = F.lower(F.regexp_replace(plain, _OTHER, " "))
    return F.filter(F.transform(F.split(plain, _BREAK), lambda s: F.trim(s)), lambda s: s != "")


# Marks between words: of a clause, an empty line, a sentence and a line.
_CLAUSE, _EMPTY, _END, _LINE = "\x1c", "\x1d", "\x1e", "\x1f"
_MARKS = "[\x1c-\x1f]"
_GAP = f"[ {_CLAUSE}{_LINE}]"
_THINGS = "project|software|program|code|package|library|work|module|repository|tool|plugin|application|app|dataset|data|model|file|files|crate|framework|documentation"

#: Steps (pattern, replacement by numbers of groups) of the text's words in normal form with marks; the step None lowers case.
#: No pattern tries one place for longer than some words or one run of characters, so that all texts take linear time.
_STEPS: list[tuple[str, str] | None] = [
    (_MARKS, " "),
    (r"\x0D\x0A?", "\n"),
    (r"(^|[^A-Za-z0-9])[vV]\.[^A-Za-z0-9]{1,20}(?:dnl |rem )?([0-9])", "{1}v {2}"),  # an abbreviated version ends no sentence
    ("[hH][tT][tT][pP][sS]://", "http://"),
    (r"[.!?][\x20\x09-\x0D]+", _END),
    (r"(http://[^\x20\x09-\x0D\x1e]+)[\x20\x09]+", "{1}" + _CLAUSE),
    (r"[:;][\x20\x09]+", _CLAUSE),
    ("\n", _LINE),
    ("[^A-Za-z0-9\x1c-\x1f]+", " "),
    None,
    (f" ?({_MARKS}) ?", "{1}"),
    (f"([{_LINE}{_END}])(?:dnl|rem)(?: |({_MARKS}))", "{1}{2}"),  # comment prefixes of letters, twice as neighbours share a mark
    (f"([{_LINE}{_END}])(?:dnl|rem)(?: |({_MARKS}))", "{1}{2}"),
    (f"{_LINE}{{2,}}", _EMPTY),
    (f"{_EMPTY}http ", f"{_LINE}http "),  # an address may stand by itself between empty lines
    (f"(^|{_MARKS})((?:this|the|our){_GAP}(?:[a-z0-9]+{_GAP}){{0,2}}(?:{_THINGS}){_GAP}(?:is|are)(?:{_GAP}made)?){_GAP}((?:{'|'.join(VERBS)}){_GAP}under{_GAP})", "{1}{2}" + _CLAUSE + "{3}"),
    (f"{_GAP}(see{_GAP}(?:the{_GAP})?(?:file{_GAP})?licen[sc]e(?:{_GAP}(?:md|txt|rst|file|licen[sc]e)){{0,4}}{_GAP}for(?:{_GAP}(?:the|more|full|further|complete)){{0,2}}{_GAP}(?:details|information|text|terms))({_MARKS}|$)", f"{_CLAUSE}{{1}}{{2}}"),
    (f"[{_EMPTY}{_END}]", f"{_LINE}{_END}{_LINE}"),
    (_CLAUSE, _LINE),
]


def _clauses(text: Column) -> Column:
    """The text's clauses in normal form; one of the mark alone between those that a hard mark parts."""
    plain = F.concat(F.coalesce(text, F.lit("")), F.lit(" "))
    for step in _STEPS:
        plain = F.trim(F.lower(plain)) if step is None else F.regexp_replace(plain, step[0], re.sub(r"\{(\d)\}", r"$\1", step[1]))
    return F.filter(F.split(plain, _LINE), lambda c: c != "")


def _groups(known: dict[str, int]) -> dict[str, list[tuple[str, int]]]:
    """Known sentences, in the form that addresses have in clauses, by their first word and by their first two."""
    groups: dict[str, list[tuple[str, int]]] = {}
    for sentence, i in known.items():
        words = sentence.replace("https ", "http ").split(" ")
        for key in dict.fromkeys([words[0], " ".join(words[:2])]):
            groups.setdefault(key, []).append((" ".join(words), i))
    return groups


def _anchors(known: dict[str, int]) -> list[str]:
    """Words of which every known sentence has one, of six letters or more where it has such a word; the most shared first."""
    left = []
    for s in known:
        words = s.split(" ")
        left.append({w for w in words if len(w) >= 6} or {max(words, key=len)})
    anchors = []
    while left:
        n = Counter(w for words in left for w in words)
        anchors.append(min(n, key=lambda w: (-n[w], w)))
        left = [words for words in left if anchors[-1] not in words]
    return anchors


def _found(text: Column, known: dict[str, int]) -> Column:
    """Identifiers of the known sentences that the text holds, in order. Sentences within the run of another are left out."""
    groups = _groups(known)
    if not groups:
        return F.array().cast("array<int>")
    table = lambda values: F.split(F.lit(_LINE.join(map(str, values))), _LINE)  # noqa: E731  one literal, split once when the plan is made
    keys = table(groups)
    said = F.array(*[table(s for s, _ in g) for g in groups.values()])
    ids = F.array(*[table(i for _, i in g).cast("array<int>") for g in groups.values()])
    most = table(max(s.count(" ") + 1 for s, _ in g) for g in groups.values()).cast("array<int>")

    def longest(clauses: Column, start: Column) -> Column:
        i, g = start["i"], start["g"]
        runs = F.transform(
            F.sequence(F.lit(1), F.least(F.element_at(most, g), F.size(clauses) - i)),
            lambda k: F.struct(i.alias("i"), (i + k).alias("end"), F.array_position(F.element_at(said, g), F.array_join(F.slice(clauses, i + 1, k), " ")).cast("int").alias("at"), g.alias("g")),
        )
        return F.try_element_at(F.filter(runs, lambda r: r["at"] > 0), F.lit(-1))

    def within(clauses: Column) -> Column:
        starts = F.transform(clauses, lambda c, i: F.struct(i.alias("i"), F.array_position(keys, F.substring_index(c, " ", 2)).cast("int").alias("g")))
        hits = F.transform(F.filter(starts, lambda s: s["g"] > 0), lambda s: longest(clauses, s))
        return F.filter(hits, lambda h: h.isNotNull())

    # a transform of one element names its value, so that it is worked out once
    hits = F.element_at(F.transform(F.array(_clauses(text)), within), 1)
    reach = max(s.count(" ") + 1 for s in known)  # no run has more clauses

    def outer(hits: Column) -> Column:
        before = lambda k: F.slice(hits, F.greatest(k - (reach - 1), F.lit(1)), F.least(k, F.lit(reach)))
        return F.filter(hits, lambda h, k: F.aggregate(before(k), F.lit(0), lambda m, x: F.greatest(m, x["end"])) <= h["i"])

    return F.transform(F.element_at(F.transform(F.array(hits), outer), 1), lambda h: F.element_at(F.element_at(ids, h["g"]), h["at"]))


def _sequence(ids: list[int]) -> str:
    return "".join(f"<{i}>" for i in ids)


def license_scan(docs: DataFrame, known: dict[str, int] | list[str] | None = None, rules: list[tuple] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row and rule that it matches: doc_id, rule, license, noncommercial, n_matches, n_sentences (of the text), recognised (ids
    of known sentences in order, as "<7><13>").

    `known` maps sentences in normal form to identifiers; in a list a sentence's identifier is its place, from 1. A rule
    matches where its sentences follow one another among the text's known sentences; others may stand between.
    Known sentences count wrapped over lines too, also behind comment prefixes; n_sentences has lines as sentences of
    their own. A rule within a longer one that matches is reported too. Null and empty texts match nothing; repeated rows are
    reported each, a null id stays null, an empty table gives an empty one, other columns are ignored. Whole texts, no
    shuffle, no Python; a text without any of the few words of which every known sentence has one is not taken apart. Known sentences and rules are parameters of the plan: some thousands of sentences, looked up by their
    first words, and some hundreds of rules.
    """
    known, rules = KNOWN if known is None else known, RULES if rules is None else rules
    known = known if isinstance(known, dict) else {s: k for k, s in reversed(list(enumerate(known, 1)))}
    may = [F.contains(F.lower(F.col(text_col)), F.lit(w)) for w in _anchors(known)]
    docs = docs.filter(reduce(lambda a, b: a | b, may, F.lit(False)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), sentences(F.col(text_col)).alias("s"), _found(F.col(text_col), known).alias("ids"))
    rows = rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.concat_ws("", F.transform("ids", lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">")))).alias("recognised"))
    all_rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(lic).alias("license"), F.lit(nc).alias("noncommercial"), F.lit(_sequence(seq)).alias("seq")) for name, lic, seq, nc in rules]).cast("array<struct<rule:string,license:string,noncommercial:boolean,seq:string>>")
    met = rows.withColumn("r", F.explode(F.filter(all_rules, lambda r: F.contains(F.col("recognised"), r["seq"]))))
    n = ((F.length("recognised") - F.length(F.replace("recognised", F.col("r.seq"), F.lit("")))) / F.length("r.seq")).cast("long")
    return met.select("doc_id", "r.rule", "r.license", "r.noncommercial", n.alias("n_matches"), "n_sentences", "recognised")


def license_sql() -> str:
    """The same over `documents`, for DuckDB: runs of clauses joined with the known sentences."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    plain = "coalesce(text, '') || ' '"
    for step in _STEPS:
        plain = f"trim(lower({plain}))" if step is None else f"regexp_replace({plain}, {q(step[0])}, {q(re.sub(r'{(.)}', lambda m: chr(92) + m[1], step[1]))}, 'g')"
    said = {s.replace("https ", "http "): i for s, i in KNOWN.items()}
    known = ", ".join(f"({q(s)}, {i})" for s, i in said.items())
    first = ", ".join(q(w) for w in sorted({s.split(" ")[0] for s in said}))
    reach = max(s.count(" ") + 1 for s in said)
    rules = ", ".join(f"({q(n)}, {q(lic)}, {nc}, {q(_sequence(s))})" for n, lic, s, nc in RULES)
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
plain AS (
    SELECT rid, doc_id, lower(regexp_replace(regexp_replace(coalesce(text, '') || ' ', '{_ENDS}', chr(30), 'g'), '[^A-Za-z0-9]+', ' ', 'g')) AS p,
        list_filter(string_split({plain}, chr(31)), lambda c: c <> '') AS clauses FROM docs),
known(sentence, id) AS (VALUES {known}),
starts AS (SELECT * FROM (SELECT rid, clauses, unnest(range(1, len(clauses) + 1)) AS i FROM plain) WHERE string_split(clauses[i], ' ')[1] IN ({first})),
runs AS (SELECT rid, i, unnest(range(1, least({reach}, len(clauses) - i + 1) + 1)) AS k, clauses FROM starts),
hits AS (
    SELECT rid, i, max(i + k) AS until, max_by(id, k) AS id
    FROM (SELECT rid, i, k, array_to_string(clauses[i:i + k - 1], ' ') AS run FROM runs) r JOIN known ON sentence = run GROUP BY rid, i),
outermost AS (SELECT rid, i, id FROM (SELECT *, max(until) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM hits) WHERE coalesce(covered, 0) <= i),
recognised AS (SELECT rid, string_agg('<' || id || '>', '' ORDER BY i) AS recognised FROM outermost GROUP BY rid),
rules(rule, license, noncommercial, seq) AS (VALUES {rules})
SELECT doc_id, rule, license, noncommercial, CAST((length(recognised) - length(replace(recognised, seq, ''))) // length(seq) AS BIGINT) AS n_matches,
    CAST(len(list_filter(string_split(p, chr(30)), lambda x: trim(x) <> '')) AS BIGINT) AS n_sentences, recognised
FROM plain JOIN recognised USING (rid) JOIN rules ON contains(recognised, seq)"""
