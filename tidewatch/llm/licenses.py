"""License texts and notices in documents, by ordered signature rules.

The text becomes its words (lower-case runs of digits, letters and characters
beyond ASCII) with one space between them, so signatures need not care about case,
punctuation or line breaks. Every rule names a word that must be there: a text's
words select the rules whose word occurs, and only those run their regular
expression. Rules are ordered by priority. A detection inside the interval of one
of higher priority, or of equal priority and greater length, is suppressed.

Null and empty texts have no words and no detections. Repeated detections of one
license at several places are all kept; their label counts once. Texts are judged
one by one, whole, and nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewatch.llm.common import with_columns
from tidewatch.llm.decontaminate import words

# Licenses as `label: title | spdx ids | address`, each a regular expression over normalised words.
LICENSES = r"""
mit: mit | mit | (?:opensource org licenses mit|mit license org)
mit-0: mit no attribution | mit 0 | opensource org licenses mit 0
apache-1.0: apache(?: software)?(?: license)?(?: version| v)? 1 0 | apache 1 0 | apache org licenses license 1 0
apache-1.1: apache(?: software)?(?: license)?(?: version| v)? 1 1 | apache 1 1 | apache org licenses license 1 1
apache-2.0: apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)? | apache 2 0 | apache org licenses license 2 0
bsd-2-clause: (?:simplified|freebsd|2 clause|two clause) bsd | bsd 2 clause | opensource org licenses bsd 2 clause
bsd-3-clause: (?:new|modified|revised|3 clause|three clause) bsd | bsd 3 clause(?: clear)? | opensource org licenses bsd 3 clause
bsd-4-clause: (?:original|old|4 clause|four clause) bsd | bsd 4 clause | spdx org licenses bsd 4 clause
0bsd: (?:zero clause|0 clause) bsd | 0bsd | opensource org licenses 0bsd
bsd: bsd(?: style)? | bsd | opensource org licenses bsd license
gpl-1.0: (?:gnu )?general public license(?: version| v) 1(?: 0)? | gpl 1 0(?: only| or later)? | gnu org licenses (?:old licenses )?gpl 1 0
gpl-2.0: (?:gnu )?(?:general public license|gpl)(?: as published by the free software foundation)?(?: either)?(?: version| v) 2(?: 0)? | (?:gpl 2 0(?: only| or later)?|gplv2) | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0: (?:gnu )?(?:general public license|gpl)(?: as published by the free software foundation)?(?: either)?(?: version| v) 3(?: 0)? | (?:gpl 3 0(?: only| or later)?|gplv3) | gnu org licenses gpl 3 0
gpl: gnu (?:general public|gpl) | gpl | gnu org licenses gpl
lgpl-2.0: (?:gnu )?library general public license(?: version| v)? ?(?:2(?: 0)?)? | lgpl 2 0(?: only| or later)? | gnu org licenses (?:old licenses )?lgpl 2 0
lgpl-2.1: (?:gnu )?(?:lesser general public license|lgpl)(?: version| v) 2 1 | (?:lgpl 2 1(?: only| or later)?|lgplv2 1) | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0: (?:gnu )?(?:lesser general public license|lgpl)(?: version| v) 3(?: 0)? | (?:lgpl 3 0(?: only| or later)?|lgplv3) | gnu org licenses lgpl 3 0
lgpl: (?:gnu )?lesser general public | lgpl | gnu org licenses lgpl
agpl-1.0: affero general public license(?: version| v) 1(?: 0)? | agpl 1 0(?: only| or later)? | affero org oagpl
agpl-3.0: (?:gnu )?affero general public(?: license(?: version| v) 3(?: 0)?)? | (?:agpl 3 0(?: only| or later)?|agplv3) | gnu org licenses agpl(?: 3 0)?
gfdl-1.1: (?:gnu )?free documentation license(?: version| v) 1 1 | gfdl 1 1(?: only| or later)? | gnu org licenses (?:old licenses )?fdl 1 1
gfdl-1.2: (?:gnu )?free documentation license(?: version| v) 1 2 | gfdl 1 2(?: only| or later)? | gnu org licenses (?:old licenses )?fdl 1 2
gfdl-1.3: (?:gnu )?free documentation(?: license(?: version| v) 1 3)? | gfdl 1 3(?: only| or later)? | gnu org licenses fdl(?: 1 3)?
mpl-1.0: (?:mozilla public license|mpl)(?: version| v)? 1 0 | mpl 1 0 | mozilla org mpl 1 0
mpl-1.1: (?:mozilla public license|mpl)(?: version| v)? 1 1 | mpl 1 1 | mozilla org mpl 1 1
mpl-2.0: mozilla public(?: license(?: version| v)? 2 0)? | mpl 2 0 | mozilla org mpl 2 0
epl-1.0: eclipse public license(?: version| v)? 1 0 | epl 1 0 | eclipse org legal epl v10
epl-2.0: eclipse public(?: license(?: version| v)? 2 0)? | epl 2 0 | eclipse org legal epl (?:v20|2 0)
cddl-1.0: common development and distribution(?: license(?: version| v)? 1 0)? | cddl 1 0 | opensource org licenses cddl ?1(?: 0)?
cddl-1.1: common development and distribution license(?: version| v)? 1 1 | cddl 1 1 | spdx org licenses cddl 1 1
cpl-1.0: common public(?: license(?: version| v)? 1 0)? | cpl 1 0 | opensource org licenses cpl ?1(?: 0)?
ipl-1.0: ibm public(?: license(?: version| v)? 1 0)? | ipl 1 0 | opensource org licenses ibmpl
isc: isc | isc | opensource org licenses isc
zlib: (?:zlib|zlib libpng) | zlib(?: acknowledgement)? | (?:opensource org licenses zlib|zlib net zlib license)
libpng: libpng | libpng(?: 2 0)? | libpng org pub png src libpng license
bsl-1.0: boost software(?: license(?: version)? 1 0)? | bsl 1 0 | boost org license 1 0
busl-1.1: business source(?: license(?: version)? 1 1)? | busl 1 1 | mariadb com bsl11
elastic-2.0: elastic license(?: version)? 2 0 | elastic 2 0 | elastic co licensing elastic license
sspl-1.0: server side public | sspl 1 0 | mongodb com licensing server side public license
unlicense: unlicense | unlicense | unlicense org
wtfpl: (?:do what the fuck you want to public|wtfpl) | wtfpl | wtfpl net
artistic-1.0: (?:perl )?artistic license 1 0 | artistic 1 0(?: perl| cl8)? | opensource org licenses artistic license 1 0
artistic-2.0: (?:perl )?artistic(?: license(?: version)? 2 0)? | artistic 2 0 | opensource org licenses artistic license 2 0
python-2.0: (?:python software foundation|psf)(?: license version 2)? | (?:python 2 0|psf 2 0) | python org psf license
ruby: ruby | ruby | ruby lang org en about license txt
php-3.01: php license(?: version)? 3 01 | php 3 01 | php net license 3 01
zend-2.0: zend engine | zend 2 0 | zend com license 2 00
openssl: openssl | openssl | openssl org source license
ssleay: ssleay | ssleay | spdx org licenses ssleay
postgresql: postgresql | postgresql | postgresql org about licence
ncsa: (?:university of illinois )?ncsa(?: open source)? | ncsa | opensource org licenses (?:uoi )?ncsa
w3c: w3c software(?: notice and)?(?: document)? | w3c | w3 org consortium legal copyright software
x11: x11 | x11 | x org releases license
curl: curl | curl | curl se docs copyright
icu: icu | icu | source icu project org repos icu license
unicode: unicode(?: data files and software)? | unicode dfs 2016 | unicode org copyright
afl-2.1: academic free license(?: version| v)? 2 1 | afl 2 1 | opensource linux mirrors org licenses afl 2 1
afl-3.0: academic free(?: license(?: version| v)? 3 0)? | afl 3 0 | opensource org licenses afl 3 0
osl-2.1: open software license(?: version| v)? 2 1 | osl 2 1 | opensource org licenses osl 2 1
osl-3.0: open software(?: license(?: version| v)? 3 0)? | osl 3 0 | opensource org licenses osl 3 0
ecl-2.0: educational community | ecl 2 0 | opensource org licenses ecl 2 0
eupl-1.1: european union public licen[cs]e(?: version| v)? 1 1 | eupl 1 1 | ec europa eu idabc eupl
eupl-1.2: european union public(?: licen[cs]e(?: version| v)? 1 2)? | eupl 1 2 | joinup ec europa eu page eupl text 11 12
cecill-2.1: cecill(?: free software)? | cecill 2 1 | cecill info licences
mulan-2.0: mulan (?:psl|permissive software)(?: v2| version 2)? | mulanpsl 2 0 | license coscl org cn mulanpsl2
ms-pl: (?:microsoft public|ms pl) | ms pl | opensource org licenses ms pl
ms-rl: (?:microsoft reciprocal|ms rl) | ms rl | opensource org licenses ms rl
ofl-1.1: sil open font(?: license(?: version)? 1 1)? | ofl 1 1 | scripts sil org ofl
odbl-1.0: open database | odbl 1 0 | opendatacommons org licenses odbl
odc-by-1.0: open data commons attribution | odc by 1 0 | opendatacommons org licenses by
pddl-1.0: public domain dedication and | pddl 1 0 | opendatacommons org licenses pddl
cc0-1.0: (?:creative commons zero|cc0)(?: 1 0)?(?: universal)? | cc0 1 0 | creativecommons org publicdomain zero 1 0
openrail: (?:bigscience |creativeml )?open rail(?: m)? | openrail(?: m)? | bigscience huggingface co blog the bigscience rail license
"""
# Sentences of license texts as `label: regular expression`.
SENTENCES = r"""
mit: permission is hereby granted free of charge to any person obtaining a copy of this software
mit: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
x11: except as contained in this notice the name of the .{1,60}? shall not be used in advertising
apache-2.0: you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2.0: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0: terms and conditions for use reproduction and distribution 1 definitions
bsd: redistribution and use in source and binary forms with or without modification are permitted
bsd: redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause: neither the name of .{1,80}? nor the names of (?:its|his|their|any) contributors may be used to endorse or promote
bsd-4-clause: all advertising materials mentioning features or use of this software must display the following acknowledgement
gpl: this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl: this program is distributed in the hope that it will be useful but without any warranty
gpl-2.0: either version 2(?: 0)? of the license or at your option any later version
gpl-3.0: either version 3(?: 0)? of the license or at your option any later version
gpl: everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
lgpl: this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl-3.0: this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license
gfdl-1.3: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2.0: this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1: the contents of this file are subject to the mozilla public license version 1 1
epl-1.0: this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0: this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
cddl-1.0: the contents of this file are subject to the terms of the common development and distribution license
isc: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
zlib: this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib: altered source versions must be plainly marked as such and must not be misrepresented as being the original software
bsl-1.0: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense: this is free and unencumbered software released into the public domain
wtfpl: you just do what the fuck you want to
artistic-2.0: this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
ofl-1.1: this font software is licensed under the sil open font license version 1 1
cc0-1.0: (?:to the extent possible under law .{1,60}? )?has waived all copyright and related or neighboring rights
public-domain: (?:is|are|placed|released|dedicated)(?: in| into| to)? the public domain
public-domain: no rights reserved
proprietary: all rights reserved
proprietary: proprietary and confidential
proprietary: unauthorized copying of this (?:file|work|document|software)
proprietary: may not be (?:reproduced|copied|distributed)(?: or \w+)* without (?:the )?(?:prior )?(?:express )?(?:written )?(?:permission|consent)
"""
CC_KINDS = {
    "by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s?",
    "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike",
    "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?",
}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words of rules too common to select by.
COMMON = set(
    "the of and or to in is this a as for it you any may be org license licenses licence public software open source "
    "general version with by from free not without are no use copy".split()
)


@dataclass(frozen=True)
class Rule:
    """``word`` must occur for the rule to run; ``trust`` is what a detection is worth, 0 to 1."""

    label: str
    word: str
    pattern: re.Pattern
    priority: int
    trust: float


def _literal_words(pattern: str) -> list[str]:
    """Words that stand in every text the pattern fits: those outside groups and optional parts."""
    flat, depth = [], 0
    for part in re.split(r"(\(\?:|\)\??)", pattern):
        if part == "(?:":
            depth += 1
            flat.append(" _")
        elif part.startswith(")"):
            depth -= 1
            flat.append("_ ")
        elif not depth:
            flat.append(part)
    return [w for w in "".join(flat).split() if re.fullmatch(r"[a-z0-9]+", w)]


def _rules(label: str, body: str, priority: int, trust: float) -> list[Rule]:
    """A rule for each way the first group's alternatives give a word to select by."""
    found = _literal_words(body)
    rare = sorted((w for w in found if w not in COMMON and not w.isdigit()), key=lambda w: (-len(w), w))
    if rare:
        return [Rule(label, rare[0], re.compile(rf"(?<= ){body}(?= )".encode()), priority, trust)]
    group = re.search(r"\(\?:([^()]*)\)(?!\?)", body)
    if not group:
        if not found:
            raise ValueError(f"no word to select by in {body}")
        return [Rule(label, max(found, key=len), re.compile(rf"(?<= ){body}(?= )".encode()), priority, trust)]
    return [
        r for option in group[1].split("|")
        for r in _rules(label, body[: group.start()] + option + body[group.end() :], priority, trust)
    ]


def signature_rules() -> list[Rule]:
    """All rules, first the weightiest: texts, tags and addresses, grants, titles."""
    out: list[Rule] = []
    rows = [line.partition(": ")[::2] for line in LICENSES.strip().splitlines()]
    table = [(label, *[x.strip() for x in rest.split(" | ")]) for label, rest in rows]
    for kind, name in CC_KINDS.items():
        short = kind.replace("-", " ")
        for version in CC_VERSIONS:
            number = version.replace(".", " ")
            title = rf"(?:creative commons|cc) (?:{short}|{name})(?: license)?(?: version| v)? {number}(?: international| unported| generic)?"
            table.append((f"cc-{kind}-{version}", title, f"cc {short} {number}", f"creativecommons org licenses {short} {number}"))
    for line in SENTENCES.strip().splitlines():
        label, _, body = line.partition(": ")
        out += _rules(label, body, 4, 1.0)
    for label, title, tag, address in table:
        out += _rules(label, rf"spdx license identifier {tag}", 4, 1.0)
        out += _rules(label, address, 3, 0.9)
        grant = r"(?:licensed|released|distributed|available|published|provided|covered) (?:under|by)(?: the)?(?: terms of)?(?: the)?(?: gnu)? "
        out += _rules(label, rf"{grant}{title}(?: public)?(?: licen[cs]e)?(?:(?: version| v) [0-9](?: [0-9])?)?", 2, 0.8)
        out += _rules(label, rf"(?:the )?{title} licen[cs]e", 1, 0.6)
    return out


def _places(data: bytes, spaces: np.ndarray, begin: int, end: int) -> tuple[int, int]:
    """First word of a match, and the one behind it."""
    first, behind = np.searchsorted(spaces, [begin, end])
    return int(first) - 1, int(behind)


class Scanner:
    def __init__(self, rules: list[Rule] | None = None, base: dict[str, str] | None = None):
        self.by_word: dict[bytes, list[tuple[int, Rule]]] = defaultdict(list)
        for i, r in enumerate(signature_rules() if rules is None else rules):
            self.by_word[r.word.encode()].append((i, r))
        self.base = [(re.compile(rf"(?<= ){p}(?= )".encode()), b) for p, b in (BASE if base is None else base).items()]
        self.gate = {*self.by_word, *(p.split()[0].encode() for p in (BASE if base is None else base))}

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]]]:
        """Number of words; base places (start, label); kept detections (start, end, label, trust)."""
        own = words(text)
        present = self.gate.intersection(own)
        if not present:
            return len(own), [], []
        data = b" " + b" ".join(own) + b" "
        spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        places = sorted(
            (_places(data, spaces, m.start(), m.end())[0], label) for e, label in self.base for m in e.finditer(data)
        )
        found = []
        for word in present:
            for i, r in self.by_word.get(word, ()):
                for m in r.pattern.finditer(data):
                    begin, end = _places(data, spaces, m.start(), m.end())
                    found.append((-r.priority, begin - end, begin, i, end, r))
        return len(own), places, suppress(found)


def suppress(found: list[tuple]) -> list[tuple[int, int, str, float]]:
    """Detections that lie inside no weightier one, by place.

    They come by priority, then length, then place, then order of rules. Of the kept
    ones only those inside no other are remembered; their ends rise with their
    starts, so the last that starts at or before a place tells whether any contains it.
    """
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for _, _, begin, _, end, rule in sorted(found, key=lambda x: x[:4]):
        i = bisect_right(starts, begin)
        if i and ends[i - 1] >= end:
            continue
        kept.append((begin, end, rule.label, rule.trust))
        i -= bool(i and starts[i - 1] == begin)
        j = bisect_right(ends, end, i)
        starts[i:j], ends[i:j] = [begin], [end]
    return sorted(kept)


DETECTION = T.ArrayType(T.StructType([
    T.StructField("first", T.IntegerType()), T.StructField("behind", T.IntegerType()),
    T.StructField("label", T.StringType()), T.StructField("trust", T.DoubleType()),
]))
PLACE = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("label", T.StringType())]))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, ``n_words``, ``base_places`` (start, label) and ``detections`` (first, behind, label, trust)."""

    def make():
        scanner = Scanner()

        def one(t):
            n, places, found = scanner.scan(t)
            return (
                n, [{"first": a, "label": b} for a, b in places],
                [dict(zip(("first", "behind", "label", "trust"), x)) for x in found],
            )

        return lambda texts: list(zip(*map(one, texts)))

    return with_columns(
        docs, make, [("n_words", T.LongType()), ("base_places", PLACE), ("detections", DETECTION)], text, keep,
    )
