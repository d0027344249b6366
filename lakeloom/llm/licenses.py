"""License scans with token automata compiled from template markup.

A template is a line of wording in which ``[[ ... ]]`` is an optional region, ``(( a | b ))`` a choice of
wordings, and ``{{name:pattern:least-most}}`` a replaceable region of that many words that each match the
pattern. It compiles to an automaton over words; a text is accepted at a place if its words from there take
the automaton from its first to its last state, so all mandatory wording has to match exactly. Plain phrases
are templates without regions.

Documents are scanned whole where they are, without a shuffle. A template whose longest mandatory word is
not in the text cannot match, which leaves most texts with a count of their words.

Cases: null text has no words; repeated rows each get a row; an empty table gives no rows; extra columns are
ignored; very long texts are read whole; overlapping places of a phrase all count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import ALNUM_WORDS, lower_bytes, pieces_of, ship

#: The phrases and labels of the contract.
BASE_PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

#: The wording of public licenses and their notices, with labels of their own, as templates.
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[[ {{n:[1a]:1-1}} ]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[ {{n:[2b]:1-1}} ]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_NAMES = "[[ {{n:[3c]:1-1}} ]] neither the name of {{holder:.+:1-12}} nor the names of (( its | their )) contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_END = (
    "this software is provided by {{holder:.+:1-12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall {{holder:.+:1-12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_ISC_END = (
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
    "arising out of or in connection with the use or performance of this software"
)
TEMPLATES = [
    ("mit-grant", "(( released | licensed | distributed | available | provided )) under the [[ terms of the ]] mit license"),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and [[ its ]] associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice [[ including the next paragraph ]] shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall {{holder:.+:2-8}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("apache-2.0", "licensed under the apache license version 2 0 [[ the license ]]"),
    (
        "apache-2.0-notice",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[ {{scheme:https?:1-1}} ]] www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    ("cc-by-nc-versioned", "licensed under [[ a ]] cc by nc [[ (( sa | nd )) ]] {{version:[0-9]+:1-2}}"),
    ("cc-by", "licensed under [[ a ]] (( cc by | creative commons attribution )) [[ (( sa | sharealike )) ]] {{version:[0-9]+:1-2}}"),
    ("gpl", "(( this work | this program | this software | {{name:.+:1-4}} )) is [[ free software ]] licensed under the gnu [[ lesser | affero ]] general public license version {{version:[0-9]+:1-2}}"),
    (
        "gpl-notice",
        "{{name:.+:1-3}} is free software you can redistribute it and or modify it under the terms of the gnu [[ lesser | affero ]] general public license as published by the free software foundation either version {{version:[0-9]+:1-2}} of the license or [[ at your option ]] any later version "
        "{{name:.+:1-3}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu [[ lesser | affero ]] general public license for more details",
    ),
    ("bsd-2-clause", f"{_BSD} {_BSD_END}"),
    ("bsd-3-clause", f"{_BSD} {_BSD_NAMES} {_BSD_END}"),
    ("isc", f"permission to use copy modify and [[ or ]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies {_ISC_END}"),
    ("0bsd", f"permission to use copy modify and [[ or ]] distribute this software for any purpose with or without fee is hereby granted {_ISC_END}"),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "[[ 1 ]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "[[ 2 ]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "[[ 3 ]] this notice may not be removed or altered from any source distribution",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    ("mpl", "subject to the terms of the mozilla public license [[ v ]] [[ version ]] {{version:[0-9]+:1-2}}"),
    (
        "mpl-notice",
        "this source code [[ form ]] is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [[ {{scheme:https?:1-1}} ]] [[ www ]] mozilla org mpl 2 0",
    ),
    ("all-rights", "copyright [[ c ]] {{year:[0-9]+:1-2}} {{holder:.+:0-6}} all rights reserved"),
]
#: Mandatory words of which a match is as likely right as not; a match of as many scores one half.
HALF = 4

_MARK = re.compile(r"\[\[|\]\]|\(\(|\)\)|\||\{\{[^}]*\}\}|[^\s\[\]\(\)\|\{\}]+")


@dataclass
class Automaton:
    """States are numbers; a state has word moves, pattern moves and free moves."""

    label: str
    words: list[dict[bytes, list[int]]] = field(default_factory=list)
    patterns: list[list[tuple[re.Pattern, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    first: int = 0
    last: int = 0
    anchor: bytes = b""
    mandatory: int = 0

    @property
    def score(self) -> float:
        """Nearer to 1 the more mandatory words a match had to get right."""
        return self.mandatory / (self.mandatory + HALF)

    def state(self) -> int:
        self.words.append({})
        self.patterns.append([])
        self.free.append([])
        return len(self.words) - 1

    def closure(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for nxt in self.free[todo.pop()]:
                if nxt not in out:
                    out.add(nxt)
                    todo.append(nxt)
        return out

    def step(self, states: set[int], word: bytes) -> set[int]:
        out: set[int] = set()
        for s in states:
            out.update(self.words[s].get(word, ()))
            out.update(nxt for pattern, nxt in self.patterns[s] if pattern.fullmatch(word))
        return self.closure(out)

    def starters(self) -> tuple[set[bytes], bool]:
        """Words that a match can begin with, and whether a replaceable region can come first."""
        opening = self.closure({self.first})
        return {w for s in opening for w in self.words[s]}, any(self.patterns[s] for s in opening)

    def matches(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(start, end) of the longest match from every place that has one."""
        opening = self.closure({self.first})
        starters, anything = self.starters()
        out = []
        for start, word in enumerate(words):
            if not anything and word not in starters:
                continue
            states, at, end = opening, start, None
            while states and at < len(words):
                states = self.step(states, words[at])
                at += 1
                if self.last in states:
                    end = at
            if end is not None:
                out.append((start, end))
        return out


def compile_template(label: str, markup: str) -> Automaton:
    """Optional and replaceable regions become free and pattern moves around the mandatory words."""
    auto = Automaton(label)
    tokens = _MARK.findall(markup)
    at = 0
    mandatory: list[bytes] = []

    def sequence(begin: int, depth: int, required: bool) -> int:
        """Reads words and regions up to a closing mark or bar; returns the state they end in."""
        nonlocal at
        here = begin
        while at < len(tokens) and tokens[at] not in ("]]", "))", "|"):
            token = tokens[at]
            at += 1
            if token in ("[[", "(("):
                here = choice(here, depth + 1, "]]" if token == "[[" else "))")
            elif token.startswith("{{"):
                _, pattern, span = token[2:-2].rsplit(":", 2)
                least, most = map(int, span.split("-"))
                word = re.compile(pattern.encode())
                end = auto.state()
                for k in range(most + 1):
                    if k >= least:
                        auto.free[here].append(end)
                    if k < most:
                        nxt = auto.state()
                        auto.patterns[here].append((word, nxt))
                        here = nxt
                here = end
            else:
                word = token.lower().encode()
                nxt = auto.state()
                auto.words[here].setdefault(word, []).append(nxt)
                here = nxt
                if required:
                    mandatory.append(word)
        return here

    def choice(begin: int, depth: int, closing: str) -> int:
        nonlocal at
        end = auto.state()
        while True:
            branch = auto.state()
            auto.free[begin].append(branch)
            auto.free[sequence(branch, depth, False)].append(end)
            if at >= len(tokens):
                raise ValueError(f"{label}: a region is not closed")
            token = tokens[at]
            at += 1
            if token == closing:
                break
            if token != "|":
                raise ValueError(f"{label}: {token} does not close the region")
        if closing == "]]":
            auto.free[begin].append(end)
        return end

    auto.first = auto.state()
    auto.last = sequence(auto.first, 0, True)
    if at != len(tokens):
        raise ValueError(f"{label}: {tokens[at]} without a region")
    if not mandatory:
        raise ValueError(f"{label}: a template needs mandatory wording")
    auto.anchor, auto.mandatory = max(mandatory, key=len), len(mandatory)
    return auto


class Scanner:
    def __init__(self, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]):
        self.phrases = [compile_template(*p) for p in phrases]
        self.templates = [compile_template(*t) for t in templates]
        self.anchors = {a.anchor for a in self.phrases + self.templates}

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int, int, bool, float]]]:
        """Words of the text, and (label, start, end, is a base phrase, score) of every match."""
        raw = lower_bytes(text)
        words = ALNUM_WORDS.findall(raw)
        present = {a for a in self.anchors if a in raw}
        found = []
        if present:
            for base, automata in ((True, self.phrases), (False, self.templates)):
                for auto in automata:
                    if auto.anchor in present:
                        found += [(auto.label, s, e, base, auto.score) for s, e in auto.matches(words)]
        return len(words), found


MATCHES = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))


def license_matches(docs: DataFrame, phrases=None, templates=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, matches)``: every accepted place with its label."""
    ship(docs.sparkSession)
    phrases, templates = BASE_PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in pieces_of(batches, 512):
            results = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            matches = [[{"label": a, "start": s, "end": e, "base": b, "score": x} for a, s, e, b, x in found] for _, found in results]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in results], pa.int64()), pa.array(matches, MATCHES)], ["_id", "n_words", "matches"])

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, n_words long, matches array<struct<label: string, start: long, end: long, base: boolean, score: double>>")
    return out.withColumnRenamed("_id", id_col)
