"""License scans by template markup.

A template is wording with regions: ``<<optional>> ... <<end>>`` may be absent
as a whole, ``<<replace:a-b>>`` stands for a to b words of any kind. A template is compiled to a token automaton that accepts where all mandatory words stand in
order, with nothing between them but what regions allow.

A few fixed phrases are looked for beside the templates; their labels are always
kept. Defined cases: a null or empty text has no words, no labels and score 0;
repeated rows give repeated results; a template that may begin with any word is
refused; of templates that begin at one place all labels count; other columns are never read. Every word of a text is read, however long the text is.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column

from hopmeter.llm.common import by_task

# Phrases and labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of whole licenses and of notices, words only. A template that
# is not a whole text names the license beyond doubt. Holders and years are regions.
_AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
    "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or "
    "otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of <<replace:1-8>> and associated "
    "documentation files <<optional>>the software<<end>>"
)
_MIT_RIGHTS = (
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
    "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do "
    "so subject to the following conditions the above copyright notice and this permission notice "
    "<<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software"
)
_BSD_START = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met"
)
_BSD_TWO = (
    "<<optional>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and "
    "the following disclaimer <<optional>>2<<end>> redistributions in binary form must reproduce the above copyright notice "
    "this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_THREE = (
    "<<optional>>3<<end>> neither the name of <<replace:1-12>> nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission"
)
_BSD_AS_IS = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties "
    "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are "
    "disclaimed in no event shall the copyright <<replace:1-2>> or contributors be liable for any direct indirect incidental "
    "special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
    "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract "
    "strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if "
    "advised of the possibility of such damage"
)


def _gnu(name: str) -> list[str]:
    """Notices of one of the three licenses of the family."""
    return [
        f"licensed under the <<optional>>terms of the<<end>> gnu {name} <<optional>>version <<replace:1-2>><<end>>",
        f"redistribute it and or modify it under the terms of the gnu {name} "
        "<<optional>>as published by the free software foundation<<end>> "
        "<<optional>>either version <<replace:1-2>> of the license or at your option any later version<<end>>",
    ]


#: label -> templates.
TEMPLATES = {
    "gpl": _gnu("general public license"),
    "lgpl": _gnu("lesser general public license"),
    "agpl": _gnu("affero general public license"),
    "apache": [
        "licensed under the apache license <<optional>>version 2 0<<end>> <<optional>>the license you may not use this file "
        "except in compliance with the license you may obtain a copy of the license at http www apache org licenses license "
        "2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed "
        "on an as is basis without warranties or conditions of any kind either express or implied see the license for the "
        "specific language governing permissions and limitations under the license<<end>>",
        "licensed under the apache 2 0 license",
        "apache software license <<optional>>version 2 0<<end>>",
    ],
    "mit": [
        "released under the <<optional>>terms of the<<end>> mit <<optional>>x11<<end>> license",
        _MIT_GRANT,
        f"{_MIT_GRANT} {_MIT_RIGHTS} {_AS_IS}",
    ],
    "isc": [
        "permission to use copy modify and <<optional>>or<<end>> distribute this software for any purpose with or without fee "
        "is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "released under the <<optional>>terms of the<<end>> isc license",
    ],
    "cc-by": [
        "licensed under <<optional>>the<<end>> <<optional>>a<<end>> cc by "
        "<<optional>>nc<<end>> <<optional>>sa<<end>> <<optional>>nd<<end>> "
        "<<optional>>4 0<<end>>",
        "licensed under a creative commons attribution <<optional>>noncommercial<<end>> "
        "<<optional>>sharealike<<end>> <<replace:0-2>> <<optional>>international<<end>> license",
    ],
    "cc-by-nc": [
        "licensed under <<optional>>the<<end>> cc by nc <<optional>>sa<<end>> <<optional>>4 0<<end>>",
        "licensed under a creative commons attribution noncommercial <<optional>>sharealike<<end>>",
    ],
    "cc-by-sa": [
        "licensed under <<optional>>the<<end>> cc by sa <<optional>>4 0<<end>>",
        "licensed under a creative commons attribution sharealike",
    ],
    "cc0": ["to the extent possible under law <<replace:1-12>> has waived all copyright and related or neighboring rights to"],
    "bsd": [_BSD_START, "<<optional>>released under the<<end>> bsd <<replace:1-2>> clause license"],
    "bsd-2-clause": [f"{_BSD_START} {_BSD_TWO} {_BSD_AS_IS}"],
    "bsd-3-clause": [f"{_BSD_START} {_BSD_TWO} {_BSD_THREE} {_BSD_AS_IS}"],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable "
        "for any damages arising from the use of this software permission is granted to anyone to use this software for any "
        "purpose including commercial applications and to alter it and redistribute it freely",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
        "compile sell or distribute this software",
    ],
    "mpl": [
        "subject to the terms of the mozilla public license <<optional>>v <<replace:1-2>><<end>> <<optional>>if a copy of the "
        "mpl was not distributed with this file you can obtain one at <<replace:1-8>><<end>>",
    ],
}
TABLE = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32
    for c in range(256)
)
ANY = None
RESULT = (
    "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,"
    "base_labels:string,labels:string,score:double>"
)
_RESULT = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
    ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()),
    ("score", pa.float64()),
])


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: digits, letters and everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split(b" ")


def tokens_of(text: str | None) -> list[bytes]:
    return [w for w in words_of(text) if w]


class Automaton:
    """Steps are (word or ANY, next state); a state may also be left for free."""

    def __init__(self, markup: str):
        self.steps: list[dict] = [{"on": {}, "any": None, "free": []}]
        self.mandatory = 0
        at, depth, opened = 0, 0, []
        for mark, options, word in re.findall(r"<<(\w+)(?::([0-9-]+))?>>|([^<>\s]+)", markup):
            if mark == "optional":
                opened.append(at)
                depth += 1
            elif mark == "replace":
                low, high = map(int, options.split("-"))
                skipped = []
                for i in range(high):
                    if i >= low:
                        skipped.append(at)
                    at = self._add(at, ANY)
                for state in skipped:
                    self.steps[state]["free"].append(at)
            elif mark == "end":
                self.steps[opened.pop()]["free"].append(at)
                depth -= 1
            elif mark:
                raise ValueError(f"unknown region {mark!r}")
            else:
                for w in tokens_of(word):
                    at = self._add(at, w)
                    self.mandatory += not depth
        if opened or not self.mandatory:
            raise ValueError(f"open region or no mandatory word in {markup!r}")
        self.last = at
        start = [self.steps[s] for s in self._closure({0})]
        if any(step["any"] is not None for step in start):
            raise ValueError(f"{markup!r} may begin with any word; a template is looked up by its first word")
        self.first = {w for step in start for w in step["on"]}

    def _add(self, at: int, word: bytes | None) -> int:
        self.steps.append({"on": {}, "any": None, "free": []})
        new = len(self.steps) - 1
        if word is ANY:
            self.steps[at]["any"] = new
        else:
            self.steps[at]["on"][word] = new
        return new

    def _closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.steps[todo.pop()]["free"]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def accepts_at(self, words: list[bytes], at: int) -> int:
        """Words of the longest match that starts at ``at``; 0 if there is none."""
        states, best = self._closure({0}), 0
        for i in range(at, len(words)):
            w = words[i]
            step = set()
            for s in states:
                state = self.steps[s]
                if w in state["on"]:
                    step.add(state["on"][w])
                if state["any"] is not None:
                    step.add(state["any"])
            if not step:
                break
            states = self._closure(step)
            if self.last in states:
                best = i + 1 - at
        return best


class Scanner:
    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]):
        self.phrases = [(tokens_of(p), label) for p, label in phrases.items()]
        self.by_first: dict[bytes, list[tuple[str, Automaton]]] = {}
        longest: dict[str, int] = {}
        for label, markups in templates.items():
            for markup in markups:
                automaton = Automaton(markup)
                longest[label] = max(longest.get(label, 0), automaton.mandatory)
                for w in automaton.first:
                    self.by_first.setdefault(w, []).append((label, automaton))
        self.anchors = {p[0] for p, _ in self.phrases} | set(self.by_first)

    def scan(self, text: str | None) -> tuple:
        words = tokens_of(text)
        base, labels, starts, covered = set(), set(), [], 0
        if not self.anchors.isdisjoint(words):
            for i, w in enumerate(words):
                if w not in self.anchors:
                    continue
                for phrase, label in self.phrases:
                    if words[i : i + len(phrase)] == phrase:
                        base.add(label)
                        starts.append(i)
                        covered = max(covered, len(phrase))
                for label, automaton in self.by_first.get(w, ()):
                    if n := automaton.accepts_at(words, i):
                        labels.add(label)
                        covered = max(covered, n)
        labels |= base
        # Certainty grows with the words matched: 2 words 0.5, 6 words 0.75, 18 words 0.9.
        score = covered / (covered + 2.0) if labels else 0.0
        return (
            len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), score,
        )


def license_scan(
    text: Column, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES
) -> Column:
    """Struct of word and phrase counts, labels and score of ``text``."""
    Scanner(templates, phrases)  # refuses bad markup on the driver
    names = [f.name for f in _RESULT]

    def build() -> Callable:
        scanner = Scanner(templates, phrases)

        def scan(texts: pa.Array) -> pa.Array:
            found = list(zip(*(scanner.scan(t.as_py()) for t in texts))) or [()] * len(names)
            return pa.StructArray.from_arrays(
                [pa.array(c, f.type) for c, f in zip(found, _RESULT)], names
            )

        return scan

    return by_task(RESULT, build)(text)
