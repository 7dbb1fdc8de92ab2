"""Licence scan by template markup.

A licence template is text with marked regions: ``<<beginOptional>> ... <<endOptional>>`` may be left out,
``<<var;original="...";match="...">>`` may be replaced.  ``match`` is ``.+`` (any words, at least one), ``.*`` (any words),
``.{a,b}`` (any a to b words) or alternatives of words (``released|licensed``).  A template is compiled to an automaton over words;
it accepts a run of a text's words exactly when all mandatory wording is there, in order, with nothing else between.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame

from .common import map_batches, texts

# Word characters are digits, ASCII letters and everything beyond ASCII; upper-case ASCII letters become lower case.
_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Public licence notices and texts as templates.
TEMPLATES = {
    "mit-notice": """<<var;original="released";match="released|licensed|distributed|available|published|provided">> under the
        <<beginOptional>>terms of the<<endOptional>> MIT License""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files <<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
        to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of
        the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        <<var;original="THE AUTHORS OR COPYRIGHT HOLDERS";match=".+">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE""",
    "isc": """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
        SOFTWARE IS PROVIDED "AS IS" AND <<var;original="THE AUTHOR";match=".+">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;original="THE AUTHOR";match=".+">> BE
        LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form
        must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY
        <<var;original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";match=".+">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
        NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
        <<var;original="THE COPYRIGHT HOLDER OR CONTRIBUTORS";match=".+">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
        EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
        DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
        OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY
        OF SUCH DAMAGE""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form
        must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. <<beginOptional>>3.<<endOptional>> Neither the name of
        <<var;original="the copyright holder nor the names of its contributors";match=".+">> may be used to endorse or promote products
        derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY
        <<var;original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";match=".+">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
        NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
        <<var;original="THE COPYRIGHT HOLDER OR CONTRIBUTORS";match=".+">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
        EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
        DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
        OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY
        OF SUCH DAMAGE""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License"); you may not use this file except in
        compliance with the License<<endOptional>>""",
    "gpl": """<<var;original="This work is licensed";match=".{0,4}">> under the <<beginOptional>>terms of the<<endOptional>>
        <<beginOptional>>GNU<<endOptional>> General Public License <<beginOptional>>as published by the Free Software
        Foundation<<endOptional>> <<beginOptional>>, either<<endOptional>> <<beginOptional>>version
        <<var;original="3";match="1|2|3">><<endOptional>>""",
    "gpl-2.0": """GNU General Public License <<beginOptional>>as published by the Free Software Foundation, either<<endOptional>> version 2""",
    "gpl-3.0": """GNU General Public License <<beginOptional>>as published by the Free Software Foundation, either<<endOptional>> version 3""",
    "cc-by-4.0": """CC BY 4.0""",
    "cc-by-sa-4.0": """CC BY-SA 4.0""",
    "cc-by-nc-4.0": """CC BY-NC 4.0""",
    "cc-by-nc-sa-4.0": """CC BY-NC-SA 4.0""",
    "cc-by-nd-4.0": """CC BY-ND 4.0""",
    "cc-by": """<<beginOptional>>licensed under a<<endOptional>> Creative Commons Attribution
        <<beginOptional>><<var;original="4.0 International";match=".{0,3}">><<endOptional>> License""",
    "cc0-1.0": """CC0 1.0 <<beginOptional>>Universal<<endOptional>>""",
    "reserved": """<<beginOptional>>Copyright <<var;original="(c) 2020 the owner";match=".{0,12}">><<endOptional>> All rights reserved""",
}

MARK = re.compile(r"<<(beginOptional|endOptional|var)([^>]*)>>")
BOUNDS = re.compile(r"\.\{(\d+),(\d+)\}")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of digits, letters and anything beyond ASCII."""
    return text.encode().translate(_TABLE).split() if text else []


class Automaton:
    """A template as a nondeterministic automaton over words, with one state between any two of its words.

    ``words[s]`` leads on a given word, ``free[s]`` on any word, ``empty[s]`` without one; the last state accepts.  ``loops`` are
    the states that any word leaves where they are.
    """

    def __init__(self, template: str):
        self.words: list[dict[bytes, int]] = [{}]
        self.free: list[int | None] = [None]
        self.empty: list[list[int]] = [[]]
        self.loops: set[int] = set()
        self.required: list[bytes] = []
        opened: list[int] = []
        at, place = 0, 0
        for mark in [*MARK.finditer(template), None]:
            for word in words_of(template[place : mark.start() if mark else len(template)]):
                at = self._step(at, [word])
                if not opened:
                    self.required.append(word)
            if mark is None:
                break
            place = mark.end()
            if mark[1] == "beginOptional":
                opened.append(at)
            elif mark[1] == "endOptional":
                start, at = opened.pop(), self._join(at)
                self.empty[start].append(at)
            else:
                at = self._variable(at, re.search(r'match="([^"]*)"', mark[2])[1])
        self.last = at
        self.trailing = {s for s in self.loops if at in self._close({s})}
        if not self.required:
            raise ValueError("a template needs mandatory words")

    def _new(self) -> int:
        self.words.append({})
        self.free.append(None)
        self.empty.append([])
        return len(self.words) - 1

    def _join(self, at: int) -> int:
        new = self._new()
        self.empty[at].append(new)
        return new

    def _step(self, at: int, words: list[bytes]) -> int:
        if self.words[at] or self.free[at] is not None:
            at = self._join(at)
        new = self._new()
        for word in words:
            self.words[at][word] = new
        return new

    def _variable(self, at: int, match: str) -> int:
        if match in (".+", ".*"):
            at = self._join(at)
            loop = self._new() if match == ".+" else at
            self.free[at] = self.free[loop] = loop
            self.loops.add(loop)
            return self._join(loop)
        if not (bounds := BOUNDS.fullmatch(match)):
            return self._step(at, [w for x in match.split("|") for w in words_of(x)])
        least, most = int(bounds[1]), int(bounds[2])
        at = self._join(at)
        ends = [at] if not least else []
        for i in range(most):
            new = self._new()
            self.free[at] = new
            at = new
            if i + 1 >= least:
                ends.append(at)
        out = self._new()
        for end in ends:
            self.empty[end].append(out)
        return out

    def _close(self, states: set[int]) -> set[int]:
        stack = list(states)
        while stack:
            for s in self.empty[stack.pop()]:
                if s not in states:
                    states.add(s)
                    stack.append(s)
        return states

    def first_words(self) -> set[bytes] | None:
        """Words a run can begin with; None if it can begin with any."""
        states = self._close({0})
        if any(self.free[s] is not None for s in states):
            return None
        return {w for s in states for w in self.words[s]}

    def longest(self, words: list[bytes], start: int, dead: dict[int, int]) -> int:
        """End of the accepted run from ``start``; -1 if there is none.

        Once a run is accepted, only what follows without a loop in the middle of the template makes it longer, so that two
        licences in one text stay two.  ``dead`` keeps from call to call the first place of each loop in a run that failed:
        a later run that is there or further on in the same loop fails as well.
        """
        states, end, reached = self._close({0}), -1, {}
        for i in range(start, len(words) + 1):
            if self.last in states:
                end = i
            for s in states & self.loops:
                if end >= 0 and s not in self.trailing or dead.get(s, i + 1) <= i:
                    states.remove(s)
                else:
                    reached.setdefault(s, i)
            if i == len(words) or not states:
                break
            word, after = words[i], set()
            for s in states:
                if (t := self.words[s].get(word)) is not None:
                    after.add(t)
                if self.free[s] is not None:
                    after.add(self.free[s])
            states = self._close(after)
        if end < 0:
            for s, i in reached.items():
                dead[s] = min(i, dead.get(s, i))
        return end


@cache
def automata() -> dict[str, tuple[Automaton, bytes, set[bytes], set[bytes] | None]]:
    """Per label: automaton, the mandatory word that is hardest to find, all mandatory words, first words."""
    out = {}
    for label, template in TEMPLATES.items():
        a = Automaton(template)
        out[label] = (a, max(a.required, key=len), set(a.required), a.first_words())
    return out


def phrase_places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Every start of the phrase, overlapping ones included."""
    out, at, k = [], 0, len(phrase)
    while True:
        try:
            at = words.index(phrase[0], at)
        except ValueError:
            return out
        if words[at : at + k] == phrase:
            out.append(at)
        at += 1


def template_spans(words: list[bytes], joined: bytes) -> list[tuple[str, int, int]]:
    """``(label, start, end)`` of the accepted runs, leftmost first, not overlapping within a label."""
    present: set[bytes] | None = None
    out = []
    for label, (automaton, rare, required, first) in automata().items():
        if rare not in joined:
            continue
        present = set(words) if present is None else present
        if not required <= present:
            continue
        at, dead = 0, {}
        while at < len(words):
            if first is None or words[at] in first:
                end = automaton.longest(words, at, dead)
                if end > at:
                    out.append((label, at, end))
                    at = end
                    continue
            at += 1
    return out


def scan_text(text: str | None) -> dict:
    """All that is reported of one text; a null or empty text has no words and no labels."""
    words = words_of(text)
    joined = b" ".join(words)
    places: dict[str, list[int]] = {}
    for phrase, label in PHRASES.items():
        if (encoded := phrase.encode()) in joined and (found := phrase_places(words, encoded.split())):
            places[label] = found
    spans = template_spans(words, joined)
    starts = [p for found in places.values() for p in found]
    labels = {*places, *(s[0] for s in spans)}
    return {
        "n_words": len(words),
        "n_base": len(starts),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(places)),
        "labels": ",".join(sorted(labels)),
        "score": 1.0 if spans else 0.5 if starts else 0.0,
        "spans": [f"{label}:{a}:{b}" for label, a, b in spans],
    }


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row: words, phrase places, labels, score (1: a template matched, 0.5: only a phrase) and template spans in words."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>"

    def work(columns: dict[str, list]) -> Iterator[dict[str, list]]:
        found = [scan_text(t) for t in columns["text"]]
        yield {"doc_id": columns["doc_id"], **{k: [f[k] for f in found] for k in found[0]}}

    return map_batches(texts(docs), work, schema)
