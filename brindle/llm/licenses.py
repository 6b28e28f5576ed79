"""License scan: phrases, and templates compiled into word automata.

A template is license wording with two kinds of markup. ``{{ ... }}`` may be
left out; ``<<n>>`` stands for up to n words of any kind (a name, a year). What
is outside both is mandatory and has to be there word for word. A template is
compiled once into an automaton over words, and all of them are one automaton that reads a text
once: a run begins at every word that may begin a template, and runs that stand at the same
place of a template are one. Sets of places are states of their own, made when they are
first met, so a word costs a step, however many runs there are. A text is accepted for a
template if a run reaches the end.

Labels that end in ``-full`` stand for a license's whole wording, where what is changed or added
inside takes the label away. The others stand for excerpts and notices: a match says that
their wording is there, and nothing of what the text says after it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate
from operator import getitem

from pyspark.sql import DataFrame

from brindle.llm.texts import with_fields

# Bytes of ASCII that are no part of a word become spaces, and A-Z are lowered. In
# UTF-8 all bytes of a character past ASCII are 0x80 or more, and stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else
              c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

#: Phrases and the labels they stand for.
PHRASES = {
    "the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# the clause on names stands between the conditions and the disclaimer, or not
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met: {{1}} Redistributions of source "
    "code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. {{2}} Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation "
    "{{and}} {{or}} other materials provided with the distribution. %s THIS SOFTWARE IS PROVIDED "
    "BY <<8>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL <<8>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT "
    "OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")

#: Wording of public licenses and of the usual notices that name them.
TEMPLATES = {
    "mit": [
        "{{Released}} {{or}} {{licensed}} under the {{terms of the}} MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of "
        "<<6>> software and associated documentation files {{(the \"Software\")}}, to deal in "
        "the Software without restriction, including without limitation the rights to use, "
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject "
        "to the following conditions: The above copyright notice and this permission notice "
        "{{(including the next paragraph)}} shall be included in all copies or substantial "
        "portions of the Software.",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0 {{(the \"License\")}}",
    ],
    "cc-by-nc": [
        "{{This <<3>> is}} licensed under {{a}} {{the}} CC BY-NC {{<<2>>}} {{license}}",
        "licensed under {{a}} {{the}} Creative Commons Attribution-NonCommercial "
        "{{<<2>>}} {{International}} License",
    ],
    "gpl-3": [
        "{{This <<3>> is}} licensed under {{the terms of}} the GNU General Public License, "
        "{{as published by the Free Software Foundation,}} {{either}} version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies",
    ],
    "mit-full": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of "
        "<<6>> software and associated documentation files {{(the \"Software\")}}, to deal in "
        "the Software without restriction, including without limitation the rights to use, "
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject "
        "to the following conditions: The above copyright notice and this permission notice "
        "{{(including the next paragraph)}} shall be included in all copies or substantial "
        "portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL <<8>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "isc-full": [
        "Permission to use, copy, modify, {{and}} {{or}} distribute this software for any "
        "purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS "
        "IS\" AND <<6>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<6>> BE LIABLE "
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ],
    "bsd-2-full": [_BSD % ""],
    "bsd-3-full": [_BSD % (
        "{{3}} Neither the name of <<8>> nor the names of <<2>> contributors may be used to "
        "endorse or promote products derived from this software without specific prior written "
        "permission.")],
}


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lowered, as UTF-8: digits, a-z and all past ASCII."""
    return (text or "").encode().translate(_FOLD).split()


class Automaton:
    """States are places in a template; an edge takes a word, any word, or none.

    A place knows how many mandatory words stand before it.
    """

    def __init__(self, template: str):
        self.edges: list[list[tuple[bytes | None, int]]] = [[]]  # word (None: any), target
        self.skips: list[list[int]] = [[]]
        self.met: list[int] = [0]  # mandatory words on the way to a state
        depth: list[int] = []
        for mark, gap, wording in re.findall(r"(\{\{|\}\})|<<(\d+)>>|((?:(?!\{\{|\}\}|<<).)+)",
                                             template):
            if mark == "{{":
                depth.append(len(self.edges) - 1)
            elif mark == "}}":
                self.skips[depth.pop()].append(len(self.edges) - 1)
            elif gap:
                first = len(self.edges) - 1
                for _ in range(int(gap)):
                    self._step(None, False)
                for state in range(first, len(self.edges) - 1):
                    self.skips[state].append(len(self.edges) - 1)
            else:
                for word in words_of(wording):
                    self._step(word, not depth)
        self.end = len(self.edges) - 1
        self.mandatory = self.met[-1]

    def _step(self, word: bytes | None, mandatory: bool) -> None:
        self.edges[-1].append((word, len(self.edges)))
        self.met.append(self.met[-1] + mandatory)
        self.edges.append([])
        self.skips.append([])

    def closed(self, states: set[int]) -> set[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return found


class _State(dict):
    """Places in which runs stand, with the state that follows by a word of the templates.

    ``score`` is the largest share of a template's mandatory words that a run has met,
    ``labels`` what is accepted here.
    """

    __slots__ = ("_all", "_places", "score", "labels")
    __hash__, __eq__ = object.__hash__, object.__eq__

    def __init__(self, matcher: Matcher, places: frozenset[tuple[int, int]]):
        super().__init__()
        self._all, self._places = matcher, places
        shares = [(matcher.told[t][1].met[s] / matcher.told[t][1].mandatory, t, s)
                  for t, s in places]
        self.labels = {matcher.told[t][0] for _, t, s in shares if s == matcher.told[t][1].end}
        self.score = 1.0 if self.labels else max((share for share, *_ in shares), default=0.0)

    def __missing__(self, word: bytes | None) -> _State:
        self[word] = found = self._all.after(self._places, word)
        return found


class Matcher:
    """All templates as one automaton, whose states are made as texts need them."""

    def __init__(self, templates: dict[str, list[str]], most: int = 50_000):
        self.told = [(label, Automaton(t)) for label, found in templates.items() for t in found]
        words = {w for _, a in self.told for edges in a.edges for w, _ in edges if w is not None}
        self._words, self._most = {w: w for w in words}, most
        self._states: dict[frozenset, _State] = {}
        # a run begins with a word that is told, never with any word
        self._firsts: dict[bytes, set[tuple[int, int]]] = {}
        for t, (_, a) in enumerate(self.told):
            for state in a.closed({0}):
                for word, to in a.edges[state]:
                    if word is not None:
                        self._firsts.setdefault(word, set()).add((t, to))

    def _state(self, places: frozenset) -> _State:
        if places not in self._states:
            self._states[places] = _State(self, places)
        return self._states[places]

    def after(self, places: frozenset, word: bytes | None) -> _State:
        reached = set(self._firsts.get(word, ()))
        for t, state in places:
            reached.update((t, to) for w, to in self.told[t][1].edges[state]
                           if w is None or w == word)
        return self._state(frozenset(
            (t, s) for t, to in reached for s in self.told[t][1].closed({to})))

    def match(self, words: list[bytes]) -> tuple[set[str], float]:
        """The labels accepted anywhere, and the largest share of a template's mandatory words."""
        if len(self._states) > self._most:
            self._states = {}
        # other words than the templates' are all the same to them
        met = set(accumulate(map(self._words.get, words), getitem,
                             initial=self._state(frozenset())))
        return set().union(*(s.labels for s in met)), max(s.score for s in met)


@functools.cache
def matcher() -> Matcher:
    return Matcher(TEMPLATES)


def scan(text: str | None, phrases: dict[str, str] = PHRASES) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in phrases.items():
        wanted = b" " + phrase.encode() + b" "
        before, place, at = 0, 0, line.find(wanted)
        while at >= 0:
            place += line.count(b" ", before, at)
            places.append(place)
            base.add(label)
            before, at = at, line.find(wanted, at + 1)
    labels, score = matcher().match(words)
    # the module's phrases are labels of the method, whichever phrases are counted
    named = base | {label for phrase, label in PHRASES.items()
                    if b" " + phrase.encode() + b" " in line}
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels | named)), 1.0 if named else score)


FIELDS = ("n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double")


def _rows(phrases: dict[str, str], texts: Iterable[str | None]) -> Iterator[tuple]:
    return (scan(text, phrases) for text in texts)


def scan_licenses(df: DataFrame, text: str, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """``df`` with n_words, n_base, first_word, last_word, base_labels, labels and score.

    ``n_base`` counts all places of ``phrases``, first_word and last_word are the
    least and greatest (words from 0; null without any). ``labels`` adds what ``PHRASES`` and
    the templates stand for; ``score`` is 1 where a phrase or a template is met, else
    the greatest share of a template's mandatory words that stand in a row from a
    place where it may begin. Texts are read whole, row by row: nothing is
    shuffled and memory holds an Arrow batch; time is in proportion to a text's length. A null
    or empty text has no words, no labels and score 0. Repeated rows get the same each; an empty
    table gives no rows. Columns named like a result are replaced by it.
    """
    return with_fields(df, text, FIELDS, functools.partial(_rows, phrases))
