"""License scan by template-markup matching.

A template is wording with markup: `[ ... ]` is an optional region, `{n}` a replaceable one of at
most n words. Templates compile to token automata over word hashes; a text is accepted where all
mandatory words stand in order. Automata start only at places where a template's lead stands: its
first mandatory words up to the next region, four at most, found for all texts of a batch at once.
Words are lower-cased (A-Z) runs of a-z, 0-9 and non-ASCII.

The catalogue covers the whole MIT, ISC, zero-clause, two-clause and three-clause BSD texts, and the
standard notices of the GPL, LGPL, AGPL, Apache, MPL and CC BY-NC licences; the long licences themselves
are known by their notices and titles only.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit

#: Fixed base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of {4} and associated documentation files {3} to deal in {3} without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of {3} and to permit persons to whom {3} is furnished to do so subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of {3}"
_AS_IS = "{3} is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {6} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with {3} or the use or other dealings in {3}"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_NO_NAMES = "[3] neither the name of {12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_AS_IS = "this software is provided by {12} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {12} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
_ISC_KEEP = "provided that the above copyright notice and this permission notice appear in all copies"
_ISC_AS_IS = "the software is provided as is and {6} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {6} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"


def _gnu(name: str, version: str) -> tuple[str, ...]:
    """A GNU licence's notice, whole and in the short forms that name the version."""
    title = f"gnu {name} general public license" if name else "gnu general public license"
    return (
        f"{{8}} is free software you can redistribute it and or modify it under the terms of the {title} as published by the free software foundation either version {version} of the license or at your option any later version",
        f"licensed under the [terms of the] {title} [as published by the free software foundation] [either] version {version}",
    )


#: Fixed wording of the templates, by label.
TEMPLATES = {
    "mit-text": (f"{_GRANT} {_AS_IS}",),
    "mit-license": ("licensed under the [terms of the] mit license", "released under the [terms of the] mit license", "distributed under the [terms of the] mit license"),
    "isc": (f"{_ISC} {_ISC_KEEP} {_ISC_AS_IS}",),
    "0bsd": (f"{_ISC} {_ISC_AS_IS}",),
    "bsd-2-clause": (f"{_BSD} {_BSD_AS_IS}",),
    "bsd-3-clause": (f"{_BSD} {_NO_NAMES} {_BSD_AS_IS}",),
    "apache-2.0": (
        "licensed under the apache license version 2 0 [the license] you may not use this file except in compliance with the license you may obtain a copy of the license at [http] [https] www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "licensed under the apache license version 2 0",
    ),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [http] [https] mozilla org mpl 2 0",),
    "gpl-2.0": _gnu("", "2"),
    "gpl-3.0": _gnu("", "3"),
    "lgpl-2.1": _gnu("lesser", "2 1"),
    "lgpl-3.0": _gnu("lesser", "3"),
    "agpl-3.0": _gnu("affero", "3"),
    "cc-by-nc-4.0": ("licensed under [a] [the] [creative commons] [attribution noncommercial] cc by nc 4 0 [international] [license]", "licensed under a creative commons attribution noncommercial 4 0 international license"),
}
LEAD = 4
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


class Automaton:
    """A template compiled to states: word states, and skip edges for optional and replaceable regions."""

    def __init__(self, template: str):
        self.words: list[int | None] = []  # None: any word, of a replaceable region
        self.skips: dict[int, list[int]] = {}
        self.mandatory = 0
        self.lead: list[int] = []
        self.done: dict[int, int] = {}  # mandatory words before a state
        for part in re.findall(r"\[[^\]]*\]|\{\d+\}|[^\s\[\]{}]+", template):
            at = len(self.words)
            if part[0] in "[{":
                opened = bool(self.lead)
            if part[0] == "[":
                own = part[1:-1].split()
                self.words += [textkit.hash_word(w) for w in own]
                self.skips.setdefault(at, []).append(len(self.words))
            elif part[0] == "{":
                n = int(part[1:-1])
                self.words += [None] * n
                for k in range(n):
                    self.skips.setdefault(at + k, []).append(at + n)
            else:
                if not self.mandatory:
                    self.lead_at, opened = at, False
                if not opened and len(self.lead) < LEAD:
                    self.lead.append(textkit.hash_word(part))
                self.words.append(textkit.hash_word(part))
                self.mandatory += 1
            self.done.update((k, self.mandatory) for k in range(at + 1, len(self.words) + 1))
        self.end = len(self.words)

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skips.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def matches(self, hashes: np.ndarray, at: int, stop: int) -> float:
        """Largest share of the mandatory words that stand in order from `at` on; 1 where the text is accepted."""
        states, best, k = self.closure({self.lead_at}), 0, at
        while states:
            best = max(best, max(self.done.get(s, 0) for s in states))
            if self.end in states or k >= stop:
                break
            h = int(hashes[k])
            states = self.closure({s + 1 for s in states if s < self.end and (self.words[s] is None or self.words[s] == h)})
            k += 1
        return 1.0 if self.end in states else min(best, self.mandatory - 1) / self.mandatory


def _places(hashes: np.ndarray, rows: np.ndarray, phrase: Sequence[int]) -> np.ndarray:
    at = np.flatnonzero(hashes == np.uint64(phrase[0]))
    at = at[at + len(phrase) <= len(hashes)]
    for k, h in enumerate(phrase[1:], 1):
        at = at[hashes[at + k] == np.uint64(h)]
    return at[rows[at] == rows[at + len(phrase) - 1]]


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, Sequence[str]] = TEMPLATES) -> DataFrame:
    """Phrases and templates found in each text: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of the phrases, first_word and last_word are their smallest and largest
    start (null without one). labels has the phrases' labels and those of accepted templates. score
    is the largest share of a template's mandatory wording that stands in order from its lead on: 1
    for an accepted one, less where a text breaks off or was altered; a phrase is a wording of its
    own and counts 1; 0 where nothing starts. A null text counts as empty; repeated rows and null
    ids are returned each; other columns are ignored; an empty table gives no rows. All labels of
    equal score are given.
    """
    base = [([textkit.hash_word(w) for w in p.split()], label) for p, label in phrases.items()]

    def scan(batches):
        automata = [(label, Automaton(t)) for label, ts in templates.items() for t in ts]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rows, hashes = textkit.words(batch.column(1), textkit.NOT_ALNUM, lower=True)
            first = textkit.first_of_row(rows, n)
            count, low, high = np.zeros(n, np.int64), np.full(n, 1 << 62), np.full(n, -1)
            found: list[set[str]] = [set() for _ in range(n)]
            more: list[set[str]] = [set() for _ in range(n)]
            score = np.zeros(n)
            for words, label in base:
                at = _places(hashes, rows, words)
                r = rows[at]
                np.add.at(count, r, 1)
                np.minimum.at(low, r, at - first[r])
                np.maximum.at(high, r, at - first[r])
                score[r] = 1.0
                for k in np.unique(r):
                    found[k].add(label)
            for label, a in automata:
                for at in _places(hashes, rows, a.lead):
                    r = int(rows[at])
                    if label not in more[r]:
                        share = a.matches(hashes, int(at), int(first[r + 1]))
                        score[r] = max(score[r], share)
                        if share == 1:
                            more[r].add(label)
            has = count > 0
            yield pa.record_batch([
                batch.column(0), np.diff(first), count, pa.array(low, mask=~has), pa.array(high, mask=~has),
                [",".join(sorted(x)) for x in found], [",".join(sorted(x | y)) for x, y in zip(found, more)], score], schema=_RESULT)

    return df.selectExpr(f"cast(`{id_col}` as bigint) as id", f"cast(`{text_col}` as string) as text").mapInArrow(scan, RESULT)
