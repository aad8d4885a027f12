"""License scans: licence notices matched as templates with optional and replaceable regions.

Words: A-Z are lower-cased, and a word is a run of characters other than U+0000-2F, U+3A-60 and U+7B-7F.
A template is text with two kinds of markup: ``[[...]]`` may be missing, and ``<<n>>`` stands for 0 to n words of any
kind (years, holders, versions). Short licences are there with their whole text, so one whose conditions or disclaimer were altered isn't
taken for it; longer ones by the notice that applies them. References by name have templates of their own. Each template is compiled to an automaton over words; a place matches where the mandatory wording stands exactly.
Only places whose word begins some template are tried: a batch's words are hashed at once, and the automaton confirms each
place on the words themselves.

Base phrases are counted at every place where their words stand consecutively. The score is 0 without a label, and
otherwise 1 - 0.5 ** (words in matches / 2), so that longer or more notices score closer to 1.

Edge cases: a null or empty text has no words, null places, empty labels and score 0; repeated rows give repeated results;
overlapping matches all count; a text longer than a slice is read whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrowtext as at

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: What may stand before or in a licence's text: the copyright line, and a holder's name in place of the usual words.
_COPYRIGHT = "[[copyright [[c]] <<12>> [[all rights reserved]]]]"
_HOLDER = "[[the]] [[copyright holder]] [[copyright owner]] [[authors]] [[author]] [[<<6>>]]"
_DISCLAIMER = f"""this software is provided by {_HOLDER} [[and contributors]] as is and any express or implied warranties including but not limited to the
implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {_HOLDER} [[or contributors]] be liable for
any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services
loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort
including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
and or other materials provided with the distribution"""
_BSD3 = f"""[[3]] neither the name of {_HOLDER} nor the names of [[its]] [[their]] [[any]] contributors may be used to endorse or promote products derived from this
software without specific prior written permission"""
#: Labels and their templates: the whole wording of short licences, the notices that longer ones are applied by, and references by name.
TEMPLATES = {
    "apache-2.0": [
        """licensed under the apache license version 2 0 the license you may not use this [[file]] [[software]] [[work]] except in compliance with the license you may obtain a copy of
        the license at [[http]] [[https]] www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed
        under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the
        specific language governing permissions and limitations under the license""",
        "licensed under the apache license [[,]] version 2 0", "[[spdx]] license identifier apache 2 0",
    ],
    "mit": [
        f"""[[[[the]] mit license [[mit]]]] {_COPYRIGHT} permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
        files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the
        following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or
        substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to
        the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {_HOLDER} [[or copyright holders]] be liable
        for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software
        or the use or other dealings in the software""",
        "[[released]] [[licensed]] under the mit license", "license identifier mit",
    ],
    "bsd-2-clause": [f"{_COPYRIGHT} {_BSD} {_DISCLAIMER}"],
    "bsd-3-clause": [f"{_COPYRIGHT} {_BSD} {_BSD3} {_DISCLAIMER}"],
    "bsd": ["under the [[<<2>>]] bsd license", "license identifier bsd <<2>> clause"],
    "isc": [
        f"""{_COPYRIGHT} permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above
        copyright notice and this permission notice appear in all copies the software is provided as is and {_HOLDER} disclaims all warranties with regard to
        this software including all implied warranties of merchantability and fitness in no event shall {_HOLDER} be liable for any special direct indirect or
        consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other
        tortious action arising out of or in connection with the use or performance of this software""",
        "license identifier isc",
    ],
    "zlib": [
        f"""{_COPYRIGHT} this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from
        the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and
        redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you
        wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not
        required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may
        not be removed or altered from any source distribution""",
        "license identifier zlib",
    ],
    "gpl": [
        """[[this program is free software you can redistribute it and or modify it]] under the terms of the gnu [[lesser]] [[affero]] general public license as
        published by the free software foundation either version <<1>> of the license or at your option any later version [[this program is distributed in the
        hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the
        gnu [[lesser]] [[affero]] general public license for more details]]""",
        "under the [[terms of the]] gnu [[lesser]] [[affero]] general public license [[as published by the free software foundation]] [[either]] version <<2>>",
        "license identifier gpl",
    ],
    "mpl-2.0": [
        """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can
        obtain one at [[http]] [[https]] mozilla org mpl 2 0""",
        "license identifier mpl 2 0",
    ],
    "cc-by-nc": ["cc by nc", "creative commons attribution non commercial", "creative commons attribution noncommercial"],
    "cc-by": ["licensed under [[a]] [[the]] creative commons attribution [[<<2>>]] [[international]] license"],
    "unlicense": [
        """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this
        software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means [[in jurisdictions that
        recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we
        make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an
        overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law]] the software is provided as is
        without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and
        noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise
        arising from out of or in connection with the software or the use or other dealings in the software""",
    ],
    "public-domain": ["dedicated to the public domain", "cc0"],
    "copyright": ["copyright [[c]] <<6>> all rights reserved"],
}

_WORD = np.ones(256, bool)
_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
_SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Automaton:
    """A template as edges between states: edges[s] lists (word or None for any, next state); skips are followed for free."""

    def __init__(self, template: str):
        self.edges: dict[int, list[tuple[bytes | None, int]]] = defaultdict(list)
        self.skips: dict[int, set[int]] = defaultdict(set)
        self.last = self._build(template, 0)[0]
        self.first = {w for s in self._closed({0}) for w, _ in self.edges[s]}
        if None in self.first or self.last in self._closed({0}):
            raise ValueError(f"a template begins with mandatory wording: {template}")

    def _build(self, template: str, state: int) -> tuple[int, int]:
        """Adds the template's states after ``state``; gives its last state and the count of states so far."""
        count = state
        for token in re.findall(r"\[\[|\]\]|<<\d+>>|[^\s\[\]<>]+", template):
            if token == "[[":
                self._open = [*getattr(self, "_open", []), state]
            elif token == "]]":
                self.skips[self._open.pop()].add(state)
            elif token.startswith("<<"):
                begin = state
                for _ in range(int(token[2:-2])):
                    count += 1
                    self.edges[state].append((None, count))
                    self.skips[begin].add(count)
                    state = count
            else:
                for word in _SPLIT.findall(token.lower()):
                    count += 1
                    self.edges[state].append((word.encode(), count))
                    state = count
        return state, count

    def _closed(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in self.skips.get(todo.pop(), ()):
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def match(self, word_at, place: int, stop: int) -> int:
        """Words of the longest match that begins at ``place``, or 0."""
        now, best, k = self._closed({0}), 0, place
        while now and k < stop:
            word = word_at(k)
            now = self._closed({t for s in now for w, t in self.edges.get(s, ()) if w is None or w == word})
            k += 1
            if self.last in now:
                best = k - place
        return best


class Scanner:
    def __init__(self):
        self.phrases = [([w.encode() for w in p.split()], label) for p, label in PHRASES.items()]
        self.automata = [(Automaton(t), label) for label, templates in TEMPLATES.items() for t in templates]
        self.begins: dict[bytes, tuple[list, list]] = defaultdict(lambda: ([], []))
        for words, label in self.phrases:
            self.begins[words[0]][0].append((words, label))
        for automaton, label in self.automata:
            for word in automaton.first:
                self.begins[word][1].append((automaton, label))
        self.hashes = np.array([at.token_hash(w.decode()) for w in self.begins], np.uint64)

    def scan(self, texts: pa.Array) -> list[tuple]:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score) of each text."""
        data, offsets = at.bytes_of(texts)
        data = at.LOWER[data]
        starts, ends, row_starts = at.runs(_WORD[data], offsets)
        n = len(offsets) - 1
        base: list[list[int]] = [[] for _ in range(n)]
        labels: list[tuple[set, set]] = [(set(), set()) for _ in range(n)]
        covered = [0] * n
        raw = data.tobytes()
        if len(starts):
            # a word of a template is at most this long, so longer words need no hash
            short = np.flatnonzero(ends - starts <= max(map(len, self.begins)))
            tried = short[np.isin(at.RollingHash(data).ranges(starts[short], ends[short]), self.hashes)]
            rows = np.searchsorted(row_starts, tried, "right") - 1

            def word_at(k: int) -> bytes:
                return raw[starts[k] : ends[k]]

            for k, r in zip(tried.tolist(), rows.tolist(), strict=True):
                stop = int(row_starts[r + 1])
                phrases, automata = self.begins.get(word_at(k), ((), ()))
                longest = 0
                for words, label in phrases:
                    if k + len(words) <= stop and all(word_at(k + i) == w for i, w in enumerate(words)):
                        base[r].append(k - int(row_starts[r]))
                        labels[r][0].add(label)
                        longest = max(longest, len(words))
                for automaton, label in automata:
                    if size := automaton.match(word_at, k, stop):
                        labels[r][1].add(label)
                        longest = max(longest, size)
                covered[r] += longest
        return [(int(row_starts[r + 1] - row_starts[r]), len(base[r]), min(base[r], default=None), max(base[r], default=None), ",".join(sorted(labels[r][0])), ",".join(sorted(labels[r][0] | labels[r][1])), 1 - 0.5 ** (covered[r] / 2)) for r in range(n)]


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner()
        for batch in batches:
            for part, texts in at.slices(batch, "text"):
                found = zip(*own.scan(texts), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], ["doc_id", *columns])

    return documents.select("doc_id", "text").mapInArrow(scanned, f"doc_id {dict(documents.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
