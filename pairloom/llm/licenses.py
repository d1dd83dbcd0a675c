"""License scans: template markup compiled to token automata.

A template is a line of words with markup: ``<<opt>> ... <</opt>>`` is an optional region,
``<<var m-n>>`` stands for m to n words of any kind, ``a|b`` for either word; all other words are
mandatory and must match exactly.  Each template becomes a non-deterministic automaton over words
that is stepped from every place where its first mandatory word could stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases of the base scan and their labels (fixed values of the contract).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_GNU = "gnu <<opt>> lesser|library|affero <</opt>> general public license"
_WORK = "program|library|file|software|package|module"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<opt>> 1|a <</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<opt>> 2|b <</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution {third} "
    "this software is provided by the <<var 1-16>> as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall the <<var 1-16>> be liable for any direct indirect incidental "
    "special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or "
    "business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
    "arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_THIRD = (
    "<<opt>> 3|c <</opt>> neither the name <<opt>> s <</opt>> of <<var 1-16>> nor the names of its|their|his|any <<opt>> other <</opt>> contributors "
    "may be used to endorse or promote products derived from this software without specific prior written permission"
)

#: label -> templates: the published wordings of licences and notices (fixed values), and common short forms
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to "
        "deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or "
        "sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice <<opt>> including the next paragraph <</opt>> shall be included in all copies or "
        "substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited "
        "to the warranties of merchantability fitness for a particular purpose and <<opt>> non <</opt>> noninfringement|infringement in no event shall "
        "the <<var 1-16>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
        "connection with the software or the use or other dealings in the software",
    ),
    "isc": (
        "permission to use copy modify and <<opt>> or <</opt>> distribute this software for any purpose with or without fee is hereby granted "
        "<<opt>> provided that the above copyright notice and this permission notice appear in all copies <</opt>> the software is provided as is and "
        "<<var 1-10>> disclaims|disclaim all warranties with regard to this software including all implied warranties of merchantability and fitness in no "
        "event shall <<var 1-10>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use "
        "data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance "
        "of this software",
    ),
    "bsd-2-clause": (_BSD.format(third=""),),
    "bsd-3-clause": (_BSD.format(third=_THIRD),),
    "apache-2.0": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at <<opt>> http|https <</opt>> www apache org licenses license 2 0 <<opt>> txt|html <</opt>> unless required by applicable law or "
        "agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either "
        "express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    "gpl-header": (
        f"this {_WORK} is free software you can redistribute it and or modify it under the terms of the {_GNU} as published by the free software "
        f"foundation either version 2|3 <<opt>> 0|1 <</opt>> of the license or at your option any later version this {_WORK} is distributed in the hope "
        "that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see "
        f"the {_GNU} for more details <<opt>> you should have received a copy of the {_GNU} along with this {_WORK} <<opt>> if not see <<var 1-8>> <</opt>> <</opt>>",
    ),
    "mit-notice": ("released|licensed|distributed under the <<opt>> terms of the <</opt>> mit license",),
    "apache-notice": ("licensed under the apache license <<opt>> version <</opt>> 2 0",),
    "gpl-notice": ("licensed under the <<opt>> terms of the <</opt>> <<opt>> gnu <</opt>> <<opt>> lesser|affero <</opt>> general public license <<opt>> version|v <<var 1-1>> <</opt>>",),
    "bsd-notice": ("licensed under the <<opt>> new|revised|simplified <</opt>> <<opt>> 2|3 clause <</opt>> bsd license",),
    "cc-by": ("licensed under <<opt>> a|the <</opt>> <<opt>> creative commons <</opt>> cc|attribution <<opt>> by <</opt>> <<opt>> nc|sa|nd <</opt>> <<opt>> nc|sa|nd <</opt>> 1|2|3|4 0|5",),
    "all-rights-reserved": ("copyright <<opt>> c <</opt>> <<var 1-8>> all rights reserved",),
}

#: Words are runs of these bytes after lower-casing A-Z: digits, a-z and all of 0x80 and above.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

State = tuple[dict[bytes, frozenset[int]], frozenset[int]]


class Automaton:
    """Words lead from state to state; ``None`` among the arcs stands for any word."""

    def __init__(self, template: str):
        self.arcs: list[dict[bytes | None, set[int]]] = [{}]
        self.skip: list[set[int]] = [set()]
        at, opens = 0, []
        for part in re.findall(r"<<[^>]*>>|\S+", template):
            if part == "<<opt>>":
                opens.append(at)
            elif part == "<</opt>>":
                self.skip[opens.pop()].add(at)
            elif m := re.fullmatch(r"<<var (\d+)-(\d+)>>", part):
                begun, least, most = at, int(m[1]), int(m[2])
                hops = [begun]
                for _ in range(most):
                    at = self._step(at, [None])
                    hops.append(at)
                for h in hops[least:-1]:
                    self.skip[h].add(at)
            else:
                at = self._step(at, [w.encode() for w in part.split("|")])
        self.end = at
        self.first = {w for s in self._closed({0}) for w in self.arcs[s]}

    def _step(self, at: int, words: list[bytes | None]) -> int:
        self.arcs.append({})
        self.skip.append(set())
        for w in words:
            self.arcs[at].setdefault(w, set()).add(len(self.arcs) - 1)
        return len(self.arcs) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skip[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return seen

    def accepts_at(self, words: list[bytes], at: int) -> int:
        """The end of the longest accepted text from word ``at``, or -1."""
        now, best, i = self._closed({0}), -1, at
        while now:
            if self.end in now:
                best = i
            if i == len(words):
                break
            now = self._closed({t for s in now for w in (words[i], None) for t in self.arcs[s].get(w, ())})
            i += 1
        return best


def evidence(words: int) -> float:
    """How much a match of so many words tells: 0.5 for four, more for longer wordings, below 1."""
    return 1 - 2 ** (-words / 4) if words < 200 else 1.0


class Scanner:
    """All templates at once, over the words of a text."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, base: dict[str, str] = BASE):
        self.automata = [(label, Automaton(t)) for label, ts in templates.items() for t in ts]
        self.by_first: dict[bytes, list[tuple[str, Automaton]]] = {}
        for label, a in self.automata:
            for w in a.first:
                if w is None:
                    raise ValueError(f"template of {label} begins with a replaceable region")
                self.by_first.setdefault(w, []).append((label, a))
        self.base = [(p.encode().split(), label) for p, label in base.items()]
        #: a text without any of these has no match; which words they are is a matter of speed only
        self.hint = re.compile(b"|".join(sorted({re.escape(w) for w in self.by_first} | {re.escape(p[-1]) for p, _ in self.base})))

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float, int]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, n_templates."""
        flat = text.encode().translate(TO_WORDS) if text else b""
        words = flat.split()
        if not self.hint.search(flat):
            return len(words), 0, None, None, "", "", 0.0, 0
        places: list[int] = []
        base: set[str] = set()
        for phrase, label in self.base:
            last, n = phrase[-1], len(phrase)
            i = -1
            while True:
                try:
                    i = words.index(last, i + 1)
                except ValueError:
                    break
                if i >= n - 1 and words[i - n + 1 : i + 1] == phrase:
                    places.append(i - n + 1)
                    base.add(label)
        labels, hits, longest = set(base), 0, max((len(p) for p, label in self.base if label in base), default=0)
        for w in self.by_first.keys() & set(words):
            i = -1
            while True:
                try:
                    i = words.index(w, i + 1)
                except ValueError:
                    break
                for label, automaton in self.by_first[w]:
                    end = automaton.accepts_at(words, i)
                    if end > 0:
                        labels.add(label)
                        hits, longest = hits + 1, max(longest, end - i)
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), evidence(longest), hits


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_templates long"


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per row of ``docs``: key, word and phrase counts, labels, score (the evidence of the
    longest accepted wording or phrase, 0 without any) and the number of accepted places.

    One narrow pass, no shuffle.  Null text has no words; repeated rows are scanned each; labels
    are empty strings where nothing matches.
    """
    told = templates or TEMPLATES
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(told)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                rows = [scanner.scan(t.as_py()) for t in batch.column(1)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[key, *(f.split()[0] for f in FIELDS.split(", "))])

    return docs.select(F.col(key), F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, {FIELDS}")
