"""Operator 8: licence scans by template-markup matching.

A template is wording with two kinds of markup: ``[[ ... ]]`` may be left out, and ``<<n>>``
stands for at most n words of any kind.  Templates compile to token automata, which run from
every place where their first word stands; a label is given when all mandatory wording stands
there word by word.  Templates of licence texts run to the end of their mandatory wording,
conditions and disclaimer included, so a text that opens like one and goes on otherwise has no
label; short notices and identifiers that name a licence are templates of their own.  A notice after
"not" or "never" and an identifier that goes on ("MIT-0") give no label.  Texts that lack the longest
mandatory word of every phrase and template are counted but not cut into words.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerscope.llm import common

# fixed values: the base phrases and their labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions [[1]] the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall <<12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
    "arising from out of or in connection with the software or the use or other dealings in the software")
_ISC = (
    "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and <<12>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall <<12>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software")
_APACHE = (
    "licensed under the apache license version 2 0 [[the license]] you may not use this file except in compliance with the license you may obtain a copy of the license at <<12>> "
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
    "see the license for the specific language governing permissions and limitations under the license")
# the conditions of the BSD forms: source, binary, advertising, endorsement
_SOURCE = "[[1]] [[a]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BINARY = ("[[2]] [[b]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
           "in the documentation and or other materials provided with the distribution")
_ADVERTISING = ("[[3]] [[c]] all advertising materials mentioning features or use of this software must display the following acknowledgement "
                "this product includes software developed by <<20>>")
_ENDORSEMENT = "neither the name of <<16>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"


def _bsd(*conditions: str) -> str:
    """A BSD licence: the grant, its conditions and the disclaimer."""
    return " ".join([
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", *conditions,
        "this software is provided by <<12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall <<12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
        "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
        "arising in any way out of the use of this software even if advised of the possibility of such damage"])


#: label -> templates (wording of public licences and of the notices that name them)
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": ["licensed under [[the terms of]] the apache [[software]] license [[,]] version 2 0", _APACHE, "spdx license identifier apache 2 0"],
    "mit": ["released under the [[terms of the]] mit license", "licensed under the mit license", "spdx license identifier mit", _MIT],
    "isc": [_ISC, "spdx license identifier isc"],
    "bsd-2-clause": [_bsd(_SOURCE, _BINARY), "spdx license identifier bsd 2 clause"],
    "bsd-3-clause": [_bsd(_SOURCE, _BINARY, f"[[3]] [[c]] {_ENDORSEMENT}"), "spdx license identifier bsd 3 clause"],
    "bsd-4-clause": [_bsd(_SOURCE, _BINARY, _ADVERTISING, f"[[4]] [[d]] {_ENDORSEMENT}"), "spdx license identifier bsd 4 clause"],
    "gpl-3.0": ["licensed under the gnu general public license [[,]] version 3", "spdx license identifier gpl 3 0 [[only]] [[or later]]"],
    "gpl-notice": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version <<2>> of the license or at your option any later version"],
    "lgpl-notice": ["this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version <<2>> of the license or at your option any later version"],
    "cc-by-4.0": ["licensed under [[a]] [[the]] [[creative commons]] cc by 4 0", "licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa-4.0": ["licensed under [[the]] cc by sa 4 0"],
    "cc-by-nc-4.0": ["licensed under [[the]] cc by nc 4 0"],
    "copyright": ["copyright [[c]] <<8>> all rights reserved"],
}
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


class Automaton:
    """States of one template; ``None`` on an arc stands for any word."""

    def __init__(self, template: str):
        self.arcs: list[dict[bytes | None, set[int]]] = [{}]
        self.skips: dict[int, set[int]] = defaultdict(set)
        mandatory: list[bytes] = []
        opened: list[int] = []
        now = 0
        for mark, n, word in re.findall(r"(\[\[|\]\])|<<(\d+)>>|([0-9a-z\x80-\U0010ffff]+)", template.lower()):
            if mark == "[[":
                opened.append(now)
            elif mark == "]]":
                self.skips[opened.pop()].add(now)
            elif n:
                first = now
                for _ in range(int(n)):
                    now = self._arc(now, None)
                for state in range(first, now):
                    self.skips[state].add(now)
            else:
                now = self._arc(now, word.encode())
                if not opened:
                    mandatory.append(word.encode())
        self.last, self.key = now, max(mandatory, key=len)
        self.begin = self._closure({0})

    def _arc(self, state: int, word: bytes | None) -> int:
        self.arcs.append({})
        self.arcs[state].setdefault(word, set()).add(len(self.arcs) - 1)
        return len(self.arcs) - 1

    def _closure(self, states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.skips.get(todo.pop(), ()):
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def first_words(self) -> set[bytes]:
        return {w for s in self.begin for w in self.arcs[s] if w}

    def end_of_match(self, words: list[bytes], at: int) -> int:
        """Where the longest accepted text that starts at word ``at`` ends; -1 if there is none."""
        states, end = self.begin, -1
        while states and at < len(words):
            reached = set()
            for s in states:
                reached |= self.arcs[s].get(words[at], set()) | self.arcs[s].get(None, set())
            at += 1
            states = self._closure(reached)
            if self.last in states:
                end = at
        return end


#: a notice that begins with one of these words says the contrary after one of those
_NOTICE, _DENIED = {b"released", b"licensed"}, {b"not", b"never"}
#: what stands after the last word of an identifier that goes on
_GOES_ON = re.compile(rb"[-.+_]+[a-z0-9]")


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]]):
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.automata = [(Automaton(t), label) for label, ts in templates.items() for t in ts]
        self.keys = sorted({max(p, key=len) for p, _ in self.phrases} | {a.key for a, _ in self.automata})
        self.by_first: dict[bytes, list] = defaultdict(list)
        for p, label in self.phrases:
            self.by_first[p[0]].append((p, label, True))
        for a, label in self.automata:
            for w in a.first_words():
                self.by_first[w].append((a, label, False))

    def __call__(self, text: str) -> tuple[int, list[tuple[str, int, int, bool]]]:
        """The number of words; label, first word, end word and whether it is a base phrase, by place."""
        low = text.encode().lower()
        if not any(k in low for k in self.keys):
            mask = _IS_WORD[np.frombuffer(low, np.uint8)]
            return int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(len(mask) > 0 and mask[0]), []
        words, found = _WORD.findall(low), []

        def whole_identifier(end: int) -> bool:
            """Whether an identifier ends with word ``end - 1``: "MIT-0" and "MIT.x" go on."""
            last = next(itertools.islice(_WORD.finditer(low), end - 1, None)).end()
            return _GOES_ON.match(low, last) is None

        for at, word in enumerate(words):
            for what, label, base in self.by_first.get(word, ()):
                if base:
                    if words[at:at + len(what)] == what:
                        found.append((label, at, at + len(what), True))
                elif not (at and words[at - 1] in _DENIED and word in _NOTICE) and (end := what.end_of_match(words, at)) >= 0:
                    if word != b"spdx" or whole_identifier(end):
                        found.append((label, at, end, False))
        return len(words), found


MATCHES = "doc_id long, n_words long, matches array<struct<label:string,first:long,end:long,base:boolean>>"


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Per document its words and every match: label, first word, end (exclusive), base phrase or template.

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII, lower-cased
    in ASCII.  Null and empty texts have no words and no matches; repeated rows and null ids are
    carried; other columns are ignored.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates

    def work(batches):
        scanner = Scanner(phrases, templates)
        kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in common.slices(batches):
            got = [scanner(t) for t in batch.column("text").to_pylist()]
            matches = [[dict(zip(("label", "first", "end", "base"), m)) for m in ms] for _, ms in got]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in got], pa.int64()), pa.array(matches, kind)], names=["doc_id", "n_words", "matches"])

    return common.texts_of(docs).mapInArrow(work, MATCHES)


def summary(docs: DataFrame) -> DataFrame:
    """The contract's columns; ``score`` is the share of words that stand in matches."""
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    covered = F.aggregate("matches", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
                          lambda a, m: F.struct(F.greatest(a["end"], m["end"]).alias("end"), (a["n"] + F.greatest(m["end"] - F.greatest(a["end"], m["first"]), F.lit(0))).alias("n")))["n"]
    return scan(docs).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["first"])).alias("first_word"), F.array_max(F.transform(base, lambda m: m["first"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.when(F.col("n_words") > 0, covered / F.col("n_words")).otherwise(0.0).alias("score"))
