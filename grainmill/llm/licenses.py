"""Licence scans: templates with optional and replaceable regions, as token automata."""

from __future__ import annotations

import pkgutil
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, as_bytes, runs_of_rows

#: Words are runs of digits, letters and all code points from U+0080 on.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that give a label wherever their words stand together.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Licence wordings, in the words of their texts.  ``[...]`` may be left out, and regions nest.  ``{n}``
#: stands for up to n words of any kind, ``{m-n}`` for m to n of them, ``{n:x}`` for up to n words that the pattern x
#: takes whole, ``{a|b}`` for one of the words named.  Typographic quotes belong to the words beside them.
TEMPLATES = (
    # texts
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the {software|“software”} to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software [the software is provided {as|“as} {is|is”} without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and {noninfringement|infringement} in no event shall the {authors|author|holders} [or copyright holders] be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software]"),
    ("isc", "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies [the software is provided {as|“as} {is|is”} and {1-6} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {1-6} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software]"),
    ("0bsd", "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted the software is provided {as|“as} {is|is”} and {1-6} disclaims all warranties with regard to this software"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {1:[1a]} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer {1:[2b]} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by {1-10} {as|“as} {is|is”} and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {1-10} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {1:[1a]} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer {1:[2b]} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution {1:[3c4d]} neither the name of {1-12} may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by {1-10} {as|“as} {is|is”} and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {1-10} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("zlib", "this software is provided {as|“as} {is|is”} without any express or implied warranty in no event will the {authors|author} be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions {1:1} the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required {1:2} altered source versions must be plainly marked as such and must not be misrepresented as being the original software {1:3} this notice may not be removed or altered from any source distribution"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the {software|“software”} to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor the software is provided {as|“as} {is|is”} without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided {as|“as} {is|is”} without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("wtfpl", "do what the {1-2:[a-z]+} you want to public license"),
    # headings, first clauses and notices: not the licence, but a text that names it
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {1:[1a]} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsl-1.0-notice", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense-notice", "this is free and unencumbered software released into the public domain"),
    ("apache-2.0-notice", "apache license version 2 0 january 2004 {5} terms and conditions for use reproduction and distribution"),
    ("gpl-2.0-notice", "gnu general public license version 2 june 1991 copyright {1:c|©} {2:[0-9]+} free software foundation inc {24} everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-3.0-notice", "gnu general public license version 3 29 june 2007 copyright {1:c|©} {2:[0-9]+} free software foundation inc {8} everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("agpl-3.0-notice", "gnu affero general public license version 3 19 november 2007 copyright {1:c|©} {2:[0-9]+} free software foundation inc {8} everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("mit-notice", "[this] {4} released under the [terms of the] mit license"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0 [the {license|“license”} [you may not use this file except in compliance with the license [you may obtain a copy of the license at {6}]] [unless required by applicable law or agreed to in writing software distributed under the license is distributed on an {as|“as} {is|is”} basis without warranties or conditions of any kind either express or implied]]"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0-notice", "licensed under the [terms of the] gnu general public license [as published by the free software foundation] [either] [version] [v] 2"),
    ("gpl-3.0-notice", "licensed under the [terms of the] gnu general public license [as published by the free software foundation] [either] [version] [v] 3"),
    ("gpl-2.0-notice", "under the terms of the gnu general public license [as published by the free software foundation] [either] version 2"),
    ("gpl-3.0-notice", "under the terms of the gnu general public license [as published by the free software foundation] [either] version 3"),
    ("lgpl-notice", "licensed under the [terms of the] gnu lesser general public license [version] {2}"),
    ("lgpl-notice", "under the terms of the gnu {lesser|library} general public license [as published by the free software foundation]"),
    ("agpl-3.0-notice", "under the terms of the gnu affero general public license [as published by the free software foundation] [either] version 3"),
    ("mpl-2.0-notice", "this source code form is subject to the terms of the mozilla public license v 2 0 [if a copy of the mpl was not distributed with this file you can obtain one at {6}]"),
    ("epl-2.0-notice", "made available under the terms of the eclipse public license [v] 2 0"),
    ("cc-by-notice", "licensed under [the] [a] [creative commons] cc by [4] [3] 0"),
    ("cc-by-sa-notice", "licensed under [the] [a] [creative commons] cc by sa [4] [3] 0"),
    ("cc-by-nc-notice", "licensed under [the] [a] [creative commons] cc by nc [4] [3] 0"),
    ("cc-by-nc-notice", "licensed under a creative commons attribution {noncommercial|non} [commercial] {2:[0-9]+} [{international|unported}] license"),
    ("cc-by-sa-notice", "licensed under a creative commons attribution {sharealike|share} [alike] {2:[0-9]+} [{international|unported}] license"),
    ("cc-by-notice", "licensed under a creative commons attribution {2:[0-9]+} [{international|unported}] license"),
)
#: Long licences, whose texts stand beside this module, with the first and the last words of their terms.
WHOLE = (
    ("apache-2.0", "terms and conditions for use reproduction and distribution 1 definitions", "accepting any such warranty or additional liability"),
    ("mpl-2.0", "1 definitions 1 1 contributor", "the notice described in exhibit b of this license must be attached"),
    ("gpl-2.0", "0 this license applies to any program", "advised of the possibility of such damages"),
    ("gpl-3.0", "0 definitions this license refers to version 3", "accompanies a copy of the program in return for a fee"),
)
#: Share of mandatory words from which an incomplete wording counts in the score.
PARTIAL = 0.5


@dataclass(frozen=True)
class Automaton:
    """States are places before a node; each node takes one word of a set or by a pattern, and may be skippable to another state."""

    label: str
    nodes: tuple[frozenset[bytes] | re.Pattern[bytes] | None, ...]  # None takes any word
    skips: dict[int, tuple[int, ...]]
    done: tuple[int, ...]  # mandatory words before each state

    def takes(self, state: int, word: bytes) -> bool:
        node = self.nodes[state]
        if isinstance(node, frozenset):
            return word in node
        return node is None or node.fullmatch(word) is not None

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skips.get(todo.pop(), ()):
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def firsts(self) -> set[bytes]:
        """Fixed words that can come first, replaceable ones left aside."""
        return {w for s in self.closure({0}) if s < len(self.nodes) and isinstance(self.nodes[s], frozenset) for w in self.nodes[s]}

    def needs(self) -> tuple[frozenset[bytes], ...]:
        """The two longest of the mandatory words; an accepted text holds both."""
        fixed = {n for n, d, e in zip(self.nodes, self.done[:-1], self.done[1:], strict=True) if e > d}
        return tuple(sorted(fixed, key=lambda n: (-min(map(len, n)), sorted(n)))[:2])

    def run(self, words: list[bytes], at: int) -> tuple[int, float]:
        """(words taken, or 0 if not accepted; best share of mandatory words in sequence) from word ``at`` on."""
        states, best, end = self.closure({0}), 0, 0
        for i in range(at, len(words)):
            states = self.closure({s + 1 for s in states if s < len(self.nodes) and self.takes(s, words[i])})
            if not states:
                break
            best = max(best, max(self.done[s] for s in states))
            if len(self.nodes) in states:
                end = i + 1 - at
        return end, best / max(1, self.done[-1])


#: A part of a template: a bracket, a replaceable region or a word.
_PART = re.compile(r"\[|\]|\{[^{}\s]*\}|[^\s\[\]{}]+")
_REGION = re.compile(r"(?:(\d+)-)?(\d+)(?::(.+))?")


def compile_template(label: str, text: str) -> Automaton:
    """A template as an automaton; wrong markup and a text that has only optional parts are refused."""
    nodes: list[frozenset[bytes] | re.Pattern[bytes] | None] = []
    skips: dict[int, list[int]] = {}
    done = [0]
    open_: list[int] = []
    parts = _PART.findall(text)
    if "".join(parts) != "".join(text.split()):
        raise ValueError(f"a brace without its other: {text}")
    for part in parts:
        if part == "[":
            open_.append(len(nodes))
        elif part == "]":
            if not open_:
                raise ValueError(f"no optional region is open: {text}")
            skips.setdefault(open_.pop(), []).append(len(nodes))
        elif region := part[0] == "{" and _REGION.fullmatch(part[1:-1]):
            least, most, pattern = region.groups()
            for i in range(int(most)):
                if i >= int(least or 0):
                    skips.setdefault(len(nodes), []).append(len(nodes) + 1)
                nodes.append(re.compile(pattern.encode()) if pattern else None)
                done.append(done[-1])
        else:
            nodes.append(frozenset(w.encode() for w in part.strip("{}").split("|")))
            done.append(done[-1] + (not open_))
    if open_ or not done[-1]:
        raise ValueError(f"an open region or no mandatory word: {text}")
    return Automaton(label, tuple(nodes), {k: tuple(v) for k, v in skips.items()}, tuple(done))


_WORD_OR_QUOTE = re.compile(WORD.pattern + rb'|"')


def template_of(text: str, first: str, last: str) -> str:
    """The template of a licence's text, from the words ``first``, where they stand first, to ``last``, where they stand last.

    Each word is mandatory.  Straight quotes may be typographic ones in a text, which belong to the word beside them, or
    are a word of their own beside a sign; a typographic apostrophe makes another word, so such a text is not accepted.
    """
    raw = text.encode().lower()  # A-Z only, as scanned texts are
    parts = []
    for m in _WORD_OR_QUOTE.finditer(raw):
        w = m[0].decode()
        if w == '"':
            if parts and not any(WORD.match(raw[i : i + 1]) for i in (m.start() - 1, m.end())):
                parts[-1] = (parts[-1][0], parts[-1][1] + " [{“|”}]")
            continue
        quoted = ("“" if raw[m.start() - 1 : m.start()] == b'"' else "") + w + ("”" if raw[m.end() : m.end() + 1] == b'"' else "")
        parts.append((w, w if quoted == w else f"{{{w}|{quoted}}}"))
    words, a, b = [w for w, _ in parts], first.split(), last.split()
    starts = [i for i in range(len(words)) if words[i : i + len(a)] == a]
    ends = [i + len(b) for i in range(len(words)) if words[i : i + len(b)] == b]
    if not starts or not ends or starts[0] >= ends[-1]:
        raise ValueError(f"the text does not go from {first!r} to {last!r}")
    return " ".join(p for _, p in parts[starts[0] : ends[-1]])


def whole_text(label: str) -> str:
    """The text of a long licence as it is published."""
    return pkgutil.get_data(__package__, f"wordings/{label}.txt").decode()


AUTOMATA = tuple(compile_template(*t) for t in (*TEMPLATES, *((label, template_of(whole_text(label), first, last)) for label, first, last in WHOLE)))


class Scanner:
    """Base phrases and automata over one text at a time."""

    def __init__(self, automata: tuple[Automaton, ...] = AUTOMATA, phrases=PHRASES):
        self.phrases = [(re.compile(rb"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])" + _GAP.join(p.encode().split()) + rb"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"), p.split()[-1].encode(), label) for p, label in phrases]
        #: The sets of words that automata need first, each with the automata that need it, so that a text is searched once for each.
        self.by_need: dict[frozenset[bytes], list[tuple[Automaton, tuple[frozenset[bytes], ...], set[bytes]]]] = {}
        for a in automata:
            needs = a.needs()
            self.by_need.setdefault(needs[0], []).append((a, needs[1:], a.firsts()))

    def base(self, text: bytes) -> list[tuple[int, str]]:
        """(byte place, label) of each phrase; ``text`` in lower case."""
        return sorted((m.start(), label) for pattern, last, label in self.phrases if last in text for m in pattern.finditer(text))

    def templates(self, text: bytes) -> tuple[list[tuple[str, int, int]], float]:
        """(label, first word, words) of each accepted wording, and the best share of an incomplete one.

        Wordings whose two longest mandatory words do not both stand in the text are passed over.
        """
        by_first: dict[bytes, list[Automaton]] = {}
        for need, group in self.by_need.items():
            if any(w in text for w in need):
                for a, more, firsts in group:
                    if all(any(w in text for w in n) for n in more):
                        for w in firsts:
                            by_first.setdefault(w, []).append(a)
        if not by_first:
            return [], 0.0
        words = WORD.findall(text)
        found, best = [], 0.0
        for i, w in enumerate(words):
            for a in by_first.get(w, ()):
                n, share = a.run(words, i)
                if n:
                    found.append((a.label, i, n))
                else:
                    best = max(best, share)
        return found, best


def count_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of words of each row of lower-cased bytes."""
    inside = (data >= 128) | ((data >= 48) & (data < 58)) | ((data >= 97) & (data < 123))
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[firsts] = inside[firsts]
    total = np.concatenate([[0], np.cumsum(starts)])
    return total[offsets[1:]] - total[offsets[:-1]]


def scan(docs: DataFrame, automata: tuple[Automaton, ...] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and matches.

    ``matches`` lists accepted wordings as (label, first word, words).  The score is 1
    where a wording was accepted, 0.6 where only a base phrase stands, less for half a
    wording and more, and 0 for none.  Null and empty texts have no words and no labels
    (empty strings).  Whole texts are read, however long; rows may be equal or share a
    doc_id; other columns are ignored; an empty table gives no rows.  ``automata``: compiled
    templates to look for instead of the module's own.
    """
    match = pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(AUTOMATA if automata is None else automata)
        table = np.frombuffer(LOWER_ASCII, dtype=np.uint8)
        for batch in batches:
            flat, at = as_bytes(batch.column(1))
            rows = []
            n_words = [np.zeros(0, np.int64)]
            for lo, hi in runs_of_rows(at, 1 << 20):
                data, own = table[flat[at[lo] : at[hi]]], at[lo : hi + 1] - at[lo]
                n_words.append(count_words(data, own))
                for i in range(hi - lo):
                    text = data[own[i] : own[i + 1]].tobytes()
                    base = scanner.base(text)
                    found, share = scanner.templates(text)
                    words = [len(WORD.findall(text[:p])) for p in {base[0][0], base[-1][0]}] if base else []
                    own_labels = {x for _, x in base}
                    points = 1.0 if found else 0.6 if base else 0.6 * share if share >= PARTIAL else 0.0
                    rows.append((len(base), min(words, default=None), max(words, default=None), ",".join(sorted(own_labels)), ",".join(sorted(own_labels | {x[0] for x in found})), points, [{"label": a, "word": b, "words": c} for a, b, c in found]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(match)]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n_words)), *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,word:bigint,words:bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
