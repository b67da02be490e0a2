"""Licence scan: matching statistics over a generalised suffix automaton of templates.

Templates are token sequences of licence texts and notices.  One suffix
automaton holds all of them; it is small, fixed and built once per worker.  A
text streams through it token by token, which gives at each word the longest
stretch ending there that occurs in a template.  Long stretches are chained, in
order and with small gaps, into spans of the template they cover; a template
covered for at least ``MIN_COVER`` adds its label.  The base phrases are
templates too: a phrase stands wherever the statistics reach its state.

Rows are independent: no shuffle.  Edge cases: a null text is empty and has no
words; long texts stream whole; repeated rows are each scanned; of templates
that tie, all labels are given; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_or_empty

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}

#: The base phrases and their labels where a caller names none.
BASE = {
    "the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notices and opening grants of public licences, as their publishers word them.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software",
        "Released under the MIT License.",
        "Licensed under the MIT license",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted",
    ],
    "gpl-3": [
        "licensed under the GNU General Public License, version 3",
        "either version 3 of the License, or (at your option) any later version",
    ],
    "gpl-2": [
        "licensed under the GNU General Public License, version 2",
        "either version 2 of the License, or (at your option) any later version",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
    ],
    "lgpl": ["under the terms of the GNU Lesser General Public License"],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc-by": ["licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["licensed under a Creative Commons Attribution ShareAlike 4.0 International License"],
    "cc-by-nc": ["licensed under a Creative Commons Attribution NonCommercial 4.0 International License"],
    "cc0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring "
            "rights to this software to the public domain worldwide"],
}
#: Words of the shortest stretch that counts, of the largest gap in a chain, and the share of a template to cover.
MIN_MATCH = 3
MAX_GAP = 4
MIN_COVER = 0.8


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower() if text.isascii() else text.translate(_LOWER))


class Automaton:
    """Suffix automaton of several token sequences; a state knows one place in each template it occurs in."""

    def __init__(self, sequences):
        self.next, self.link, self.length = [{}], [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for k, seq in enumerate(sequences):
            last = 0
            for i, t in enumerate(seq):
                last = self._extend(last, t, ends)
                ends[last].add((k, i + 1))
        # A state's strings also end wherever those of the states that link to it do.
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                ends[self.link[s]] |= ends[s]
        self.ends = [tuple(sorted(e)) for e in ends]

    def _clone(self, p, q, ends):
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        ends.append(set())
        return len(self.next) - 1

    def _redirect(self, p, t, q, c):
        while p != -1 and self.next[p].get(t) == q:
            self.next[p][t] = c
            p = self.link[p]

    def _extend(self, last, t, ends):
        q = self.next[last].get(t)
        if q is not None:  # an earlier sequence has it already
            if self.length[q] == self.length[last] + 1:
                return q
            c = self._clone(last, q, ends)
            self.link[q] = c
            self._redirect(last, t, q, c)
            return c
        cur = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        ends.append(set())
        p = last
        while p != -1 and t not in self.next[p]:
            self.next[p][t] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][t]
            if self.length[q] == self.length[p] + 1:
                self.link[cur] = q
            else:
                c = self._clone(p, q, ends)
                self.link[q] = self.link[cur] = c
                self._redirect(p, t, q, c)
        return cur

    def statistics(self, words, least: int = MIN_MATCH):
        """(end, state, length) wherever a stretch of template words cannot be carried on, and at every word
        of at least ``least`` matched words; words outside the templates cost one lookup each."""
        nxt, link, length = self.next, self.link, self.length
        known = nxt[0]
        s = n = 0
        for i, w in enumerate(words):
            if w not in known:
                s = n = 0
                continue
            while s and w not in nxt[s]:
                s = link[s]
                n = length[s]
            s = nxt[s][w]
            n += 1
            if n >= least:
                yield i + 1, s, n


class Scanner:
    def __init__(self, phrases=BASE):
        named = [(label, tokens(p), True) for p, label in phrases.items()]
        named += [(label, tokens(t), False) for label, texts in TEMPLATES.items() for t in texts]
        self.labels = [x[0] for x in named]
        self.sizes = [len(x[1]) for x in named]
        a = self.automaton = Automaton([x[1] for x in named])
        n_base = len(phrases)
        #: Shorter phrases than a stretch that counts are reported too.
        self.least = min([MIN_MATCH, *self.sizes[:n_base]])
        #: Base phrases that a state's longest string is, and those that end in every string of the state.
        self.whole = [[k for k, at in e if k < n_base and at == self.sizes[k] == a.length[s]]
                      for s, e in enumerate(a.ends)]
        self.inside = [[] for _ in a.ends]
        for s in sorted(range(1, len(a.ends)), key=lambda s: a.length[s]):
            self.inside[s] = self.inside[a.link[s]] + self.whole[a.link[s]]
        self.long = [[x for x in e if x[0] >= n_base] for e in a.ends]

    def scan(self, words):
        """Base places (start, label) and template spans (label, start, end, covered share)."""
        places, runs = [], {}
        sizes, labels, length = self.sizes, self.labels, self.automaton.length
        for end, state, n in self.automaton.statistics(words, self.least):
            here = self.inside[state] + self.whole[state] if n == length[state] else self.inside[state]
            places += [(end - sizes[k], labels[k]) for k in here]
            for k, at in self.long[state] if n >= MIN_MATCH else ():
                own = runs.setdefault(k, [])
                # The stretch [end - n, end) is template words [at - n, at); one that goes on replaces its start.
                if own and own[-1][1] == end - 1 and own[-1][3] == at - 1:
                    own[-1] = (min(own[-1][0], end - n), end, min(own[-1][2], at - n), at)
                else:
                    own.append((end - n, end, at - n, at))
        spans = [x for k, own in runs.items() for x in self._chains(k, own)]
        # Of spans that share words, only those of the largest covered share stay.
        return sorted(places), [x for x in spans if not any(
            y[3] > x[3] and y[1] < x[2] and x[1] < y[2] for y in spans)]

    def _chains(self, k, own):
        """Spans of template ``k``: stretches in text and template order, at most ``MAX_GAP`` words apart."""
        out, chain = [], []

        def close():
            covered, at = 0, 0
            for _, _, a, b in chain:
                covered += max(0, b - max(a, at))
                at = max(at, b)
            if covered >= MIN_COVER * self.sizes[k]:
                out.append((self.labels[k], chain[0][0], chain[-1][1], covered / self.sizes[k]))

        for piece in sorted(own):
            if chain and not (0 <= piece[0] - chain[-1][1] + MAX_GAP <= 2 * MAX_GAP
                              and piece[3] > chain[-1][3] and piece[2] - chain[-1][3] <= MAX_GAP):
                if piece[3] <= chain[-1][3] and piece[1] <= chain[-1][1] + MAX_GAP:
                    continue  # an echo inside what the chain already covers
                close()
                chain = []
            chain.append(piece)
        if chain:
            close()
        return out


_SCANNERS: dict[tuple, Scanner] = {}


def scan(docs: DataFrame, phrases: dict[str, str] | None = None) -> DataFrame:
    """Digest columns of every row, and ``spans``: label:first word:end word:share of each covered template.

    ``phrases`` are the base phrases and their labels (``BASE`` by default); each has a word at least.
    """
    phrases = dict(BASE if phrases is None else phrases)
    if not all(tokens(p) for p in phrases):
        raise ValueError("a base phrase has no word")

    def run(batches):
        key = tuple(phrases.items())
        if key not in _SCANNERS:
            _SCANNERS[key] = Scanner(phrases)
        scanner = _SCANNERS[key]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = tokens(text)
                places, spans = scanner.scan(words)
                base = sorted({label for _, label in places})
                every = sorted({*base, *(s[0] for s in spans)})
                score = 1.0 if base else max((s[3] for s in spans), default=0.0)
                rows.append((len(words), len(places), places[0][0] if places else None,
                             places[-1][0] if places else None, ",".join(base), ",".join(every), min(1.0, score),
                             ",".join(f"{a}:{b}:{c}:{d:.2f}" for a, b, c, d in sorted(spans, key=lambda s: s[1:] + s[:1]))))
            cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds)]],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                       "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
             "base_labels string, labels string, score double, spans string")
