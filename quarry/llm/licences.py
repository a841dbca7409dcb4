"""License scans with a generalised suffix automaton over licence words.

The templates' words, one template after another, make one suffix automaton. A document's words stream through it; at
each place the state gives the longest run ending there that occurs in some template (matching statistics). Runs that
cannot grow and have at least `least` words (`least_long` for templates of over `LONG` words) are kept and, per template,
chained in order of both texts; a template whose words are covered to `enough` by its best chain adds its label.
Independently, the places of the base phrases are counted by themselves, and their labels always stay.

Templates are short notices, and the full texts in `licence_texts/`, one file each, named by label and version.

Null texts have no words. Documents of any length are streamed whole. Repeated rows give repeated results, an empty
table an empty one; only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

from functools import lru_cache
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import batch, map_batches, utf8, words

#: The phrases whose places count, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Words from which on a template is long.
LONG = 40

#: Short public licence notices and the labels that they stand for.
NOTICES = (
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


@lru_cache(maxsize=1)
def templates() -> tuple[tuple[str, str], ...]:
    """(label, text) of the notices and of the full texts."""
    files = sorted((f for f in resources.files("quarry.llm").joinpath("licence_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return (*NOTICES, *((f.name.split(".")[0], f.read_text(encoding="utf-8")) for f in files))


class SuffixAutomaton:
    """Of several word sequences: each gets an end mark of its own, so that no match runs over from one to the next.

    Where a state's words end is known for states of at least `least` words.
    """

    def __init__(self, sequences: list[list[int]], least: int = 1) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [[]]
        last = 0
        for number, sequence in enumerate(sequences):
            for place, word in enumerate([*sequence, -2 - number]):
                last = self._extend(last, word, (number, place))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0 and self.length[self.link[state]] >= least:
                self.ends[self.link[state]] += self.ends[state]

    def _extend(self, last: int, word: int, end: tuple[int, int]) -> int:
        new = self._state(self.length[last] + 1, {}, [end])
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
            return new
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            self.link[new] = q
            return new
        copy = self._state(self.length[p] + 1, dict(self.next[q]), [])
        self.link[copy] = self.link[q]
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = self.link[new] = copy
        return new

    def _state(self, length: int, nexts: dict[int, int], ends: list[tuple[int, int]]) -> int:
        self.next.append(nexts)
        self.link.append(0)
        self.length.append(length)
        self.ends.append(ends)
        return len(self.next) - 1

    def matches(self, ids: list[int], least: int) -> list[tuple[int, int, int]]:
        """(end, length, state) of the runs of at least `least` words that a further word would end; ids of -1 match nothing."""
        out, state, n = [], 0, 0
        for i, word in enumerate([*ids, -1]):
            before, held = n, state
            while state and word not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if word in self.next[state]:
                state, n = self.next[state][word], n + 1
            else:
                state, n = 0, 0
            if n <= before and before >= least:
                out.append((i, before, held))
        return out


class Scanner:
    def __init__(self, known: tuple[tuple[str, str], ...] | None = None, phrases=PHRASES, least: int = 3, least_long: int = 6, enough: float = 0.8) -> None:
        known = templates() if known is None else known
        self.least, self.enough, self.labels = least, enough, [label for label, _ in known]
        texts = [words(t.encode()) for _, t in known]
        self.need = [least_long if len(t) > LONG else least for t in texts]
        self.phrases = [(p.encode().split(), label) for p, label in phrases]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in t} | {w for p, _ in self.phrases for w in p}))}
        self.sizes = [len(t) for t in texts]
        self.machine = SuffixAutomaton([[self.vocabulary[w] for w in t] for t in texts], least)

    def scan(self, text: bytes) -> tuple[int, list[int], list[str], list[str], float, list[tuple[int, int, str]]]:
        """Number of words, starts of base phrases, base labels, all labels, best coverage, covered (first, end, label)."""
        found = words(text)
        ids = np.fromiter((self.vocabulary.get(w, -1) for w in found), np.int64, len(found))
        starts, base = [], set()
        for phrase, label in self.phrases:
            want = [self.vocabulary[w] for w in phrase]
            n = len(ids) - len(want) + 1
            here = np.flatnonzero(np.logical_and.reduce([ids[k : k + n] == w for k, w in enumerate(want)])) if n > 0 else np.zeros(0, int)
            if len(here):
                starts += here.tolist()
                base.add(label)
        covered, best = [], 0.0
        known = np.concatenate([[0], (ids >= 0).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(known))
        runs = [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= self.least]
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in runs:
            for end, n, state in self.machine.matches(ids[a:b].tolist(), self.least):
                for number, place in self.machine.ends[state]:
                    if n < self.need[number]:
                        continue
                    pieces.setdefault(number, []).append((a + end - n, place + 1 - n, n))
        for number, own in pieces.items():
            score, first, end = self._chain(own, self.sizes[number])
            best = max(best, score)
            if score >= self.enough:
                covered.append((first, end, self.labels[number]))
        return len(found), starts, sorted(base), sorted(base | {c[2] for c in covered}), best, sorted(covered)

    def _chain(self, pieces: list[tuple[int, int, int]], size: int) -> tuple[float, int, int]:
        """The largest share of a template's words that matches in order cover, within twice its length of the document."""
        best = (0.0, 0, 0)
        open_: list[tuple[int, int, int, int]] = []  # document end, template end, words covered, first word
        for at, place, n in sorted(pieces):
            open_ = [c for c in open_ if at - c[3] <= 2 * size]
            total, first = n, at
            for end, done, words_, start in open_:
                cut = max(0, end - at, done - place)
                if cut < n and words_ + n - cut > total:
                    total, first = words_ + n - cut, start
            open_.append((at + n, place + n, total, first))
            best = max(best, (min(1.0, total / size), first, at + n))
        return best


@lru_cache(maxsize=2)
def _scanner(known, phrases, least: int, least_long: int, enough: float) -> Scanner:
    return Scanner(known, phrases, least, least_long, enough)


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known=None, phrases=PHRASES, least: int = 3, least_long: int = 6, enough: float = 0.8) -> DataFrame:
    """Per row of docs: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    first_word and last_word: the smallest and largest start of a base phrase, in words from 0, else null. score: the
    best coverage of a template. spans: (first word, end word, label) of the covered templates. known (templates() by
    default) and phrases are (label, text) and (phrase, label) tuples of bounded size, sent with the tasks.
    """
    known, phrases = tuple(map(tuple, templates() if known is None else known)), tuple(map(tuple, phrases))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        scanner = _scanner(known, phrases, least, least_long, enough)
        rows = [scanner.scan(t) for t in utf8(b.column(1))]
        long = lambda x: pa.array(x, pa.int64())
        return batch(
            id=b.column(0), n_words=long([r[0] for r in rows]), n_base=long([len(r[1]) for r in rows]), first_word=long([min(r[1], default=None) for r in rows]),
            last_word=long([max(r[1], default=None) for r in rows]), base_labels=pa.array([r[2] for r in rows], pa.list_(pa.string())), labels=pa.array([r[3] for r in rows], pa.list_(pa.string())),
            score=pa.array([r[4] for r in rows], pa.float64()), spans=pa.array([[{"first": x, "end": y, "label": z} for x, y, z in r[5]] for r in rows], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))),
        )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<struct<first: bigint, end: bigint, label: string>>"
    return map_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), schema, run).withColumnRenamed("id", id_col)
