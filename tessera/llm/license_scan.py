"""Licence scan: matching statistics on a generalised suffix automaton, chained to template spans.

The automaton holds the word sequences of all licence templates.  A document's
words stream through it once; at each word it gives, for every template, the
longest run of words ending there that occurs in it, and all its places.  Long
maximal matches of a template are chained (both places advance, small gaps) by
dynamic programming, and a template is reported where its best chain covers
enough of its words.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .shared import cleared, short_batches
from .textkit import ascii_lower

# The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notices of public licences, by label.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions""",
    "mit-short": "Released under the MIT License",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
    "apache-2-short": "Licensed under the Apache License, Version 2.0",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer""",
    "gpl-3": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License""",
    "gpl-3-short": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-nc": """This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License""",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0",
}

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LEAST, GAP, COVER = 3, 8, 0.6


def words_of(text: str | None) -> list[str]:
    return WORD.findall(ascii_lower(text or ""))


class Automaton:
    """A generalised suffix automaton over word ids, built from fixed templates.

    ``places`` gives, for each state, all ends of its word run in each template
    that has it; ``longest`` the state of the longest suffix of its run that a
    template has, for every template that has one.
    """

    def __init__(self, sequences: list[list[int]]):
        self.next, self.link, self.size, self.places = [{}], [-1], [0], [{}]
        for t, seq in enumerate(sequences):
            last = 0
            for i, w in enumerate(seq):
                last = self._extend(last, w)
                self.places[last].setdefault(t, set()).add(i + 1)
        by_size = sorted(range(1, len(self.size)), key=lambda s: self.size[s])
        for s in reversed(by_size):
            for t, ends in self.places[s].items():
                self.places[self.link[s]].setdefault(t, set()).update(ends)
        self.longest = [{} for _ in self.size]
        for s in by_size:
            self.longest[s] = {**self.longest[self.link[s]], **dict.fromkeys(self.places[s], s)}

    def _new(self, size: int, copy: int | None = None) -> int:
        self.next.append(dict(self.next[copy]) if copy is not None else {})
        self.link.append(self.link[copy] if copy is not None else 0)
        self.size.append(size)
        self.places.append({})
        return len(self.size) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        c = self._new(self.size[p] + 1, q)
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:                        # the run exists already (another template has it)
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, w)
        cur, p = self._new(self.size[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, w)
        return cur

    def statistics(self, ids: list):
        """For each word the state and length of the longest run ending there that any template has."""
        state = length = 0
        for w in ids:
            if w is None:
                state = length = 0
            else:
                while state and w not in self.next[state]:
                    state = self.link[state]
                    length = self.size[state]
                q = self.next[state].get(w)
                state, length = (q, length + 1) if q is not None else (0, 0)
            yield state, length

    def maximal(self, ids: list, least: int):
        """``(template, end, length, ends)`` of the runs of ``least`` words or more that the next word does not extend
        in that template; ``ends``: where the run ends in it."""
        open_ = {}
        for i, (state, length) in enumerate(self.statistics(ids)):
            if length < least and not open_:
                continue
            now = {}
            if length >= least:
                for t, s in self.longest[state].items():
                    size = length if s == state else self.size[s]
                    if size >= least:
                        now[t] = (size, s)
            for t, (size, s) in open_.items():
                if now.get(t, (0,))[0] != size + 1:
                    yield t, i, size, self.places[s][t]
            open_ = now
        for t, (size, s) in open_.items():
            yield t, len(ids), size, self.places[s][t]


class Scanner:
    """Templates, phrases and the automaton (built once per task)."""

    def __init__(self, templates: dict, phrases: dict, least: int, gap: int, cover: float):
        self.names = list(templates) + list(phrases)
        seqs = [words_of(t) for t in (*templates.values(), *phrases)]
        self.labels = [n.removesuffix("-short") for n in templates] + list(phrases.values())
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for s in seqs for w in s}))}
        self.seqs = [[self.vocabulary[w] for w in s] for s in seqs]
        self.automaton = Automaton(self.seqs)
        self.bases = range(len(templates), len(seqs))
        self.least, self.gap, self.cover = least, gap, cover

    def scan(self, words: list[str]):
        """``(base starts, base labels, spans)``; a span is (label, start, end, coverage)."""
        get = self.vocabulary.get
        ids = [get(w) for w in words]
        shortest = min([self.least, *(len(self.seqs[b]) for b in self.bases)])
        matches = list(self.automaton.maximal(ids, shortest))
        starts = []
        for t, end, size, ends in matches:
            whole = len(self.seqs[t])
            if t in self.bases and size == whole:
                starts.append((end - size, t))
        starts = sorted(set(starts))
        labels = {self.labels[b] for _, b in starts}
        of = {}
        for t, end, size, ends in matches:
            if t not in self.bases and size >= self.least:
                of.setdefault(t, []).extend((end - size, end, to - size) for to in ends)
        spans = [s for t, mine in sorted(of.items()) for s in self._spans(t, mine)]
        return [s for s, _ in starts], labels, spans

    def _spans(self, t: int, matches: list):
        """The chains of template ``t`` that cover enough of it, best first, none overlapping a better one."""
        total, found = len(self.seqs[t]), []
        for covered, start, end in sorted(chains(matches, self.gap), key=lambda c: (-c[0], c[1], c[2])):
            if covered < self.cover * total:
                break
            if all(end <= a or start >= b for _, a, b, _ in found):
                found.append((self.labels[t], start, end, min(1.0, covered / total)))
        return found


def chains(matches: list, gap: int):
    """``(covered, start, end)`` of the best chain that ends with each match ``(start, end, at)``; later ends have no earlier starts.

    In a chain both places advance: the next match begins at most ``gap`` words
    after the one before, in the text and in the template; where they overlap,
    the later one counts from the end of the earlier.
    """
    matches, best, first = sorted(set(matches), key=lambda m: (m[1], m[0], m[2])), [], 0
    for start, end, at in matches:
        to, mine = at + end - start, (end - start, start)
        while first < len(best) and matches[first][1] < start - gap:
            first += 1
        for k in range(first, len(best)):
            s, e, a = matches[k]
            skip = max(0, e - start, a + e - s - at)                # words of this match that the chain has already
            if skip < end - start and s < start and start + skip - e <= gap and at + skip - (a + e - s) <= gap:
                mine = max(mine, (best[k][0] + end - start - skip, best[k][1]), key=lambda c: (c[0], -c[1]))
        best.append(mine)
    return [(covered, start, end) for (covered, start), (_, end, _) in zip(best, matches)]


def scan_licenses(docs: DataFrame, templates: dict | None = None, phrases: dict | None = None, least: int = LEAST,
                  gap: int = GAP, cover: float = COVER) -> DataFrame:
    """``docs`` (without the text) plus the licence columns.

    ``n_words``; ``n_base``, ``first_word``, ``last_word``, ``base_labels`` (array) of
    the phrases; ``spans``: (label, start, end, coverage) of templates, in
    words; ``labels`` (array): phrases' and templates'; ``score``: the best
    coverage, 1 with a phrase, 0 with nothing.  A NULL or empty text has no
    words; every row gives a row, repeated rows too; a computed column replaces
    one of the same name.
    """
    short_batches(docs.sparkSession)
    made = ("n_words", "n_base", "first_word", "last_word", "base_labels", "spans", "labels", "score")
    docs = cleared(docs, *made)
    keep = [f for f in docs.schema.fields if f.name != "text"]
    span = StructType([StructField("label", StringType()), StructField("start", LongType()), StructField("end", LongType()),
                       StructField("coverage", DoubleType())])
    types = (LongType(), LongType(), LongType(), LongType(), ArrayType(StringType()), ArrayType(span), ArrayType(StringType()), DoubleType())
    schema = StructType([*keep, *(StructField(n, t) for n, t in zip(made, types))])
    arrow_span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])
    arrow = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(arrow_span), pa.list_(pa.string()), pa.float64())
    templates, phrases = templates or TEMPLATES, phrases or PHRASES

    def run(batches):
        scanner = Scanner(templates, phrases, least, gap, cover)
        for b in batches:
            out = []
            for t in b.column("text"):
                words = words_of(t.as_py())
                starts, base, spans = scanner.scan(words)
                labels = sorted(base | {s[0] for s in spans})
                score = 1.0 if starts else max((s[3] for s in spans), default=0.0)
                out.append((len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, sorted(base),
                            [dict(zip(("label", "start", "end", "coverage"), s)) for s in sorted(spans, key=lambda s: s[1:])], labels, score))
            cols = list(zip(*out)) or [[]] * len(made)
            yield pa.record_batch([b.column(f.name) for f in keep] + [pa.array(list(c), a) for c, a in zip(cols, arrow)],
                                  names=[*(f.name for f in keep), *made])
    return docs.mapInArrow(run, schema)
