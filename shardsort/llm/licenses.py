"""Licence scans with a generalised suffix automaton of licence words.

All phrases and notices go into one suffix automaton over word numbers. A document is streamed
through it: at each word the automaton gives the longest match that ends there (its matching
statistic). Matches that cannot be extended are chained, notice by notice: a chain advances in
both the text and the notice, and of all chains that end with a match the one counts that covers
most of the notice. Of the chains that cover enough of it, those that lie apart and cover most
together are its spans. A phrase is found wherever the current match ends in it, so every place is
reported.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardsort.llm.common import arrow_rows, bounded_batches, lower_ascii, widened

#: A word, of a text whose A-Z are lower-cased: fixed value.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases whose every place is a base hit: fixed values.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Notices of public licences, by label: fixed values.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
)

#: A match of a notice counts from this many words on.
LEAST_MATCH = 3
#: Text words that may stand between two matches of one chain.
CHAIN_GAP = 12
#: A notice is there when a chain covers this share of its words.
COVERAGE = 0.75


def words_of(text: str | None) -> list[str]:
    """Words of a text in order, after lower-casing A-Z; null counts as empty."""
    return WORD.findall(lower_ascii(text).decode("utf-8", "surrogatepass"))


class SuffixAutomaton:
    """Of several sequences of word numbers; knows where in which sequence each state ends."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        self.state_of: list[int] = []
        for k, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((k, at))
            self.state_of.append(last)
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] |= self.ends[state]
        self.ends[0] = set()

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(dict(step))
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, state: int, word: int) -> int:
        """The state for the longest string of `state` followed by `word`, cloned if it must be."""
        target = self.step[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._state(self.length[state] + 1, self.step[target], self.link[target])
        self.link[target] = clone
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word)
        return new


@dataclass(frozen=True)
class Match:
    """Text words from `begin` up to (not with) `end` that stand in a notice from `start` on."""

    begin: int
    end: int
    start: int


def spans_of(matches: list[Match], size: int, gap: int, coverage: float) -> list[tuple[int, int, int]]:
    """(first word, last word, words covered) of a notice's spans, from its matches in the order of their ends.

    A match may follow another that begins and ends before it, in the text as in the notice, at
    most ``gap`` text words further on; words that both hold count once. For every match the chain
    that ends with it and covers most (the shortest of these) is found from those of the matches
    before it; a longest increasing path, match by match. Of the chains that cover ``coverage`` of
    the notice's ``size``, the disjoint ones are taken that cover most together.
    """
    best: list[tuple[int, int]] = []  # (covered, first word) of the chain that ends with each match
    window = 0
    for j, m in enumerate(matches):
        while matches[window].end < m.begin - gap:
            window += 1
        chain = (m.end - m.begin, m.begin)
        for i in range(window, j):
            before = matches[i]
            ahead = m.start - before.start
            if before.begin < m.begin and before.end < m.end and 0 < ahead and ahead + m.end - m.begin > before.end - before.begin:
                shared = max(0, before.end - m.begin, before.end - before.begin - ahead)
                if shared < m.end - m.begin:
                    chain = max(chain, (best[i][0] + m.end - m.begin - shared, best[i][1]))
        best.append(chain)
    enough = sorted({(matches[j].end, first, covered) for j, (covered, first) in enumerate(best) if covered >= coverage * size})
    ends = [e for e, _, _ in enough]
    total, taken = [0], []  # most words of disjoint chains among the first k, and whether the k-th is one
    for k, (end, first, covered) in enumerate(enough):
        with_it = total[bisect_right(ends, first, 0, k)] + covered
        taken.append(with_it > total[-1])
        total.append(max(with_it, total[-1]))
    spans, k = [], len(enough)
    while k:
        end, first, covered = enough[k - 1]
        if taken[k - 1]:
            spans.append((first, end - 1, covered))
            k = bisect_right(ends, first, 0, k - 1)
        else:
            k -= 1
    return spans[::-1]


class LicenceScanner:
    """Finds the phrases' places and the notices' spans of a sequence of words."""

    def __init__(self, phrases: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]], least_match: int = LEAST_MATCH, chain_gap: int = CHAIN_GAP, coverage: float = COVERAGE):
        self.phrases, self.notices = list(phrases), list(notices)
        self.least_match, self.chain_gap, self.coverage = least_match, chain_gap, coverage
        texts = [text.split() for _, text in (*phrases, *notices)]
        self.sizes = [len(t) for t in texts]
        self.number: dict[str, int] = {}
        for text in texts:
            for word in text:
                self.number.setdefault(word, len(self.number))
        self.automaton = SuffixAutomaton([[self.number[w] for w in t] for t in texts])
        a = self.automaton
        own: dict[int, list[int]] = {}
        for k in range(len(self.phrases)):
            own.setdefault(a.state_of[k], []).append(k)
        self.phrase_ends: list[list[int]] = [[] for _ in a.link]
        for state in sorted(range(1, len(a.link)), key=lambda s: a.length[s]):
            self.phrase_ends[state] = own.get(state, []) + self.phrase_ends[a.link[state]]
        self.least_run = min([least_match, *self.sizes[: len(self.phrases)]])
        first_notice = len(self.phrases)
        self.notice_ends = [sorted((k, e) for k, e in ends if k >= first_notice) for ends in a.ends]

    def scan(self, words: list[str]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
        """Places of phrases (label, first, last word) and spans of notices (with coverage)."""
        number = self.number
        known = [i for i, w in enumerate(words) if w in number]
        places: list[tuple[str, int, int]] = []
        matches: dict[int, list[Match]] = {}
        run = 0
        while run < len(known):
            stop = run + 1
            while stop < len(known) and known[stop] == known[stop - 1] + 1:
                stop += 1
            if stop - run >= self.least_run:
                self._run(words, known[run], known[stop - 1] + 1, places, matches)
            run = stop
        spans = []
        for k, own in matches.items():
            label, size = self.notices[k - len(self.phrases)][0], self.sizes[k]
            if sum(m.end - m.begin for m in own) >= self.coverage * size:
                spans += [(label, first, last, covered / size) for first, last, covered in spans_of(own, size, self.chain_gap, self.coverage)]
        return places, sorted(spans, key=lambda s: (s[1], s[2], s[0]))

    def _run(self, words, begin, end, places, matches) -> None:
        a, number = self.automaton, self.number
        step, link, length = a.step, a.link, a.length
        state = matched = 0
        for i in range(begin, end):
            word = number[words[i]]
            if word not in step[state]:
                if matched >= self.least_match:
                    self._match(i - matched, i, state, matches)
                while state and word not in step[state]:
                    state = link[state]
                    matched = length[state]
            following = step[state].get(word)
            if following is not None:
                state, matched = following, matched + 1
                for k in self.phrase_ends[state]:
                    if matched >= self.sizes[k]:
                        places.append((self.phrases[k][0], i - self.sizes[k] + 1, i))
        if matched >= self.least_match:
            self._match(end - matched, end, state, matches)

    def _match(self, begin, end, state, matches) -> None:
        """Text words [begin, end) stand in each notice that the state ends in."""
        for k, at in self.notice_ends[state]:
            matches.setdefault(k, []).append(Match(begin, end, at - (end - begin) + 1))


@lru_cache(maxsize=4)
def _scanner(*settings) -> LicenceScanner:
    return LicenceScanner(*settings)


PLACE = "array<struct<label: string, first_word: int, last_word: int>>"
SPAN = "array<struct<label: string, first_word: int, last_word: int, coverage: double>>"
_PLACE = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32())]))
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("coverage", pa.float64())]))


def scan(
    df: DataFrame, text: str = "text", phrases=PHRASES, notices=NOTICES, least_match: int = LEAST_MATCH, chain_gap: int = CHAIN_GAP, coverage: float = COVERAGE
) -> DataFrame:
    """Replace the text by `words` (their number), `places` of phrases and `spans` of notices.

    Phrases and notices are (label, lower-case words); phrases of any length are found. Matches of
    notices count from ``least_match`` words on, at most ``chain_gap`` words part two of a chain, and
    a span covers at least ``coverage`` of its notice.

    Null and empty texts have no words, places or spans; texts of any length are read whole;
    repeated rows give repeated results; places may overlap and are all reported, in order. Columns
    named words, places or spans are replaced, all others but the text pass through.
    """
    bounded_batches(df.sparkSession)
    out = ("words", "places", "spans")
    source = df.drop(*(c for c in out if c != text))
    schema = widened(source.drop(text), f"words long, places {PLACE}, spans {SPAN}")
    settings = (tuple(phrases), tuple(notices), least_match, chain_gap, coverage)
    kept = [c for c in source.columns if c != text]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*settings)
        as_dicts = lambda rows, names: [dict(zip(names, r, strict=True)) for r in rows]
        for batch in batches:
            counts, places, spans = [], [], []
            for (t,) in arrow_rows(batch, text):
                words = words_of(t)
                found, covered = scanner.scan(words)
                counts.append(len(words))
                places.append(as_dicts(found, ("label", "first_word", "last_word")))
                spans.append(as_dicts(covered, ("label", "first_word", "last_word", "coverage")))
            columns = [pa.array(counts, pa.int64()), pa.array(places, _PLACE), pa.array(spans, _SPAN)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *columns], names=[*kept, *out])

    return source.mapInArrow(run, schema)


def labelled(df: DataFrame) -> DataFrame:
    """Per document: base places, labels and a score, from the operator's places and spans.

    The score is 1 where a phrase stands, else the best coverage of a notice (0 without any). Null
    and empty texts have no words and labels and score 0; null and repeated doc_ids each get a row;
    other columns are not read; an empty table gives no rows.
    """
    found = scan(df.select("doc_id", "text"))
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    both = F.array_sort(F.array_union(F.col("places.label"), F.col("spans.label")))
    return found.select(
        "doc_id",
        F.col("words").alias("n_words"),
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.first_word").cast("long").alias("first_word"),
        F.array_max("places.first_word").cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("spans.coverage"), F.lit(0.0))).alias("score"),
    )
