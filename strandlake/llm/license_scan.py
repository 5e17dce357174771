"""Licence texts by a generalised suffix automaton of licence tokens.

The automaton holds all templates: the four base phrases and longer notices. A file is streamed through it token by
token; after each token the state and length are the matching statistic, the longest template substring that ends
there. Maximal matches of at least MIN_RUN tokens are chained, in the order of the file and of the template, into
covered template spans; a chain that covers enough of its template gives the template's label. Base phrases are the
automaton's outputs on the suffix links, so every place counts.

Null and empty texts have no words, no labels and score 0; texts are streamed whole; repeated rows give repeated
results; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices in common use, as plain words.
NOTICES = (
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "licensed under the gnu general public license version 2"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved"),
)
MIN_RUN = 3
MAX_GAP = 6
MIN_COVERED = 0.7
#: A match with a template: its end in the file, its length, its end in the template.
Piece = tuple[int, int, int]

#: Lower-cases A-Z and turns every ASCII byte outside 0-9, A-Z and a-z into a space; bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


class SuffixAutomaton:
    """Minimal automaton of all substrings of several token sequences."""

    def __init__(self, templates: list[tuple[str, list[int]]], phrases: list[tuple[str, list[int]]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[dict[int, set[int]]] = [{}]  # state -> template -> where the state's strings end in it
        for t, (_, tokens) in enumerate(templates):
            last = 0
            for k, c in enumerate(tokens):
                last = self._extend(last, c, ends)
                ends[last].setdefault(t, set()).add(k + 1)
        for v in sorted(range(1, len(self.len)), key=lambda v: -self.len[v]):
            up = ends[self.link[v]]
            for t, e in ends[v].items():
                up.setdefault(t, set()).update(e)
        self.ends = [[(t, sorted(e)) for t, e in found.items()] for found in ends]
        own: dict[int, list[tuple[int, str]]] = {}
        for label, tokens in phrases:
            v = 0
            for c in tokens:
                v = self.next[v][c]
            own.setdefault(v, []).append((len(tokens), label))
        self.outputs: list[tuple[tuple[int, str], ...]] = [()] * len(self.len)
        for v in sorted(range(1, len(self.len)), key=lambda v: self.len[v]):
            self.outputs[v] = (*self.outputs[self.link[v]], *own.get(v, ()))

    def _extend(self, last: int, c: int, ends: list[dict[int, set[int]]]) -> int:
        nxt, link, size = self.next, self.link, self.len

        def split(p: int, q: int) -> int:
            """A state for the strings of q no longer than those that reach it from p."""
            if size[p] + 1 == size[q]:
                return q
            size.append(size[p] + 1)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            ends.append({})
            r = len(size) - 1
            link[q] = r
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = r
                p = link[p]
            return r

        if c in nxt[last]:
            return split(last, nxt[last][c])
        size.append(size[last] + 1)
        nxt.append({})
        link.append(0)
        ends.append({})
        cur, p = len(size) - 1, last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            link[cur] = split(p, nxt[p][c])
        return cur


class Scanner:
    def __init__(self, base=BASE, notices=NOTICES) -> None:
        self.vocabulary: dict[bytes, int] = {}
        ids = lambda s: [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in s.encode().split()]
        phrases = [(label, ids(p)) for p, label in base]
        self.templates = phrases + [(label, ids(p)) for label, p in notices]
        self.automaton = SuffixAutomaton(self.templates, phrases)

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """Base places (start, label), and covered spans (label, start, end, share of the template)."""
        a = self.automaton
        nxt, link, size, outputs = a.next, a.link, a.len, a.outputs
        places: list[tuple[int, str]] = []
        matches: list[tuple[int, int, int]] = []  # end, length, state of each maximal match
        v = length = 0
        for i, c in enumerate(map(self.vocabulary.get, tokens)):
            if c is None:
                if length >= MIN_RUN:
                    matches.append((i, length, v))
                v = length = 0
                continue
            if c not in nxt[v]:
                if length >= MIN_RUN:
                    matches.append((i, length, v))
                while v and c not in nxt[v]:
                    v = link[v]
                    length = size[v]
                if c not in nxt[v]:
                    length = 0
                    continue
            v = nxt[v][c]
            length += 1
            for n, label in outputs[v]:
                if length >= n:
                    places.append((i + 1 - n, label))
        if length >= MIN_RUN:
            matches.append((len(tokens), length, v))
        return sorted(places), self.chained(matches)

    def chained(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """The spans of chains that cover enough of their template; of chains of one template that overlap, the one that covers most."""
        pieces: dict[int, list[Piece]] = {}
        for end, length, state in matches:
            for t, places in self.automaton.ends[state]:
                pieces.setdefault(t, []).extend((end, length, at) for at in places)
        found = []
        for t, mine in pieces.items():
            label, size = self.templates[t][0], len(self.templates[t][1])
            least = MIN_COVERED * size
            if sum(length for _, length, _ in mine) < least:
                continue
            taken: list[tuple[int, int]] = []
            for covered, start, end in sorted((c for c in chains(mine) if c[0] >= least), key=lambda c: (-c[0], c[1], c[2])):
                k = bisect.bisect(taken, (start, end))
                if (not k or taken[k - 1][1] <= start) and (k == len(taken) or end <= taken[k][0]):
                    taken.insert(k, (start, end))
                    found.append((label, start, end, min(1.0, covered / size)))
        return sorted(found)


def chains(pieces: list[Piece]) -> list[tuple[int, int, int]]:
    """For each piece the best chain that ends with it: tokens covered, start and end in the file. Pieces stand by their end.

    A piece may follow another if it begins at most MAX_GAP tokens behind it once what overlaps with it, in the file or in
    the template, is cut off its front, and if something is left. Of equal chains the one that begins last counts. Only
    pieces that end within a piece or MAX_GAP before it are looked at, so the work is the pieces by a template's length.
    """
    out: list[tuple[int, int, int]] = []
    for j, (end, length, at) in enumerate(pieces):
        start, best = end - length, (length, end - length)
        for i in range(j - 1, -1, -1):
            before, _, reached = pieces[i]
            if before < start - MAX_GAP:
                break
            cut = max(0, before - start, reached - (at - length))
            if cut < length and start + cut - before <= MAX_GAP:
                best = max(best, (out[i][0] + length - cut, out[i][1]))
        out.append((*best, end))
    return out


@functools.cache
def scanner() -> Scanner:
    return Scanner()


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base places and covered spans (in words, end exclusive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner().scan
        place = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))
        for batch in batches:
            n, base, covered = [], [], []
            for text in batch.column("text"):
                tokens = words(text.as_py())
                places, spans = scan(tokens)
                n.append(len(tokens))
                base.append([{"start": s, "label": x} for s, x in places])
                covered.append([{"label": x, "start": s, "end": e, "covered": c} for x, s, e, c in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(base, place), pa.array(covered, span)], ["doc_id", "n_words", "base", "spans"])

    return common.documents(docs).mapInArrow(run, "doc_id bigint, n_words bigint, base array<struct<start:bigint,label:string>>, spans array<struct<label:string,start:bigint,end:bigint,covered:double>>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from `find`; score is the best share of a template, 1 where a base phrase stands."""
    base = F.transform("base", lambda p: p["label"])
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    starts = F.transform("base", lambda p: p["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.concat(base, F.transform("spans", lambda s: s["label"]))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"])), F.lit(0.0))).alias("score"),
    )
