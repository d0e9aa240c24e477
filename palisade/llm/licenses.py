"""License scans: an exact set-similarity join of text blocks with license templates, and phrases counted at every place.

A block is a line of a text, or, so that notices wrapped over lines are found, a run of words of any lines that is as long as the
template with 100 - `threshold` percent of other words; its words and a template's are sets. A template is found in a block that holds
at least `threshold` of its words; of overlapping runs the best counts, and a run adds nothing where a line holds as much. Words are ordered by how many blocks of the whole corpus hold them, rarest first. Then a block that reaches the
threshold must hold one of a template's first few words (prefix filter), be large enough (length filter), and have enough words left
after the first one met (positional filter); what passes is compared exactly, so no block is missed. Runs are tried only around such
first words, each end of a run counted from differences. Templates are a bounded list
that every worker holds; blocks never leave their row.

Null and empty texts have no words and no label. Repeated rows are scanned each on its own. Without a hit the first and last word
are null and the score is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import ALNUM, Hasher, LOWER, bounded_batches, fresh, row_bounds, text_slices, with_text, words

#: Phrases that give a label wherever their words stand consecutively.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Notices of public licenses, by label.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-4.0": ["Creative Commons Attribution 4.0 International License"],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ],
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}
#: The usual headers and texts of further public licenses and of those above, mostly wrapped over lines, by label.
NOTICES = {
    "agpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "bsd": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0"],
    "cc-by-nc-sa-4.0": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-sa-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0-1.0": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software "
        "to the public domain worldwide. This software is distributed without any warranty."],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
        "available at"],
    "gpl-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation"],
    "mit": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "mpl-2.0": [
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: The share of a template's words that a block must hold, in percent.
THRESHOLD = 90


def all_templates() -> dict[str, list[str]]:
    return {k: [*TEMPLATES.get(k, []), *NOTICES.get(k, [])] for k in [*TEMPLATES, *(k for k in NOTICES if k not in TEMPLATES)]}


def word_list(text: str) -> list[bytes]:
    """Words of a text by the rule of the scan."""
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
    return [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]


def _vocabulary(hasher: Hasher, own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of words, and where each stands in the list."""
    data = np.frombuffer(b"".join(own), np.uint8)
    ends = np.cumsum([len(w) for w in own])
    hashes = hasher.ranges(hasher.prefix(data), ends - [len(w) for w in own], ends)
    order = np.argsort(hashes)
    return hashes[order], order


def _known(data, starts, ends, hashes, vocabulary, own: list[bytes]) -> np.ndarray:
    """For each word its number in the vocabulary, or -1; equal hashes are compared as words."""
    keys, order = vocabulary
    place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    at = np.flatnonzero(keys[place] == hashes)
    out = np.full(len(hashes), -1)
    for i in at.tolist():
        number = int(order[place[i]])
        if data[starts[i]:ends[i]].tobytes() == own[number]:
            out[i] = number
    return out


def _blocks(data, starts, rows) -> np.ndarray:
    """A number for the (row, line) of each word, rising."""
    line = np.cumsum(data == 10)[starts] if len(starts) else np.zeros(0, np.int64)
    change = np.ones(len(starts), bool)
    change[1:] = (line[1:] != line[:-1]) | (rows[1:] != rows[:-1])
    return np.cumsum(change) - 1


def frequencies(docs: DataFrame, own: list[bytes], text: str = "text") -> list[int]:
    """In how many blocks of all documents each word of the list stands."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        vocabulary, total = _vocabulary(hasher, own), np.zeros(len(own), np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                data = LOWER[data]
                starts, ends, rows = words(data, offsets, ALNUM)
                number = _known(data, starts, ends, hasher.ranges(hasher.prefix(data), starts, ends), vocabulary, own)
                at = np.flatnonzero(number >= 0)
                pairs = np.unique(_blocks(data, starts, rows)[at] * len(own) + number[at])
                total += np.bincount(pairs % len(own), minlength=len(own))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own))), pa.array(total)], names=["word", "n"])

    counted = docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in counted}
    return [found.get(i, 0) for i in range(len(own))]


class Join:
    """The templates as sets of word numbers in the global order, with their prefixes."""

    def __init__(self, templates: dict[str, list[str]], own: list[bytes], counts: list[int], threshold: int):
        rank = {w: i for i, w in enumerate(sorted(own, key=lambda w: (counts[own.index(w)], w)))}
        self.rank = np.array([rank[w] for w in own])
        self.sets: list[tuple[str, list[int], int]] = []
        self.runs: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.prefixes: dict[int, list[tuple[int, int]]] = {}
        for label, texts in templates.items():
            for text in texts:
                ranks = sorted({rank[w] for w in word_list(text)})
                least = math.ceil(threshold * len(ranks) / 100)
                if not ranks:
                    continue
                for position, r in enumerate(ranks[: len(ranks) - least + 1]):
                    self.prefixes.setdefault(r, []).append((len(self.sets), position))
                member, first = np.zeros(len(own), bool), np.zeros(len(own), bool)
                member[ranks], first[ranks[: len(ranks) - least + 1]] = True, True
                self.runs.append((member, first, -(-100 * len(word_list(text)) // threshold)))
                self.sets.append((label, ranks, least))

    def of_runs(self, ranks: np.ndarray, at: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """Set, first and last word and share of the best runs; of each known word its rank, its place among all words and its row."""
        for number, ((member, first, length), (_, wanted, least)) in enumerate(zip(self.runs, self.sets, strict=True)):
            own = np.flatnonzero(member[ranks])
            met = own[first[ranks[own]]]
            if not len(met) or len(own) < least:
                continue
            near = np.searchsorted(at[met], at[own] - length + 1) < np.searchsorted(at[met], at[own] + length)
            own = own[near]
            n, place, row, word = len(own), at[own], rows[own], ranks[own]
            # A word counts for the runs that end before it leaves, stands again, or its row ends.
            order = np.lexsort((np.arange(n), word))
            again = np.full(n, n)
            again[order[:-1]] = np.where(word[order[1:]] == word[order[:-1]], order[1:], n)
            until = np.minimum(np.minimum(np.searchsorted(place, place + length), again), np.searchsorted(row, row, side="right"))
            held = np.cumsum(np.ones(n, np.int64) - np.bincount(until, minlength=n + 1)[:n])
            good, i, free = np.flatnonzero(held >= least), 0, 0
            while i < len(good):
                end = int(good[i])
                start = self._start(place, until, end, length)
                i += 1
                if start < free:
                    continue
                # Of the runs that overlap the first, the one that holds most, the first of these.
                best = (int(held[end]), -end, start)
                while i < len(good) and (start := self._start(place, until, int(good[i]), length)) <= end:
                    best = max(best, (int(held[good[i]]), -int(good[i]), start))
                    i += 1
                free = 1 - best[1]
                yield number, int(place[best[2]]), int(place[-best[1]]), best[0] / len(wanted)

    @staticmethod
    def _start(place: np.ndarray, until: np.ndarray, end: int, length: int) -> int:
        """The first word that counts for the run ending at `end`."""
        low = int(np.searchsorted(place, place[end] - length + 1))
        return low + int(np.argmax(until[low:end + 1] > end))

    def of_block(self, ranks: list[int], size: int) -> list[tuple[int, float]]:
        """Sets with the share of the template held, for a block of `size` different words of which `ranks` are known."""
        own, tried, out = set(ranks), set(), []
        for r in sorted(own & self.prefixes.keys()):
            for number, position in self.prefixes[r]:
                if number in tried:
                    continue
                tried.add(number)
                _, wanted, least = self.sets[number]
                if size < least or len(wanted) - position < least:
                    continue
                common = len(own.intersection(wanted))
                if common >= least:
                    out.append((number, common / len(wanted)))
        return out


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, phrases: dict[str, str] = PHRASES,
         templates: dict[str, list[str]] | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """The `keep` columns (all by default) with n_words, hits (start, phrase label), matches (byte span, label, share) of each text."""
    bounded_batches(docs.sparkSession)
    templates = all_templates() if templates is None else templates
    own = sorted({w for texts in [*templates.values(), phrases] for t in texts for w in word_list(t)})
    join = Join(templates, own, frequencies(docs, own, text), threshold)
    sequences = [([own.index(w) for w in word_list(p)], label) for p, label in phrases.items()]
    keep = docs.columns if keep is None else keep
    names = fresh(docs.select(*keep), "n_words", "hits", "matches")
    slim, at = with_text(docs, keep, text)
    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[: len(keep)]]
    kinds = (f"`{names[0]}` long", f"`{names[1]}` array<struct<word:bigint,label:string>>",
             f"`{names[2]}` array<struct<byte_start:bigint,byte_end:bigint,label:string,share:double>>")
    arrow = (pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())])), pa.list_(pa.struct([
        ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("label", pa.string()), ("share", pa.float64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        vocabulary = _vocabulary(hasher, own)
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(at)):
                data = LOWER[data]
                starts, ends, rows = words(data, offsets, ALNUM)
                number = _known(data, starts, ends, hasher.ranges(hasher.prefix(data), starts, ends), vocabulary, own)
                n = end - first
                bounds = row_bounds(rows, n)
                hits: list[list[dict]] = [[] for _ in range(n)]
                for wanted, label in sequences:
                    good = np.ones(max(0, len(number) - len(wanted) + 1), bool)
                    for k, w in enumerate(wanted):
                        good &= number[k:k + len(good)] == w
                    for i in np.flatnonzero(good).tolist():
                        if rows[i] == rows[i + len(wanted) - 1]:
                            hits[rows[i]].append({"word": i - int(bounds[rows[i]]), "label": label})
                matches: list[list[dict]] = [[] for _ in range(n)]
                block = _blocks(data, starts, rows)
                seen = np.flatnonzero(number >= 0)
                rare = np.isin(join.rank[number[seen]], list(join.prefixes))
                lines: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
                for b in np.unique(block[seen[rare]]).tolist():
                    lo, hi = np.searchsorted(block, [b, b + 1]).tolist()
                    ranks = join.rank[number[lo:hi][number[lo:hi] >= 0]].tolist()
                    size = len({data[starts[i]:ends[i]].tobytes() for i in range(lo, hi)})
                    for k, share in join.of_block(ranks, size):
                        r = int(rows[lo])
                        lines.setdefault((r, k), []).append((lo, hi - 1, share))
                        matches[r].append({"byte_start": int(starts[lo] - offsets[r]), "byte_end": int(ends[hi - 1] - offsets[r]),
                                           "label": join.sets[k][0], "share": share})
                for k, lo, hi, share in join.of_runs(join.rank[number[seen]], seen, rows[seen]):
                    r = int(rows[lo])
                    if not any(a <= hi and lo <= b and share <= held for a, b, held in lines.get((r, k), ())):
                        matches[r].append({"byte_start": int(starts[lo] - offsets[r]), "byte_end": int(ends[hi] - offsets[r]),
                                           "label": join.sets[k][0], "share": share})
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(k).slice(first, n) for k in range(len(keep))), pa.array(np.diff(bounds)),
                    pa.array(hits, arrow[0]), pa.array(matches, arrow[1])], names=[*keep, *names])

    return slim.mapInArrow(run, ", ".join([*head, *kinds]))
