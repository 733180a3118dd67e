"""License scans by patience alignment (operator 8).

A template's words are aligned with a text's: words that occur once in both are matched, of these the
longest run that rises in both is kept as anchors, and the gaps between anchors are aligned in the
same way; a gap without such words is matched from its ends inwards. The coverage is the matched share
of the template's words.

Only places that can hold a template are aligned. A pair of words that stand side by side once in
the template marks such a place; marks that are nearer than a template's length belong to one place,
and a place ends where the marks start over, so that each copy is found. Texts without any of a
template's long words are passed over: they cannot reach the coverage.

Defined cases: a null or empty text has no finds; null and repeated ids stay as they are; of
overlapping finds the one with more matched words, then the first by name, is given; other columns
are ignored; a text without finds and an empty table give no rows. Memory: one text's words.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")
LONG_WORD = 5
LEAST_COVERAGE = 0.8
OUT = ("doc_id long, license string, coverage double, matched_words int, template_words int, "
       "first_word int, last_word int, start int, length int")

# Public notices and permission texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."),
    "BSD-clauses": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."),
}


def rising(pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, sorted by their first, whose seconds rise: by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        if pile:
            before[k] = at[pile - 1]
        tops[pile : pile + 1] = [b]
        at[pile : pile + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Matched places of equal words in a and b, rising in both."""
    out = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, j, k, m = gaps.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        ones, others = Counter(a[i:j]), Counter(b[k:m])
        place = {w: x for x, w in enumerate(b[k:m], k) if others[w] == 1}
        anchors = rising([(x, place[w]) for x, w in enumerate(a[i:j], i) if ones[w] == 1 and w in place])
        if anchors:
            out += anchors
            edges = [(i - 1, k - 1), *anchors, (j, m)]
            gaps += [(x + 1, y, p + 1, q) for (x, p), (y, q) in zip(edges, edges[1:])]
    return sorted(out)


class Scanner:
    def __init__(self, templates: Mapping[str, str], least: float):
        self.least = least
        self.words = {name: [w.lower() for w in WORD.findall(text)] for name, text in sorted(templates.items())}
        self.pairs: dict[tuple[str, str], list[tuple[str, int]]] = defaultdict(list)
        self.needed: set[str] = set()
        for name, words in self.words.items():
            pairs = list(zip(words, words[1:]))
            for k, pair in enumerate(pairs):
                if pairs.count(pair) == 1:
                    self.pairs[pair].append((name, k))
            long = [w for w in words if len(w) >= LONG_WORD]
            if len(long) <= (1 - least) * len(words):
                raise ValueError(f"{name} has too few long words to be looked for by them")
            self.needed |= set(long)

    def places(self, words: list[str]) -> Iterator[tuple[str, int, int]]:
        """Template, first and last word of each part of a text that may hold it."""
        open_at: dict[str, tuple[int, int, int]] = {}  # first mark, last mark, the template's place there
        for x, pair in enumerate(zip(words, words[1:])):
            for name, k in self.pairs.get(pair, ()):
                size = len(self.words[name])
                first, last, before = open_at.get(name, (x, x, -1))
                if x - last > size or (k <= before and before - k > size // 3):
                    yield name, first, last + 1
                    first = x
                open_at[name] = (first, x, k)
        yield from ((name, first, last + 1) for name, (first, last, _) in open_at.items())

    def scan(self, text: str) -> list[tuple]:
        found = list(WORD.finditer(text))
        words = [m[0].lower() for m in found]
        finds = []
        for name, first, last in self.places(words):
            template = self.words[name]
            # What stands beside the marks may belong to it as well: single words without their neighbours.
            spare = max(2, len(template) // 4)
            begin, end = max(0, first - spare), min(len(words), last + 1 + spare)
            matched = align(template, words[begin:end])
            if len(matched) >= self.least * len(template):
                finds.append((len(matched), name, begin + matched[0][1], begin + matched[-1][1]))
        kept: list[tuple] = []
        for find in sorted(finds, key=lambda f: (-f[0], f[1], f[2])):
            if all(find[3] < k[2] or find[2] > k[3] for k in kept):
                kept.append(find)
        return [(name, n / len(self.words[name]), n, len(self.words[name]), x, y, found[x].start(),
                 found[y].end() - found[x].start()) for n, name, x, y in sorted(kept, key=lambda f: f[2])]


def license_scans(df: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST_COVERAGE,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per find: its license, coverage, and place in words and in characters."""
    given = dict(templates)  # a fixed list of texts, sent with the job
    names = [c.split()[0] for c in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given, least)
        hint = "(?i)" + "|".join(sorted(re.escape(w) for w in scanner.needed))
        for batch in batches:
            worth = pc.fill_null(pc.match_substring_regex(batch["text"], hint), False)
            part = batch.filter(worth)
            rows = [(i, *find) for i, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()) for find in scanner.scan(t)]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            kinds = [pa.int64(), pa.string(), pa.float64(), *[pa.int32()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, OUT)
