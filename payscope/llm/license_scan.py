"""License scans: fixed phrases, and an exact set-similarity join of text blocks with templates.

Words are runs of ASCII letters (lower-cased) and digits and of all characters beyond ASCII. The
phrases give the base labels. A block is a line, cut further at sentence ends, or a whole sentence of
a paragraph that goes over several lines, as in hard-wrapped notices; line ends and comment marks in
it are read as spaces, and a line without words ends the paragraph. The join finds every block that
contains at least `threshold` of the words of a template, as sets:

* all words of the templates are put in one order, rarest in the corpus first, by counts over all
  documents (ties by the word);
* a template needs `least` = ceil(threshold * size) common words, so one of its first
  size - least + 1 words (its prefix) is in every block that qualifies, and that word is among the
  first len - least + 1 of the block's template words: only prefixes are looked up;
* length filter: a block with fewer than `least` template words is passed over;
* positional filter: words before the meeting place are spent, so the common words are at most
  those met before and what is left on the shorter side;
* survivors are compared exactly.

Templates are a fixed list, so they and their word counts go to every task; the documents are read
twice and never shuffled. Null texts are empty and have no labels. Repeated rows are each scanned;
an empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payscope.llm.common import by_batch, texts

# Phrases of the base labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Sentences of public license notices.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache org licenses."),
    ("apache-2.0", "You may not use this file except in compliance with the License."),
    ("apache-2.0", "You may obtain a copy of the License at apache org licenses."),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 1.0 Universal."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("reserved", "Copyright, all rights reserved."),
]

#: Bytes to lower-case letters, digits, spaces for all other ASCII; bytes beyond ASCII stay.
_FOLD = bytes(
    ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256)
)
_BLOCK_END = re.compile(rb"\n|(?<=[.!?])\s")
_STOPS = (b".", b"!", b"?")


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def blocks_of(text: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """First word and words of every block: pieces of lines, and sentences made of several of them."""
    start, sentence, pieces = 0, [], 0
    for piece in _BLOCK_END.split(text):
        own = words(piece)
        if own:
            yield start, own
            start += len(own)
            sentence += own
            pieces += 1
        if not own or piece.endswith(_STOPS):
            if pieces > 1:
                yield start - len(sentence), sentence
            sentence, pieces = [], 0
    if pieces > 1:
        yield start - len(sentence), sentence


class Index:
    """Prefix index of the templates under the global order of their words."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float):
        sets = [(label, set(words(text.encode()))) for label, text in templates]
        vocabulary = sorted(set().union(*(s for _, s in sets)), key=lambda w: (frequency.get(w, 0), w))
        self.order = {w: i for i, w in enumerate(vocabulary)}
        self.templates = [(label, sorted(map(self.order.get, s))) for label, s in sets]
        self.least = [math.ceil(threshold * len(t) - 1e-9) for _, t in self.templates]
        self.smallest = min(self.least, default=0)
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for n, (_, ranks) in enumerate(self.templates):
            for i in range(len(ranks) - self.least[n] + 1):
                self.prefix.setdefault(ranks[i], []).append((n, i))
        self.rare = {w for w, i in self.order.items() if i in self.prefix}

    def matches(self, block: list[bytes]) -> Iterator[tuple[int, float]]:
        """(template, containment) of all templates that the block contains to the threshold."""
        ranks = sorted({r for w in block if (r := self.order.get(w)) is not None})
        if len(ranks) < self.smallest:
            return
        met: dict[int, int] = {}
        for j, rank in enumerate(ranks):
            for n, i in self.prefix.get(rank, ()):
                least, size = self.least[n], len(self.templates[n][1])
                if len(ranks) < least or j > len(ranks) - least or met.get(n, 0) < 0:
                    continue
                seen = met.get(n, 0) + 1
                met[n] = seen if seen + min(size - i, len(ranks) - j) - 1 >= least else -1
        for n, seen in met.items():
            if seen > 0:
                common = len(set(ranks).intersection(self.templates[n][1]))
                if common >= self.least[n]:
                    yield n, common / len(self.templates[n][1])


def word_frequency(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each word of the templates occurs, over all documents."""

    def work():
        def each(batch):
            counts = dict.fromkeys(vocabulary, 0)
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                for w in vocabulary.intersection(words(text)):
                    counts[w] += 1
            return {"word": [w.decode() for w in counts], "n": list(counts.values())}

        return each

    counted = by_batch(texts(docs).select("text"), work, "word string, n bigint")
    return {r["word"].encode(): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


FOUND = """doc_id bigint, n_words bigint,
    base array<struct<label:string,first_word:bigint,n:bigint,last_word:bigint>>,
    blocks array<struct<label:string,first_word:bigint,n_words:bigint,containment:double>>"""


def find(
    docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.85
) -> DataFrame:
    """One row per document: places of the phrases by label, and every block that qualifies."""
    vocabulary = {w for _, text in templates for w in words(text.encode())}
    frequency = word_frequency(docs, vocabulary)
    phrases = {b" %s " % p.encode(): label for p, label in PHRASES.items()}

    def work():
        index = Index(templates, frequency, threshold)

        def places(line: bytes, phrase: bytes) -> list[int]:
            found, at, before, word = [], line.find(phrase), 0, 0
            while at >= 0:  # words are counted on from the last place
                word += line.count(b" ", before, at)
                found.append(word)
                before, at = at, line.find(phrase, at + 1)
            return found

        def each(batch):
            n_words, base, blocks = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                every = words(text)
                n_words.append(len(every))
                line = b" %s " % b" ".join(every)
                found = [(label, at) for p, label in phrases.items() if (at := places(line, p))]
                base.append(
                    [
                        {"label": label, "first_word": at[0], "n": len(at), "last_word": at[-1]}
                        for label, at in found
                    ]
                )
                hits = []
                if not index.rare.isdisjoint(every):
                    for start, own in blocks_of(text):
                        hits += [
                            {
                                "label": templates[n][0],
                                "first_word": start,
                                "n_words": len(own),
                                "containment": c,
                            }
                            for n, c in index.matches(own)
                        ]
                blocks.append(hits)
            return {"doc_id": batch.column("doc_id"), "n_words": n_words, "base": base, "blocks": blocks}

        return each

    return by_batch(texts(docs), work, FOUND)


def digest(found: DataFrame) -> DataFrame:
    """The columns of query op3. The score is 1 with a base label, else the best containment."""
    base = F.array_sort(F.array_distinct("base.label"))
    labels = F.array_sort(F.array_union(F.col("base.label"), F.col("blocks.label")))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("base", F.lit(0).cast("long"), lambda n, b: n + b["n"]).alias("n_base"),
        F.array_min("base.first_word").alias("first_word"),
        F.array_max("base.last_word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0)
        .otherwise(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0)))
        .alias("score"),
    )
