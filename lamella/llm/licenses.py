"""Licences in texts by a positional index of rare template words.

The document frequency of every template word is counted over all documents. Each
template is then known by its rarest words only; the index lists, per word, the templates
and positions it occurs at. A file looks up those of its words that are indexed. Postings
that agree on the relative position (place in the file less place in the template) vote
for one alignment, and an alignment with enough rare words is verified by the template's
mandatory phrases near the place where they should stand.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import map_rows, table, words_of

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices as their licences word them, and the phrases a notice must have.
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "mit-notice": ("Released under the MIT License.", ("mit license",)),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
        "of the Software, and to permit persons to whom the Software is furnished to do so",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    "apache-2.0-notice": ("Licensed under the Apache License, Version 2.0.", ("apache license version 2 0",)),
    "gpl-3.0-notice": (
        "This work is licensed under the GNU General Public License, version 3.",
        ("gnu general public license", "version 3"),
    ),
    "gpl-text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.",
        ("redistribute it and or modify it", "gnu general public license"),
    ),
    "lgpl-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation",
        ("gnu lesser general public license",),
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        ("mozilla public license v 2 0",),
    ),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer.",
        ("redistribution and use in source and binary forms", "must retain the above copyright notice"),
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("for any purpose with or without fee is hereby granted",),
    ),
    "unlicense-text": (
        "This is free and unencumbered software released into the public domain.",
        ("unencumbered software released into the public domain",),
    ),
    "cc-by-nc-4.0-notice": ("Licensed under CC BY-NC 4.0.", ("cc by nc 4 0",)),
    "cc-by-sa-4.0-notice": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        ("creative commons attribution sharealike 4 0",),
    ),
    "cc-by-4.0-notice": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        ("creative commons attribution 4 0",),
    ),
}

#: Rare words a template is known by, and the slack of relative positions in words.
RARE = 12
SLACK = 4
#: The share of a template's rare-word weight an alignment needs.
SHARE = 0.6


def word_counts(docs: DataFrame, words: list[str], text_col: str = "text") -> DataFrame:
    """Rows ``(word, files)``: in how many documents each of the given words occurs, and, with
    word null, the number of documents. Tasks send one row per word at most."""
    known = {w.encode() for w in words}

    def run(batches):
        import pyarrow as pa

        seen: dict = defaultdict(int)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[None] += 1
                for w in known.intersection(words_of(text)):
                    seen[w] += 1
        if seen:
            yield pa.RecordBatch.from_pydict(
                {"word": pa.array([w if w is None else w.decode() for w in seen], pa.string()), "files": pa.array(list(seen.values()), pa.int64())}
            )

    parts = docs.select(F.col(text_col)).mapInArrow(run, "word string, files bigint")
    return parts.groupBy("word").agg(F.sum("files").alias("files"))


class Index:
    """Postings of the templates' rarest words."""

    def __init__(self, files: dict[str | None, int], templates=None, rare: int = RARE, slack: int = SLACK, share: float = SHARE):
        templates = TEMPLATES if templates is None else templates
        self.slack, self.share = slack, share
        total = files.get(None, 0)
        self.names, self.weights, self.lengths, self.phrases = [], [], [], []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.idf: dict[bytes, float] = {}
        for number, (name, (text, phrases)) in enumerate(templates.items()):
            words = words_of(text)
            idf = {w: math.log((total + 1) / (files.get(w.decode(), 0) + 0.5)) for w in set(words)}
            chosen = sorted(idf, key=lambda w: (-idf[w], w))[:rare]
            for place, word in enumerate(words):
                if word in chosen:
                    self.postings[word].append((number, place))
                    self.idf[word] = max(idf[word], 1e-3)
            self.names.append(name)
            self.weights.append(sum(self.idf[w] for w in chosen))
            self.lengths.append(len(words))
            self.phrases.append([words_of(p) for p in phrases])
        self.words = frozenset(self.postings)

    def match(self, words: list[bytes]) -> dict[str, float]:
        """Labels of the templates found in a file's words, with the share of weight they have."""
        present = self.words.intersection(words)
        if not present:
            return {}
        # (template, relative position) -> indexed words that agree on it
        votes: dict[tuple[int, int], set[bytes]] = defaultdict(set)
        for place, word in enumerate(words):
            if word in present:
                for number, at in self.postings[word]:
                    votes[number, place - at].add(word)
        found: dict[str, float] = {}
        for (number, shift), agreed in votes.items():
            if self.weights[number] <= 0:
                continue
            near = set(agreed)
            for k in range(1, self.slack + 1):
                near |= votes.get((number, shift + k), set()) | votes.get((number, shift - k), set())
            share = sum(self.idf[w] for w in near) / self.weights[number]
            name = self.names[number]
            if share >= self.share and share > found.get(name, 0) and self._verified(words, number, shift):
                found[name] = min(1.0, share)
        return found

    def _verified(self, words: list[bytes], number: int, shift: int) -> bool:
        low = max(0, shift - 2 * self.slack)
        window = words[low : shift + self.lengths[number] + 2 * self.slack]
        joined = b" " + b" ".join(window) + b" "
        return all(b" " + b" ".join(p) + b" " in joined for p in self.phrases[number])


def phrase_starts(words: list[bytes], phrases: list[list[bytes]]) -> list[list[int]]:
    """Places where the words of each phrase stand consecutively."""
    starts: list[list[int]] = [[] for _ in phrases]
    rarest = {p[-1] for p in phrases}
    if rarest.isdisjoint(words):
        return starts
    for k, word in enumerate(words):
        if word in rarest:
            for phrase, own in zip(phrases, starts, strict=True):
                a = k - len(phrase) + 1
                if a >= 0 and words[a : k + 1] == phrase:
                    own.append(a)
    return starts


def find_licenses(
    docs: DataFrame, templates: dict | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows ``(id, n_words, base, starts, matches)``, one per row of ``docs``.

    ``base`` holds the labels of the base phrases found, ``starts`` the word numbers where
    they stand, ``matches`` the templates with their scores. Null and empty texts have no
    words; repeated rows are scanned each; a null id stays null. The counts that
    tasks get to build the index from are one per template word, whatever the number of
    documents.
    """
    templates = TEMPLATES if templates is None else templates
    vocabulary = sorted({w.decode() for text, _ in templates.values() for w in words_of(text)})
    files = {r["word"]: r["files"] for r in word_counts(docs, vocabulary, text_col).toLocalIterator()}
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        index = Index(files, templates)
        labels, phrases = list(BASE.values()), [words_of(p) for p in BASE]

        def step(ids, texts):
            out: list[list] = [[], [], [], []]
            for text in texts:
                words = words_of(text)
                places = phrase_starts(words, phrases)
                matches = index.match(words)
                out[0].append(len(words))
                out[1].append(sorted({n for n, p in zip(labels, places, strict=True) if p}))
                out[2].append(sorted(a for p in places for a in p))
                out[3].append([{"label": n, "score": matches[n]} for n in sorted(matches)])
            return ids, *out

        return step

    schema = f"`{id_col}` {kind}, n_words bigint, base array<string>, starts array<bigint>, matches array<struct<label: string, score: double>>"
    return map_rows(docs.select(F.col(id_col), F.col(text_col)), start, schema)


def op2_licenses(spark, folder: str) -> DataFrame:
    found = find_licenses(table(spark, folder, "documents"))
    labels = F.array_sort(F.array_union("base", F.col("matches.label")))
    # A base phrase alone names a licence without its notice.
    score = F.greatest(F.coalesce(F.array_max("matches.score"), F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("bigint").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
    )
