"""License notices in texts.

Base places are phrases whose words stand side by side.  Beyond them, an exact
set-similarity join finds every block that contains at least a share of a template's words.  A
block is a window of SPAN times the template's words, wherever lines break.
Tokens are ordered by how many lines of the whole corpus hold them, rarest first; a block is a
candidate if it holds one of a template's rarest tokens (prefix) and, from the token
at which it starts, enough of the template's to reach the share (length and position).  A candidate is verified by the order
of its words: as large a share of the template's words must stand in it in the template's order.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.words import ALNUM, U, Piece, pieces

# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices as their licenses word them: label, text, words that a block must hold, and words that it must not.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache", ""),
    ("apache-2.0-terms", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", "compliance", ""),
    ("mit", "Released under the MIT License", "mit", ""),
    ("mit-terms", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission granted", ""),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "fee permission", ""),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "gnu 3", "lesser affero"),
    ("gpl-terms", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu redistribute", "lesser affero library"),
    ("lgpl-terms", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gnu lesser redistribute", ""),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla", ""),
    ("bsd", "Released under the BSD License", "bsd", ""),
    ("bsd-terms", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution", ""),
    ("cc-by-4.0", "Licensed under CC BY 4.0", "cc by", "nc sa nd"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc nc", "sa nd"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "cc sa", "nc nd"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "commons attribution", "noncommercial sharealike noderivatives"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "commons noncommercial", "sharealike noderivatives"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "commons sharealike", "noncommercial noderivatives"),
    ("all-rights-reserved", "Copyright All rights reserved", "copyright reserved", ""),
    ("apache-2.0", "SPDX License Identifier Apache 2.0", "spdx apache", ""),
    ("mit", "MIT License", "mit license", ""),
    ("mit", "SPDX License Identifier MIT", "spdx mit", ""),
    ("bsd", "SPDX License Identifier BSD 3 Clause", "spdx bsd", ""),
    ("bsd", "SPDX License Identifier BSD 2 Clause", "spdx bsd", ""),
    ("bsd-terms", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "redistributions retain", ""),
    ("gpl-3.0", "SPDX License Identifier GPL 3.0", "spdx gpl 3", "lgpl agpl"),
    ("gpl-3.0", "licensed under the GNU GPL v3", "gnu gpl v3", "lesser affero"),
    ("mpl-2.0", "SPDX License Identifier MPL 2.0", "spdx mpl", ""),
    ("mit-terms", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT", "noninfringement warranty", ""),
    ("cc-by-sa-3.0", "Creative Commons Attribution-ShareAlike 3.0", "commons sharealike 3", "noncommercial noderivatives"),
    ("cc-by-3.0", "Creative Commons Attribution 3.0", "commons attribution 3", "noncommercial sharealike noderivatives"),
    ("public-domain", "This work is dedicated to the public domain", "dedicated domain", ""),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered", ""),
]


#: Words of a block for each word of the template.
SPAN = 2


def _words(text: str) -> np.ndarray:
    return next(pieces(pa.array([text]), ALNUM, lower=True)).hashes()


def vocabulary_of(templates: list[tuple[str, str, str, str]]) -> np.ndarray:
    return np.unique(np.concatenate([_words(t) for x in templates for t in x[1:]]))


def _blocks(p: Piece) -> np.ndarray:
    """For each word the number of its line, counted over the piece; texts end lines."""
    ends = np.cumsum(np.r_[0, p.data == 0x0A])
    return ends[p.starts] + p.doc


def _known(p: Piece, words: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the vocabulary: their places, and which they are."""
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    own = np.flatnonzero(vocabulary[at] == words)
    return own, at[own]


def chain(template: list[int], block: list[int]) -> int:
    """How many of the template's words stand in the block in the template's order."""
    best = [0] * (len(template) + 1)
    for word in block:
        before = 0
        for i, t in enumerate(template, 1):
            was = best[i]
            best[i] = before + 1 if t == word else max(was, best[i - 1])
            before = was
    return best[-1]


def _frequencies(vocabulary: np.ndarray):
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for p in pieces(batch.column(0), ALNUM, lower=True):
                own, which = _known(p, p.hashes(), vocabulary)
                if len(own):
                    total += np.bincount(np.unique(_blocks(p)[own] * len(vocabulary) + which) % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary)), pa.int32()), pa.array(total, pa.int64())], names=["token", "n"])

    return frequencies


def _scan(phrases: dict[str, str], templates: list[tuple[str, str, str, str]], vocabulary: np.ndarray, rank: np.ndarray, least: float):
    sought = [(_words(k), v) for k, v in phrases.items()]
    # each template's tokens as their numbers, rarest first
    tokens = lambda text: np.searchsorted(vocabulary, _words(text)).tolist()
    sets = [(name, sorted(set(tokens(text)), key=lambda t: rank[t])) for name, text, _, _ in templates]
    needed = [max(1, ceil(least * len(s) - 1e-9)) for _, s in sets]
    spans = [SPAN * len(_words(text)) for _, text, _, _ in templates]
    orders = [tokens(text) for _, text, _, _ in templates]
    chained = [max(1, ceil(least * len(x) - 1e-9)) for x in orders]
    must, never = ([set(tokens(x[k])) for x in templates] for k in (2, 3))
    # by token: whether it is the template's, and whether one of its rarest
    member, rare = np.zeros((len(sets), len(vocabulary)), bool), np.zeros((len(sets), len(vocabulary)), bool)
    for i, (_, s) in enumerate(sets):
        member[i, s] = True
        rare[i, s[: len(s) - needed[i] + 1]] = True

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words, n_base = np.zeros(n, np.int64), np.zeros(n, np.int64)
            first: list[int | None] = [None] * n
            last: list[int | None] = [None] * n
            base: list[set[str]] = [set() for _ in range(n)]
            also: list[set[str]] = [set() for _ in range(n)]
            score = np.zeros(n)
            for p in pieces(batch.column(1), ALNUM, lower=True):
                words, doc = p.hashes(), p.doc
                n_words[p.rows.start : p.rows.stop] = np.diff(p.first)
                for phrase, label in sought:
                    at = np.flatnonzero(words == phrase[0])
                    at = at[at + len(phrase) <= len(words)]
                    for j, x in enumerate(phrase[1:], 1):
                        at = at[words[at + j] == x]
                    at = at[doc[at] == doc[at + len(phrase) - 1]] if len(at) else at
                    for i in at.tolist():
                        r, place = int(doc[i]) + p.rows.start, i - int(p.first[doc[i]])
                        n_base[r] += 1
                        base[r].add(label)
                        score[r] = 1.0
                        first[r] = place if first[r] is None else min(first[r], place)
                        last[r] = place if last[r] is None else max(last[r], place)
                own, which = _known(p, words, vocabulary)
                for i, (name, s) in enumerate(sets):
                    if not rare[i][which].any():
                        continue
                    mine = member[i][which]
                    place, token = own[mine], which[mine]
                    at, end = np.arange(len(place)), np.searchsorted(place, np.minimum(place + spans[i], p.first[1:][doc[place]]))
                    hot = np.r_[0, np.cumsum(rare[i][token])]
                    for j in np.flatnonzero((end - at >= needed[i]) & (hot[end] > hot[at])).tolist():
                        held = set(token[j : end[j]].tolist())
                        common = len(held)
                        if common < needed[i] or not must[i] <= held:
                            continue
                        # from the first of the template's words to the last, none that tells another license
                        between = which[np.searchsorted(own, place[j]) : np.searchsorted(own, place[end[j] - 1], "right")]
                        if not never[i] & set(between.tolist()) and chain(orders[i], token[j : end[j]].tolist()) >= chained[i]:
                            r = int(doc[place[j]]) + p.rows.start
                            also[r].add(name)
                            score[r] = max(score[r], common / len(s))
            labels = [",".join(sorted(a | b)) for a, b in zip(base, also, strict=True)]
            made = [batch.column(0), pa.array(n_words), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array([",".join(sorted(x)) for x in base], pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return scan


def license_scan(docs: DataFrame, least: float = 0.8, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str, str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: n_words, n_base (places of phrases), first_word and last_word (their least and
    greatest first words, from 0; null without any), base_labels, labels (templates' too) and
    score (1 at a base place, else the largest share of a template that one block holds, if at least ``least``).

    A block counts for a template if it also holds the words that tell its license, and none that tells another, and if that share of the template's
    words stands in it in their order.  Templates of one label are alike.  Null and empty texts have no words and score 0; long texts are read whole; repeated rows each give a row, a null id too; an empty table gives none; other
    columns of docs are not looked at, whatever their names."""
    vocabulary = vocabulary_of(templates)
    text = docs.select(F.col(text_col).alias("text"))
    counts = text.mapInArrow(_frequencies(vocabulary), "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # one row for each word of the templates
    n = np.zeros(len(vocabulary), np.int64)
    for r in counts:
        n[r["token"]] = r["n"]
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.lexsort((vocabulary, n))] = np.arange(len(vocabulary))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_scan(phrases, templates, vocabulary, rank, least), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
