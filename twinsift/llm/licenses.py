"""Licence scans with a positional index of rare words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.common import alnum_words, as_bytes, slices

# The plain phrases and their labels.
PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]

# Label, wording of the public notice, phrases that must stand in it.
TEMPLATES = [
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ["permission is hereby granted free of charge"]),
    ("apache", "Licensed under the Apache License, Version 2.0", ["apache license"]),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["apache org licenses"]),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license"]),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ["gnu general public license"]),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["lesser general public license"]),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["affero general public license"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike"]),
    ("cc-by", "Licensed under CC BY 4.0", ["cc by 4"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4"]),
    ("cc0", "Dedicated to the public domain under CC0 1.0 Universal", ["cc0 1 0"]),
]


@dataclass(frozen=True)
class Found:
    n_words: int
    n_base: int
    first_word: int | None
    last_word: int | None
    base_labels: list[str]
    labels: list[str]
    score: float


class LicenseIndex:
    """Postings ``(template, position)`` of each template's rarest words, for lookup by relative position."""

    def __init__(self, idf: dict[bytes, float] | None = None, anchors: int = 3, coverage: float = 0.6, templates=TEMPLATES, phrases=PHRASES, drift: int = 4):
        self.coverage, self.drift = coverage, drift
        coded = [(label, alnum_words(text.encode()), [w for p in must if (w := alnum_words(p.encode()))]) for label, text, must in templates]
        plain = [(label, w) for text, label in phrases if (w := alnum_words(text.encode()))]
        self.words = {w: i for i, w in enumerate(sorted({w for _, t, _ in coded for w in t} | {w for _, p in plain for w in p}), 1)}
        number = lambda ws: np.array([self.words.get(w, 0) for w in ws])
        self.templates = [(label, number(t), [number(p) for p in must]) for label, t, must in coded]
        self.phrases = [(label, number(p)) for label, p in plain]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        self.need = []
        for t, (_, words, _) in enumerate(coded):
            rare = sorted(set(words), key=lambda w: (-(idf or {}).get(w, 0.0), w))[:anchors]
            self.need.append(min(2, len(rare)))
            for q, w in enumerate(words):
                if w in rare:
                    self.postings.setdefault(self.words[w], []).append((t, q))
        reverse = {i: w for w, i in self.words.items()}
        self.starters = {reverse[i] for i in self.postings} | {w for _, p in plain for w in p[-1:]}

    def scan(self, text: bytes | None) -> Found:
        words = alnum_words(text)
        if self.starters.isdisjoint(words):
            return Found(len(words), 0, None, None, [], [], 0.0)
        get = self.words.get
        ids = np.array([get(w, 0) for w in words])
        starts, base = [], set()
        for label, phrase in self.phrases:
            at = self._places(ids, phrase)
            if len(at):
                base.add(label)
                starts.append(at)
        votes: list[np.ndarray] = []
        for word, posts in self.postings.items():
            at = np.flatnonzero(ids == word)
            for t, q in posts if len(at) else ():
                votes.append(np.stack([np.full(len(at), t), at - q, np.full(len(at), word)], 1))
        own, best = set(), 0.0
        votes = np.unique(np.concatenate(votes), axis=0) if votes else np.zeros((0, 3), np.int64)
        first = 0
        for t, offset in np.unique(votes[:, :2], axis=0).tolist():
            while tuple(votes[first, :2]) < (t, offset):
                first += 1
            near, last = set(), first
            while last < len(votes) and votes[last, 0] == t and votes[last, 1] <= offset + self.drift:
                near.add(int(votes[last, 2]))
                last += 1
            label, wanted, must = self.templates[t]
            if len(near) < self.need[t] or (label in own and best == 1):
                continue
            share = self._share(ids, wanted, offset)
            if share >= self.coverage and all(len(self._places(ids[max(0, offset - self.drift) : offset + len(wanted) + self.drift], p)) for p in must):
                own.add(label)
                best = max(best, share)
        at = np.concatenate(starts) if starts else None
        ends = (int(at.min()), int(at.max())) if starts else (None, None)
        return Found(len(words), sum(map(len, starts)), *ends, sorted(base), sorted(base | own), best)

    def _share(self, ids: np.ndarray, wanted: np.ndarray, offset: int) -> float:
        """Part of the template's words that stand in place: all at the best shift, runs of three or more at others."""
        met, best = np.zeros(len(wanted), bool), np.zeros(len(wanted), bool)
        for at in range(offset - self.drift, offset + self.drift + 1):
            lo, hi = max(0, at), min(len(ids), at + len(wanted))
            if lo >= hi:
                continue
            same = np.zeros(len(wanted), bool)
            same[lo - at : hi - at] = ids[lo:hi] == wanted[lo - at : hi - at]
            if same.sum() > best.sum():
                best = same
            ends = np.flatnonzero(same[2:] & same[1:-1] & same[:-2])
            for k in range(3):
                met[ends + k] = True
        return float((met | best).mean())

    @staticmethod
    def _places(ids: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        m = len(ids) - len(phrase) + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        ok = ids[:m] == phrase[0]
        for j in range(1, len(phrase)):
            ok &= ids[j : j + m] == phrase[j]
        return np.flatnonzero(ok)


def word_idf(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> dict[bytes, float]:
    """Inverse document frequency over all rows of ``docs`` of every word that a template has."""
    vocabulary = {w for _, t, _ in templates for w in alnum_words(t.encode())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = dict.fromkeys(vocabulary, 0)
        rows = 0
        for batch in slices(batches, 256):
            rows += batch.num_rows
            for text in as_bytes(batch.column(0)):
                for w in vocabulary.intersection(alnum_words(text)):
                    counts[w] += 1
        words = [None, *(w.decode() for w in counts)]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([rows, *counts.values()], pa.int64())], ["word", "n"])

    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in sums.collect()}
    total = found.pop(None, 0)
    return {w.encode(): float(np.log((1 + total) / (1 + n))) for w, n in found.items()}


def scan(docs: DataFrame, anchors: int = 3, coverage: float = 0.6, templates=TEMPLATES, phrases=PHRASES, drift: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence phrases and notices in whole texts; one row per row of ``docs``.

    Columns: ``doc_id, n_words, n_base`` (places of the plain phrases), ``first_word, last_word`` (their first and
    last start; null without any), ``base_labels, labels, score``. A template is looked up by its ``anchors`` words
    of highest inverse document frequency over the corpus: where two of them stand at the template's relative
    positions, give or take ``drift`` words, at least the part ``coverage`` of its words must stand there, with its mandatory
    phrases whole. The best shift counts all its words, other shifts runs of three or more, so that words put in or left
    out only cost what is near them. The score is the best such part, 0 without any. ``templates(label, text, mandatory
    phrases)`` and ``phrases(phrase, label)`` may be the caller's; whole licence texts are templates like any other. Null and empty texts have no words; null ids, repeated
    rows and extra columns change nothing; no rows give no rows.
    """
    idf = word_idf(docs, text_col, templates)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LicenseIndex(idf, anchors, coverage, templates, phrases, drift)
        for batch in slices(batches, 256):
            found = [index.scan(t) for t in as_bytes(batch.column(1))]
            out = [pa.array([getattr(f, n) for f in found], pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")]
            out += [pa.array([",".join(getattr(f, n)) for f in found], pa.string()) for n in ("base_labels", "labels")]
            out.append(pa.array([f.score for f in found], pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], COLUMNS)

    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
