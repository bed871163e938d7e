"""Licence notices by a positional index of rare words.

Each notice is a template with a mandatory phrase. The words of all templates are counted over all documents; each template
is indexed by the rarest words of its phrase, with their places. A file's occurrences of indexed words name a template and the place
where it would begin; where all rare words of a template agree on that place, the phrase is verified word by word, and
the share of the template's words that stand at their places, weighted by rarity, is the score. Base phrases are found in the
same way, by the rarest of their own words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import texts
from shelfscope.llm.ragged import Words, alphanumeric, slices, text_bytes, words

# Phrases that are counted wherever they stand, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    """A notice: its words, and the phrase inside it that must stand in a file."""

    label: str
    text: str
    phrase: str


# Wording of public licences.
TEMPLATES = (
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("artistic-2.0", "licensed under the artistic license 2 0", "artistic license 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("bsd", "licensed under the bsd 3 clause license", "bsd 3 clause license"),
    Template("bsl-1.0", "boost software license version 1 0", "boost software license"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", "cc by nc nd 4 0"),
    Template("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", "cc by nc sa 4 0"),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc0-1.0", "released under cc0 1 0 universal public domain dedication", "cc0 1 0"),
    Template("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee"),
    Template("lgpl", "licensed under the gnu lesser general public license version 2 1", "gnu lesser general public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("reserved", "copyright all rights reserved", "all rights reserved"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
ANCHORS = 2


def _hash(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return words(data, np.array([0, len(data)]), alphanumeric()).hash[0]


class Vocabulary:
    """Words by number, found by hash; a first look at 16 bits of the hash rules out nearly all words of a text."""

    def __init__(self, names: list[str]):
        hashes = np.array([_hash(w) for w in names], np.uint64)
        order = np.argsort(hashes)
        self.names, self.sorted, self.order = names, hashes[order], order
        self.first_look = np.zeros(1 << 16, bool)
        self.first_look[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known words, and their numbers."""
        place = np.flatnonzero(self.first_look[(hashes & np.uint64(0xFFFF)).astype(np.int32)])
        at = np.minimum(np.searchsorted(self.sorted, hashes[place]), len(self.sorted) - 1)
        hit = self.sorted[at] == hashes[place]
        return place[hit], self.order[at[hit]]


def vocabulary(templates: tuple[Template, ...] = TEMPLATES) -> list[str]:
    return sorted({w for t in templates for w in t.text.split()} | {w for p in BASE_PHRASES for w in p.split()})


def word_frequencies(rows: DataFrame, names: list[str]) -> tuple[dict[str, int], int]:
    """Documents that hold each word, and all documents. As many numbers as there are words in the templates."""

    def run(batches: Iterator[pa.RecordBatch]):
        known, total, n = Vocabulary(names), np.zeros(len(names), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for part in slices(batch, "__text"):
                found = words(*text_bytes(part.column("__text")), alphanumeric())
                place, number = known.find(found.hash)
                row = np.searchsorted(found.offsets, place, "right") - 1
                total += np.bincount(np.unique(row * len(names) + number) % len(names), minlength=len(names))
        yield pa.record_batch({"word": pa.array([*range(len(names)), -1], pa.int64()), "n": pa.array([*total.tolist(), n], pa.int64())})

    counted = {r["word"]: r["n"] for r in rows.select("__text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: counted.get(i, 0) for i, w in enumerate(names)}, counted.get(-1, 0)


class Index:
    """Postings of the rarest words of each template's phrase and of each base phrase, and rarities for the score."""

    def __init__(self, frequency: dict[str, int], n: int, templates: tuple[Template, ...] = TEMPLATES):
        self.templates, self.known = templates, Vocabulary(sorted(frequency))
        number = {w: i for i, w in enumerate(self.known.names)}
        self.idf = np.log((1 + n) / (1 + np.array([frequency[w] for w in self.known.names]))) + 1
        self.words = [np.array([number[w] for w in t.text.split()]) for t in templates]
        self.anchors, self.phrases = [], []
        for t, template in zip(templates, self.words, strict=True):
            phrase = [number[w] for w in t.phrase.split()]
            at = next(i for i in range(len(template)) if template[i : i + len(phrase)].tolist() == phrase)
            self.phrases.append((at, phrase))
            self.anchors.append([(w, at + j) for w, j in self._rarest(phrase)])
        base = [([number[w] for w in p.split()], label) for p, label in BASE_PHRASES.items()]
        self.base = [(phrase, self._rarest(phrase), label) for phrase, label in base]

    def _rarest(self, phrase: list[int]) -> list[tuple[int, int]]:
        """The rarest words of a phrase and their places in it, the rarest first."""
        return [(phrase[j], j) for j in sorted(range(len(phrase)), key=lambda j: (-self.idf[phrase[j]], j))[:ANCHORS]]

    def scan(self, data: np.ndarray, found: Words):
        """For each text: places of base phrases, their labels, all labels, score."""
        place, number = self.known.find(found.hash)
        rows = len(found.offsets) - 1
        starts, base, labels, score = [[] for _ in range(rows)], [set() for _ in range(rows)], [set() for _ in range(rows)], [0.0] * rows
        if not len(place):
            return starts, base, labels, score
        word_at = np.full(len(found.hash) + 1, -1, np.int16)
        word_at[place] = number
        of = {i: place[number == i] for i in np.unique(number).tolist()}
        empty = np.zeros(0, np.int64)

        def standing(first: np.ndarray, phrase: list[int]) -> list[tuple[int, int]]:
            """(row, first word) of the places in ``first`` where the whole phrase stands inside one text, byte by byte."""
            row = np.searchsorted(found.offsets, first, "right") - 1
            fits = (first >= found.offsets[row]) & (first + len(phrase) <= found.offsets[np.minimum(row + 1, rows)])
            first, row = first[fits], row[fits]
            for j, w in enumerate(phrase):
                same = word_at[first + j] == w
                first, row = first[same], row[same]
            text = lambda p: bytes(data[found.start[p] : found.end[p]]).lower().decode()
            return [(r, p) for r, p in zip(row.tolist(), first.tolist(), strict=True) if all(text(p + j) == self.known.names[w] for j, w in enumerate(phrase))]

        def agreed(anchors: list[tuple[int, int]]) -> np.ndarray:
            """Places where a text would begin whose ``anchors`` all stand: their postings, shifted by their places and intersected."""
            begins = None
            for w, where in anchors:
                own = of.get(w, empty) - where
                begins = own if begins is None else begins[np.isin(begins, own, assume_unique=True)]
            return begins

        for phrase, anchors, label in self.base:
            begins = agreed(anchors)
            for r, p in standing(begins[begins >= 0], phrase):
                starts[r].append(p - int(found.offsets[r]))
                base[r].add(label)
                labels[r].add(label)
        for t, template, anchors, (at, phrase) in zip(self.templates, self.words, self.anchors, self.phrases, strict=True):
            begins = agreed(anchors) + at
            for r, p in standing(begins[begins >= 0], phrase):
                labels[r].add(t.label)
                places = p - at + np.arange(len(template))
                inside = (places >= found.offsets[r]) & (places < found.offsets[r + 1])
                same = inside & (word_at[np.where(inside, places, -1)] == template)
                weight = self.idf[template]
                score[r] = max(score[r], float(weight[same].sum() / weight.sum()))
        return starts, base, labels, score


def license_labels(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``__id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
    ``labels``, ``score``.

    Null and empty texts have no words, no labels (empty strings) and score 0. Base phrases that share words count each.
    Labels are distinct, sorted and joined by commas, so ties have no effect. Repeated rows are scanned each; an empty
    table gives no rows; other columns are not read.
    """
    rows = texts(docs, id_column, text_column)
    frequency, n = word_frequencies(rows, vocabulary())

    def run(batches: Iterator[pa.RecordBatch]):
        index = Index(frequency, n)
        for batch in batches:
            for part in slices(batch, "__text"):
                data, offsets = text_bytes(part.column("__text"))
                found = words(data, offsets, alphanumeric())
                starts, base, labels, score = index.scan(data, found)
                yield pa.record_batch({
                    "__id": part.column("__id"), "n_words": pa.array(np.diff(found.offsets), pa.int64()),
                    "n_base": pa.array([len(s) for s in starts], pa.int64()),
                    "first_word": pa.array([min(s, default=None) for s in starts], pa.int64()), "last_word": pa.array([max(s, default=None) for s in starts], pa.int64()),
                    "base_labels": pa.array([",".join(sorted(x)) for x in base]), "labels": pa.array([",".join(sorted(x)) for x in labels]),
                    "score": pa.array(score, pa.float64()),
                })

    kind = rows.schema["__id"].dataType.simpleString()
    columns = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return rows.mapInArrow(run, f"__id {kind}, {columns}")
