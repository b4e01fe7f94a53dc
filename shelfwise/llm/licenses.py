"""Licence scans by a positional index of rare licence words.

Licence notices and phrases are templates: a label, words, and key phrases that must stand. The inverse document
frequency of every template word is counted over all documents. Of each template the words of highest frequency
weight are indexed with their positions. A file's licence words are looked up there; each gives a place where the
template would begin, and a place on which enough words agree is a candidate. A candidate counts when the template's
key phrases stand there, word by word, within a few words of their place. For a phrase all words must stand in place,
so every place of a phrase is found.

The corpus is read twice in whole texts (counting, then scanning); only counts of template words come to the driver,
at most one per word. Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased.

Defined results: a null or empty text has no words, no places, empty labels and score 0; every row is scanned by
itself, repeated or not; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices by which licences are commonly referred to: label, text, and the key phrases that must stand in it.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("mit", "spdx license identifier mit", ["identifier mit"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in "
     "compliance with the license", ["apache license version 2"]),
    ("apache-2", "spdx license identifier apache 2 0", ["identifier apache 2 0"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either "
     "version 3 of the license or any later version", ["gnu general public license", "version 3 of the license"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either "
     "version 2 of the license or any later version", ["gnu general public license", "version 2 of the license"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "licensed under the bsd license", ["the bsd license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", ["permission to use copy modify and or distribute this software"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license", ["commons attribution noncommercial"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["commons attribution 4 0"]),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0"]),
]
#: Words indexed of a notice, of which so many must agree on a place, and the words that a key phrase may be off.
INDEXED, AGREEING, SLACK = 6, 2, 4

# every ASCII character outside 0-9, A-Z and a-z separates words
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[int, tuple[bytes, ...]], ...]  # place in the template, words
    phrase: bool  # a base phrase: all its words, in place


def _template(label: str, text: str, keys: list[str] | None = None) -> Template:
    words = tuple(words_of(text))
    placed = []
    for key in keys or []:
        held = tuple(words_of(key))
        placed.append((next(i for i in range(len(words)) if words[i : i + len(held)] == held), held))
    return Template(label, words, tuple(placed), keys is None)


def templates(phrases: Mapping[str, str] = BASE_PHRASES, notices: list | None = None) -> list[Template]:
    notices = NOTICES if notices is None else notices
    return [_template(label, text) for text, label in phrases.items()] + [_template(*n) for n in notices]


class Index:
    """Postings of the highest-weighted words of each template: word to (template, place)."""

    def __init__(self, of: list[Template], weight: Mapping[bytes, float]):
        self.templates = of
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.agreeing = []
        for t, template in enumerate(of):
            ranked = sorted(range(len(template.words)), key=lambda i: (-weight.get(template.words[i], 0.0), i))
            # a phrase is looked up by its rarest word alone, and then compared as a whole
            chosen = ranked[: 1 if template.phrase else INDEXED]
            self.agreeing.append(min(AGREEING, len(chosen)))
            for place in chosen:
                self.postings[template.words[place]].append((t, place))
        self.words = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Places and labels of the phrases, and the labels of all templates with the share of words in place."""
        known = self.words.intersection(words)
        if not known:
            return [], {}
        votes: Counter[tuple[int, int]] = Counter()
        for at, word in enumerate(words):
            if word in known:
                votes.update((t, at - place) for t, place in self.postings[word])
        places, labels = [], {}
        for (t, begin), agreed in votes.items():
            template = self.templates[t]
            if template.phrase:
                if begin >= 0 and tuple(words[begin : begin + len(template.words)]) == template.words:
                    places.append((begin, template.label))
                    labels[template.label] = 1.0
            elif agreed >= self.agreeing[t] and all(_near(words, begin + at, key) for at, key in template.keys):
                same = sum(w == words[begin + i] for i, w in enumerate(template.words) if 0 <= begin + i < len(words))
                labels[template.label] = max(labels.get(template.label, 0.0), same / len(template.words))
        return places, labels


def _near(words: list[bytes], at: int, key: tuple[bytes, ...]) -> bool:
    return any(tuple(words[max(i, 0) : max(i, 0) + len(key)]) == key for i in range(at - SLACK, at + SLACK + 1))


def word_weights(docs: DataFrame, of: list[Template]) -> dict[bytes, float]:
    """Inverse document frequency of the template words over all of ``docs(text)``."""
    vocabulary = frozenset(w for t in of for w in t.words)
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(vocabulary.intersection(words_of(text)))
                counts[b""] += 1  # the number of documents
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], schema=schema)

    found = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {bytes(r["word"]): r["n"] for r in found.collect()}
    total = counts.get(b"", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


def scan_licenses(docs: DataFrame, phrases: Mapping[str, str] = BASE_PHRASES, notices: list | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of ``docs(doc_id, text)``.

    ``n_base`` counts the places of all phrases, ``first_word`` and ``last_word`` are the first and last of them;
    ``score`` is the largest share of a found template's words that stand in place.
    """
    of = templates(phrases, notices)
    index = Index(of, word_weights(docs, of))
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                places, labels = index.scan(words)
                begins = [p for p, _ in places]
                base = ",".join(sorted({label for _, label in places}))
                rows.append((
                    doc_id, len(words), len(places), min(begins, default=None), max(begins, default=None), base,
                    ",".join(sorted(labels)), max(labels.values(), default=0.0),
                ))
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        scan,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double",
    )
