"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a line, or some lines one after another without a blank one between them, of at most WIDTH words together; its tokens
form a set. A whole paragraph is tried first, as no run of its lines can meet a template that it doesn't. A
block meets a template if it holds at least `percent` of the template's distinct tokens.
Tokens are ordered by how many lines of the whole corpus hold them, rarest first. A block
that meets a template must hold one of the template's first |T| - need + 1 tokens (prefix
filter), must have `need` distinct tokens (length filter), and from the first shared token
on both sides must have enough left (positional filter); what passes is counted exactly. The
templates are a fixed list, so every document finds its matches without a shuffle.

Besides, the base scan counts fixed phrases at their places among the document's words.
Null and empty texts: no words, no labels, score 0. Null doc_ids and repeated rows are
returned as they come; extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, texts

# The phrases of the base scan and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Sentences of public licenses, by label.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("proprietary", "all rights reserved"),
]
#: 90: templates of fewer than ten tokens must be met in full, so CC BY-NC is not taken for CC BY-SA.
PERCENT = 90
#: Words of a block of several lines: twice those of the longest template.
WIDTH = 2 * max(len(t.split()) for _, t in TEMPLATES)
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

#: Bytes to themselves if they are of words (digits, a-z, all beyond ASCII), A-Z to a-z, others to a space; lines are split before.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _paragraphs(text: bytes) -> list[list[list[bytes]]]:
    """The words of the lines of each paragraph: of the lines with words between two without."""
    found: list[list[list[bytes]]] = [[]]
    for line in text.split(b"\n"):
        if words := line.translate(_TABLE).split():
            found[-1].append(words)
        elif found[-1]:
            found.append([])
    return found


def _frequencies(vocabulary: frozenset[bytes]):
    def run(batches):
        counts = dict.fromkeys(vocabulary, 0)
        for _, rows in texts(batches):
            for text in rows:
                for line in (text or b"").split(b"\n"):
                    for w in vocabulary.intersection(line.translate(_TABLE).split()):
                        counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts]), pa.array(counts.values(), pa.int64())], ["token", "n"])

    return run


class Templates:
    """Templates as token ranks in global order, with the index of their prefixes."""

    def __init__(self, frequency: dict[str, int], percent: int):
        tokens = sorted({w for _, t in TEMPLATES for w in t.split()}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w.encode(): i for i, w in enumerate(tokens)}
        self.sets, self.index = [], {}
        for label, text in TEMPLATES:
            ranks = sorted(self.rank[w.encode()] for w in set(text.split()))
            need = -(-percent * len(ranks) // 100)
            for place in range(len(ranks) - need + 1):
                self.index.setdefault(ranks[place], []).append((len(self.sets), place))
            self.sets.append((label, frozenset(ranks), len(ranks), need))

    def matches(self, words: list[bytes]) -> dict[int, float]:
        """Template number to containment, for templates that a block with these words meets."""
        distinct = set(words)
        ranks = sorted(self.rank[w] for w in self.rank.keys() & distinct)
        out = {}
        for at, rank in enumerate(ranks):
            for t, place in self.index.get(rank, ()):
                label, tokens, size, need = self.sets[t]
                if t in out or len(distinct) < need or place + min(size - place, len(ranks) - at) < need:
                    continue
                common = len(tokens.intersection(ranks))
                if common >= need:
                    out[t] = common / size
        return out


    def best(self, paragraph: list[list[bytes]]) -> dict[int, float]:
        """Template number to the best containment in a block of the paragraph's lines."""
        out: dict[int, float] = {}

        def add(words: list[bytes]) -> None:
            for t, share in self.matches(words).items():
                out[t] = max(share, out.get(t, 0.0))

        for words in paragraph:
            add(words)
        whole = self.matches([w for line in paragraph for w in line]) if len(paragraph) > 1 else {}
        if any(share > out.get(t, 0.0) for t, share in whole.items()):
            for i, first in enumerate(paragraph):
                words = list(first)
                for line in paragraph[i + 1 :]:
                    words = words + line
                    if len(words) > WIDTH:
                        break
                    add(words)
        return out


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase starts; joined has a space before and after each word."""
    found, at = [], joined.find(b" " + phrase + b" ")
    count = last = 0
    while at >= 0:
        count += joined.count(b" ", last, at)
        last = at
        found.append(count)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return found


def _scan(templates):
    def run(batches):
        known = templates.value
        for part, rows in texts(batches):
            out = []
            for text in rows:
                words = (text or b"").translate(_TABLE).split()
                joined = b" " + b" ".join(words) + b" "
                base = {label: at for phrase, label in PHRASES.items() if (at := _places(joined, phrase.encode()))}
                places = [x for at in base.values() for x in at]
                best: dict[str, float] = {}
                for paragraph in _paragraphs(text or b""):
                    for t, share in known.best(paragraph).items():
                        label = known.sets[t][0]
                        best[label] = max(share, best.get(label, 0.0))
                score = 1.0 if base else max(best.values(), default=0.0)
                out.append((
                    len(words), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(base)), ",".join(sorted(base.keys() | best.keys())), score,
                ))
            columns = list(zip(*out)) or [[]] * 7
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], SCHEMA.replace(" long", "").replace(" string", "").replace(" double", "").split(", "))

    return run


def scan_licenses(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """n_words, the base scan's places and labels, all labels and the best containment for every row of docs (doc_id, text)."""
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocabulary = frozenset(w.encode() for _, t in TEMPLATES for w in t.split())
    counted = docs.select("text").mapInArrow(_frequencies(vocabulary), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    frequency = {r["token"]: r["n"] for r in counted.collect()}  # one row per template token
    templates = docs.sparkSession.sparkContext.broadcast(Templates(frequency, percent))
    return docs.mapInArrow(_scan(templates), SCHEMA)
