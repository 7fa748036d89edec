"""Quality rules with line sequence labelling by a linear-chain conditional random field.

Every line with a word gets features (length, symbols, capitals, repetition, punctuation).
A two-label chain (content, boilerplate) is trained on the lines of a bounded sample of
labelled documents: SAMPLE documents of the labels table, those with the least hash of their
id, half of each quality as far as there are. Lines of good documents count as content, lines
of bad ones as boilerplate; besides these sequences of one label, mixed ones are made, lines of a bad document set into a
good one's, so that the field learns how labels change. Viterbi decoding labels each document's lines; a document
whose words lie in content lines to less than SHARE is rejected.

Base rules: fewer than 50 words, or more than half the words in repeated three-word windows.
Without labels of both kinds, every line is content. Null and empty texts: no words, counts 0, base_failed.
Null doc_ids, repeated rows: returned as they come. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, readable, texts
from .memos import turn
from .words import HASHES, windows, word_hashes

#: Documents of the labels table that the field is trained on, at most.
SAMPLE = 1600
#: Lines of a document that the field is trained on, at most.
LINES = 1000
#: Least share of words in content lines.
SHARE = 0.5
#: Lines of a training sequence; longer documents give several.
SPAN = 32
FEATURES = ["bias", "words", "symbols", "capitals", "marks", "again", "distinct", "length", "stop", "copy", "digits"]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"

_SPACES, _SYMBOLS = " \t\n\r\x0b\f", "#*$%&|<>"
_MARKS = re.compile(r"[!?#*$%&|<>=_~^@]")


def line_features(line: str, seen: bool) -> list[float]:
    """FEATURES of a line that has a word; seen: an equal line stands before it in the document."""
    words = line.split()
    n, chars = max(len(words), 1), len(line)
    upper = sum(map(str.isupper, words))
    marks = len(_MARKS.findall(line))
    again = sum(map(str.__eq__, words, words[1:]))
    digits = sum(map(str.isdigit, words))
    return [
        1.0, min(n, 200) / 100, sum(map(line.count, _SYMBOLS)) / n, upper / n, marks / n, again / n, len(set(words)) / n,
        min(chars / n, 40) / 10, float(line.rstrip()[-1:] in ".!?:\"'"), float(seen), digits / n,
    ]


def _lines(text: str) -> tuple[list[str], list[bool]]:
    """Lines with a word, and whether an equal line stands before each."""
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    if len(set(lines)) == len(lines):
        return lines, [False] * len(lines)
    found: set[str] = set()
    return lines, [x in found or found.add(x) is not None for x in lines]


class Field:
    """Linear-chain conditional random field of two labels: 1 content, 0 boilerplate."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps  # (2, features), (2, 2)

    def content(self, features: np.ndarray) -> np.ndarray:
        """Viterbi labels of one document's lines (a row of features each)."""
        scores = (features @ self.weights.T).tolist()
        (s00, s01), (s10, s11) = self.steps.tolist()
        a, b = scores[0]
        back = []
        for x, y in scores[1:]:
            from_a, from_b = a + s00 >= b + s10, a + s01 > b + s11
            back.append((from_a, from_b))
            a, b = (a + s00 if from_a else b + s10) + x, (a + s01 if from_b else b + s11) + y
        label = b >= a
        out = [label]
        for from_a, from_b in reversed(back):
            label = not (from_b if label else from_a)
            out.append(label)
        return np.array(out[::-1], bool)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def mixed(sequences: list[tuple[np.ndarray, int]], seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sequences with a label for each line, and as many made of a run of a bad one's lines within a good one's."""
    r = np.random.default_rng(seed)
    out = [(x, np.full(len(x), y)) for x, y in sequences]
    good, bad = ([x for x, y in sequences if y == label] for label in (1, 0))
    for i in range(len(sequences) if good and bad else 0):
        g, b = good[i % len(good)][:SPAN], bad[r.integers(len(bad))]
        size = int(r.integers(1, min(len(b), SPAN // 2) + 1))
        start, at = int(r.integers(len(b) - size + 1)), int(r.integers(len(g) + 1))
        b = b[start : start + size]
        out.append((np.concatenate([g[:at], b, g[at:]]), np.concatenate([np.ones(at, int), np.zeros(size, int), np.ones(len(g) - at, int)])))
    return out


def train(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 120, ridge: float = 1e-3) -> Field:
    """Maximum conditional likelihood by gradient ascent (Adam) of sequences of lines with a label each."""
    spans = [(x[i : i + SPAN], y[i : i + SPAN]) for x, y in sequences for i in range(0, len(x), SPAN)]
    longest, k = max(len(x) for x, _ in spans), len(FEATURES)
    x, on = np.zeros((len(spans), longest, k)), np.zeros((len(spans), longest), bool)
    true = np.zeros((len(spans), longest, 2))
    for i, (rows, labels) in enumerate(spans):
        x[i, : len(rows)], on[i, : len(rows)] = rows, True
        true[i, np.arange(len(rows)), labels] = 1
    share = np.full(len(spans), 1 / max(on.sum(), 1))
    told = np.einsum("sla,slb->ab", true[:, :-1], true[:, 1:]) * share[0]
    w, s = np.zeros((2, k)), np.zeros((2, 2))
    moments = [np.zeros(2 * k + 4), np.zeros(2 * k + 4)]
    for t in range(1, rounds + 1):
        e = x @ w.T
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for i in range(1, longest):
            step = _lse(alpha[:, i - 1, :, None] + s, 1) + e[:, i]
            alpha[:, i] = np.where(on[:, i, None], step, alpha[:, i - 1])
        for i in range(longest - 2, -1, -1):
            step = _lse(s + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where(on[:, i + 1, None], step, 0)
        z = _lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * on[..., None]
        # The labels less what the field expects, for lines and for steps.
        gw = np.einsum("slc,slk,s->ck", true - p, x, share)
        both = np.exp(alpha[:, :-1, :, None] + s + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * on[:, 1:, None, None]
        gs = told - np.einsum("slab,s->ab", both, share)
        g = np.concatenate([(gw - ridge * w).ravel(), (gs - ridge * s).ravel()])
        moments = [0.9 * moments[0] + 0.1 * g, 0.99 * moments[1] + 0.01 * g * g]
        move = 0.1 * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-9)
        w, s = w + move[: 2 * k].reshape(2, k), s + move[2 * k :].reshape(2, 2)
    return Field(w, s)


def _featured(batches):
    """Arrow batches (quality, text) to (quality, features of each line, flat)."""
    for part, rows in texts(batches):
        flat = []
        for text in rows:
            lines, seen = _lines((text or b"").decode())
            start = zlib.crc32(text or b"") % max(len(lines) - LINES, 1)  # of a very long document LINES lines in a row
            flat.append([v for x, s in zip(lines[start : start + LINES], seen[start : start + LINES]) for v in line_features(x, s)])
        yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), pa.array(flat, pa.list_(pa.float64()))], ["quality", "features"])


def fit_field(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field | None:
    """The field trained on at most `sample` labelled documents; None if one kind is missing."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    chosen = None
    for quality in (0, 1):
        part = labels.where(F.col("quality") == quality).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.withColumnRenamed("doc_id", "__id")
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))  # at most `sample` ids
    rows = rows.groupBy("__id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("quality", "x.text")  # one row of each
    found = [(np.array(r["features"]).reshape(-1, len(FEATURES)), r["quality"]) for r in rows.mapInArrow(_featured, "quality int, features array<double>").collect() if r["features"]]
    found.sort(key=lambda f: (f[1], f[0].shape, f[0].tobytes()))
    return train(mixed(found)) if {y for _, y in found} == {0, 1} else None


def _judged(field, share: float):
    def run(batches):
        turn(__name__, HASHES.clear)
        model = field.value
        for part, rows in texts(batches):
            out = []
            for data in rows:
                data = data or b""
                text = data.decode()
                words = data.split()
                n = len(words)
                lines, seen = _lines(text)
                repeated = 0
                if n >= 3:
                    _, inverse, counts = np.unique(windows(word_hashes(words), 3), return_inverse=True, return_counts=True)
                    twice = counts[inverse] > 1
                    if twice.any():
                        covered = np.zeros(n, bool)
                        for i in range(3):
                            covered[i : i + len(twice)] |= twice
                        repeated = int(covered.sum())
                failed = n < 50 or 100 * repeated > 50 * n
                content = 1.0
                if model and lines:
                    label = model.content(np.array([line_features(x, s) for x, s in zip(lines, seen)]))
                    size = np.array([len(x.split()) for x in lines])
                    content = float(size[label].sum() / max(size.sum(), 1))
                out.append((n, len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), sum(seen), repeated, failed, not failed and content >= share, content))
            columns = list(zip(*out)) or [[]] * 8
            kinds = (*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"],
            )

    return run


def quality_rules(docs: DataFrame, labels: DataFrame, share: float = SHARE) -> DataFrame:
    """The base counts, base_failed, kept and content_share for every row of docs (doc_id, text)."""
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), readable("text").alias("text"))
    field = docs.sparkSession.sparkContext.broadcast(fit_field(docs, labels))
    return docs.mapInArrow(_judged(field, share), SCHEMA)
