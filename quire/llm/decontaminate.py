"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and freed of outer punctuation; numbers, names and units become typed placeholders. A
capitalised word is a name, unless it begins a sentence and the benchmark has it in lower case somewhere (a bitmap of the
benchmark's lower-case words tells both sides alike); a line break begins no sentence. Windows of W canonical words of the benchmark
items are joined by hash with those of the documents, so a question with other numbers or
names still meets its template. A window of placeholders alone, as in a table of numbers, keeps its values. Of equal windows
of an item the first one counts. Matches are laid along diagonals (place in the
document less place in the item); on a diagonal, which holds no more matches than the item has windows, the slots must be
consistent: one value of the item always has the same value in the document, and the other way round. A document is
contaminated by an item if consistent matches cover SHARE of its windows, or RUN words in a row.

Documents pass a bitmap of the benchmark's window hashes first: CELLS bits, however long the benchmark
is. What passes goes to the hash join, so a full bitmap costs time, not rows.

Null and empty texts and items without words match nothing. An item shorter than W words is one
window of its own length, if it has LEAST words. Null doc_ids and repeated rows are
returned as they come; extra columns are ignored. An empty benchmark contaminates nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small, texts, wrapped
from .memos import LONG, turn
from .words import MEMO, windows

W, LEAST, RUN, SHARE = 8, 5, 13, 0.5
#: Bits of the bitmaps of window hashes and of lower-case words.
CELLS = 1 << 24

# Units of measure and money.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent dollar dollars cent cents euro euros mph kmh degree degrees watt watts volt volts"
).split()
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(?:%|st|nd|rd|th)?")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_PLAIN, _NUM, _UNIT = 0, 1, 2


class _Words(dict):
    """A raw word to its place in arrays of hashes, kinds, capitals and sentence ends. Cleared between texts when it holds much."""

    held = 0

    def __init__(self):
        self.made(1 << 16)

    def clear(self):
        super().clear()
        self.held = 0

    def made(self, room: int):
        """Room for so many words; what is there stays."""
        for name, kind in (("plain", np.uint64), ("exact", np.uint64), ("kind", np.int8), ("capital", bool), ("ends", bool)):
            new = np.zeros(room, kind)
            new[: len(self)] = getattr(self, name, new)[: len(self)]
            setattr(self, name, new)

    def __missing__(self, raw: bytes) -> int:
        word = raw.decode("utf-8", "replace")
        core = word.strip(_EDGES)
        lower = core.lower()
        kind = _NUM if _NUMBER.fullmatch(word.rstrip(".,;:!?)")) or _NUMBER.fullmatch(core) else _UNIT if lower in _UNITS_SET else _PLAIN
        at = len(self)
        if at == len(self.plain):
            self.made(2 * at)
        self[raw] = at
        self.held += len(raw)
        self.exact[at] = xxhash.xxh3_64_intdigest(lower)
        self.plain[at] = self.exact[at] if kind == _PLAIN else xxhash.xxh3_64_intdigest(f"<{kind}>")
        self.kind[at] = kind
        self.capital[at] = kind == _PLAIN and core[:1].isupper() and core[1:].islower()
        self.ends[at] = word.rstrip("\"')]")[-1:] in (".", "!", "?", ":")
        return at


_UNITS_SET = frozenset(UNITS)
_NAME = np.uint64(xxhash.xxh3_64_intdigest("<name>"))
WORDS = _Words()


def _bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cell = keys & np.uint64(CELLS - 1)
    return ((bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


class Canonical:
    """A text's canonical words: hashes with names, numbers and units as placeholders, hashes of the words themselves, raw words, kinds of slot (0: none)."""

    def __init__(self, text: bytes, common: np.ndarray):
        if len(WORDS) > MEMO or WORDS.held > LONG * MEMO:
            WORDS.clear()
        self.raw = text.split()
        at = np.fromiter(map(WORDS.__getitem__, self.raw), np.int64, len(self.raw))
        start = np.ones(len(at), bool)
        start[1:] = WORDS.ends[at[:-1]]
        self.exact = WORDS.exact[at]
        name = WORDS.capital[at] & ~(start & _bit(common, self.exact))
        self.hashes, self.kinds = np.where(name, _NAME, WORDS.plain[at]), np.where(name, 3, WORDS.kind[at])

    def keys(self, size: int) -> np.ndarray:
        """Hash of each window; of the words themselves where all are slots."""
        slots = np.concatenate([[0], np.cumsum(self.kinds > 0)])
        return np.where(slots[size:] - slots[:-size] == size, windows(self.exact, size), windows(self.hashes, size))

    def rows(self, sizes: list[int], passes=None):
        """(hash, size, place, slots) of the windows that pass; slots are kind=word texts."""
        for size in sizes:
            if len(self.raw) < size:
                continue
            keys = self.keys(size)
            places = np.arange(len(keys)) if passes is None else np.flatnonzero(passes(keys))
            for p in places.tolist():
                slots = [f"{i}{self.kinds[p + i]}={self.raw[p + i].decode('utf-8', 'replace').strip(_EDGES).lower()}" for i in np.flatnonzero(self.kinds[p : p + size]).tolist()]
                yield int(keys[p].view(np.int64)), size, p, slots


_WINDOWS = pa.list_(pa.struct([("h", pa.int64()), ("size", pa.int32()), ("p", pa.int32()), ("slots", pa.list_(pa.string()))]))
_WINDOWS_SQL = "array<struct<h: long, size: int, p: int, slots: array<string>>>"


def _lower_cells(batches):
    """Cells of the items' words that are written in lower case."""
    for _, rows in texts(batches):
        words = {w for text in rows for w in (text or b"").split()}
        lower = [x.strip(_EDGES) for w in words if (x := w.decode("utf-8", "replace")).strip(_EDGES).islower()]
        cells = np.unique(np.array([xxhash.xxh3_64_intdigest(x) & (CELLS - 1) for x in lower], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64())], ["c"])


def _bitmap(cells: DataFrame) -> bytes:
    """Bits for the distinct values of c, of which there are at most CELLS."""
    cell = cells.distinct().toArrow().column("c").to_numpy()
    bits = np.zeros(CELLS // 8, np.uint8)
    np.bitwise_or.at(bits, cell >> 3, (1 << (cell & 7)).astype(np.uint8))
    return bits.tobytes()


def _item_windows(common, w: int, least: int):
    def run(batches):
        lower = np.frombuffer(common.value, np.uint8)
        for part, rows in texts(batches):
            out = []
            for text in rows:
                n = len((text or b"").split())
                size = w if n >= w else n
                first: dict[int, dict] = {}
                for x in Canonical(text, lower).rows([size]) if size >= least else ():
                    first.setdefault(x[0], dict(zip(("h", "size", "p", "slots"), x)))
                out.append(list(first.values()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, _WINDOWS)], ["item_id", "windows"])

    return run


def _doc_windows(common, cells, sizes: list[int]):
    def run(batches):
        turn(__name__, WORDS.clear)
        lower, bits = (np.frombuffer(b.value, np.uint8) for b in (common, cells))
        for part, rows in texts(batches):
            out = [[dict(zip(("h", "size", "p", "slots"), x)) for x in Canonical(text, lower).rows(sizes, lambda keys: _bit(bits, keys))] if text else [] for text in rows]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, _WINDOWS)], ["doc_id", "text_key", "windows"])

    return run


def _aligned(batches):
    """Matches on a diagonal (q, size, ours, theirs) to the words in the longest consistent run, the places of its windows in the item, and changed slots."""
    for batch in batches:
        out = []
        for found in batch.column("matches").to_pylist():
            to: dict[str, str] = {}
            back: dict[tuple[str, str], str] = {}
            spans = []
            for m in sorted(found, key=lambda m: m["q"]):
                pairs = [(a[len(a) - len(a.lstrip("0123456789")) - 1] + a.partition("=")[2], b.partition("=")[2]) for a, b in zip(m["theirs"], m["ours"])]
                if all(to.get(a, b) == b and back.get((a[0], b), a) == a for a, b in pairs):
                    for a, b in pairs:
                        to[a], back[a[0], b] = b, a
                    spans.append((m["q"], m["q"] + m["size"]))
            start = end = None
            longest = 0
            for s, e in spans:
                start, end = (s, e) if end is None or s > end else (start, max(end, e))
                longest = max(longest, end - start)
            out.append((longest, [s for s, _ in spans], sum(a[1:] != b for a, b in to.items())))
        columns = list(zip(*out)) or [[]] * 3
        arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.list_(pa.int32()), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_key", "item_id", "n_windows")), *arrays], ["doc_id", "text_key", "item_id", "n_windows", "run_words", "places", "changed"])


def matches(docs: DataFrame, benchmark: DataFrame, w: int = W, run_words: int = RUN, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """(documents, hits): a row (doc_id, text_key) for each row of docs, and (doc_id, text_key, item_id, run_words, covered, changed) for contaminations."""
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast
    common = shared(_bitmap(items.select("text").mapInArrow(_lower_cells, "c long")))
    theirs = materialize(items.mapInArrow(_item_windows(common, w, LEAST), f"item_id long, windows {_WINDOWS_SQL}"), "items")
    theirs = theirs.select("item_id", F.size("windows").alias("n_windows"), F.explode("windows").alias("x")).select("item_id", "n_windows", "x.h", "x.size", F.col("x.p").alias("q"), F.col("x.slots").alias("theirs"))
    cells = shared(_bitmap(theirs.select(F.expr(f"h & {CELLS - 1}").alias("c"))))
    sizes = sorted(r["size"] for r in theirs.select("size").distinct().collect())  # at most w sizes
    found = materialize(docs.mapInArrow(_doc_windows(common, cells, sizes), f"doc_id long, text_key long, windows {_WINDOWS_SQL}"), "windows")
    ours = found.where("size(windows) > 0").distinct()  # repeated rows are compared once
    ours = ours.select("doc_id", "text_key", F.explode("windows").alias("x")).select("doc_id", "text_key", "x.h", "x.size", "x.p", F.col("x.slots").alias("ours"))
    joined = ours.join(small(theirs), ["h", "size"]).withColumn("diagonal", F.col("p") - F.col("q"))
    pair = ["doc_id", "text_key", "item_id", "n_windows"]
    groups = joined.groupBy(*pair, "diagonal").agg(F.collect_list(F.struct("q", "size", "ours", "theirs")).alias("matches"))  # as long as an item
    laid = groups.mapInArrow(_aligned, "doc_id long, text_key long, item_id long, n_windows int, run_words int, places array<int>, changed int")
    by_place = laid.select(*pair, "run_words", "changed", F.explode("places").alias("q")).groupBy(*pair, "q").agg(F.max("run_words").alias("run_words"), F.max("changed").alias("changed"))
    hits = by_place.groupBy(*pair).agg(F.max("run_words").alias("run_words"), F.count("*").cast("int").alias("covered"), F.max("changed").alias("changed"))
    hits = hits.where((F.col("run_words") >= run_words) | (F.col("covered") >= share * F.col("n_windows"))).drop("n_windows")
    return found.select("doc_id", "text_key"), materialize(hits, "hits")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated and item_ids (sorted) for every row of docs."""
    rows, hits = matches(docs, benchmark, **options)
    flagged = hits.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("hit_key")).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    out = rows.join(small(materialize(flagged, "flagged")), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("hit_key")), "left")
    return out.select("doc_id", F.col("hit_key").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones; rows with equal id and text go together."""
    _, hits = matches(docs, benchmark, **options)
    flagged = materialize(hits.select(F.col("doc_id").alias("id"), F.col("text_key").alias("hit_key")).distinct(), "flagged")
    marked = wrapped(docs, doc_id=F.col("doc_id").cast("long"), text_key=F.xxhash64(F.col("text").cast("string")))
    return marked.join(small(flagged), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("hit_key")), "left_anti").select("row.*")
