"""Ranked lexical search over a bit-sliced impact index.

The index has one row for each block of about BLOCK documents: their ids and lengths, and for each term the places
and frequencies of the documents that hold it. With the statistics of the whole collection, a block's
term becomes a bit-sliced bitmap: slice s has the bit of every document of which the term's impact (weight times damped
frequency, a whole number) has bit s. An item's scores in a block are the sums of its terms' slices, made
by carry arithmetic on whole bitmaps, term by term in a tree. The best k are found without sorting: from
the most significant slice down, documents with the bit are kept while more than k have it. Slices of a block live in
one task while it answers all items of a chunk; only k rows an item leave a task.

`vocabulary` restricts the index to terms that some query has; without it, every term is indexed and the table can serve any
items. All documents are indexed either way, and results are exact.

Null and empty texts hold no term, do not count in N, and are never found. Documents without an id rank last among equal
scores; repeated rows rank each for itself, and so do repeated items or items without an id or text (no rows). An
empty collection or query set gives no rows. Bytes that are not UTF-8 count as letters. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, materialize, small, texts
from .memos import turn

#: Documents and postings of a block, about.
BLOCK, POSTINGS = 2048, 2_000_000
#: Items of a chunk; of these, so many are added up at once, so many terms at a time.
CHUNK, TOGETHER, FOLD = 256, 8, 32
#: Terms and their bytes up to which the vocabulary goes to every task.
TERMS, TERM_BYTES = 1_000_000, 32 << 20
#: Rows that a task keeps of what it found.
HELD = 200_000

# The damping of frequencies by length, and the scale of weights.
SCALE, DAMPING, LENGTH_PERCENT, WEIGHT_SCALE = 1_000_000_000, 8, 75, 1000

_LETTERS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(128)) + bytes(range(128, 256))
#: A-Z to lower case, digits, letters and all bytes beyond ASCII as they are, everything else to a space.
TABLE = _LETTERS.lower()
_INDEX = "ids array<long>, lengths array<long>, terms array<string>, df array<long>, at array<int>, tf array<long>"


def term_counts(text: bytes | None, size: int = 4 << 20) -> Counter:
    """Terms of a text with their frequencies, counted by parts of about `size` bytes."""
    clean, counts, start = (text or b"").translate(TABLE), Counter(), 0
    while start < len(clean):
        end = clean.find(b" ", start + size)
        end = len(clean) if end < 0 else end
        counts.update(clean[start:end].split())
        start = end
    return counts


class _Block:
    def __init__(self):
        self.ids, self.lengths, self.at, self.tf, self.size = [], [], defaultdict(list), defaultdict(list), 0

    def add(self, doc, counts: Counter, terms) -> None:
        for term in terms:
            self.at[term].append(len(self.ids))
            self.tf[term].append(counts[term])
        self.ids.append(doc)
        self.lengths.append(counts.total())
        self.size += len(terms)

    def batch(self):
        df = [len(x) for x in self.at.values()]
        terms = pa.array([x.decode("utf-8", "replace") for x in self.at], pa.string())
        flat = [x for y in self.at.values() for x in y], [x for y in self.tf.values() for x in y]
        whole = [(self.ids, pa.int64()), (self.lengths, pa.int64()), (terms, pa.string()), (df, pa.int64()), (flat[0], pa.int32()), (flat[1], pa.int64())]
        columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind)) for x, kind in whole]
        return pa.RecordBatch.from_arrays(columns, ["ids", "lengths", "terms", "df", "at", "tf"])


def _blocks(vocabulary, size: int):
    """Arrow batches (doc_id, text) to rows of the index; of the terms, those of the broadcast vocabulary, if there is one."""

    def run(batches):
        turn(__name__, dict)
        known = vocabulary.value if vocabulary else None
        block = _Block()
        for part, rows in texts(batches):
            for doc, text in zip(part.column(0).to_pylist(), rows):
                counts = term_counts(text)
                if counts:
                    block.add(doc, counts, counts.keys() & known if known is not None else counts.keys())
                if len(block.ids) >= size or block.size >= POSTINGS:
                    yield block.batch()
                    block = _Block()
        if block.ids:
            yield block.batch()

    return run


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """The index of (doc_id, text) as a table; vocabulary (term), if given and small, bounds its terms."""
    known = None
    if vocabulary is not None:
        n, size = vocabulary.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
        if n <= TERMS and size <= TERM_BYTES:
            known = docs.sparkSession.sparkContext.broadcast({r.term.encode() for r in vocabulary.toLocalIterator()})
    found = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(found.mapInArrow(_blocks(known, block), _INDEX), "index")


def _item_terms(batches):
    """Arrow batches (item, text) to (item, term, times)."""
    turn(__name__, dict)
    for part, rows in texts(batches):
        for item, text in zip(part.column(0).to_pylist(), rows):
            counts = term_counts(text)
            terms = pa.array([x.decode("utf-8", "replace") for x in counts], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(counts), pa.int64()), terms, pa.array(counts.values(), pa.int64())], ["item", "term", "times"])


def slices(at: np.ndarray, values: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Bit-sliced bitmaps [bits, words] of documents `at` (of `size`, a multiple of 64) with whole-number values."""
    if len(at) * 4 > size:
        dense = np.zeros(size, np.int64)
        dense[at] = values
        planes = (dense[None, :] >> np.arange(bits)[:, None]) & 1
        return np.packbits(planes.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
    out = np.zeros((bits, size // 64), np.uint64)
    s, i = np.nonzero((values[None, :] >> np.arange(bits)[:, None]) & 1)
    np.bitwise_or.at(out, (s, at[i] >> 6), np.uint64(1) << (at[i] & 63).astype(np.uint64))
    return out


def add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of bit-sliced numbers [..., bits, words]: one slice after the other, with the carry to the next."""
    out = np.empty((*x.shape[:-2], x.shape[-2] + 1, x.shape[-1]), np.uint64)
    carry = np.zeros_like(x[..., 0, :])
    for s in range(x.shape[-2]):
        a, b = x[..., s, :], y[..., s, :]
        half = a ^ b
        out[..., s, :] = half ^ carry
        carry = (a & b) | (half & carry)
    out[..., -1, :] = carry
    return out


def add_all(planes: np.ndarray) -> np.ndarray:
    """Sum over the second axis of [items, terms, bits, words], in a tree."""
    while planes.shape[1] > 1:
        if planes.shape[1] % 2:
            planes = np.concatenate([planes, np.zeros_like(planes[:, :1])], 1)
        planes = add(planes[:, ::2], planes[:, 1::2])
    return planes[:, 0]


def _wider(x: np.ndarray, bits: int) -> np.ndarray:
    return np.concatenate([x, np.zeros((*x.shape[:-2], bits - x.shape[-2], x.shape[-1]), np.uint64)], -2) if x.shape[-2] < bits else x


def top(planes: np.ndarray, k: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k largest numbers above 0 of the slices [bits, words]; of equal ones, those of the least `order`."""
    sure = np.zeros(planes.shape[1], np.uint64)
    open_ = np.bitwise_or.reduce(planes, 0)
    n_sure = 0
    for s in range(len(planes) - 1, -1, -1):
        have = open_ & planes[s]
        n = n_sure + int(np.bitwise_count(have).sum())
        if n > k:
            open_ = have
        else:
            sure, open_, n_sure = sure | have, open_ & ~planes[s], n
            if n == k:
                open_ = np.zeros_like(open_)
                break
    places = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    ties = places(open_)
    at = np.concatenate([places(sure), ties[np.argsort(order[ties], kind="stable")][: k - n_sure]])
    bits = (planes[:, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
    return at, (bits.astype(np.int64) << np.arange(len(planes))[:, None]).sum(0)


def _answers(k: int, n_docs: int, n_terms: int):
    """Arrow batches of a block beside a chunk of items to (item, doc_id, score): the best k of the task for each item."""

    def best(rows: list) -> list:
        return sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))[:k]

    def run(batches):
        turn(__name__, dict)
        found: dict[int, list] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                for item, hits in _answered(batch.slice(row, 1), k, n_docs, n_terms):
                    found[item] = best(found.get(item, []) + hits)
            if sum(map(len, found.values())) > HELD:
                yield flush(found)
                found = {}
        yield flush(found)

    def flush(found):
        rows = [(i, d, s) for i, hits in found.items() for d, s in hits]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [[], [], []])], ["item", "doc_id", "score"])

    return run


def _answered(row, k: int, n_docs: int, n_terms: int):
    """(item, [(doc_id, score)]) of one block for each item of one chunk."""
    column = lambda name: row.column(row.schema.get_field_index(name))
    flat = lambda name: column(name).flatten().to_numpy(zero_copy_only=False)
    ids = column("ids").flatten().to_pylist()
    order = np.empty(len(ids), np.int64)
    order[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))] = np.arange(len(ids))
    less = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * flat("lengths") * n_docs) // n_terms
    upto = np.concatenate([[0], np.cumsum(flat("df"))])
    at, tf = flat("at").astype(np.int64), flat("tf")
    damped = (SCALE * tf) // (1000 * tf + DAMPING * less[at])
    place = {t: i for i, t in enumerate(column("terms").flatten().to_pylist())}
    items = column("items").flatten()
    term, weight, times, of = (items.field(n) for n in ("term", "w", "times", "item"))
    wanted = [(i, place[t], w, x) for i, t, w, x in zip(of.to_pylist(), term.to_pylist(), weight.to_pylist(), times.to_pylist()) if t in place and w > 0]
    if not wanted:
        return
    size = -(-len(ids) // 64) * 64
    bits = max(int(damped[upto[p] : upto[p + 1]].max()) * w for _, p, w, _ in wanted).bit_length()
    if not bits:
        return
    used = {p: i for i, p in enumerate(dict.fromkeys(p for _, p, _, _ in wanted), 1)}  # 0 stands for no term
    weights = {p: w for _, p, w, _ in wanted}
    planes = np.zeros((len(used) + 1, bits, size // 64), np.uint64)
    for p, i in used.items():
        span = slice(upto[p], upto[p + 1])
        planes[i] = slices(at[span], damped[span] * weights[p], size, bits)
    by_item = defaultdict(list)
    for item, p, _, x in wanted:
        by_item[item] += [used[p]] * x
    names = sorted(by_item, key=lambda i: len(by_item[i]))
    for start in range(0, len(names), TOGETHER):
        group = names[start : start + TOGETHER]
        width = max(len(by_item[i]) for i in group)
        index = np.array([by_item[i] + [0] * (width - len(by_item[i])) for i in group])
        total = None
        for fold in range(0, width, FOLD):
            part = add_all(planes[index[:, fold : fold + FOLD]])
            if total is not None:
                wide = max(part.shape[-2], total.shape[-2])
                part = add(_wider(part, wide), _wider(total, wide))
            used_bits = int(np.flatnonzero(part.any((0, 2))).max(initial=0)) + 1
            total = part[:, :used_bits]
        for item, sums in zip(group, total):
            where, scores = top(sums, k, order)
            yield item, [(ids[i], s) for i, s in zip(where.tolist(), scores.tolist())]


def search(docs: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) for each item (item_id, text)."""
    asked = bounded(items).select("item_id", F.col("text").cast("string").alias("text"))
    asked = materialize(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    terms = materialize(asked.select("item", "text").mapInArrow(_item_terms, "item long, term string, times long"), "terms")
    index = build_index(docs, terms.select("term").distinct(), block)
    return answer(index, asked, terms, k)


def answer(index: DataFrame, asked: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """The k best of the index for the items `asked` (item, item_id) with their terms (item, term, times)."""
    sums = index.select(F.explode("lengths").alias("n")).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, n_terms = sums
    held = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))
    weight = F.floor(WEIGHT_SCALE * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = terms.join(held, "term").select("item", "term", "times", weight.alias("w"))
    chunks = max(1, -(-asked.count() // CHUNK))
    weighed = weighed.groupBy(F.pmod(F.hash("item"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("item", "term", "times", "w")).alias("items"))
    # Every block meets every chunk of the stated query set; only k rows an item come out of a task.
    met = index.crossJoin(small(materialize(weighed.select("items"), "chunks")))
    found = met.mapInArrow(_answers(k, n_docs, max(n_terms, 1)), "item long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    found = found.withColumn("rank", place).where(F.col("rank") <= k)
    return found.join(small(asked.select("item", "item_id")), "item").select("item_id", "rank", "doc_id", "score")
