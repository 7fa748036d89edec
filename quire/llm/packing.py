"""Pattern packing by non-negative least squares.

Documents become pieces of at most `room` tokens (longer ones are cut, the first piece takes
the remainder). Only the histogram of piece lengths, at most `room` numbers, reaches the
driver. There, patterns of one, two and three lengths that fill a sequence to the last token are enumerated.
Non-negative least squares by coordinates fit how often each is repeated: a pattern in turn takes the mean of what its
lengths still lack, which leaves few patterns above zero (hardly more than there are lengths). The counts are rounded,
what is left is fitted again until no pattern is left, and the residual pieces are packed by best fit.

The residual needs short pieces to fill its gaps, so a part of them is held back from the fit. RESERVES are tried
in turn, the smallest first, until the sequences are as few as the tokens allow; otherwise the best of them is taken.
The plan (for each length, runs of pieces and where they go) is bounded by the pattern count, not by the data; each
piece looks its place up by its rank among the pieces of its length.

Ranks are counted in salted groups of about GROUP pieces, so that a length which a third of all pieces have is
spread over many tasks. Null and empty texts are one piece of the end id. Null doc_ids and repeated
rows are packed like others. Extra columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parts, readable, running_total, small
from .tokens import encoder, vocabulary

ROOM, END_ID = 2048, 0
#: Pieces in a salted group, about.
GROUP = 500
#: Parts of a histogram that are held back from the fit: of all lengths, and half of the pieces below a length.
RESERVES = ((0.0, 128), (0.1, 0), (0.1, 128), (0.2, 256), (0.3, 512), (0.4, 512))
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"


def _pieces(path: str, room: int, end_id: int):
    def run(batches):
        enc, end, row = encoder(path), np.array([end_id], "<u4").tobytes(), 0
        for part in parts(batches):
            out = []
            for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode_column(part.column(1))):
                ids += end
                row += 1  # spreads rows that share a doc_id or have none
                n, at = len(ids) // 4, 0
                for i in range(-(-n // room)):
                    size = (n - 1) % room + 1 if i == 0 else room
                    out.append((doc_id, i, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), zlib.crc32(b"%d %d %d" % (doc_id or 0, i, row))))
                    at += size
            columns = list(zip(*out)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return run


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and repeats that pack counts[length] pieces of each length: longest first, each gap filled with the longest that fits.

    A step repeats its pattern until one of its lengths runs out, so there are hardly more
    steps than lengths.
    """
    left, room, out = counts.copy(), len(counts) - 1, []
    while left.any():
        used: dict[int, int] = {}
        gap, fits = room, left > 0
        while gap > 0 and (longest := np.flatnonzero(fits[: gap + 1])).size:
            length = int(longest[-1])
            take = min(gap // length, int(left[length]))
            used[length] = take
            gap -= take * length
            fits[length] = False
        times = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= times * k
        out.append((tuple(n for n, k in used.items() for _ in range(k)), times))
    return out


def patterns(counts: np.ndarray) -> np.ndarray:
    """Rows of one, two or three lengths (0 for none) that occur and add up to the room."""
    room, have = len(counts) - 1, counts > 0
    lengths = np.flatnonzero(have)
    found = [np.array([[room, 0, 0]])] if have[room] else []
    long = lengths[(2 * lengths >= room) & (lengths < room)]
    long = long[have[room - long]]
    found.append(np.stack([long, room - long, 0 * long], 1))
    for a in lengths[(3 * lengths >= room) & (lengths < room)]:
        b = np.arange((room - a + 1) // 2, min(a, room - a - 1) + 1)
        b = b[have[b] & have[room - a - b]]
        found.append(np.stack([np.full(len(b), a), b, room - a - b], 1))
    return np.concatenate(found)


def fit(rows: np.ndarray, counts: np.ndarray, rounds: int = 30, visits: int = 4096, sweeps: int = 20) -> np.ndarray:
    """Repeats x >= 0 of the patterns in rows for which their lengths' sum comes near counts (least squares by coordinates).

    A round visits the `visits` patterns whose scarcest length lacks most; sweeps over those above zero finish.
    """
    missing = counts.astype(float)
    missing[0] = 0.0
    size, x = (rows > 0).sum(1), np.zeros(len(rows))
    ties = np.random.default_rng(0).random(len(rows))

    def step(i: int) -> None:
        members = [n for n in rows[i].tolist() if n]
        d = max(-x[i], sum(missing[n] for n in members) / len(members))
        x[i] += d
        for n in members:
            missing[n] -= d

    for _ in range(rounds):
        scarcest = np.where(rows > 0, missing[rows], np.inf).min(1, initial=np.inf)
        open_ = np.flatnonzero((scarcest > 0.5) & (missing[rows].sum(1) > 0.5 * size))
        for i in open_[np.lexsort((ties[open_], -scarcest[open_]))][:visits].tolist():
            if min(missing[n] for n in rows[i].tolist() if n) > 0.5:
                step(i)
        if not len(open_):
            break
    above = np.flatnonzero(x > 0).tolist()
    for _ in range(sweeps):
        for i in above:
            step(i)
    return x


def fitted(counts: np.ndarray, spare: float = 0.0, short: int = 0) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Fitted patterns with their repeats, and the counts they leave; a part of the histogram is held back (see RESERVES)."""
    left = counts.copy()
    held = counts - np.floor(counts * (1 - spare) + 0.5).astype(np.int64)
    held[:short] = np.maximum(held[:short], counts[:short] - counts[:short] // 2)
    held[-1] = 0  # full pieces fill a sequence by themselves
    used = []
    while True:
        rows = patterns(left - held)
        x = fit(rows, left - held)
        repeats, before = np.floor(x + 0.5).astype(np.int64), len(used)
        for i in np.argsort(-x, kind="stable"):
            if not repeats[i]:
                break
            lengths, k = np.unique(rows[i][rows[i] > 0], return_counts=True)
            times = min(int(repeats[i]), int(((left - held)[lengths] // k).min()))
            if times > 0:
                left[lengths] -= times * k
                used.append((tuple(np.repeat(lengths, k).tolist()), times))
        if len(used) == before:
            return used, left


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use every piece of the histogram once: fitted ones, then best fit of the residual."""
    bound, best = -(-int(counts @ np.arange(len(counts))) // (len(counts) - 1)), None
    for spare, short in RESERVES:
        used, left = fitted(counts, spare, short)
        steps = used + best_fit(left)
        if best is None or sum(n for _, n in steps) < sum(n for _, n in best):
            best = steps
        if sum(n for _, n in best) == bound:
            break
    return best


def _places(steps: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of runs of pieces, the sequence of each run's first piece, and the offset there."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for pattern, times in steps:
        at = 0
        for length in pattern:
            rank = ranks.get(length, 0)
            runs.setdefault(length, []).append((rank, first, at))
            ranks[length] = rank + times
            at += length
        first += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*r)) for n, r in runs.items()}


def _placed(places):
    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = length == n
                ranks, firsts, offsets = places.value[int(n)]
                i = np.searchsorted(ranks, rank[at], "right") - 1
                seq[at], off[at] = firsts[i] + rank[at] - ranks[i], offsets[i]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, room: int = ROOM, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for every piece of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), readable("text").alias("text"))
    pieces = materialize(docs.mapInArrow(_pieces(path or vocabulary(), room, end_id), PIECE), "pieces")
    counts = np.zeros(room + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `room` rows
        counts[r["length"]] = r["n"]
    places = spark.sparkContext.broadcast(_places(plan(counts)))
    groups = F.element_at(F.array(*map(F.lit, (counts // GROUP + 1).tolist())), F.col("length").cast("int") + 1)
    pieces = pieces.withColumn("salt", F.col("salt") % groups)
    sizes = pieces.groupBy("length", "salt").agg(F.count("*").alias("n")).select(F.struct("length", "salt").alias("key"), "n")
    shorter = F.element_at(F.array(*map(F.lit, np.concatenate([[0], np.cumsum(counts)[:-1]]).tolist())), F.col("key.length").cast("int") + 1)
    before = running_total(sizes, "key", "n", "before").select("key.length", "key.salt", (F.col("before") - shorter).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    ranked = pieces.withColumn("within", within).join(small(materialize(before, "before")), ["length", "salt"])
    ranked = ranked.withColumn("rank", (F.col("before") + F.col("within") - 1).cast("long"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _placed(places), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
