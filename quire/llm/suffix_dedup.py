"""Repeated byte strings by merging Burrows-Wheeler transforms of shards.

A start is repeated if the `length` bytes from it also start anywhere else. Three steps find all of them:

1. Every start has an anchor: the place of the least seed (hash of SEED bytes) in its `length` bytes. Equal strings
   have equal anchors at the same offset. Starts with the same anchor are neighbours; the bytes that they span
   are the anchor's context. A context that occurs twice is repeated throughout; a seed with a single
   context, which occurs once, has no repeated start. What is left are seeds with several contexts, each taken once.
2. Contexts are cut into pieces of a tenth of `length`, counted from the anchor. Shards of contexts, in order of their seeds
   (a frequent seed spans several), get their Burrows-Wheeler transforms: the symbols before their sorted suffixes. The transforms are
   merged by refining their interleave: the blocks of suffixes with a common prefix of d pieces follow from those of d - 1 pieces by one
   step through each shard's transform, and the interleave says how many suffixes of which
   shard a block holds. No suffix is sorted again, and a shard hands on one row for each of its blocks. Blocks with one suffix drop
   out. What is left at nine pieces are the repeated intervals: the common prefix of all starts between two pieces.
3. In these intervals starts are held against each other by their whole strings (128-bit hashes): within a shard, and across
   shards where the interleave has the block in several.

What goes to all tasks are bitmaps of blocks (BITS bits whatever the input); two blocks that share a bit only cost more comparisons.

Texts are UTF-8 bytes; bytes that are no UTF-8 are bytes as others. Null and short texts have no start and stay. Equal rows are documents of
their own, so their strings repeat. A removed run may end within a character, hence results are binary. Extra columns are kept; those named like the
results are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize, texts, wrapped
from .memos import turn
from .words import mix

LENGTH = 400
#: Pieces of a string; all but one of them are whole in every string that starts between the same two pieces.
PIECES = 10
#: Bytes whose anchors are found at once, and contexts of a shard.
BUFFER, SHARD = 1 << 20, 1024
#: Bits of the bitmaps of seeds and blocks.
BITS = 1 << 25
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _SPREAD)
_PLACE = np.uint64((1 << 26) - 1)
_ANCHORS = "key binary, x long, lo long, n int, seed long, c1 long, c2 long, copies long"
_SHARDS = "shard long, c1 array<long>, c2 array<long>, sure array<boolean>, at array<int>, n array<int>, size array<int>, bytes binary, bwt array<long>, owner array<int>, boundary array<int>"


def seed_size(length: int) -> int:
    """Bytes of a seed: the largest power of two up to an eighth of the length."""
    return 1 << max(length // 8, 1).bit_length() - 1


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values, from running minima to both sides of every width-th place."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    after = np.minimum.accumulate(rows, 1).ravel()
    before = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(before[: n - width + 1], after[width - 1 : n])


def anchors(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the seed at every place, and the anchor of every start, of the bytes `raw` (at least `length`)."""
    size = seed_size(length)
    h, width, step = _BYTES[raw], 1, int(_SPREAD)
    while width < size:
        h = h[:-width] * np.uint64(step) + h[width:]
        step, width = step * step % (1 << 64), width * 2
    h = mix(h)
    return h, (least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - size + 1) & _PLACE).astype(np.int64)


def _buffers(found: dict, length: int, size: int):
    """Texts {key: [bytes, copies]} as lists of (key, offset, part, copies); parts overlap so that no start is lost or doubled."""
    out, held = [], 0
    for key, (text, copies) in found.items():
        for offset in range(0, len(text) - length + 1, size):
            part = text[offset : offset + size + length - 1]
            out.append((key, offset, part, copies))
            held += len(part)
            if held >= size:
                yield out
                out, held = [], 0
    if out:
        yield out


def _anchored(length: int, buffer: int):
    """Arrow batches (key, text) to the anchors of their distinct texts: place, first start, starts, seed, context, copies."""

    def run(batches):
        turn(__name__, dict)
        for part, rows in texts(batches):
            found: dict[bytes, list] = {}
            for key, text in zip(part.column(0).to_pylist(), rows):
                found.setdefault(key, [text or b"", 0])[1] += 1
            for parts in _buffers(found, length, buffer):
                yield rows_of(parts)

    def rows_of(parts):
        raw = b"".join(x[2] for x in parts)
        h, anchor = anchors(np.frombuffer(raw, np.uint8), length)
        sizes = np.array([len(x[2]) for x in parts])
        starts, begins = sizes - length + 1, np.cumsum(sizes) - sizes
        upto = np.cumsum(starts)
        start = np.arange(upto[-1]) + np.repeat(begins - upto + starts, starts)
        at = anchor[start]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
        n = np.diff(np.append(first, len(start)))
        lo, x, of = start[first], at[first], np.searchsorted(upto, first, "right")
        view = memoryview(raw)
        digests = [xxhash.xxh3_128_digest(view[a : a + m + length - 1], seed=b - a) for a, b, m in zip(lo.tolist(), x.tolist(), n.tolist())]
        c = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        shift = np.array([x[1] for x in parts])[of] - begins[of]
        keys = pa.array([x[0] for x in parts], pa.binary()).take(pa.array(of))
        copies = np.array([x[3] for x in parts])[of]
        columns = [keys, pa.array(x + shift), pa.array(lo + shift), pa.array(n.astype(np.int32)), pa.array(h[x].view(np.int64)), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(copies)]
        return pa.RecordBatch.from_arrays(columns, ["key", "x", "lo", "n", "seed", "c1", "c2", "copies"])

    return run


def bitmap(values: DataFrame, column: str) -> np.ndarray:
    """Bits of the values' low bits, put together in tasks: at most BITS bits come to the driver, by one job however many partitions hold them."""
    bit = F.col(column).bitwiseAND(F.lit(BITS - 1)) + 1
    held = values.select(F.bitmap_bucket_number(bit).alias("k"), F.bitmap_bit_position(bit).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for row in held.collect():
        start = (row.k - 1) * len(row.bits)
        out[start : start + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return out


def held(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values (int64) have their bit."""
    bit = values & (BITS - 1)
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _with_seed(bits):
    """Rows of anchors or contexts whose seed has its bit in the broadcast bitmap."""

    def run(batches):
        for batch in batches:
            seed = batch.column(batch.schema.get_field_index("seed")).to_numpy()
            yield batch.filter(pa.array(held(bits.value, seed)))

    return run


def _cut_out(length: int):
    """Arrow batches (text, contexts) to the contexts with their bytes."""
    names = ["seed", "c1", "c2", "sure", "at", "n"]

    def run(batches):
        turn(__name__, dict)
        for part, rows in texts(batches):
            found = part.column(part.schema.get_field_index("contexts")).to_pylist()
            for text, contexts in zip(rows, found):
                for start in range(0, len(contexts), SHARD):
                    some = contexts[start : start + SHARD]
                    columns = [pa.array([c[n] for c in some], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()))]
                    columns.append(pa.array([text[c["lo"] : c["lo"] + c["n"] + length - 1] for c in some], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, [*names, "bytes"])

    return run


def transform(strings: list[bytes], at: list[int], piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of strings cut into pieces from their places `at`: symbols, and the string and boundary of each sorted suffix.

    A boundary is counted in pieces from `at`. Symbols are hashes of a piece with its place from `at`; 0 stands before a string's first piece.
    """
    symbols, owner, boundary = [], [], []
    for i, (s, a) in enumerate(zip(strings, at)):
        first = -(a // piece)
        places = range(a + first * piece, len(s) - piece + 1, piece)
        found = [xxhash.xxh3_64_intdigest(s[p : p + piece], seed=(first + j) % (1 << 32)) | 1 for j, p in enumerate(places)]
        symbols.append(found)
        owner += [i] * (len(found) + 1)
        boundary += range(first, first + len(found) + 1)
    deep = max(map(len, symbols), default=0)
    suffixes = np.zeros((len(owner), deep + 1), np.uint64)  # an ended suffix comes first
    before = np.zeros(len(owner), np.uint64)
    row = 0
    for found in symbols:
        for j in range(len(found) + 1):
            suffixes[row, : len(found) - j] = found[j:]
            before[row] = found[j - 1] if j else 0
            row += 1
    # Equal suffixes stay in the order of their strings, so that a step to the left keeps the order.
    order = np.lexsort(suffixes.T[::-1])
    return before[order], np.array(owner, np.int32)[order], np.array(boundary, np.int32)[order]


def _sharded(piece: int, shard: int):
    """Arrow batches of contexts in order of their seeds to shards with their transforms."""

    def run(batches):
        turn(__name__, dict)
        for batch in batches:
            for start in range(0, batch.num_rows, shard):
                part = batch.slice(start, shard)
                c1, c2, sure, at, n, strings = (part.column(part.schema.get_field_index(x)).to_pylist() for x in ("c1", "c2", "sure", "at", "n", "bytes"))
                bwt, owner, boundary = transform(strings, at, piece)
                name = xxhash.xxh3_64_intdigest(part.column(part.schema.get_field_index("c1")).to_numpy().tobytes()) - (1 << 63)
                lists = [(c1, pa.int64()), (c2, pa.int64()), (sure, pa.bool_()), (at, pa.int32()), (n, pa.int32()), ([len(s) for s in strings], pa.int32())]
                columns = [pa.array([name]), *(pa.array([x], pa.list_(t)) for x, t in lists), pa.array([b"".join(strings)], pa.binary())]
                columns += [pa.array([x], pa.list_(t)) for x, t in ((bwt.view(np.int64), pa.int64()), (owner, pa.int32()), (boundary, pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "c1", "c2", "sure", "at", "n", "size", "bytes", "bwt", "owner", "boundary"])

    return run


def blocks(bwt: np.ndarray, depth: int) -> np.ndarray:
    """For each sorted suffix the name of the block of its first `depth` pieces; 0 where it is shorter.

    Sorted, the transform's symbols are the suffixes' first ones, and the stable order that sorts them leads from each suffix to the next shorter one.
    """
    follows = np.argsort(bwt, kind="stable")
    first = bwt[follows]
    names = np.ones(len(bwt), np.uint64)
    for _ in range(depth):
        after = names[follows]
        names = np.where((first == 0) | (after == 0), 0, mix(after * _SPREAD + first) | np.uint64(1))
    return names


def _flat(batch, name: str):
    return batch.column(batch.schema.get_field_index(name)).flatten()


def _refined(depth: int, alive):
    """Arrow batches of shards to (block, n): their blocks of `depth` pieces whose block of one piece less, one step to the right, is alive."""

    def run(batches):
        turn(__name__, dict)
        for batch in batches:
            for i in range(batch.num_rows):
                bwt = _flat(batch.slice(i, 1), "bwt").to_numpy().view(np.uint64)
                names = blocks(bwt, depth).view(np.int64)
                live = names != 0
                if alive:
                    live &= held(alive.value, blocks(bwt, depth - 1).view(np.int64)[np.argsort(bwt, kind="stable")])
                found, n = np.unique(names[live], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["block", "n"])

    return run


def merged(shards: DataFrame, depth: int):
    """Bitmaps (as broadcasts) of the blocks of `depth` pieces with two suffixes or more, and of those in two shards or more.

    The interleave of the shards' transforms is refined piece by piece: a row is a block with its suffixes in one shard.
    """
    context = shards.sparkSession.sparkContext
    alive = spread = None
    for d in range(1, depth + 1):
        interleave = shards.mapInArrow(_refined(d, alive), "block long, n long").groupBy("block").agg(F.sum("n").alias("n"), F.count("*").alias("shards"))
        interleave = interleave.where("n > 1")
        if d == depth:  # read twice
            interleave = materialize(interleave, "interleave")
        before, alive = alive, context.broadcast(bitmap(interleave, "block"))
        if d == depth:
            spread = context.broadcast(bitmap(interleave.where("shards > 1"), "block"))
        if before:
            before.destroy()
    return alive, spread


def _compared(length: int, piece: int, depth: int, alive, spread):
    """Arrow batches of shards to (c1, c2, o, o_end, h): repeated offsets of contexts, and with h strings to hold against other shards' ."""

    def run(batches):
        turn(__name__, dict)
        for batch in batches:
            for i in range(batch.num_rows):
                yield rows_of(batch.slice(i, 1))

    def rows_of(row):
        names = blocks(_flat(row, "bwt").to_numpy().view(np.uint64), depth).view(np.int64)
        boundary, owner = _flat(row, "boundary").to_numpy(), _flat(row, "owner").to_numpy()
        live = (boundary <= 0) & (names != 0) & held(alive.value, names)
        far = held(spread.value, names[live]).tolist()
        c1, c2, sure, at, n, size = (_flat(row, x).to_pylist() for x in ("c1", "c2", "sure", "at", "n", "size"))
        begins = np.cumsum([0, *size]).tolist()
        view = memoryview(row.column(row.schema.get_field_index("bytes"))[0].as_py())
        seen: dict[bytes, list] = defaultdict(list)
        for of, b, f in zip(owner[live].tolist(), boundary[live].tolist(), far):
            for o in range(max(-b * piece, at[of] - n[of] + 1), min(-b * piece + piece - 1, at[of]) + 1):
                start = begins[of] + at[of] - o
                seen[xxhash.xxh3_128_digest(view[start : start + length])].append((of, o, f))
        out, here = [], defaultdict(list)
        for h, places in seen.items():
            if len(places) > 1:
                for of, o, _ in places:
                    if not sure[of]:
                        here[of].append(o)
                if places[0][2]:
                    out.append((None, None, None, None, h))
            elif places[0][2]:
                of, o, _ = places[0]
                out.append((c1[of], c2[of], o, o, h) if not sure[of] else (None, None, None, None, h))
        for of, offsets in here.items():
            offsets.sort()
            begin = offsets[0]
            for a, b in zip(offsets, [*offsets[1:], offsets[-1] + 2]):
                if b != a + 1:
                    out.append((c1[of], c2[of], begin, a, None))
                    begin = b
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5, kinds)], ["c1", "c2", "o", "o_end", "h"])

    return run


def _key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("binary"), F.lit(b""))))


def repeated_starts(docs: DataFrame, length: int = LENGTH, shard: int = SHARD, buffer: int = BUFFER) -> DataFrame:
    """(key, starts): for the MD5 digest of each text with repeated starts, their ranges {s, e} (from 0, both inclusive)."""
    context = docs.sparkSession.sparkContext
    keyed = bounded(docs).select(_key(docs["text"]).alias("key"), docs["text"].cast("string").alias("text"))
    anchored = materialize(keyed.mapInArrow(_anchored(length, buffer), _ANCHORS), "anchors")
    seeds = anchored.groupBy("seed").agg(F.sum("copies").alias("w"), *(f(c).alias(f.__name__ + c) for f in (F.min, F.max) for c in ("c1", "c2")))
    seeds = materialize(seeds.where("w > 1").select("seed", ((F.col("minc1") != F.col("maxc1")) | (F.col("minc2") != F.col("maxc2"))).alias("shared")), "seeds")
    repeated, shared = context.broadcast(bitmap(seeds, "seed")), context.broadcast(bitmap(seeds.where("shared"), "seed"))
    some = anchored.mapInArrow(_with_seed(repeated), _ANCHORS)
    rep = F.min(F.struct("key", "lo", "n", (F.col("x") - F.col("lo")).cast("int").alias("at"))).alias("rep")
    contexts = materialize(some.groupBy("seed", "c1", "c2").agg(F.sum("copies").alias("w"), rep), "contexts")

    # Contexts of shared seeds, once each, with their bytes.
    open_ = contexts.mapInArrow(_with_seed(shared), contexts.schema)
    fields = F.struct("seed", "c1", "c2", (F.col("w") > 1).alias("sure"), "rep.at", "rep.lo", "rep.n")
    wanted = materialize(open_.groupBy(F.col("rep.key").alias("key")).agg(F.collect_list(fields).alias("contexts")), "wanted")  # of one text
    piece = max(1, length // PIECES)
    depth = max(1, length // piece - 1)
    found = keyed.join(wanted, "key").select("text", "contexts").mapInArrow(_cut_out(length), "seed long, c1 long, c2 long, sure boolean, at int, n int, bytes binary")
    found = found.dropDuplicates(["c1", "c2"])
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = found.repartitionByRange(n, "seed", "c1").sortWithinPartitions("seed", "c1").mapInArrow(_sharded(piece, shard), _SHARDS)
    shards = materialize(shards, "shards")
    alive, spread = merged(shards, depth)
    compared = materialize(shards.mapInArrow(_compared(length, piece, depth, alive, spread), "c1 long, c2 long, o int, o_end int, h binary"), "compared")
    across = compared.where("h is not null")
    twice = across.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    ranges = compared.where("h is null").drop("h").unionByName(across.where("c1 is not null").join(twice, "h", "left_semi").drop("h"))
    whole = contexts.where("w > 1").select("c1", "c2", F.lit(None).cast("int").alias("o"), F.lit(None).cast("int").alias("o_end"))
    ranges = materialize(ranges.unionByName(whole), "ranges")
    begin = F.coalesce(F.col("x") - F.col("o_end"), F.col("lo"))
    end = F.coalesce(F.col("x") - F.col("o"), F.col("lo") + F.col("n") - 1)
    starts = some.join(ranges, ["c1", "c2"]).select("key", F.struct(begin.alias("s"), end.alias("e")).alias("x"))
    starts = materialize(starts.groupBy("key").agg(F.collect_set("x").alias("starts")), "starts")  # of one text
    for x in (repeated, shared, alive, spread):
        x.destroy()
    return starts


def _removed(length: int):
    """Arrow batches (row, text, starts) to (row, kept, spans)."""
    spans_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        turn(__name__, dict)
        for part, rows in texts(batches):
            kept, spans = [], []
            for text, starts in zip(rows, part.column(part.schema.get_field_index("starts")).to_pylist()):
                text, runs, out, at = text or b"", [], [], 0
                for x in sorted(starts or [], key=lambda x: x["s"]):
                    begin, end = x["s"], x["e"] + length
                    if runs and begin <= runs[-1]["end"]:
                        runs[-1]["end"] = max(end, runs[-1]["end"])
                    else:
                        runs.append({"begin": begin, "end": end})
                for r in runs:
                    out.append(text[at : r["begin"]])
                    at = r["end"]
                kept.append(b"".join([*out, text[at:]]))
                spans.append(runs)
            row = part.column(part.schema.get_field_index("row"))
            yield pa.RecordBatch.from_arrays([row, pa.array(kept, pa.binary()), pa.array(spans, spans_type)], ["row", "kept", "spans"])

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, **sizes: int) -> DataFrame:
    """docs with `kept` (bytes left) and `spans` ({begin, end} of maximal removed runs) in place of text."""
    starts = repeated_starts(docs, length, **sizes)
    rest = [c for c in docs.columns if c not in ("text", "kept", "spans")]
    row = wrapped(docs.select(*(f"`{c}`" for c in rest), "text"), text=docs["text"].cast("string"), key=_key(docs["text"]))
    row = row.withColumn("row", F.struct(*(F.col("row")[c].alias(c) for c in rest)))
    found = row.join(starts, "key", "left").select("row", "text", "starts")
    schema = f"row {found.schema['row'].dataType.simpleString()}, kept binary, spans array<struct<begin: long, end: long>>"
    return found.mapInArrow(_removed(length), schema).select(*(F.col("row")[c].alias(c) for c in rest), "kept", "spans")


def remove_repeats(docs: DataFrame, length: int = LENGTH, **sizes: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document without its repeated strings of `length` bytes."""
    found = without_repeats(docs.select("doc_id", "text"), length, **sizes)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])
    return found.select(
        "doc_id", (F.octet_length("kept") + gone).alias("n_bytes"), gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
