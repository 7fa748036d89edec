"""MinHash near-deduplication by SuperMinHash signatures, banding, verification and union-find.

A document's set holds its distinct k-word shingles (64-bit hashes). Documents with equal
sets form one class, so exact copies cost nothing further. Each class gets a SuperMinHash
signature of 128 registers; bands of as many registers as the similarity allows make candidates (`banding`: at 0.8, 32 bands
of 4, and a pair at 0.8 shares no band with a chance of 5e-8). Links are confirmed on the full sets, and linked classes are grouped
by distributed union-find.

Within a bucket not all pairs are made. First every class is compared with one pivot, the
one it shares most bands with; then with its other pivots, if they lie in another
component; last, in buckets that still hold several components, the classes outside the largest one are compared
with all others of the bucket, in blocks of about BLOCK classes that meet two by two. A block holds a class's whole set up to SKETCH
shingles; larger sets are thinned by bits of their hashes, both sets of a pair alike, and a pair of which one is
thinned leaves a block if the rest is less than 4.5 standard deviations too unlike. Each pair
leaves once (in the first bucket in which the two meet, by the full band keys) and is confirmed on the full sets.
Pairs that are skipped lie in one component already.

Null and empty texts: an empty set, linked with nothing, component_id the row's own doc_id.
Null doc_ids: take part as texts; a component_id is the least doc_id that is not null.
Repeated rows: returned as often as they come; `deduplicate` keeps one of them. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, small, texts, wrapped
from .memos import turn
from .words import HASHES, mix, shingle_set

REGISTERS = 128
#: Chance that a pair at the least similarity shares no band, at most.
MISSED = 1e-7
#: Classes of a block, about, and the shingles of a class that a block holds.
BLOCK, SKETCH = 512, 1024
_STEP = np.uint64(0xD1342543DE82EF95)


def superminhash(x: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """SuperMinHash of the elements x (distinct 64-bit hashes): m registers.

    In round j every element draws the next place of its own random permutation and a
    random number; the register there keeps the least (j, number). After a round in which
    all registers hold a rank of this round or before, no later one can change them.
    """
    h = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    rows, perm, first = np.arange(len(x)), None, None
    for j in range(m):
        z = mix(x + np.uint64((j + 1) * int(_STEP) % (1 << 64)))
        place = j + ((z & np.uint64(0xFFFF)) % np.uint64(m - j)).astype(np.int64)
        if j == 0:
            first = place
        else:
            if perm is None:  # only short sets come here
                perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(x), 1))
                perm[rows, first] = 0
            place, at = perm[rows, place].astype(np.int64), place
            perm[rows, at] = perm[:, j]
        np.minimum.at(h, place, (z >> np.uint64(16)) | np.uint64(j << 48))
        if int(h.max()) < (j + 1) << 48:
            break
    return h


def banding(percent: int) -> int:
    """Registers of a band: as many as keep the chance to miss a pair of that similarity below MISSED."""
    for rows in (8, 4, 2, 1):
        if (1 - (percent / 100) ** rows) ** (REGISTERS // rows) < MISSED:
            return rows
    raise ValueError(f"{REGISTERS} registers can't find pairs of {percent} percent")


def _band_keys(h: np.ndarray, rows: int) -> np.ndarray:
    out = np.arange(1, len(h) // rows + 1, dtype=np.uint64)
    for column in h.reshape(-1, rows).T:
        out = mix(out * _STEP + column)
    return out.view(np.int64)


def _signed(k: int, rows: int):
    """Arrow batches (doc_id, key, text) to class, set size and band keys."""

    def run(batches):
        turn(__name__, HASHES.clear)
        for part, texts_ in texts(batches):
            n, cls, bands = [], [], []
            for text in texts_:
                x = shingle_set(text, k)
                n.append(len(x))
                if len(x):
                    cls.append(xxhash.xxh3_128_digest(x.tobytes()))
                    bands.append(_band_keys(superminhash(x), rows))
                else:
                    cls.append(None), bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "key", "n_shingles", "cls", "bands"],
            )

    return run


def _level(n: int) -> int:
    """Bits of a hash that must be 0 so that about SKETCH or fewer of n are left."""
    return max(0, -(-n // SKETCH) - 1).bit_length()


def _short(x: np.ndarray) -> np.ndarray:
    """The upper halves of sorted hashes; two of a set are hardly ever equal, and then the pair gets as much slack."""
    return (x >> np.uint64(32)).astype(np.uint32)


def _thinned(x: np.ndarray, level: int) -> np.ndarray:
    return x[x & np.uint32((1 << level) - 1) == 0] if level else x


def _sets(k: int, rows: int):
    """Arrow batches (text, cls) to (cls, set, thinned set, its level, band keys), for rows whose text has that class."""

    def run(batches):
        turn(__name__, HASHES.clear)
        for part, texts_ in texts(batches):
            wanted = part.column(part.schema.get_field_index("cls")).to_pylist()
            out = []
            for text, c in zip(texts_, wanted):
                x = shingle_set(text, k)
                if len(x) and xxhash.xxh3_128_digest(x.tobytes()) == c:
                    level = _level(len(x))
                    out.append((c, x.tobytes(), _thinned(_short(x), level).tobytes(), level, _band_keys(superminhash(x), rows).tobytes()))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["cls", "shingles", "sketch", "level", "keys"])

    return run


def _near(sketches: list[tuple[np.ndarray, int]], own: np.ndarray, own_level: int, percent: int) -> np.ndarray:
    """Whether each of the sketches (set, level) may be linked with the set `own` of own_level; exact where both are whole sets."""
    out = np.zeros(len(sketches), bool)
    for level in {max(own_level, at) for _, at in sketches}:
        which = [i for i, (_, at) in enumerate(sketches) if max(own_level, at) == level]
        mine, theirs = _thinned(own, level), [_thinned(sketches[i][0], level) for i in which]
        size = np.array([len(t) for t in theirs])
        flat = np.concatenate(theirs)
        twice = np.concatenate([[0, 0], np.cumsum(flat[1:] == flat[:-1])])[: len(flat) + 1]
        at = np.minimum(np.searchsorted(mine, flat), max(len(mine) - 1, 0))
        same = np.concatenate([[0], np.cumsum(mine[at] == flat)]) if len(mine) else np.zeros(len(flat) + 1, np.int64)
        ends = np.cumsum(size)
        common = same[ends] - same[ends - size]
        union = len(mine) + size - common
        slack = 200 * (twice[ends] - twice[ends - size] + (mine[1:] == mine[:-1]).sum())
        if level:
            slack = slack + 4.5 * np.sqrt(percent * (100 - percent) * np.maximum(union, 1))
        out[which] = (100 * common >= percent * union - slack)
    return out


def _blocks(percent: int):
    """Arrow batches (band number, blocks x and y, either or both of them) to the pairs (a, b, root_a, root_b) that may be links between components.

    x meets y, and itself where `alone`. Each pair of classes leaves in the first band that it shares.
    """

    def meetings(batch):
        for j, x, y, alone in zip(*(batch.column(c) for c in ("j", "x", "y", "alone"))):
            j, x, y = j.as_py(), x.as_py(), y.as_py()
            if alone.as_py():
                yield j, x, x
            if y:
                yield j, x, y

    def run(batches):
        for batch in batches:
            for j, x, y in meetings(batch):
                keys_y = np.stack([np.frombuffer(m["keys"], np.int64) for m in y])
                sketches = [(np.frombuffer(m["sketch"], np.uint32), m["level"]) for m in y]
                roots_y, cls_y = np.array([m["root"] for m in y], object), np.array([m["cls"] for m in y], object)
                found: tuple[list, ...] = ([], [], [], [])
                for m in x:
                    other = (roots_y > m["root"]) if x is y else (roots_y != m["root"])
                    shared = np.frombuffer(m["keys"], np.int64) == keys_y
                    at = np.flatnonzero(other & shared[:, j] & (shared.argmax(1) == j))
                    if len(at):
                        at = at[_near([sketches[i] for i in at], np.frombuffer(m["sketch"], np.uint32), m["level"], percent)]
                    for column, values in zip(found, ([m["cls"]] * len(at), cls_y[at], [m["root"]] * len(at), roots_y[at])):
                        column.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in found], ["a", "b", "root_a", "root_b"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    lo, hi = sorted((len(x), len(y)))
    if 100 * lo < percent * hi:  # the sizes alone rule a link out
        return False
    both = np.sort(np.concatenate([x, y]))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (lo + hi - common)


def _verify(percent: int):
    """Arrow batches (a, b, ..., sa, sb) to the pairs (a, b, ...) with 100 * common >= percent * union."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keep = [_linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(part.column("sa").to_pylist(), part.column("sb").to_pylist())]
                yield part.drop_columns(["sa", "sb"]).filter(pa.array(keep, pa.bool_()))

    return run


def _grouped(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): (doc_id, key, n_shingles, cls) for each row of docs, key a hash of its text, and (cls, root, component_id)."""
    rows = banding(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    signed = materialize(docs.mapInArrow(_signed(k, rows), "doc_id long, key long, n_shingles long, cls binary, bands array<long>"), "signed")
    # A class's first row: the least doc_id, null last.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("f")
    first_seen = signed.where("cls is not null").groupBy("cls").agg(first).select("cls", "f.doc_id", "f.key")
    classes = signed.where("cls is not null").groupBy("cls").agg(F.first("bands").alias("bands"))
    keys = materialize(classes.select("cls", F.posexplode("bands").alias("j", "band")), "bands")
    pivots = keys.groupBy("band").agg(F.min("cls").alias("pivot"), F.max("cls").alias("other")).where("pivot <> other").select("band", "pivot")
    buckets = materialize(keys.join(pivots, "band"), "buckets")
    members = buckets.select("cls").distinct()

    # The sets of the classes in buckets only, made again from one text each.
    wanted = materialize(members.join(first_seen, "cls").withColumnRenamed("key", "first_key"), "wanted")
    texts_of = docs.withColumnRenamed("doc_id", "d").join(small(wanted), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("first_key"))).select("text", "cls")
    sets = materialize(texts_of.mapInArrow(_sets(k, rows), "cls binary, shingles binary, sketch binary, level int, keys binary").dropDuplicates(["cls"]), "sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, root_a, root_b) whose full sets are similar enough."""
        with_a = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a")
        both = with_a.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
        both = both.select("a", "b", "root_a", "root_b", "sa", "sb")
        return materialize(both.mapInArrow(_verify(percent), "a binary, b binary, root_a binary, root_b binary"), "linked")

    def merged(found: DataFrame, pairs: DataFrame) -> DataFrame:
        """found (node, root) with the components of confirmed pairs made one."""
        if pairs.isEmpty():
            return found
        links = confirm(pairs)
        if links.isEmpty():
            return found
        roots = components(links, "root_a", "root_b").select(F.col("node").alias("root"), F.col("root").alias("top"))
        return materialize(found.join(roots, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")

    stars = materialize(buckets.where("cls <> pivot").groupBy(F.col("pivot").alias("a"), F.col("cls").alias("b")).agg(F.count("*").alias("votes")), "stars")
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("votes", "a")).alias("a"))
    found = members.select(F.col("cls").alias("node"), F.col("cls").alias("root"))
    found = merged(found, materialize(best.select("a", "b", F.col("a").alias("root_a"), F.col("b").alias("root_b")), "best"))
    apart = stars.select("a", "b")
    for c in ("a", "b"):
        apart = apart.join(found.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c)
    found = merged(found, materialize(apart.where("root_a <> root_b"), "apart"))

    # Buckets that still hold several components: the classes outside the largest against the bucket, two blocks at a time.
    tagged = materialize(buckets.join(found.withColumnRenamed("node", "cls"), "cls").select("band", "j", "cls", "root"), "tagged")
    sizes = tagged.groupBy("band", "j", "root").agg(F.count("*").alias("c"))
    split = sizes.groupBy("band", "j").agg(F.max_by("root", F.struct("c", "root")).alias("largest"), F.max("c").alias("c"), F.sum("c").alias("n"), F.count("*").alias("roots"))
    split = split.where("roots > 1").select("band", "j", "largest", F.ceil(F.col("c") / BLOCK).alias("inside"), F.ceil((F.col("n") - F.col("c")) / BLOCK).alias("outside"))
    split = materialize(split, "split")
    if not split.isEmpty():
        held = tagged.join(split.drop("j"), "band").join(sets.select("cls", "keys", "sketch", "level"), "cls")
        side = (F.col("root") == F.col("largest")).alias("main")
        block = F.pmod(F.xxhash64("cls"), F.when(F.col("root") == F.col("largest"), F.col("inside")).otherwise(F.col("outside"))).alias("block")
        one = (F.col("inside") <= 1) & (F.col("outside") <= 1)
        held = held.select("band", "j", one.alias("one"), side, block, F.struct("cls", "root", "keys", "sketch", "level").alias("m"))
        # Most buckets are no more than two blocks, and a row holds both.
        few = held.where("one").groupBy("band", "j").agg(F.collect_list(F.when(~F.col("main"), F.col("m"))).alias("x"), F.collect_list(F.when(F.col("main"), F.col("m"))).alias("y"))
        few = few.select("j", "x", "y", F.lit(True).alias("alone"))
        blocks = held.where("not one").groupBy("band", "main", "block").agg(F.collect_list("m").alias("x"))  # about BLOCK
        blocks = materialize(blocks, "blocks")
        # Numbers of the blocks that meet; the blocks themselves come by (bucket, block), so no key has more than a bucket's blocks.
        meets = split.where(~one).select("band", "j", "inside", F.col("outside"), F.explode(F.sequence(F.lit(0), F.col("outside") - 1)).alias("block"))
        within = F.transform(F.sequence(F.col("block"), F.col("outside") - 1), lambda b: F.struct(F.lit(False).alias("main"), b.alias("block")))
        across = F.transform(F.sequence(F.lit(0).cast("long"), F.col("inside") - 1), lambda b: F.struct(F.lit(True).alias("main"), b.alias("block")))
        meets = meets.select("band", "j", "block", F.explode(F.concat(within, across)).alias("o")).select("band", "j", "block", F.col("o.main").alias("other_main"), F.col("o.block").alias("other"))
        itself = ~F.col("other_main") & (F.col("block") == F.col("other"))
        pairs = meets.withColumn("main", F.lit(False)).withColumn("alone", itself).join(blocks, ["band", "main", "block"])
        others = blocks.select("band", F.col("main").alias("other_main"), F.col("block").alias("other"), F.col("x").alias("y"))
        two = pairs.where("not alone").join(others, ["band", "other_main", "other"]).select("j", "x", "y", "alone")
        pairs = few.unionByName(two).unionByName(pairs.where("alone").select("j", "x", F.lit(None).cast(blocks.schema["x"].dataType).alias("y"), "alone"))
        found = merged(found, materialize(pairs.mapInArrow(_blocks(percent), "a binary, b binary, root_a binary, root_b binary"), "cross"))

    # Every class's component is named by the least doc_id in it.
    named = first_seen.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = materialize(named, "named")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return signed.select("doc_id", "key", "n_shingles", "cls"), materialize(named.join(small(materialize(least, "least")), "root").select("cls", "root", "component_id"), "ids")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text)."""
    rows, classes = _grouped(docs, k, percent)
    out = rows.join(small(classes), "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group: that with the least doc_id (null last), of equal rows any one. Rows without words all stay."""
    rows, classes = _grouped(docs, k, percent)
    with_root = rows.join(small(classes), "cls", "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("f")
    keep = with_root.where("cls is not null").groupBy("root").agg(first).select("f.doc_id", "f.key")
    times = rows.where("cls is not null").groupBy("doc_id", "key").agg(F.count("*").alias("c"))
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k"))
    keep = keep.select(F.col("doc_id").alias("i"), F.col("key").alias("k")).join(times, same).select("i", "k", (F.col("c") > 1).alias("more"))
    empty = rows.where("cls is null").select(F.col("doc_id").alias("i"), F.col("key").alias("k"), F.lit(False).alias("more")).distinct()
    keep = materialize(keep.unionByName(empty), "kept")
    marked = wrapped(docs, doc_id=F.col("doc_id").cast("long"), key=F.xxhash64(F.col("text").cast("string"))).join(small(keep), same)
    # Only rows of which there are equal ones are shuffled.
    one = marked.where("not more").unionByName(marked.where("more").dropDuplicates(["i", "k"]))
    return one.select("row.*")
