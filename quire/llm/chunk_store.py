"""Content-addressed store of token ids.

write_store cuts every document's ids into chunks where a rolling hash of the last ids hits
a mask, so equal passages give equal chunks wherever they stand. A store is a folder of
Parquet tables:

* chunks   digest (128-bit BLAKE2b of the ids), ids (little-endian, 2 or 4 bytes each): every distinct chunk once
* recipes  start, doc_id, n_tokens, digests, root: range-partitioned and sorted by start, so the files follow each other
           in ascending doc_id order; root is the Merkle root of the digests
* manifest the Merkle tree over all recipes: level, node, n_docs, n_tokens, hash. A node of level 0 hashes, in order, the recipes
           that start in a span of SPAN ids; one of a higher level FANOUT nodes below; the top is the store's root

Both readers first build the tree anew from the recipes and hold it against the manifest, so a recipe that is missing, changed
or added is an error; they check each document's digests against its root and each chunk against
its digest, and a chunk that is missing is an error. `document_sums` returns length and CRC per document without
gathering the ids: the CRCs of the chunks read are combined (a CRC is linear over concatenation). `read_documents` returns
the ids themselves.

Null and empty texts hold the end id alone. Rows with a null doc_id come first. Repeated rows are
kept, each with its own place. Extra columns are ignored. No rows give empty tables.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, parts, readable, running_total, scratch_dir, small, texts
from .tokens import encoder, vocabulary
from .words import mix

END_ID = 2
#: Ids that the rolling hash sees; a cut falls on one id in MASK + 1; no chunk is longer than LONGEST.
WINDOW, MASK, LONGEST = 8, 511, 4096
#: Ids of a leaf of the manifest's tree, and children of its other nodes.
SPAN, FANOUT = 1 << 16, 1024
RECIPES = "start long, doc_id long, n_tokens long, digests array<binary>, root binary"
CHUNKS = "digest binary, ids binary"


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary hash tree; a last odd node moves up as it is; no leaves: the digest of nothing."""
    level = list(leaves) or [_digest(b"")]
    while len(level) > 1:
        level = [_digest(b"\x01" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


#: A hash of each id; ids beyond the table share entries.
_HASH = (mix(np.arange(1 << 16, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def cut_all(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each of the documents that stand in ids one after another, up to ends. No hash reaches over a document's start."""
    h = _HASH[ids & 0xFFFF]
    rolled = h.copy()
    for i in range(1, min(WINDOW, len(ids))):
        rolled[i:] += h[: len(ids) - i] * np.uint32(2 * i + 1)
    hits = np.flatnonzero((rolled * np.uint32(0x9E3779B1)) >> np.uint32(16) & np.uint32(MASK) == 0) + 1
    starts = np.concatenate([[0], ends[:-1]])
    hits = hits[hits - starts[np.searchsorted(ends, hits)] >= WINDOW]
    at, hits, out = np.searchsorted(hits, ends, "left").tolist(), hits.tolist(), []
    for doc, end in enumerate(ends.tolist()):
        last, own = int(starts[doc]), []
        for cut in (*hits[at[doc - 1] if doc else 0 : at[doc]], end):
            if cut > last:
                own += range(last + LONGEST, cut, LONGEST)
                own.append(cut)
                last = cut
        out.append(own)
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream."""
    return cut_all(ids, np.array([len(ids)]))[0]


def _staged(path: str, end_id: int, width: int):
    def run(batches):
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for part in parts(batches):
            found = [ids + end for ids in enc.encode_column(part.column(1))]
            ends = np.cumsum([len(x) // 4 for x in found])
            ids = np.frombuffer(b"".join(found), "<u4")
            if len(ids) and int(ids.max()) >> (8 * width):
                raise ValueError(f"id {ids.max()} does not fit in {width} bytes")
            data, start, out = ids.astype(f"<u{width}").tobytes(), 0, []
            for own in cut_all(ids, ends):
                chunks, last = [], start
                for cut in own:
                    chunks.append(data[width * last : width * cut])
                    last = cut
                digests = [_digest(c) for c in chunks]
                out.append((last - start, digests, chunks, merkle_root(digests)))
                start = last
            columns = list(zip(*out)) or [[]] * 4
            kinds = (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_tokens", "digests", "chunks", "root"])

    return run


def _hashed(order: str) -> Column:
    """Hash of a group's hashes in an order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "hash"))), lambda x: x["hash"]), ","), 256)


def merkle_tree(recipes: DataFrame) -> DataFrame:
    """The manifest's rows for recipes (start, doc_id, n_tokens, root); a node gathers at most SPAN recipes or FANOUT nodes."""
    row = F.sha2(F.concat_ws(":", "start", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "n_tokens", F.hex("root")), 256)
    leaves = recipes.select("start", "n_tokens", row.alias("hash"))
    sums = [F.sum("n_tokens").alias("n_tokens")]
    level = leaves.groupBy(F.expr(f"start div {SPAN}").alias("node")).agg(F.count("*").alias("n_docs"), *sums, _hashed("start").alias("hash"))
    tree = level = materialize(level.select(F.lit(0).alias("level"), "node", "n_docs", "n_tokens", "hash"), "tree")
    top, depth = level.agg(F.max("node")).first()[0] or 0, 0
    while top > 0:
        top, depth = top // FANOUT, depth + 1
        level = level.groupBy(F.expr(f"node div {FANOUT}").alias("up")).agg(F.sum("n_docs").alias("n_docs"), *sums, _hashed("node").alias("hash"))
        level = materialize(level.select(F.lit(depth).alias("level"), F.col("up").alias("node"), "n_docs", "n_tokens", "hash"), "tree")
        tree = tree.unionByName(level)
    return tree


def write_store(docs: DataFrame, path: str, end_id: int = END_ID, vocab: str | None = None, width: int = 2) -> None:
    """Tokenize docs (doc_id, text) and write them as a store at path. width 2 holds ids below 65,536; larger ones are an error."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), readable("text").alias("text"))
    rows = docs.mapInArrow(_staged(vocab or vocabulary(), end_id, width), "doc_id long, n_tokens long, digests array<binary>, chunks array<binary>, root binary")
    staged = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "staged")

    recipes = running_total(staged.select("doc_id", "n_tokens", "digests", "root", "row"), "doc_id", "n_tokens", "start", "row")
    recipes = recipes.select("start", "doc_id", "n_tokens", "digests", "root")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    recipes.repartitionByRange(files, "start").sortWithinPartitions("start").write.parquet(f"{path}/recipes")
    merkle_tree(spark.read.schema(RECIPES).parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")

    places = staged.select("row", F.posexplode("digests").alias("i", "digest"))
    owners = places.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("row", "i")).alias("owner")).where("n > 1").select("digest", "owner")
    copies = places.join(small(materialize(owners, "owners")), "digest").where(F.struct("row", "i") != F.col("owner"))
    copies = materialize(copies.groupBy("row").agg(F.collect_list("i").alias("copies")), "copies")  # bounded by the row's own chunks
    owned = staged.join(small(copies), "row", "left").select(F.arrays_zip("digests", "chunks").alias("z"), F.coalesce("copies", F.array().cast("array<int>")).alias("copies"))
    owned = owned.select(F.posexplode("z").alias("i", "c"), "copies").where(~F.array_contains("copies", F.col("i")))
    owned.select(F.col("c.digests").alias("digest"), F.col("c.chunks").alias("ids")).write.option("compression", "zstd").parquet(f"{path}/chunks")


@lru_cache(maxsize=64)
def _append(log: int) -> list[list[int]]:
    """Tables that move a CRC past 2^log zero bytes: one of 256 entries for each of its bytes."""
    if log == 0:
        # crc32(data, c) is linear in c up to a constant, so a bit's effect is its difference to c = 0.
        bits = [zlib.crc32(b"\0", 1 << i) ^ zlib.crc32(b"\0") for i in range(32)]
    else:
        bits = [_moved(_moved(1 << i, log - 1), log - 1) for i in range(32)]
    tables = []
    for b in range(4):
        table = [0]
        for i in range(8):
            table += [x ^ bits[8 * b + i] for x in table]
        tables.append(table)
    return tables


def _moved(crc: int, log: int) -> int:
    a, b, c, d = _append(log)
    return a[crc & 255] ^ b[crc >> 8 & 255] ^ c[crc >> 16 & 255] ^ d[crc >> 24]


def combined_crc(parts: list[tuple[int, int]]) -> int:
    """CRC of a concatenation, from (crc, bytes) of its parts."""
    crc = 0
    for part, n in parts:
        log = 0
        while n:
            if n & 1:
                crc = _moved(crc, log)
            n >>= 1
            log += 1
        crc ^= part
    return crc


def _checked(batches):
    """Chunks (digest, ids) as they are; an error where one doesn't have its digest."""
    for part, rows in texts(batches, "ids"):
        if bad := [d.hex() for d, data in zip(part.column(0).to_pylist(), rows) if _digest(data) != d]:
            raise ValueError(f"chunks that don't have their digest: {bad[:3]}")
        yield part


def _chunk_sums(width: int):
    """Chunks to digest, ids and CRC."""

    def run(batches):
        for part in _checked(batches):
            digests, rows = part.column(0), part.column(1).to_pylist()
            crc = [zlib.crc32(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()) for data in rows]
            yield pa.RecordBatch.from_arrays([digests, pa.array([len(x) // width for x in rows], pa.int32()), pa.array(crc, pa.int64())], ["digest", "n", "crc"])

    return run


def _rooted(batches):
    """Recipes as they are; an error where the digests don't have the document's root."""
    for batch in batches:
        for start, digests, root in zip(*(batch.column(c).to_pylist() for c in ("start", "digests", "root"))):
            if merkle_root(digests) != root:
                raise ValueError(f"the chunks of the document at {start} don't have its root")
        yield batch


def verified_recipes(spark: SparkSession, path: str) -> DataFrame:
    """The recipes of a store; an error if their Merkle tree is not the manifest's."""
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    key, values = ["level", "node"], ["n_docs", "n_tokens", "hash"]
    told = spark.read.parquet(f"{path}/manifest").select(*key, F.struct(*values).alias("told"))
    found = merkle_tree(recipes).select(*key, F.struct(*values).alias("found"))
    if wrong := told.join(found, key, "full").where(~F.col("told").eqNullSafe(F.col("found"))).orderBy("level", "node").limit(3).collect():
        raise ValueError(f"the recipes don't match the manifest: {wrong}")
    return recipes.mapInArrow(_rooted, RECIPES)


def _summed(batches):
    for batch in batches:
        found = batch.column("parts")
        i, n, crc = (c.to_numpy(zero_copy_only=False) for c in found.flatten().flatten())
        at, out = found.offsets.to_numpy() - found.offsets[0].as_py(), []
        for row, (start, doc_id, n_tokens) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("start", "doc_id", "n_tokens")))):
            own = slice(at[row], at[row + 1])
            order = np.argsort(i[own])
            sizes = n[own][order].tolist()
            if any(x != x for x in sizes) or sum(sizes) != n_tokens:
                raise ValueError(f"chunks of document {doc_id} at {start} are missing")
            out.append((doc_id, start, n_tokens, combined_crc([(int(c), 4 * int(x)) for c, x in zip(crc[own][order].tolist(), sizes)])))
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _steps(spark: SparkSession, path: str) -> DataFrame:
    """A row for each chunk of each document, with its place i."""
    return verified_recipes(spark, path).select("start", "doc_id", "n_tokens", F.posexplode("digests").alias("i", "digest"))


def document_sums(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files; fails if something is missing or changed."""
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").mapInArrow(_chunk_sums(width), "digest binary, n int, crc long")
    found = _steps(spark, path).join(chunks, "digest", "left")
    rows = found.groupBy("start", "doc_id", "n_tokens").agg(F.collect_list(F.struct("i", "n", "crc")).alias("parts"))  # of one document
    return rows.mapInArrow(_summed, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start and ids (little-endian bytes) of every document; fails if something is missing or changed."""
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").mapInArrow(_checked, CHUNKS)
    found = _steps(spark, path).join(chunks, "digest", "left")
    missing = F.raise_error(F.concat(F.lit("a chunk is missing: "), F.hex("digest"))).cast("binary")
    found = found.withColumn("ids", F.when(F.col("ids").isNull(), missing).otherwise(F.col("ids")))
    rows = found.groupBy("start", "doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("parts"))
    return rows.select("doc_id", "start", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def store_and_sums(docs: DataFrame, end_id: int = END_ID) -> DataFrame:
    """Write docs as a new store in the shared folder and read it back."""
    path = f"{scratch_dir(docs.sparkSession).rstrip('/')}/store-{uuid.uuid4().hex}"
    write_store(docs, path, end_id)
    return document_sums(docs.sparkSession, path)
