"""Quality classifier: interpolated modified Kneser-Ney model of characters, one per language.

Trusted text (labelled good and not toxic) is counted by all its ORDER-grams of characters, white space
runs as one space; nine tenths of the trusted documents train, a tenth (by hash of the id) is held out.
The highest order has its counts, lower orders have continuation counts; three
discounts per language and order come from counts of counts; probabilities are built from the shortest
order up by joins of the count tables on (language, suffix) and (language, context), sharded like any
Spark join. A document's negative log-likelihood per character gives its perplexity; drawn to its language's held-out
mean by WEIGHT characters it is its rate, which the threshold is held against.

A few words unlike trusted text hardly move the mean of a long document, so the mean of its worst WINDOW characters
in a row is a second rate (a shorter text is filled up with its language's mean). A document is rejected if either rate
is beyond the held-out quantile at QUANTILE of its language; languages with fewer than POOLED held-out documents take
that quantile from the distances of all languages' held-out rates from their language's mean. Where even these are
fewer than POOLED, the sample is too small for the quantile and the limit lies beyond it by its distance from the median.

Log-probabilities are kept as whole numbers of 1/SCALE, so sums don't depend on their order. Scoring joins the documents' grams
with the model: by lookup in broadcast arrays if the model has at most MODEL_ROWS rows, else by shuffle joins of each document's distinct
grams. The size chooses the join alone; results are equal to the last bit. Characters take the place of words, whose trigrams
would all have to be shuffled: a model of five characters sees odd spelling, junk and foreign words, but not odd order of usual words.

Empty and null texts, and texts of languages without trusted text, have no perplexity and are kept. Null languages form one of
their own. Null doc_ids and repeated rows are returned as they come. Extra columns are ignored by `perplexities`
and kept by `keep_good`.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, readable, small, texts, wrapped
from .memos import turn

ORDER, WEIGHT, QUANTILE, HELD_OUT = 5, 200, 0.99, 10
WINDOW, POOLED = 10, 100
MODEL_ROWS = 4_000_000
#: Parts of a log-probability, and the mark for none.
SCALE, NONE = 1 << 20, -(1 << 31)
_P = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _codes(text: bytes | None) -> np.ndarray:
    """Code points of the text with white space as single spaces, after ORDER - 1 spaces."""
    words = " ".join((text or b"").decode().split())
    return np.frombuffer((" " * (ORDER - 1) + words).encode("utf-32-le"), np.uint32) if words else np.empty(0, np.uint32)


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For k from 1 to ORDER the hashes of the k-grams that end at each place (the first places wrap and are not used)."""
    c, out = codes.astype(np.uint64), []
    h = np.zeros(len(c), np.uint64)
    for k in range(ORDER):
        h = h + np.roll(c, k) * np.uint64(pow(_P, k, 1 << 64))
        out.append(h)
    return out


def _top_hashes(codes: np.ndarray) -> np.ndarray:
    """The last of _hashes alone."""
    c = codes.astype(np.uint64)
    h = c.copy()
    for k in range(1, ORDER):
        h += np.roll(c, k) * np.uint64(pow(_P, k, 1 << 64))
    return h


def _counted(batches):
    """Arrow batches (lang, text) to (lang, gram, n): every ORDER-gram, summed within the task."""
    found: dict[str, list] = {}
    rows = 0

    def merged(parts):
        keys, first, where = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        return keys, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64), np.concatenate([p[2] for p in parts])[first]

    def batches_of():
        for lang, parts in found.items():
            _, n, grams = merged(parts)
            for at in range(0, len(n), 100_000):
                part = grams[at : at + 100_000]
                text = part.tobytes().decode("utf-32-le")
                names = [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names)), pa.array(names), pa.array(n[at : at + 100_000])], ["lang", "gram", "n"])

    for part, texts_ in texts(batches, size=64):
        by_lang: dict[str, list] = {}
        for lang, text in zip(part.column(0).to_pylist(), texts_):
            by_lang.setdefault(lang, []).append(_codes(text))
        for lang, codes in by_lang.items():
            # Windows that end in a document's first ORDER - 1 places reach into the one before.
            inside = np.concatenate([np.arange(len(c)) >= ORDER - 1 for c in codes])[ORDER - 1 :]
            codes = np.concatenate(codes)
            if not len(codes):
                continue
            keys = _top_hashes(codes)[ORDER - 1 :][inside]
            grams = np.lib.stride_tricks.sliding_window_view(codes, ORDER)[inside]
            unique, first, n = np.unique(keys, return_index=True, return_counts=True)
            found.setdefault(lang, []).append((unique, n, grams[first]))
            rows += len(unique)
        if rows > 800_000:
            for lang, parts in found.items():
                found[lang] = [merged(parts)]
            rows = sum(len(p[0][0]) for p in found.values())
            if rows > 500_000:  # partial sums go out; Spark adds them up
                yield from batches_of()
                found, rows = {}, 0
    yield from batches_of()


def _discounts(counts: DataFrame) -> DataFrame:
    """lang and d1, d2, d3 from the counts of counts."""
    n = counts.groupBy("lang").agg(*(F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in range(1, 5)))
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
    out = []
    for i in (1, 2, 3):
        d = i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1.0))
        out.append(F.greatest(F.lit(0.1), F.least(d, F.lit(i - 0.1))).alias(f"d{i}"))
    return n.select("lang", *out)


def model(trusted: DataFrame) -> DataFrame:
    """lang, gram, logp (null if the gram is only a context) and backoff (log weight of the shorter order after it) in 1/SCALE, for trusted (lang, text).

    The empty gram's logp is that of an unseen character.
    """
    grams = trusted.select("lang", "text").mapInArrow(_counted, "lang string, gram string, n long")
    counts = {ORDER: materialize(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")}
    for k in range(ORDER - 1, 0, -1):
        longer = counts[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
        counts[k] = materialize(longer, "continuations")
    n = counts[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("p"))
    below = n.withColumn("gram", F.lit(""))
    out = []
    for k in range(1, ORDER + 1):
        c = counts[k].join(F.broadcast(_discounts(counts[k])), "lang")  # a row per language
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        c = c.withColumn("d", F.least(d, F.col("n"))).withColumn("context", F.substring("gram", 1, k - 1) if k > 1 else F.lit(""))
        contexts = materialize(c.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("weight")), "contexts")
        c = c.join(small(contexts), ["lang", "context"]).withColumn("suffix", F.substring("gram", 2, k))
        shorter = below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
        p = (F.col("n") - F.col("d")) / F.col("total") + F.col("weight") * F.col("q")
        if k == 1:
            unseen = contexts.join(below.select("lang", "p"), "lang").select("lang", F.lit("").alias("gram"), F.log(F.col("weight") * F.col("p")).alias("logp"))
            out.append(unseen)
        below = materialize(c.join(small(shorter), ["lang", "suffix"]).select("lang", "gram", p.alias("p")), "order")
        out.append(below.select("lang", "gram", F.log("p").alias("logp")))
        if k > 1:
            out.append(contexts.select("lang", F.col("context").alias("gram"), F.log("weight").alias("backoff")))
    union = out[0]
    for x in out[1:]:
        union = union.unionByName(x, allowMissingColumns=True)
    whole = [F.round(F.max(c) * SCALE).cast("int").alias(c) for c in ("logp", "backoff")]
    return materialize(union.groupBy("lang", "gram").agg(*whole), "model")


class _Table:
    """Hashes to two numbers by open addressing; lookups of whole arrays at once."""

    def __init__(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray):
        bits = max(8, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.at = np.full(1 << bits, -1, np.int32)
        self.keys, self.a, self.b = keys, a, b
        todo = np.arange(len(keys), dtype=np.int32)
        slot = ((keys * _MIX) >> self.shift).astype(np.int64)
        while len(todo):
            free = self.at[slot] < 0
            self.at[slot[free]] = todo[free]  # of several for one slot the last stays
            left = self.at[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes, -1 where absent."""
        slot = ((h * _MIX) >> self.shift).astype(np.int64)
        out = self.at[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != h))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            out[open_] = self.at[slot[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[out[open_]] != h[open_])]
        return out


def _hashed(batches):
    """Arrow batches (lang, gram, logp, backoff) to numbers: lang, size, hash, logp, backoff."""
    for batch in batches:
        grams = batch.column(1).to_pylist()
        size, h = np.array([len(g) for g in grams]), np.zeros(len(grams), np.uint64)
        for k in range(1, ORDER + 1):
            own = np.flatnonzero(size == k)
            codes = np.frombuffer("".join([grams[i] for i in own]).encode("utf-32-le"), np.uint32).reshape(len(own), k)
            if k and len(own):
                h[own] = sum(codes[:, k - 1 - j].astype(np.uint64) * np.uint64(pow(_P, j, 1 << 64)) for j in range(k))
        kept = (batch.column(2).fill_null(NONE), batch.column(3).fill_null(0))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), pa.array(h.view(np.int64)), *kept], ["lang", "size", "h", "logp", "backoff"])


def _arrays(found: DataFrame) -> dict[tuple[str, int], tuple[np.ndarray, ...]]:
    """(language, gram size) to hashes, log-probabilities and backoffs, for a model of checked size."""
    langs = sorted(r["lang"] for r in found.select("lang").distinct().collect())  # a row per language
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int").alias("lang") if langs else F.lit(0).alias("lang")
    rows = found.select(number, "gram", "logp", "backoff").mapInArrow(_hashed, "lang int, size int, h long, logp int, backoff int").toArrow()
    lang, size, h, logp, backoff = (rows.column(c).to_numpy() for c in ("lang", "size", "h", "logp", "backoff"))
    out = {}
    for i, key in enumerate(langs, 1):
        for k in range(ORDER + 1):
            at = np.flatnonzero((lang == i) & (size == k))
            out[key, k] = (h[at].view(np.uint64), logp[at], backoff[at])
    return out


#: The tables of the last model that a worker saw, by its number.
_TABLES: dict[int, dict[str, list[_Table]]] = {}


def _tables(arrays, number: int = -1) -> dict[str, list[_Table]]:
    """For each language the tables of the grams of 0 to ORDER characters."""
    if number < 0 or number not in _TABLES:
        _TABLES.clear()
        _TABLES[number] = {lang: [_Table(*arrays[lang, k]) for k in range(ORDER + 1)] for lang, size in arrays if size == 0}
    return _TABLES[number]


def _logp(tables: list[_Table], codes: np.ndarray) -> np.ndarray:
    """Log-probability, in 1/SCALE, of the character at each place of codes, after the ORDER - 1 before it."""
    h = _hashes(codes)
    out, todo = np.zeros(len(codes), np.int64), np.arange(ORDER - 1, len(codes))
    for k in range(ORDER, 0, -1):
        at = tables[k].find(h[k - 1][todo])
        p = np.where(at >= 0, tables[k].a[at], NONE)
        hit = p != NONE
        out[todo[hit]] += p[hit]
        todo = todo[~hit]
        if not len(todo):
            return out
        if k > 1:
            at = tables[k - 1].find(h[k - 2][todo - 1])
            out[todo] += np.where(at >= 0, tables[k - 1].b[at], 0)
    out[todo] += tables[0].a[0]
    return out


def _worst(sums: np.ndarray) -> int:
    """The largest loss of WINDOW characters in a row, of all if there are fewer, from running sums of log-probabilities that start at 0."""
    size = min(WINDOW, len(sums) - 1)
    return int((sums[:-size] - sums[size:]).max())


def _scored(arrays, number: int):
    def run(batches):
        turn(__name__, _TABLES.clear)
        models = _tables(arrays.value, number)
        for part, rows in texts(batches, size=64):
            langs = part.column(part.schema.get_field_index("lang")).to_pylist()
            nll, n, worst = [None] * len(rows), [0] * len(rows), [None] * len(rows)
            for lang in set(langs) & models.keys():
                own = [i for i, x in enumerate(langs) if x == lang]
                while own:
                    some, codes, size = [], [], 0
                    while own and size < 100_000:
                        some.append(own.pop())
                        codes.append(_codes(rows[some[-1]]))
                        size += len(codes[-1])
                    logp = np.concatenate([[0], np.cumsum(_logp(models[lang], np.concatenate(codes)))]) if size else np.zeros(1, np.int64)
                    end = 0
                    for i, c in zip(some, codes):
                        start, end = end, end + len(c)
                        if len(c):
                            nll[i], n[i] = int(logp[start + ORDER - 1] - logp[end]), len(c) - ORDER + 1
                            worst[i] = _worst(logp[start + ORDER - 1 : end + 1])
            kept = [part.column(i) for i in range(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(nll, pa.int64()), pa.array(worst, pa.int64())], ["doc_id", "lang", "role", "n", "nll", "worst"])

    return run


def _gram_rows(batches):
    """Arrow batches (doc_id, lang, role, row, text) to a row per distinct gram with its places, and one without gram for each document."""
    for part, rows in texts(batches):
        for i, text in enumerate(rows):
            codes = _codes(text)
            text = codes.tobytes().decode("utf-32-le")
            grams, where, n = np.unique([text[j : j + ORDER] for j in range(len(text) - ORDER + 1)], return_inverse=True, return_counts=True) if len(codes) else ([], [], [])
            places = np.split(np.argsort(where, kind="stable"), np.cumsum(n)[:-1]) if len(codes) else []
            one = part.slice(i, 1).to_pydict()
            k = len(grams) + 1
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(one[c] * k, t) for c, t in (("doc_id", pa.int64()), ("lang", pa.string()), ("role", pa.int32()), ("row", pa.int64()))), pa.array([None, *map(str, grams)], pa.string()), pa.array([0, *map(int, n)], pa.int64()), pa.array([None, *places], pa.list_(pa.int32()))],
                ["doc_id", "lang", "role", "row", "gram", "times", "places"],
            )


def _worst_rows(batches):
    """Arrow batches (doc_id, lang, role, n, nll, grams) with the worst stretch in place of the grams (places, lp) of a document."""
    for batch in batches:
        worst = []
        for n, nll, grams in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)):
            if nll is None:
                worst.append(None)
                continue
            places, lp = grams.values.flatten()
            logp = np.zeros(n + 1, np.int64)
            logp[places.flatten().to_numpy() + 1] = np.repeat(lp.to_numpy(), pc.fill_null(pc.list_value_length(places), 0).to_numpy())
            worst.append(_worst(np.cumsum(logp)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(worst, pa.int64())], ["doc_id", "lang", "role", "n", "nll", "worst"])


def score_by_join(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, lang, role, n, nll and worst by shuffle joins of the documents' grams with the model's tables."""
    docs = materialize(docs.select("doc_id", "lang", "role", F.monotonically_increasing_id().alias("row"), "text"), "rows")
    rows = docs.mapInArrow(_gram_rows, "doc_id long, lang string, role int, row long, gram string, times long, places array<int>")
    rows = rows.withColumn("rest", F.col("gram")).withColumn("acc", F.lit(0).cast("long")).withColumn("lp", F.lit(None).cast("long"))
    probabilities = found.where("logp is not null and gram <> ''").select("lang", F.col("gram").alias("rest"), "logp")
    backoffs = found.where("backoff is not null").select("lang", F.col("gram").alias("context"), "backoff")
    for k in range(ORDER, 0, -1):
        rows = rows.join(probabilities, ["lang", "rest"], "left")
        rows = rows.withColumn("lp", F.coalesce("lp", F.col("acc") + F.col("logp"))).drop("logp")
        rows = rows.withColumn("context", F.when(F.col("lp").isNull(), F.substring("rest", 1, k - 1)))
        rows = rows.join(backoffs, ["lang", "context"], "left").withColumn("acc", F.col("acc") + F.coalesce("backoff", F.lit(0))).drop("backoff", "context")
        rows = rows.withColumn("rest", F.when(F.col("lp").isNull(), F.substring("rest", 2, k - 1)))
    unseen = found.where("gram = ''").select("lang", F.col("logp").alias("unseen"))
    rows = rows.join(F.broadcast(unseen), "lang", "left").withColumn("lp", F.coalesce("lp", F.col("acc") + F.col("unseen")))
    known = F.first(F.col("unseen").isNotNull())
    rows = rows.groupBy("doc_id", "lang", "role", "row").agg(
        F.when(known, F.sum("times")).otherwise(0).alias("n"), F.when(known & (F.sum("times") > 0), -F.sum(F.col("lp") * F.col("times"))).alias("nll"),
        F.collect_list(F.struct("places", "lp")).alias("grams"),  # as long as the document
    ).drop("row")
    return rows.mapInArrow(_worst_rows, "doc_id long, lang string, role int, n long, nll long, worst long")


def perplexities(docs: DataFrame, labels: DataFrame, model_rows: int = MODEL_ROWS, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_scored, perplexity, the same drawn to the mean (smoothed), its threshold, the same of the worst stretch (worst, worst_threshold) and kept for every row of docs (doc_id, text, lang)."""
    trusted = labels.where("doc_id is not null and quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()
    # Role 1 trains, role 2 is held out, role 0 is neither.
    role = F.when(F.pmod(F.xxhash64("trusted_id"), F.lit(HELD_OUT)) == 0, 2).otherwise(1)
    trusted = materialize(trusted.withColumn("trusted_role", role), "trusted")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), readable("text").alias("text"))
    docs = docs.join(small(trusted), F.col("doc_id") == F.col("trusted_id"), "left").select("doc_id", "lang", F.coalesce("trusted_role", F.lit(0)).alias("role"), "text")
    found = model(docs.where("role = 1"))
    if found.count() <= model_rows:
        arrays = docs.sparkSession.sparkContext.broadcast(_arrays(found))
        scored = docs.mapInArrow(_scored(arrays, uuid.uuid4().int), "doc_id long, lang string, role int, n long, nll long, worst long")
    else:
        scored = score_by_join(docs, found)
    scored = materialize(scored, "scored").withColumns({c: F.col(c) / SCALE for c in ("nll", "worst")})
    means = scored.where("role = 2 and n > 0").groupBy("lang").agg((F.sum("nll") / F.sum("n")).alias("mean"))
    scored = scored.join(F.broadcast(means), "lang", "left")  # a row per language
    scored = scored.withColumn("rate", (F.col("nll") + WEIGHT * F.col("mean")) / (F.col("n") + WEIGHT))
    scored = scored.withColumn("worst", (F.col("worst") + F.greatest(WINDOW - F.col("n"), F.lit(0)) * F.col("mean")) / WINDOW)
    held = scored.where("role = 2 and rate is not null")
    q = [F.percentile_approx(F.col(c) - F.col("mean"), F.array(F.lit(0.5), F.lit(quantile)), 10_000).alias(f"{p}_{c}") for p in ("own", "all") for c in ("rate", "worst")]
    pooled = held.agg(F.count("*").alias("n_all"), *q[2:])
    limits = held.groupBy("lang").agg(F.count("*").alias("n_own"), *q[:2]).join(F.broadcast(pooled))  # a row per language

    def limit(c: str):
        few = F.col(f"all_{c}")[1] + F.when(F.col("n_all") < POOLED, F.col(f"all_{c}")[1] - F.col(f"all_{c}")[0]).otherwise(0.0)
        return F.when(F.col("n_own") < POOLED, few).otherwise(F.col(f"own_{c}")[1])

    out = scored.join(F.broadcast(limits.select("lang", limit("rate").alias("limit"), limit("worst").alias("worst_limit"))), "lang", "left")
    over = [F.col("rate") - F.col("mean") > F.col("limit"), F.col("worst") - F.col("mean") > F.col("worst_limit")]
    kept = ~F.coalesce(over[0] | over[1], F.lit(False))
    return out.select(
        "doc_id", "lang", F.col("n").alias("n_scored"), F.exp(F.col("nll") / F.col("n")).alias("perplexity"), F.exp("rate").alias("smoothed"), F.exp(F.col("mean") + F.col("limit")).alias("threshold"),
        F.exp("worst").alias("worst"), F.exp(F.col("mean") + F.col("worst_limit")).alias("worst_threshold"), kept.alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rejected ones; rows with one doc_id go together."""
    bad = materialize(perplexities(docs, labels).where("not kept").select(F.col("doc_id").alias("bad")).distinct(), "rejected")
    return wrapped(docs, id=F.col("doc_id").cast("long")).join(small(bad), F.col("id").eqNullSafe(F.col("bad")), "left_anti").select("row.*")
