"""Quality selection by importance resampling with hashed n-grams.

Two generative models, of target text and of raw text, are bags of hashed words and word pairs. A document's log importance
weight is the sum over its features of the log ratio of their probabilities. Adding Gumbel noise and taking the top k
samples k documents without replacement in proportion to their weights. Counts cover every document; the noise is a hash
of the id, so a rerun after a lost executor gives the same sample.

The number of buckets grows with the square root of the bytes read, as the number of distinct words does (Heaps' law): 2^14
for small tables, 2^16 at 0.5 GB, 2^19 at 30 GB, 2^25 at 100 TB. What a task holds and what is broadcast for scoring is
one number of 8 bytes a bucket, so at most 32 bytes times that root: 270 MB at 100 TB.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.arrow import as_bytes, map_batches
from kinweave.operators.numbering import gapless
from kinweave.runtime import spool

#: The least number of buckets.
BUCKETS = 1 << 14
#: Features that a task gathers before it counts them.
GATHERED = 1 << 22
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
REMEMBERED = 300_000
_hashes: dict[bytes, int] = {}


def bits_for(n_bytes: int) -> int:
    """Buckets for so many bytes of text are 2 to the power of this: at least 2 sqrt(n_bytes) of them."""
    return max(BUCKETS.bit_length() - 1, ceil(log2(2 * sqrt(max(n_bytes, 1)))))


def features(text: bytes | None, bits: int = BUCKETS.bit_length() - 1) -> np.ndarray:
    """Buckets, of 2^bits, of all words and all pairs of neighbours of a whole text."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.int64)
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    for w in set(words).difference(_hashes):
        _hashes[w] = zlib.crc32(w)
    ones = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    twos = ones[:-1] * np.uint64(0x9E3779B97F4A7C15) + ones[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = np.concatenate([ones * np.uint64(0xFF51AFD7ED558CCD), twos])
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _counts(targets, bits: int) -> object:
    """(bucket, raw, target) of each GATHERED features or so, to be summed up."""

    def counted(every: list, chosen: list) -> pa.RecordBatch:
        cells, raw = np.unique(np.concatenate(every), return_counts=True)
        own, n = np.unique(np.concatenate([np.empty(0, np.int64), *chosen]), return_counts=True)
        target = np.zeros(len(cells), np.int64)
        target[np.searchsorted(cells, own)] = n
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (cells, raw, target)], names=["cell", "raw", "target"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = targets.value
        every, chosen, size = [], [], 0
        for batch in batches:
            for name, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                found = features(text.as_py(), bits)
                every.append(found)
                size += len(found)
                if name in wanted:
                    chosen.append(found)
                if size >= GATHERED:
                    yield counted(every, chosen)
                    every, chosen, size = [], [], 0
        if every:
            yield counted(every, chosen)

    return run


def log_ratios(docs: DataFrame, target_ids: set[int], bits: int | None = None) -> np.ndarray:
    """ln p_target / p_raw of each bucket with one added to each count. `docs` has id and text; the raw model covers all.
    2^bits buckets, by default as many as the bytes of `docs` ask for."""
    if bits is None:
        bits = bits_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    shared = docs.sparkSession.sparkContext.broadcast(target_ids)
    found = docs.mapInArrow(_counts(shared, bits), "cell long, raw long, target long")
    table = found.groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.ones(1 << bits), np.ones(1 << bits)
    cells = table.column("cell").to_numpy()
    raw[cells] += table.column("raw").to_numpy()
    target[cells] += table.column("target").to_numpy()
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(id, n_features, log_weight) of every document of `docs` (id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def make():
        own = shared.value
        bits = len(own).bit_length() - 1

        def step(cols):
            got = [features(t, bits) for t in cols["text"]]
            return {"id": cols["id"], "n_features": [len(g) for g in got], "log_weight": [float(own[g].sum()) for g in got]}

        return step

    return map_batches(docs, make, "id long, n_features long, log_weight double")


def _cut(keys: DataFrame, k: int, bins: int = 4096, rounds: int = 12) -> tuple[float, int]:
    """(x, r): the rows with key > x and r of those with key = x are the k largest. Each round counts one histogram."""
    row = keys.agg(F.min("key"), F.max("key")).first()
    low, high, above = row[0], row[1], 0
    for _ in range(rounds):
        width = (high - low) / bins
        if not width > 0:
            break
        at = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1))
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        hist = {int(r.b): (r.n, r.lo, r.hi) for r in inside.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        for b in sorted(hist, reverse=True):
            n, lo, hi = hist[b]
            if above + n >= k:
                low, high = lo, hi
                break
            above += n
        if low == high:
            break
    return low, k - above


def resample(docs: DataFrame, target_ids: set[int], fraction: float = 0.8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_features, log_weight, key, selected) for every row of `docs`; ceil(fraction x rows) are selected.

    `target_ids`: a bounded sample of ids whose texts are the target. Null and wordless texts have weight 0; equal keys are
    told apart in an arbitrary but exact number; an empty table gives no rows; extra columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col, "text"))
    weighed = log_weights(rows, log_ratios(rows, target_ids))
    u = (F.pmod(F.xxhash64(F.coalesce("id", F.lit(-1)), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keys = spool(weighed.withColumn("key", F.col("log_weight") - F.ln(-F.ln(u))), "keys")
    total = keys.count()
    k = -int(-total * fraction // 1)
    if not total or not k:
        return keys.select(F.col("id").alias(id_col), "n_features", "log_weight", "key", F.lit(False).alias("selected"))
    x, r = _cut(keys, k)
    sure = keys.where(F.col("key") != x).withColumn("selected", F.col("key") > x)
    ties = gapless(keys.where(F.col("key") == x), ["key"], ["id"], "__n").withColumn("selected", F.col("__n") < r).drop("__n")
    return sure.unionByName(ties).withColumnRenamed("id", id_col)


def target_sample(labels: DataFrame, good, bound: int = 100_000, id_col: str = "doc_id", seed: int = 42) -> set[int]:
    """At most `bound` ids of the labelled rows that `good` holds for: those with the least hashes."""
    ids = labels.where(good).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"))
    return {r.id for r in ids.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(bound).collect()}
