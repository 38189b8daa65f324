"""Near duplicates by SimHash, with fingerprints long enough to find a given similarity of word shingles.

A text's set holds XXH64 of each of its word shingles; two texts link if the sets' Jaccard similarity is at least `similarity`.
Equal sets collapse first. As in simhash.py, a fingerprint has a bit for each of the bits that the shingles' hashes have, set
where over half of the shingles have it, and is split into blocks, so that close ones share a block; but it has BITS bits
instead of 64, as a pair of similarity 0.8 differs in 15 of 100 bits. `plan` chooses the length of a block by the number of
fingerprints, and as many blocks as leave out such a pair with a chance of MISSED. Fingerprints that share a block and differ
in few of their first 128 bits are candidates. What is said of a pair is then always decided by the sets themselves:

1. Each set is compared with one hub, the best connected of the candidates that are the hub of a block. In a group of near
   copies this links nearly all, with one pair a set and not their square.
2. Sets of one hub that it did not link are compared with the others of that hub, some dozens with some dozens at a time.
3. Candidates of different hubs that are still apart are compared pair by pair.

So every candidate pair is either joined already or compared, no group meets in one task, and there is no limit on a block:
one of over CROWD fingerprints is dealt into parts, and pairs of parts are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from math import acos, ceil, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.arrow import map_batches, numbered, with_rows
from kinweave.llm.simhash import LOWER, SEED, firsts, kept_rows, least_id, rooted
from kinweave.runtime import spool

#: Bits of a fingerprint.
BITS = 1024
#: Chance that a pair that is just similar enough shares no block, if bits were independent.
MISSED = 0.001
#: Fingerprints of a block that a task holds at a time.
CROWD = 4096
_SALTS, _FACTORS = np.random.default_rng(SEED).integers(1 << 63, size=(2, BITS // 64 - 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words, but at least one, is one shingle as a whole."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=n))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def set_key(hashes: np.ndarray) -> int:
    """A signed number that stands for the whole set."""
    return _signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))


def long_fingerprint(hashes: np.ndarray) -> bytes | None:
    """SimHash of a set; none for an empty set, which only equals other empty ones. The first 64 bits are those of XXH64,
    the others those of as many mixes of it."""
    if not len(hashes):
        return None
    ones = np.zeros(BITS, np.int64)
    words = np.empty((255, BITS // 64), ">u8")
    for at in range(0, len(hashes), 255):  # counts of 255 fit a byte
        part = hashes[at : at + 255, None]
        x = (part ^ _SALTS) * _FACTORS
        x ^= x >> np.uint64(32)
        x *= _FACTORS[::-1]
        x ^= x >> np.uint64(29)
        words[: len(part), :1], words[: len(part), 1:] = part, x
        ones += np.add.reduce(np.unpackbits(words[: len(part)].view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def differing(similarity: float) -> float:
    """The share of bits in which two sets of that similarity differ, at most: sets of equal size have the widest angle."""
    return acos(min(1.0, 2 * similarity / (1 + similarity))) / pi


def plan(n: int, similarity: float) -> tuple[int, int]:
    """(length of a block, number of blocks) with the least work for n fingerprints: rows in all blocks, and pairs expected
    to share one by chance. A row is shuffled and sorted, a pair is two XORs in numpy: reckoned as 300 to one."""
    p = differing(similarity)

    def blocks(length: int) -> int:
        return max(1, ceil(log(MISSED) / log(1 - (1 - p) ** length))) if p else 1

    length = min(range(10, 33, 2), key=lambda k: blocks(k) * (n + n * n / 2**k / 600))
    return length, blocks(length)


def block_bits(length: int, blocks: int) -> np.ndarray:
    """The bits of each block: the fingerprint cut into parts, and when these are used up, its bits in another order."""
    a_round, rng = BITS // length, np.random.default_rng(SEED)
    orders = [np.arange(BITS), *(rng.permutation(BITS) for _ in range(blocks // a_round))]
    return np.concatenate([x[: a_round * length].reshape(a_round, length) for x in orders])[:blocks]


def in_blocks(prints: DataFrame, length: int, blocks: int) -> DataFrame:
    """(block, f, g, *others, m): a row for each of the `blocks` of `prints` (print, others: longs) that m > 1 share; f and g
    are the first 128 bits."""
    others = [c for c in prints.columns if c != "print"]

    def make():
        chosen, powers = block_bits(length, blocks).ravel(), 1 << np.arange(length, dtype=np.int64)
        tables = np.arange(blocks, dtype=np.int64) << 32

        def step(cols):
            got = np.frombuffer(b"".join(cols["print"].to_pylist()), np.uint8).reshape(-1, BITS // 8)
            bits = np.unpackbits(got, axis=1)[:, chosen].reshape(len(got), blocks, length)
            first = np.ascontiguousarray(got[:, :16]).view(np.int64)
            out = {"block": ((bits @ powers) + tables).ravel(), "f": np.repeat(first[:, 0], blocks), "g": np.repeat(first[:, 1], blocks)}
            return {k: pa.array(v) for k, v in (out | {c: np.repeat(cols[c].to_numpy(), blocks) for c in others}).items()}

        return step

    rows = map_batches(prints, make, ", ".join(f"{c} long" for c in ["block", "f", "g", *others]), raw=tuple(prints.columns))
    return rows.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("block"))).where("m > 1")


def _near_pairs(cols: dict[str, np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows of one block with at most `most` differing bits; a block's rows lie together."""
    block, f, g = cols["block"], cols["f"].view(np.uint64), cols["g"].view(np.uint64)
    ends = np.flatnonzero(np.append(block[1:] != block[:-1], True)) + 1
    after = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(block))  # rows to the block's end, its own included
    i, d = np.arange(len(block)), 1
    while len(i := i[after[i] > d]):
        near = np.bitwise_count(f[i] ^ f[i + d]).astype(np.int16) + np.bitwise_count(g[i] ^ g[i + d]) <= most
        yield i[near], i[near] + d
        d += 1


def _by_block(step, names: list[str], crowd: int | None = None):
    """`step` from columns with whole blocks to columns `names`. Rows come grouped by block, each with its size m; a block
    may span batches. Blocks of over `crowd` rows may come in pieces, so that a task never holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in batch.schema.names}
            if held:
                cols = {k: np.concatenate([held[k], v]) for k, v in cols.items()}
            block, m = cols["block"], cols["m"]
            n = whole = len(block)
            if n:
                last = int(np.append(-1, np.flatnonzero(block[1:] != block[:-1]))[-1]) + 1
                whole = last if n - last < m[-1] <= (crowd or m[-1]) else n
            held = {k: v[whole:] for k, v in cols.items()}
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in step({k: v[:whole] for k, v in cols.items()})], names=names)

    return run


def _near_counts(most: int, crowd: int):
    """(key, w): rows that others of their block are near to, and how many. In blocks of over `crowd` rows all count as near:
    this only leaves out rows that need no further look."""

    def step(cols):
        few = cols["m"] <= crowd
        count, some = np.zeros(np.count_nonzero(few), np.int64), {k: v[few] for k, v in cols.items()}
        for i, j in _near_pairs(some, most):
            count[i] += 1  # a place comes at most once a round
            count[j] += 1
        return [np.concatenate([some[k][count > 0] if k == "key" else count[count > 0], cols[k][~few]]) for k in ("key", "m")]

    return _by_block(step, ["key", "w"], crowd)


def _pairs_apart(most: int):
    """(src, dst): near rows of a block with different labels and different hubs."""

    def step(cols):
        found = [np.empty((2, 0), np.int64)]
        for i, j in _near_pairs(cols, most):
            apart = (cols["label"][i] != cols["label"][j]) & (cols["hub"][i] != cols["hub"][j])
            a, b = cols["key"][i[apart]], cols["key"][j[apart]]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
        src, dst = np.unique(np.concatenate(found, axis=1), axis=1)
        return src, dst

    return _by_block(step, ["src", "dst"])


def dealt(rows: DataFrame, crowd: int) -> DataFrame:
    """`rows` (block, key, m, ...) of large blocks in smaller ones of about twice `crowd` rows, in which each two rows of a
    block meet at least once."""
    parts = F.ceil(F.col("m") / crowd)
    rows = rows.withColumn("one", F.pmod(F.xxhash64("key"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    rows = rows.withColumn("block", F.xxhash64("block", F.least("one", "other"), F.greatest("one", "other"))).drop("one", "other")
    return rows.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("block")))


def _differ(a, b):
    """The number of differing bits of two structs' or tables' f and g."""
    return F.bit_count(a["f"].bitwiseXOR(b["f"])) + F.bit_count(a["g"].bitwiseXOR(b["g"]))


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of `pairs` (src, dst) whose `sets` (key, size, hashes) are at least so similar."""
    side = lambda name, c: sets.select(F.col("key").alias(name), F.col(c).alias(f"{c}_{name}"))
    a, b = F.col("size_src"), F.col("size_dst")
    both = F.size(F.array_intersect("hashes_src", "hashes_dst"))
    # a pair of unequal sizes can't be more similar than the quotient of the sizes, so its sets are not sent
    near = pairs.join(side("src", "size"), "src").join(side("dst", "size"), "dst").where(F.least(a, b) >= similarity * F.greatest(a, b))
    near = near.join(side("src", "hashes"), "src").join(side("dst", "hashes"), "dst")
    return near.where(both >= similarity * (a + b - both)).select("src", "dst")


def links(table: DataFrame, similarity: float = 0.8, shingle: int = 5, text_col: str = "text") -> DataFrame:
    """(src, dst): edges with the same connected components as all candidate pairs that are similar enough. `table` is
    spooled and has n, key, print, and row with the text."""
    once = table.where("print is not null").groupBy("key").agg(F.min(F.struct("n", "print")).alias("f"))
    keyed = spool(once.select("key", "f.n", "f.print"), "prints")
    length, blocks = plan(keyed.count(), similarity)
    p = differing(similarity)
    most = ceil(128 * p + 4 * sqrt(128 * p * (1 - p)))  # four deviations beyond the mean

    rows = in_blocks(keyed.select("key", "print"), length, blocks)
    some = rows.select("block", "key", "f", "g", "m").mapInArrow(_near_counts(most, CROWD), "key long, w long")
    weights = some.groupBy("key").agg(F.sum("w").alias("w"))
    near = spool(weights.join(keyed, "key"), "near")

    # the sets of keys that are near others, each from one row that has it
    texts = table.select("n", F.col("row").getField(text_col).cast("string").cast("binary").alias("text"))
    texts = numbered(texts, near.select("n")).select("text")

    def make():
        def step(cols):
            sets = [shingle_set(t, shingle) for t in cols["text"]]
            return {"key": [set_key(x) for x in sets], "size": [len(x) for x in sets], "hashes": [x.view(np.int64) for x in sets]}

        return step

    sets = spool(map_batches(texts, make, "key long, size int, hashes array<long>"), "sets")
    rows = in_blocks(near.select("key", "w", "print"), length, blocks)
    hub = F.max(F.struct("w", "key", "f", "g")).over(Window.partitionBy("block"))
    rows = rows.withColumn("h", hub).where(_differ({"f": F.col("f"), "g": F.col("g")}, F.col("h")) <= most)
    best = rows.groupBy("key").agg(F.max(F.struct("h.w", "h.key")).alias("h")).select("key", F.col("h.key").alias("hub"))
    best = spool(near.select("key").join(best, "key", "left").select("key", F.coalesce("hub", "key").alias("hub")), "hubs")
    first = spool(similar(best.where("key <> hub").select(F.col("key").alias("src"), F.col("hub").alias("dst")), sets, similarity), "links")
    label = best.join(first.select(F.col("src").alias("key"), "dst"), "key", "left").select("key", "hub", F.coalesce("dst", "key").alias("label"))
    up = label.select(F.col("key").alias("label"), F.col("label").alias("above"))
    label = spool(label.join(up, "label").select("key", "hub", F.col("above").alias("label")), "labels")

    of_hub = label.select(F.col("key").alias("hub"), F.col("label").alias("hub_label"))
    inside = label.join(of_hub, "hub").select("hub", "key", "label", (F.col("label") == F.col("hub_label")).alias("with_hub"))
    mixed = inside.where("not with_hub").select("hub").distinct()
    first_bits = [F.conv(F.hex(F.substring("print", at, 8)), 16, -10).cast("long").alias(n) for at, n in ((1, "f"), (9, "g"))]
    whole = spool(inside.join(mixed, "hub", "left_semi").join(near.select("key", *first_bits), "key").join(sets.drop("size"), "key"), "mixed")

    here = Window.partitionBy("block")
    rows = in_blocks(near.select("key", "print").join(label, "key"), length, blocks)
    rows = rows.withColumn("one", F.min("hub").over(here) == F.max("hub").over(here)).where("not one").drop("one")
    rows = rows.where(F.col("m") <= CROWD).unionByName(dealt(rows.where(F.col("m") > CROWD), CROWD))
    pairs = spool(rows.mapInArrow(_pairs_apart(most), "src long, dst long").distinct(), "pairs")
    return first.unionByName(_links_apart(whole, similarity, most)).unionByName(similar(pairs, sets, similarity))


#: Sets that a task compares with as many others at a time.
TOGETHER = 64


def _links_apart(inside: DataFrame, similarity: float, most: int) -> DataFrame:
    """(src, dst): links of sets that their hub did not link with its sets of another label. `inside` has hub, key, label,
    with_hub, hashes, f, g; candidates differ in at most `most` bits of f and g.

    A hub's sets are dealt by hashes into groups of some TOGETHER sets, and pairs of groups are rows, so that a hub of any size
    is compared in many tasks, and only links come out.
    """
    sizes = inside.groupBy("hub").agg(F.ceil(F.count_if(~F.col("with_hub")) / TOGETHER).alias("na"), F.ceil(F.count(F.lit(1)) / TOGETHER).alias("nb"))
    rows = inside.join(sizes, "hub")
    own = F.struct("key", "label", "with_hub", "f", "g", "hashes")
    at = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).alias(n[1:] + "_at")
    ones = rows.where("not with_hub").select("hub", "nb", at("na"), own.alias("x")).groupBy("hub", "nb", "a_at").agg(F.collect_list("x").alias("xs"))
    ones = ones.select("hub", "xs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("b_at"))
    others = rows.select("hub", at("nb"), own.alias("y")).groupBy("hub", "b_at").agg(F.collect_list("y").alias("ys"))

    def links_of(x):
        def near(y):
            n, m = F.size(x["hashes"]), F.size(y["hashes"])
            once = (x["label"] != y["label"]) & (y["with_hub"] | (x["key"] < y["key"])) & (F.least(n, m) >= similarity * F.greatest(n, m))
            both = F.size(F.array_intersect(x["hashes"], y["hashes"]))
            return once & (_differ(x, y) <= most) & (both >= similarity * (n + m - both))

        return F.transform(F.filter("ys", near), lambda y: F.struct(x["key"].alias("src"), y["key"].alias("dst")))

    met = ones.join(others, ["hub", "b_at"])
    return met.select(F.explode(F.flatten(F.transform("xs", links_of))).alias("l")).select("l.*")


def _table(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    def make():
        def step(texts):
            sets = [shingle_set(t, shingle) for t in texts]
            return {"key": [set_key(s) for s in sets], "print": [long_fingerprint(s) for s in sets]}

        return step

    return spool(with_rows(docs, make, "key long, print binary", text_col).withColumn("id", F.col("row").getField(id_col).cast("long")), "rows")


def shingle_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id_col, component_id) for every row of `docs`.

    component_id: the least id that links reach, the row's own included. Null and wordless texts equal each other; a null id
    is never least; repeated rows each get a row; an empty table gives no rows.
    """
    table = _table(docs.select(id_col, text_col), id_col, text_col, shingle)
    roots = rooted(spool(firsts(table), "vertices"), links(table, similarity, shingle, text_col))
    labels = roots.select("key", least_id().alias("component_id"))
    return table.select("id", "key").join(labels, "key", "left").select(F.col("id").alias(id_col), "component_id")


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each group of linked rows of `docs` the one with the least id, as keep_one() of SimHash has it, with the hash of the
    set of shingles in the place of the fingerprint."""
    table = _table(docs, id_col, text_col, shingle)
    return kept_rows(table, rooted(spool(firsts(table), "vertices"), links(table, similarity, shingle, text_col)))
