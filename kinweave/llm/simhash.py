"""Near duplicates by SimHash: pigeonhole blocks, a join on blocks, Hamming distance.

A text's fingerprint has a bit for each of the 64 bits of XXH64 (seed 42) over its word shingles, set where over half of
the shingles have it. Two fingerprints link if at most `distance` bits differ. Split into `blocks` parts, such a pair
agrees on at least `blocks - distance` of them whole; so there is a table for each choice of that many parts, and linked
fingerprints share a key in at least one. More blocks give longer keys but more tables; `plan_blocks` weighs them by the
number of fingerprints, which keeps the pairs compared near proportional to the input.

Copies collapse first: blocks hold distinct fingerprints. Inside one key the links are followed breadth first and only a
spanning forest is emitted, so a group of m near copies gives m - 1 rows and not its square. Keys with over `local_limit`
fingerprints don't go to one task: there, two fingerprints link exactly if flipping at most half of `distance` of the
free bits in each leads to a common value, and an aggregate by that value links each to the least.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.arrow import as_bytes, map_batches, numbered, with_rows
from kinweave.operators.components import connected_components
from kinweave.runtime import spool

BITS = 64
SEED = 42
#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """Unsigned fingerprint; 0 without words. bytes.split() splits at exactly space, \\t, \\n, \\v, \\f and \\r."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=n)
    bits = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536].astype(">u8")
        bits += np.unpackbits(part.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id_col, fp): the fingerprint of each whole text as a signed 64-bit number. Null and wordless texts get 0."""

    def make():
        def step(cols):
            fps = [fingerprint(t, shingle) for t in cols["text"]]
            return {"id": cols["id"], "fp": [x - (1 << 64) if x >> 63 else x for x in fps]}

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col, "text"))
    return map_batches(rows, make, "id long, fp long").select(F.col("id").alias(id_col), "fp")


def plan_blocks(n: int, distance: int = 4, bits: int = BITS) -> int:
    """The number of blocks with the least work for n fingerprints: rows in all tables plus pairs expected to share a key."""

    def cost(blocks: int) -> float:
        tables, key = comb(blocks, distance), bits * (blocks - distance) // blocks
        return tables * (n + n * n / 2 ** (key + 1))

    return min(range(distance + 1, distance + 5), key=cost)


def block_masks(blocks: int, distance: int = 4, bits: int = BITS) -> list[int]:
    """A mask for each choice of blocks - distance blocks, as signed numbers."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(parts[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(fps: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the links among distinct fingerprints: (from, to) arrays."""
    out, rest = [], fps
    while len(rest) > 1:
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                found = rest[near]
                out.append((np.full(len(found), x), found))
                stack.extend(found)
                rest = rest[~near]
    return out


def _links_in_keys(distance: int):
    """Rows come grouped by (t, key), each with its group's size m; a group may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.uint64), np.empty(0, np.int64))
        for batch in batches:
            fps = np.concatenate([held[0], batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            m = np.concatenate([held[1], batch.column("m").to_numpy(zero_copy_only=False)])
            src, dst, at = [], [], 0
            twos = []
            while at < len(fps) and at + m[at] <= len(fps):
                size = int(m[at])
                if size == 2:
                    twos.append(at)
                else:
                    for a, b in _forest(fps[at : at + size], distance):
                        src.append(a)
                        dst.append(b)
                at += size
            if twos:
                a, b = fps[np.array(twos)], fps[np.array(twos) + 1]
                near = np.bitwise_count(a ^ b) <= distance
                src.append(a[near])
                dst.append(b[near])
            held = (fps[at:], m[at:])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (src, dst)], names=["src", "dst"])

    return run


def links(fps: DataFrame, distance: int = 4, blocks: int | None = None, local_limit: int = 32768) -> DataFrame:
    """(src, dst): edges with the same connected components as all pairs of distinct fp within `distance` bits.

    Nulls are ignored. Each edge is a real link, or joins two fingerprints to a common least one through real links.
    """
    fps = fps.select("fp").where("fp is not null").distinct()
    masks = block_masks(blocks or plan_blocks(fps.count(), distance), distance)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    keyed = fps.select("fp", F.explode(tables).alias("k")).select("fp", "k.t", "k.key")
    crowded = spool(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > local_limit).select("t", "key"), "crowded")
    some = not crowded.isEmpty()
    rest = keyed.join(crowded, ["t", "key"], "left_anti") if some else keyed  # no crowded key reaches the window
    sized = rest.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("t", "key"))).where("m > 1")
    small = sized.select("fp", "m").mapInArrow(_links_in_keys(distance), "src long, dst long")
    if not some:
        return small.distinct()
    return small.unionByName(_links_by_flips(keyed.join(crowded, ["t", "key"]), masks, distance)).distinct()


def _links_by_flips(keyed: DataFrame, masks: list[int], distance: int) -> DataFrame:
    """Links inside crowded keys: an aggregate over all values that half of `distance` flips of free bits lead to."""
    if distance % 2:
        raise ValueError("the distance must be even")
    flips = []
    for mask in masks:
        free = [1 << b for b in range(BITS) if not (mask >> b) & 1]
        sets = [sum(c) for k in range(distance // 2 + 1) for c in combinations(free, k)]
        flips.append([x - (1 << 64) if x >> 63 else x for x in sets])
    table = keyed.sparkSession.createDataFrame([(t, x) for t, xs in enumerate(flips) for x in xs], "t int, flip long")
    near = keyed.join(F.broadcast(table), "t").select("t", "key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    hub = near.groupBy("t", "key", "value").agg(F.min("fp").alias("dst"))
    return near.join(hub, ["t", "key", "value"]).where("fp <> dst").select(F.col("fp").alias("src"), "dst")


def firsts(prints: DataFrame) -> DataFrame:
    """(key, v) from prints (n, id, key): the vertex v of a key tells whether it has no id, its least id, the key, and the
    least n of a row with that id. Vertices are ordered by id, then key; keys without ids come last."""
    least = F.min(F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "n"))
    return prints.groupBy("key").agg(least.alias("f")).select("key", F.struct("f.none", "f.id", "key", "f.n").alias("v"))


def rooted(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, v, root): for each of `vertices` (key, v) the least vertex that `edges` (src, dst: keys) reach.

    Edges are relabelled first, so that a component's name is the answer and no component meets in a join.
    """
    end = lambda name: vertices.select(F.col("key").alias(name), F.col("v").alias(f"v_{name}"))
    found = connected_components(edges.join(end("src"), "src").join(end("dst"), "dst"), "v_src", "v_dst")
    found = found.select(F.col("vertex.key").alias("key"), F.col("component").alias("root"))
    return vertices.join(found, "key", "left").select("key", "v", F.coalesce("root", "v").alias("root"))


def least_id(root: str = "root"):
    return F.when(~F.col(f"{root}.none"), F.col(f"{root}.id"))


def kept_rows(table: DataFrame, roots: DataFrame) -> DataFrame:
    """Of `table` (n, row, id, key), spooled, one row a group, as it was: that with the least id; and one row an id, that
    with the least key and number. Rows with a null id always stay. Only numbers are joined; rows are marked by them."""
    stay = roots.where("v = root and not v.none").groupBy("v.id").agg(F.min("v.key").alias("key"), F.min_by("v.n", "v.key").alias("n")).select("n")
    gone = table.where("id is not null").select("n").join(stay, "n", "left_anti")
    return numbered(table.select("n", "row"), gone, inside=False).select("row.*")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, **options) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of `docs`.

    fingerprint: 16 lowercase hex digits. component_id: the least id that links reach, the row's own included. Null and
    wordless texts have fingerprint zero and link like any other; a null id is never least; repeated rows each get a row;
    an empty table gives no rows. Only ids and fingerprints are shuffled. Columns beyond the two are not read.
    """
    prints = spool(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    vertices = spool(firsts(prints.select(F.col(id_col).alias("id"), F.col("fp").alias("key"), F.lit(0).alias("n"))), "vertices")
    roots = rooted(vertices, links(vertices.select(F.col("key").alias("fp")), distance, **options))
    labels = roots.select(F.col("key").alias("fp"), least_id().alias("component_id"))
    return prints.join(labels, "fp", "left").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, **options) -> DataFrame:
    """Of each group of linked rows of `docs` the one with the least id, all columns as they were.

    A row is known by id and fingerprint, so rows of one id may belong to different groups; if several of them are the least of
    theirs, the one with the least fingerprint (as a signed number) stays, as an id names one document. Rows with a null id
    always stay, and stand in for none. Null and wordless texts are copies of each other.
    """

    def make():
        return lambda texts: {"key": [x - (1 << 64) if (x := fingerprint(t, shingle)) >> 63 else x for t in texts]}

    table = spool(with_rows(docs, make, "key long", text_col).withColumn("id", F.col("row").getField(id_col).cast("long")), "rows")
    vertices = spool(firsts(table), "vertices")
    return kept_rows(table, rooted(vertices, links(vertices.select(F.col("key").alias("fp")), distance, **options)))
