"""Best-fit packing with exact-complement hashing.

Documents become token pieces of at most `capacity` tokens. What to put together is decided on the histogram of piece
lengths, at most `capacity` numbers, on the driver: for each length from the longest down, an index of single, pair and
triple sums of the lengths still available is asked for one that fills the gap exactly, and as many sequences as the
availability counts allow are planned at once. A length without an exact complement starts open sequences, which shorter
lengths then best-fit. The plan (a few thousand patterns, whatever the number of documents) goes to the tasks; a piece finds
its sequence from its length and its gapless number among the pieces of that length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.arrow import as_bytes, map_batches
from kinweave.llm.tokens import encoder
from kinweave.operators.numbering import gapless
from kinweave.runtime import spool

END = b"\0\0\0\0"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids): every document's ids plus id 0, cut where longer than `capacity`.

    ids are little-endian unsigned 32-bit numbers. Null and empty texts give one piece with id 0 alone; repeated rows are
    documents of their own. Extra columns are not read.
    """

    def make():
        coder = encoder(tokenizer_path)
        step_bytes = 4 * capacity

        def step(cols):
            out = {"id": [], "piece": [], "start": [], "length": [], "ids": []}
            for name, text in zip(cols["id"], cols["text"], strict=True):
                ids = coder.encode(text) + END
                for piece, at in enumerate(range(0, len(ids), step_bytes)):
                    part = ids[at : at + step_bytes]
                    for k, v in zip(out, (name, piece, at // 4, len(part) // 4, part), strict=True):
                        out[k].append(v)
            return out

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col, "text"))
    return map_batches(rows, make, "id long, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


@dataclass(frozen=True)
class Pattern:
    """`times` sequences, each of pieces with these lengths, longest first."""

    lengths: tuple[int, ...]
    times: int


class _Sums:
    """Which single, pair and triple sums the available lengths make."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.pair_bits = 0
        self.stale = True

    def use(self, lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            self.counts[x] -= times
            self.stale |= self.counts[x] <= 0

    def _pair(self, total: int) -> tuple[int, ...] | None:
        high = np.arange(total - 1, (total - 1) // 2, -1)
        if not len(high):
            return None
        a, b = self.counts[high], self.counts[total - high]
        ok = np.flatnonzero((a > 0) & (b > 0) & ((high != total - high) | (a > 1)))
        return (int(high[ok[0]]), int(total - high[ok[0]])) if len(ok) else None

    def _pair_index(self) -> int:
        if self.stale:
            one = sum(1 << int(x) for x in np.flatnonzero(self.counts > 0))
            self.pair_bits, rest = 0, one
            while rest:
                low = rest & -rest
                self.pair_bits |= one << (low.bit_length() - 1)
                rest ^= low
            self.stale = False
        return self.pair_bits

    def filling(self, gap: int, most: int = 3) -> tuple[int, ...] | None:
        """At most `most` (up to three) available lengths, longest first, that sum to the gap; the fewest, then the longest."""
        if not gap:
            return ()
        if most and self.counts[gap] > 0:
            return (gap,)
        if most > 1 and (pair := self._pair(gap)):
            return pair
        if most < 3:
            return None
        pairs = self._pair_index()
        for x in np.flatnonzero(self.counts[:gap] > 0)[::-1]:
            x = int(x)
            if 3 * x < gap:
                return None  # the longest of three is at least a third
            if (pairs >> (gap - x)) & 1:
                self.counts[x] -= 1
                found = self._pair(gap - x)
                self.counts[x] += 1
                if found:
                    return tuple(sorted((x, *found), reverse=True))
        return None

    def beside(self, own: tuple[int, ...], gap: int, most: int) -> tuple[int, ...] | None:
        """filling() of a gap while the lengths `own` are taken."""
        for x in own:
            self.counts[x] -= 1
        found = self.filling(gap, most)
        for x in own:
            self.counts[x] += 1
        return found

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often these lengths can be had together."""
        return min(int(self.counts[x]) // lengths.count(x) for x in set(lengths))


def plan_packing(histogram: dict[int, int], capacity: int = 2048) -> list[Pattern]:
    """Patterns that use each length exactly as often as the histogram says, none over `capacity`.

    Exact fills by up to three pieces are tried first. As they can take pieces that longer ones need later, plans with fills of
    up to two, one and no pieces are made too until one meets the lower bound; the one with the fewest sequences is taken, so
    that it never has more than best fit alone.
    """
    for length in histogram:
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit")
    least = -(-sum(length * n for length, n in histogram.items()) // capacity)
    best: list[Pattern] | None = None
    fewest = 0
    for most in (3, 2, 1, 0):
        plan = _planned(histogram, capacity, most)
        n = sum(p.times for p in plan)
        if best is None or n < fewest:
            best, fewest = plan, n
        if fewest <= least:
            break
    return best


#: Pieces of one length that start a sequence together at most while its gap is looked up.
ALIKE = 8


def _planned(histogram: dict[int, int], capacity: int, most: int) -> list[Pattern]:
    """Longest first: a length goes into the least open gap that holds it, together with lengths that fill the rest of that
    gap exactly; without such a gap it starts sequences, exactly filled where sums of available lengths do so, else open."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    sums, patterns = _Sums(counts), []
    open_: dict[int, list[list]] = {}
    gaps = 0  # bit g: some open sequence has a gap of g

    def put(lengths: tuple[int, ...], times: int) -> None:
        nonlocal gaps
        lengths = tuple(sorted(lengths, reverse=True))
        if gap := capacity - sum(lengths):
            open_.setdefault(gap, []).append([lengths, times])
            gaps |= 1 << gap
        else:
            patterns.append(Pattern(lengths, times))

    for length in range(capacity, 0, -1):
        while n := int(counts[length]):
            if fits := gaps >> length:
                gap = (fits & -fits).bit_length() - 1 + length
                group = open_[gap][-1]
                new = (length, *(sums.beside((length,), gap - length, most) or ()))
                times = min(group[1], sums.times(new))
                group[1] -= times
                if not group[1]:
                    open_[gap].pop()
                    if not open_[gap]:
                        gaps ^= 1 << gap
                put((*group[0], *new), times)
                sums.use(new, times)
                continue
            each = capacity // length
            for k in range(1, min(each, n, ALIKE) + 1):
                own = (length,) * k
                if (found := sums.beside(own, capacity - k * length, most)) is not None:
                    times = sums.times((*own, *found))
                    put((*own, *found), times)
                    sums.use((*own, *found), times)
                    break
            else:
                if n >= each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                sums.use((length,), n)
    return patterns + [Pattern(lengths, times) for groups in open_.values() for lengths, times in groups]


_BASE = 1 << 48


def _places(patterns: list[Pattern]) -> tuple[np.ndarray, ...]:
    """Sorted (length, first number) keys, and for each: pieces a sequence, first sequence, first offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for p in patterns:
        offset, at = 0, 0
        while at < len(p.lengths):
            length = p.lengths[at]
            each = p.lengths.count(length)
            rows.append((length * _BASE + used.get(length, 0), each, sequence, offset))
            used[length] = used.get(length, 0) + each * p.times
            offset += each * length
            at += each
        sequence += p.times
    return tuple(np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else tuple(np.empty(0, np.int64) for _ in range(4))


def pack(pieces: DataFrame, capacity: int = 2048, unique: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """`pieces` (with a `length`) plus sequence_id and offset: each sequence holds at most `capacity` tokens, without gaps.

    `pieces` is read twice: materialise it first. Rows that are equal in `unique` each get a place. Sequence numbers are
    gapless from 0. Only the histogram comes to the driver and only the plan goes out; every other column rides along.
    """
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(histogram.values())
    shared = pieces.sparkSession.sparkContext.broadcast(_places(plan_packing(histogram, capacity)))
    numbered = gapless(pieces, ["length"], list(unique), "__number", buckets=min(4096, max(16, total // 20_000)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, number):
        import pandas as pd

        keys, each, sequence, offset = shared.value
        lengths, numbers = length.to_numpy(np.int64), number.to_numpy(np.int64)
        j = np.searchsorted(keys, lengths * _BASE + numbers, side="right") - 1
        k = numbers - keys[j] % _BASE
        return pd.DataFrame({"sequence_id": sequence[j] + k // each[j], "offset": offset[j] + k % each[j] * lengths})

    return numbered.withColumn("__place", place("length", "__number")).select(*pieces.columns, "__place.*")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", extra=()) -> DataFrame:
    """token_pieces() packed: (id_col, piece, start, length, ids, sequence_id, offset).

    `extra` names columns over ids to keep instead of them, so that only those are stored and shuffled.
    """
    pieces = token_pieces(docs, tokenizer_path, capacity, id_col, text_col)
    if extra:
        pieces = pieces.select(id_col, "piece", "start", "length", *extra)
    return pack(spool(pieces, "pieces"), capacity, (id_col, "piece"))
