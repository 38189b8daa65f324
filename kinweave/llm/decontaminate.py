"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton over the items' normalised words is built on the driver from items of a checked size and sent to the tasks.
Each document's words stream through it once; the state and the length of the longest match ending at each word tell
which windows of the items end there. Items beyond `block_words` words are split into blocks of whole items, one automaton
each, so that the size of what is sent stays bounded; the documents then pass once for each block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import chain, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.arrow import as_bytes, held, map_batches, with_rows
from kinweave.runtime import spool

#: Bytes to their lower case where they belong to words, else to a space: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z to a-z.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Words of items in one automaton (some 250 bytes each in a task's memory).
BLOCK_WORDS = 200_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORDS).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over lists of words, with the items that each window of `window` words comes from.

    An item of fewer words, but at least one, is one window as a whole.
    """

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = 13):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: set[bytes] = set()
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            self.vocabulary.update(words)
            last = 0
            for w in words:
                last = self._extend(last, w)
        self._name_windows(items)

    def _state(self, length: int, link: int, follow: dict[bytes, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(follow)
        return len(self.length) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """A state for the shorter strings of q that p leads to by w."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _name_windows(self, items: list[tuple[object, list[bytes]]]) -> None:
        """long[s]: items whose window of full length is in state s. short[s]: (words, item) of short items that end in s."""
        n, w = len(self.length), self.window
        self.long: list[set] = [set() for _ in range(n)]
        self.short: list[list] = [[] for _ in range(n)]
        for name, words in items:
            state = 0
            for word in words:
                state = self.next[state][word]
                s = state
                if len(words) >= w:
                    while self.length[s] >= w and name not in self.long[s]:
                        self.long[s].add(name)
                        s = self.link[s]
            if len(words) < w:
                self.short[state].append((len(words), name))
        by_length = sorted(range(1, n), key=self.length.__getitem__)
        self.of_window = [-1] * n  # the state that holds the suffix of exactly `window` words
        for s in by_length:
            up = self.link[s]
            if self.length[s] >= w:
                self.of_window[s] = s if self.length[up] < w else self.of_window[up]
            if self.short[up]:
                self.short[s] = self.short[s] + self.short[up]
        self.watch = [self.of_window[s] >= 0 or bool(self.short[s]) for s in range(n)]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of hit words, merged and sorted, ends exclusive; and the items with windows that occur."""
        follow, link, length, watch, window = self.next, self.link, self.length, self.watch, self.window
        spans: list[list[int]] = []
        names: set = set()
        state = run = 0
        known = self.vocabulary
        for i, w in enumerate(words):
            if w not in known:
                state = run = 0
                continue
            to = follow[state].get(w)
            if to is None:
                while to is None:  # the root knows every word of the vocabulary
                    state = link[state]
                    to = follow[state].get(w)
                run = length[state]
            state = to
            run += 1
            if watch[state]:
                longest = 0
                if run >= window:
                    longest = window
                    names |= self.long[self.of_window[state]]
                for size, name in self.short[state]:
                    if size <= run:
                        names.add(name)
                        longest = max(longest, size)
                if longest:
                    start = i + 1 - longest
                    while spans and spans[-1][0] >= start:
                        spans.pop()
                    if spans and spans[-1][1] >= start:
                        spans[-1][1] = i + 1
                    else:
                        spans.append([start, i + 1])
        return [tuple(s) for s in spans], names


def _blocks(items: DataFrame, item_id: str, item_text: str, block_words: int) -> tuple[list, Iterator]:
    """The first block of items, or two where there are more, and the rest as they are asked for."""
    blocks = _in_blocks(items, item_id, item_text, block_words)
    return list(islice(blocks, 2)), blocks


def _in_blocks(items: DataFrame, item_id: str, item_text: str, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items in blocks of at most block_words words (one longer item is a block of its own), read one partition at a time."""
    block, size = [], 0
    for row in items.select(F.col(item_id).cast("string").alias("i"), as_bytes(item_text, "t")).toLocalIterator():
        words = words_of(bytes(row.t) if row.t is not None else None)
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row.i, words))
        size += len(words)
    yield block


_FOUND = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"


def _scanner(docs: DataFrame, block: list, window: int):
    """What map_batches() and with_rows() need to scan texts for one block of items."""
    shared, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def make():
        automaton = held(key, lambda: SuffixAutomaton(shared.value, window))

        def step(texts):
            out = {"n_words": [], "spans": [], "items": []}
            for text in texts:
                words = words_of(text)
                spans, names = automaton.scan(words)
                out["n_words"].append(len(words))
                out["spans"].append([{"start": a, "end": b} for a, b in spans])
                out["items"].append(sorted(x for x in names if x is not None))
            return out

        return step

    return make


def _scan_block(docs: DataFrame, block: list, window: int) -> DataFrame:
    """`docs` (id, text) with what is found instead of the text."""
    scanner = _scanner(docs, block, window)

    def make():
        step = scanner()
        return lambda cols: {"id": cols["id"]} | step(cols["text"])

    return map_batches(docs, make, f"id long, {_FOUND}")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id_col, n_words, n_hit, spans, items) for every row of `docs`.

    spans: merged word ranges [start, end) inside occurrences of items' windows; n_hit: their words; items: the ids, as
    strings, in order, whose windows occur. Null and wordless texts have no words and no hits; items without words give no
    windows; an item with a null id gives hits but no name; an id that repeats counts once. Extra columns are not read.
    Rows are told apart by their place, never by id, so neither null or repeated ids nor the number of blocks matter. With
    several blocks of items the texts are written once to the shared folder, and the blocks' hits meet in a shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col, "text"))
    return _found(rows, *_blocks(items, item_id, item_text, block_words), window).withColumnRenamed("id", id_col)


def _found(rows: DataFrame, held: list, more: Iterator, window: int) -> DataFrame:
    """(id, n_words, n_hit, spans, items) for each of `rows` (id, text)."""
    if len(held) == 1:
        table = _scan_block(rows, held[0], window)
    else:
        numbered = spool(rows.select("id", "text", F.monotonically_increasing_id().alias("n")), "texts")
        met = None
        for block in chain(held, more):
            found = _scan_block(numbered.select(F.col("n").alias("id"), "text"), block, window)
            hits = found.where("size(spans) > 0")
            base, met = (found.select("id", "n_words"), hits) if met is None else (base, met.unionByName(hits))
        met = met.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        met = met.withColumn("spans", _merged("spans"))
        joined = numbered.select("n", F.col("id").alias("own")).join(base.withColumnRenamed("id", "n"), "n").join(met.withColumnRenamed("id", "n"), "n", "left")
        none_s, none_i = F.array().cast("array<struct<start: long, end: long>>"), F.array().cast("array<string>")
        table = joined.select(F.col("own").alias("id"), "n_words", F.coalesce("spans", none_s).alias("spans"), F.coalesce("items", none_i).alias("items"))
    return table.select("id", "n_words", _n_hit().alias("n_hit"), "spans", "items")


def _n_hit():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])


def _merged(spans: str):
    """Sorted spans, overlapping or touching ones joined."""
    empty = F.array().cast("array<struct<start: long, end: long>>")

    def add(acc, s):
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]), longer).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, empty, add)


def contaminated(one_in: int = 20):
    """Whether there are hit words and at least one in `one_in` words is hit, for rows of contamination()."""
    return (F.col("n_hit") > 0) & (F.lit(one_in) * F.col("n_hit") >= F.col("n_words"))


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """`text` without the words in `spans`; separators outside the spans stay."""
    if not text or not spans:
        return text
    raw = text.encode()
    mask, at, n, ends = raw.translate(WORDS), 0, 0, []
    for word in mask.split():
        at = mask.index(word, at)
        ends.append((at, at + len(word)))
        at += len(word)
        n += 1
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done : ends[a][0]])
        done = ends[b - 1][1]
    return b"".join([*out, raw[done:]]).decode()


def clean_texts(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 13, one_in: int = 20, **options) -> DataFrame:
    """`docs` without benchmark text: documents with one hit word in `one_in` or more go, and from the others every span
    of at least `min_words` words is cut; rows without such a span stay as they are. Each row is judged on its own text,
    whatever its id; ids are not read. Null and empty texts stay; an empty table gives no rows."""
    found = _marked(docs, items, text_col, **options).where(~contaminated(one_in))
    long_spans = F.filter("spans", lambda s: s["end"] - s["start"] >= min_words)

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        return pd.Series([cut_spans(t, [(s["start"], s["end"]) for s in ss]) if len(ss) else t for t, ss in zip(texts, spans, strict=True)], dtype=object)

    own = F.col("row")
    return found.select("row", long_spans.alias("long")).select(own.withField(text_col, cut(own.getField(text_col), "long")).alias("row")).select("row.*")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = 20, **options) -> DataFrame:
    """`docs` without the documents with one hit word in `one_in` words or more; all others stay as they are. Each row is
    judged on its own text, whatever its id; ids are not read. Null and empty texts stay; an empty table gives no rows."""
    return _marked(docs, items, text_col, **options).where(~contaminated(one_in)).select("row.*")


def _marked(docs: DataFrame, items: DataFrame, text_col: str, item_id: str = "item_id", item_text: str = "text", window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(row, n_words, n_hit, spans) for each row of `docs`. For one block of items the rows pass through the scan, without a
    shuffle; for several they are written once, and what is found is joined to them by row number."""
    held, more = _blocks(items, item_id, item_text, block_words)
    if len(held) == 1:
        return with_rows(docs, _scanner(docs, held[0], window), _FOUND, text_col).select("row", "n_words", _n_hit().alias("n_hit"), "spans")
    rows = spool(docs.select(F.monotonically_increasing_id().alias("id"), F.struct("*").alias("row")), "rows")
    found = _found(rows.select("id", F.col("row").getField(text_col).cast("string").cast("binary").alias("text")), held, more, window)
    return rows.join(found, "id").select("row", "n_words", "n_hit", "spans")
