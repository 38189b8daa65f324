"""Arrow batches in and out of Python functions: whole rows, a batch at a time, nothing held between batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType, _parse_datatype_string

from kinweave.runtime import spool

#: Rows that a function sees at once, so that a batch of very long texts stays small.
ROWS = 500

#: Bytes in a batch on its way to Python. Each task holds a batch in the JVM, with room to grow, and once more in Python.
BATCH_BYTES = 8 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Marks that are broadcast at a time, each for 64 numbers of rows.
MARKS = 1 << 20

#: What this worker process keeps from one task to the next, and the keys that its present task asked for.
_held: dict[object, object] = {}
_asked: set[object] = set()


def held(key: object, build: Callable[[], object]) -> object:
    """What `build()` returns, built once a worker process and kept while tasks ask for it. A worker that turns to another
    function lets go of it, so that the tables of one operator don't add up with those of the next."""
    _asked.add(key)
    if key not in _held:
        _held[key] = build()
    return _held[key]


def _release() -> None:
    for key in set(_held) - _asked:
        del _held[key]
    _asked.clear()
    pa.default_memory_pool().release_unused()


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str | StructType, raw: tuple[str, ...] = ()) -> DataFrame:
    """`make()` runs once a task and returns a function from columns to columns, which then gets at most ROWS rows a call.

    It gets lists, or Arrow arrays for columns named in `raw`, and may return either. Unless the session sets its own limit, batches
    to Python are held to BATCH_BYTES from here on, or to one row where that is larger.
    """
    conf = df.sparkSession.conf
    if _LIMIT not in conf.getAll:
        conf.set(_LIMIT, str(BATCH_BYTES))
    out: pa.Schema = to_arrow_schema(_schema(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _asked.clear()
        step = make()
        _release()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                got = step({name: part.column(i) if name in raw else part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([x if isinstance(x := got[f.name], pa.Array) else pa.array(x, f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def _schema(text: str) -> StructType:
    return _parse_datatype_string(text)


def with_rows(docs: DataFrame, make: Callable[[], Callable[[list], dict[str, list]]], schema: str, text_col: str = "text") -> DataFrame:
    """(n, row, *schema): each row of `docs` as a struct, in which no name can clash, a number of its own, and what the
    function that `make` returns finds in the texts. Rows pass through as they are. Spool it before n is used twice."""
    kind = StructType([StructField("n", LongType(), False), StructField("row", docs.schema, False), *_schema(schema).fields])
    number, row = F.monotonically_increasing_id().alias("n"), F.struct("*").alias("row")
    inside = docs.columns.index(text_col) if docs.columns.count(text_col) == 1 and docs.schema[text_col].dataType == StringType() else None
    # a text that is in the row already isn't sent twice
    rows = docs.select(number, row, *([as_bytes(text_col, "text")] if inside is None else []))

    def made():
        step = make()

        def run(cols):
            texts = cols["text"] if inside is None else cols["row"].field(inside).cast(pa.binary()).to_pylist()
            return {"n": cols["n"], "row": cols["row"]} | step(texts)

        return run

    return map_batches(rows, made, kind, raw=("n", "row"))


def numbered(table: DataFrame, numbers: DataFrame, inside: bool = True) -> DataFrame:
    """The rows of `table` (n, ...), spooled, whose n is among `numbers` (n), or those whose n is not. Repeated numbers count once.

    Rows stay where they are, whatever their size: marks go to them, with a bit for each number. Over MARKS of them are sent
    range by range, and what is found in a range, the only part of the table that is read then, is written before the next.
    """
    word, bit = F.shiftright("n", 6), F.expr("cast(n & 63 as int)")
    marks = numbers.select(word.alias("word"), F.expr("shiftleft(1L, cast(n & 63 as int))").alias("bit"))
    marks = spool(marks.groupBy("word").agg(F.bit_or("bit").alias("bits")), "marks")
    ranges = -(-marks.count() // MARKS)
    cuts = marks.approxQuantile("word", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    found = []
    for low, high in pairwise([None, *sorted({int(x) for x in cuts}), None]):
        rows, some = table, marks
        if low is not None:
            rows, some = rows.where(F.col("n") >= low * 64), some.where(F.col("word") >= low)
        if high is not None:
            rows, some = rows.where(F.col("n") < high * 64), some.where(F.col("word") < high)
        rows = rows.join(F.broadcast(some), word == F.col("word"), "inner" if inside else "left")
        rows = rows.where(F.coalesce(F.getbit("bits", bit), F.lit(0)) == int(inside)).select(*table.columns)
        found.append(spool(rows, "numbered") if cuts else rows)
    return reduce(DataFrame.unionByName, found)


def as_bytes(column: str, name: str | None = None):
    """The UTF-8 bytes of a text column; null stays null."""
    return F.col(column).cast("string").cast("binary").alias(name or column)
