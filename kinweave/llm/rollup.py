"""Token counts as rollups that signed deltas maintain.

A batch is a table of signed changes: an insert counts +1 document and +n tokens, a delete -1 and -n, a revised count 0 and
the difference. It is summed by source, language and tokenizer version and committed as one folder of the ledger, named by
the batch. A batch that is committed already is left as it is, so a retried job changes nothing, and one of the same name
with other content is an error; one that broke off has no _SUCCESS file and is overwritten. Totals are the sum over committed batches; compaction folds them into one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.arrow import as_bytes, map_batches
from kinweave.llm.tokens import counter
from kinweave.runtime import exists

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens")


def counted(docs: DataFrame, tokenizers: dict[str, str], pattern: str, text_col: str = "text") -> DataFrame:
    """(source, lang, counts) for every row of `docs`: counts is a map from the names in `tokenizers` to how many tokens the
    whole text has by the file of that name. Null and empty texts have none; other columns are not read."""
    rows = docs.select("source", "lang", as_bytes(text_col, "text"))

    def make():
        by_name = {name: counter(path, pattern) for name, path in tokenizers.items()}

        def step(cols):
            counts = [[(name, count(text)) for name, count in by_name.items()] for text in cols["text"]]
            return {"source": cols["source"], "lang": cols["lang"], "counts": counts}

        return step

    return map_batches(rows, make, "source string, lang string, counts map<string, long>")


def inserts(docs: DataFrame, tokenizer: str, tokens: Column) -> DataFrame:
    """Changes for documents (source, lang) that are new: `tokens` is a long column over `docs`."""
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"), F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens"))


def deletes(docs: DataFrame, tokenizer: str, tokens: Column) -> DataFrame:
    """Changes for documents that go; `tokens` as they were inserted."""
    return inserts(docs, tokenizer, tokens).withColumns({c: -F.col(c) for c in SUMS})


def revisions(docs: DataFrame, tokenizer: str, old: Column, new: Column) -> DataFrame:
    """Changes for documents that stay while their count is revised."""
    return inserts(docs, tokenizer, F.coalesce(new, F.lit(0)) - F.coalesce(old, F.lit(0))).withColumn("n_docs", F.lit(0).cast("long"))


def summed(changes: DataFrame) -> DataFrame:
    """Additive totals by key; null sources and languages are keys of their own. Partial sums come before the shuffle."""
    return changes.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])


def _digest(rows: DataFrame) -> tuple:
    """Equal for equal sums, whatever their order."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (*KEYS, *SUMS)]
    return tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*parts).cast("decimal(38,0)"))).first())


@dataclass(frozen=True)
class Ledger:
    """Batches below `path` on any file system that Spark knows."""

    spark: SparkSession
    path: str

    def _folder(self, batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
            raise ValueError(f"bad batch name {batch!r}")
        return f"{self.path}/batch={batch}"

    def committed(self, batch: str) -> bool:
        return exists(self.spark, f"{self._folder(batch)}/_SUCCESS")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commit once; False if the batch was committed before with the same sums, an error if with others."""
        rows = summed(changes)
        if self.committed(batch):
            if _digest(rows) != _digest(self.spark.read.parquet(self._folder(batch))):
                raise ValueError(f"batch {batch} was committed with other content")
            return False
        rows.write.mode("overwrite").parquet(self._folder(batch))
        return True

    def batches(self) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        names = [n.removeprefix("batch=") for n in names if n.startswith("batch=")]
        return sorted(n for n in names if self.committed(n))

    def totals(self, only: list[str] | None = None) -> DataFrame:
        """Sums over committed batches; keys without documents and tokens left are not listed. No batch: no rows."""
        names = self.batches() if only is None else only
        if not names:
            empty = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
            return self.spark.createDataFrame([], empty)
        rows = self.spark.read.parquet(*[self._folder(n) for n in names])
        return summed(rows).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self, target: Ledger) -> Ledger:
        """The totals as the single batch `base` of another ledger."""
        target.commit("base", self.totals())
        return target
