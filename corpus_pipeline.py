"""Documents to packed training sequences: quality rules, near duplicates, benchmark text, personal data, packing.

Each stage is a function of (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return
the columns of documents; the last returns a row for each piece with its place in a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.decontaminate import clean_texts
from kinweave.llm.packing import pack_documents
from kinweave.llm.pii import mask_documents
from kinweave.llm.quality import keep_good
from kinweave.llm.queries import PACKING_TOKENIZER
from kinweave.llm.shingles import keep_one_similar
from kinweave.runtime import spool


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go. Null and empty texts have no words and go; repeated rows are judged alike."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 5-word shingles of 0.8 or more the document with the least id stays.

    Null and wordless texts are copies of each other; rows with a null id stay; of repeated rows one stays.
    """
    return keep_one_similar(docs, shingle=5, similarity=0.8)


def benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go in which at least one word in twenty is part of a benchmark window; from the others, runs of 13 or more
    such words are cut. Each row is judged on its own text, also where ids are null or repeat; null and empty texts stay."""
    return _counted(docs, clean_texts(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, min_words=13, one_in=20))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind. All rows stay, repeated ones too; null and empty texts stay as they are."""
    return _counted(docs, mask_documents(docs))


def _counted(before: DataFrame, after: DataFrame) -> DataFrame:
    """`after` with an n_chars that follows its texts, where there is one."""
    return after.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType)) if "n_chars" in before.columns else after


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048. A null or empty text is one piece of one token."""
    packed = pack_documents(docs, PACKING_TOKENIZER, capacity=2048, extra=[F.crc32("ids").alias("ids_crc32")])
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_text", benchmark_text),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Hashes of shingles and token ids are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None
