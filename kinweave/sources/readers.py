"""Readers: text codecs of datasets, corpora, ratings, hierarchies, word-pair benchmarks, graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.operators.contexts import cleaned_tokens, tokens_of
from kinweave.runtime import exists
from kinweave.sources.schemas import RATING


def text_dataset(spark: SparkSession, path: str, schema: str, sep: str = " ") -> DataFrame | None:
    """Space-separated text in a fixed schema; None if the path doesn't exist."""
    return spark.read.schema(schema).option("sep", sep).csv(path) if exists(spark, path) else None


def parquet_dataset(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if exists(spark, path) else None


def scalar(spark: SparkSession, path: str) -> str | None:
    """The first line, or None if the path doesn't exist."""
    if not exists(spark, path):
        return None
    row = spark.read.text(path).first()
    return row.value if row else None


def whole_file(spark: SparkSession, path: str) -> str:
    """A whole small file as text."""
    return spark.read.option("wholetext", True).text(path).first().value


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, line): ids grow along a file but have gaps."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("line"))


def tokenised_lines(spark: SparkSession, path: str, clean: bool = False) -> DataFrame:
    """(context_id, tokens) of each line; `clean` lower-cases, drops other characters and lines with one token."""
    rows = lines(spark, path)
    if clean:
        return rows.select(F.col("line_id").alias("context_id"), cleaned_tokens(F.col("line")).alias("tokens")).where("size(tokens) > 1")
    return rows.select(F.col("line_id").alias("context_id"), tokens_of(F.col("line")).alias("tokens"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """`id label` a line, in place of an enumerated vocabulary."""
    return spark.read.schema("concept_id long, label string").option("sep", " ").csv(path)


def ngram_file(spark: SparkSession, path: str) -> DataFrame:
    """(tokens, n) from `count,tok,tok,...` lines."""
    parts = F.split("value", ",")
    return spark.read.text(path).select(F.slice(parts, F.lit(2), F.size(parts) - 1).alias("tokens"), F.try_to_number(F.trim(parts[0]), F.lit("999999999999999999")).cast("long").alias("n")).where("n is not null")


def bigram_file(spark: SparkSession, path: str, count_last: bool = False) -> DataFrame:
    """(a, b, n) from `count,w1,w2`, or `w1,w2,count`; malformed lines go."""
    schema = "a string, b string, n long" if count_last else "n long, a string, b string"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return rows.select("a", "b", "n").where("a is not null and b is not null and n is not null")


def _tuple_fields(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, "[()]", ""), ","), lambda x: F.trim(x))


def graph_vertices(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, weight) from `(id,label,weight)` lines."""
    f = _tuple_fields(F.col("value"))
    return spark.read.text(path).select(f[0].cast("long").alias("id"), f[1].alias("label"), f[2].cast("double").alias("weight"))


def graph_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight) from `((src,dst),weight)` lines."""
    f = _tuple_fields(F.col("value"))
    return spark.read.text(path).select(f[0].cast("long").alias("src"), f[1].cast("long").alias("dst"), f[2].cast("double").alias("weight"))


def tweets(spark: SparkSession, path: str) -> DataFrame:
    """(text): lines with `Text:` or `Origin:` in front, without it."""
    v = F.col("value")
    text = F.when(v.startswith("Text:"), F.substring(v, 7, 1 << 30)).when(v.startswith("Origin:"), F.substring(v, 9, 1 << 30))
    return spark.read.text(path).select(text.alias("text")).where("text is not null")


def yearly_ngrams(spark: SparkSession, path: str) -> DataFrame:
    """(tokens, n): n-grams of `ngram\\tyear\\tcount...` lines without part-of-speech marks, cleaned, summed over years."""
    rows = spark.read.schema("ngram string, year int, n long").option("sep", "\t").option("quote", "").csv(path).where(~F.contains("ngram", F.lit("_")))
    return rows.select(cleaned_tokens(F.col("ngram")).alias("tokens"), "n").where("size(tokens) > 1").groupBy("tokens").agg(F.sum("n").alias("n"))


def sentences(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(sentence): token arrays of the sentences of each text."""
    return texts.select(F.explode(F.sentences(F.col(text_col))).alias("sentence"))


#: How each word-pair benchmark is laid out: separator, header line, place of the score. Fixed values.
BENCHMARKS = {"WS-353": (",", True, 2), "WS-353-REL": ("\t", False, 2), "MTURK-771": (",", False, 2), "MTURK-287": (",", False, 2), "SIMLEX-999": ("\t", True, 3), "MEN": (" ", False, 2)}


def word_pairs(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(a, b, score) of a word-pair benchmark; none for an unknown name."""
    if name not in BENCHMARKS:
        return spark.createDataFrame([], "a string, b string, score double")
    sep, header, place = BENCHMARKS[name]
    columns = [f"_c{i} string" for i in range(place + 1)]
    rows = spark.read.schema(", ".join(columns)).option("sep", sep).option("header", header).option("enforceSchema", True).csv(path)
    return rows.select(F.trim("_c0").alias("a"), F.trim("_c1").alias("b"), F.trim(f"_c{place}").try_cast("double").alias("score")).where("score is not null")


def labelled_examples(spark: SparkSession, path: str) -> DataFrame:
    """(context_id, class_id, tokens) from `class\\ttok tok ...` lines; a token counts once."""
    parts = F.split("line", "\t")
    return lines(spark, path).select(F.col("line_id").alias("context_id"), parts[0].alias("class_id"), F.array_distinct(tokens_of(F.get(parts, 1))).alias("tokens"))


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """item, rating, day, time, user from tab-separated lines."""
    return spark.read.schema(RATING).option("sep", "\t").csv(path)


def rating_blocks(spark: SparkSession, path: str) -> DataFrame:
    """ratings() from blocks: `user|n`, then n lines without the user.

    The user of a line is that of the last header before it in its file. Headers are few, so each file's lines are cut into
    the ranges between them by a window over headers alone, and lines find their range by the file and their place.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"), "value")
    tagged = rows.withColumn("head", F.when(F.contains("value", F.lit("|")), F.split("value", r"\|")[0].cast("long")))
    before = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    f = F.split("value", "\t")
    lined = tagged.withColumn("user", F.last("head", ignorenulls=True).over(before)).where("head is null and user is not null and value <> ''")
    return lined.select(f[0].cast("long").alias("item"), f[1].cast("int").alias("rating"), f[2].cast("int").alias("day"), f[3].alias("time"), "user")


def hierarchy(spark: SparkSession, path: str, kind: str = "track") -> DataFrame:
    """`track|album|artist|genre|...` or `album|artist|genre|...`; None is null."""
    parts = F.transform(F.split("value", r"\|"), lambda x: F.when(x != "None", x).try_cast("long"))
    names = ["track_id", "album_id", "artist_id"] if kind == "track" else ["album_id", "artist_id"]
    cols = [F.get(parts, i).alias(n) for i, n in enumerate(names)]
    return spark.read.text(path).select(*cols, F.filter(F.slice(parts, len(names) + 1, 1 << 30), lambda x: x.isNotNull()).alias("genres"))


def graph_json(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight) by node name from `{nodes: [{name}], links: [{source, target, value}]}`; 0 < value < 1."""
    doc = spark.read.schema("nodes array<struct<name: string>>, links array<struct<source: int, target: int, value: double>>").option("multiLine", True).json(path)
    nodes = doc.select(F.posexplode("nodes").alias("at", "node")).select("at", "node.name")
    links = doc.select(F.explode("links").alias("l")).select("l.*").where("value > 0 and value < 1")
    name = lambda k, c: nodes.select(F.col("at").alias(k), F.col("name").alias(c))
    return links.join(name("source", "src"), "source").join(name("target", "dst"), "target").select("src", "dst", F.col("value").alias("weight"))


def graph_text(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight) from `weight source target` lines up to the first blank one; 0 < weight < 1."""
    rows = lines(spark, path)
    end = rows.where("trim(line) = ''").agg(F.min("line_id").alias("stop"))
    f = F.split("line", " ")
    kept = rows.crossJoin(F.broadcast(end)).where("stop is null or line_id < stop")  # end is one row
    return kept.select(f[1].alias("src"), f[2].alias("dst"), f[0].try_cast("double").alias("weight")).where("weight > 0 and weight < 1")


def product_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, parents) from blocks of `Id:`, `title:` and `|name[id]|name[id]` category lines.

    items: (id, title); parents: (child, parent), of each category and its outer one. One file is one ordered scan.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"), F.trim("value").alias("v"))
    before = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    tagged = rows.withColumn("id", F.last(F.when(F.col("v").startswith("Id:"), F.trim(F.substring("v", 4, 1 << 30))), ignorenulls=True).over(before))
    items = tagged.where(F.col("v").startswith("title:")).select("id", F.trim(F.substring("v", 7, 1 << 30)).alias("title"))
    chain = F.regexp_extract_all("v", F.lit(r"\[(\d+)\]"), F.lit(1))
    paths = tagged.where(F.col("v").startswith("|")).select(chain.alias("c"))
    steps = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("c") - 1, F.lit(1))), lambda i: F.struct(F.get("c", i).alias("child"), F.get("c", i - 1).alias("parent")))).alias("s"))
    return items, steps.select("s.*").where("child is not null").distinct()


def interaction_pairs(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(a, b): columns 0 and 3 of each line, both ways, without self pairs and repeats."""
    f = F.split("value", sep)
    rows = spark.read.text(path).select(F.get(f, 0).alias("a"), F.get(f, 3).alias("b")).where("a is not null and b is not null and a <> b")
    return rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def valid_token(token: Column) -> Column:
    """Alphabetic, and not a single character except i."""
    return token.rlike(r"^\p{L}+$") & ((F.length(token) > 1) | (token == "i"))


def clean_bigrams(bigrams: DataFrame, ordered: bool = False) -> DataFrame:
    """Bigrams of two valid tokens, lower-cased and summed; `ordered` by falling count."""
    rows = bigrams.select(F.lower("a").alias("a"), F.lower("b").alias("b"), "n").where(valid_token(F.col("a")) & valid_token(F.col("b")))
    out = rows.groupBy("a", "b").agg(F.sum("n").alias("n"))
    return out.orderBy(F.desc("n"), "a", "b") if ordered else out


def untagged_bigrams(bigrams: DataFrame) -> DataFrame:
    """Bigrams without part-of-speech marks and commas, lower-cased and summed."""
    ok = lambda c: ~(F.contains(c, F.lit("_")) | F.contains(c, F.lit(",")))
    return bigrams.where(ok("a") & ok("b")).select(F.lower("a").alias("a"), F.lower("b").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n"))
