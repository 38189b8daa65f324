"""Classification and rating prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def concept_naive_bayes(train: DataFrame, classes: DataFrame, test: DataFrame, n: int, laplace: float = 0.0) -> DataFrame:
    """(context_id, class_id, score): the class with the largest score for each test context; ties by least class.

    train, test: contexts; classes: (context_id, class_id); n: number of training contexts. p is the share of a concept's
    training contexts that are of the class. A class's baseline is ln(prior) plus ln(1 - p) over all concepts (-100 where p
    is 1), and each concept that a context holds adds ln p - ln(1 - p) (100 where p is 1, -100 where it is 0).
    """
    pairs = train.select("context_id", "concept_id").distinct()
    total = pairs.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"))
    joint = pairs.join(classes, "context_id").groupBy("class_id", "concept_id").agg(F.count(F.lit(1)).alias("k"))
    p = joint.join(total, "concept_id").select("class_id", "concept_id", ((F.col("k") + laplace) / (F.col("n") + 2 * laplace)).alias("p"))
    prior = classes.groupBy("class_id").agg((F.count(F.lit(1)) / F.lit(float(n))).alias("prior"))
    miss = F.when(F.col("p") >= 1, -100.0).otherwise(F.ln(1 - F.when(F.col("p") < 1, F.col("p"))))
    base = prior.join(p.groupBy("class_id").agg(F.sum(miss).alias("misses")), "class_id", "left").select("class_id", (F.ln("prior") + F.coalesce("misses", F.lit(0.0))).alias("base"))
    gain = F.when(F.col("p") >= 1, 100.0).otherwise(F.ln("p") - F.ln(1 - F.when(F.col("p") < 1, F.col("p"))))
    seen = test.select("context_id", "concept_id").distinct().join(total.select("concept_id"), "concept_id", "left_semi")
    hits = seen.join(p.withColumn("gain", gain), "concept_id").groupBy("context_id", "class_id").agg(F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("hits"))
    held = seen.groupBy("context_id").agg(F.count(F.lit(1)).alias("held"))
    # every class scores every context: the classes are few, one row each
    grid = test.select("context_id").distinct().crossJoin(F.broadcast(base)).join(held, "context_id", "left").join(hits, ["context_id", "class_id"], "left")
    none = F.coalesce("held", F.lit(0)) - F.coalesce("hits", F.lit(0))
    scored = grid.select("context_id", "class_id", (F.col("base") + F.coalesce("gain", F.lit(0.0)) - 100.0 * none).alias("score"))
    best = Window.partitionBy("context_id").orderBy(F.desc("score"), "class_id")
    return scored.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def activation_vectors(contexts: DataFrame, classes: DataFrame, vocab: DataFrame, size: int) -> DataFrame:
    """(context_id, label, features): sparse vectors of ones at the concepts' places in `vocab` (concept_id, place)."""
    from pyspark.ml.functions import array_to_vector  # noqa: F401  (registers the type)
    from pyspark.ml.linalg import SparseVector, VectorUDT

    sparse = F.udf(lambda at: SparseVector(size, sorted(at), [1.0] * len(at)), VectorUDT())
    rows = contexts.join(vocab, "concept_id").groupBy("context_id").agg(F.collect_set("place").alias("at"))
    return rows.join(classes, "context_id").select("context_id", F.col("class_id").cast("double").alias("label"), sparse("at").alias("features"))


def library_naive_bayes(vectors: DataFrame, kind: str = "multinomial", smoothing: float = 1.0, train_share: float = 0.6, seed: int = 11) -> tuple[object, DataFrame]:
    """(model, metrics): Spark's naive Bayes on a random split, and (metric, value) on the held-out rows."""
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator as Evaluator

    train, test = vectors.randomSplit([train_share, 1 - train_share], seed)
    model = NaiveBayes(modelType=kind, smoothing=smoothing).fit(train)
    out = model.transform(test).cache()
    rows = [(m, float(Evaluator(metricName=m).evaluate(out))) for m in ("accuracy", "f1", "weightedPrecision", "weightedRecall", "weightedTruePositiveRate", "weightedFalsePositiveRate")]
    labels = [r.label for r in vectors.select("label").distinct().orderBy("label").collect()]
    rows += [(f"{m}:{x:g}", float(Evaluator(metricName=m, metricLabel=x).evaluate(out))) for m in ("precisionByLabel", "recallByLabel", "fMeasureByLabel") for x in labels]
    return model, vectors.sparkSession.createDataFrame(rows, "metric string, value double")


def targets_with_history(validation: DataFrame, history: DataFrame) -> DataFrame:
    """(user, target, rating, item, item_rating): each validation rating with each of the user's history ratings, or nulls."""
    past = history.select("user", F.col("item").alias("item"), F.col("rating").alias("item_rating"))
    return validation.select("user", F.col("item").alias("target"), "rating").join(past, "user", "left")


def knn_predict(validation: DataFrame, history: DataFrame, paths: DataFrame, k: int = 5) -> DataFrame:
    """(user, target, rating, predicted, hit): a prediction for every validation rating.

    With history items that `paths` (source, target, similarity) reaches from the target: the mean of their ratings weighted
    by similarity over the k largest, ties by least item. Otherwise a miss: the mean of the user's whole history, 0 without
    one. Means come from sums by user; only history items on a path are joined row by row.
    """
    near = paths.select(F.col("source").alias("target"), F.col("target").alias("item"), "similarity").where("similarity > 0")
    aims = validation.select("user", F.col("item").alias("target"), "rating")
    past = history.select("user", "item", F.col("rating").alias("item_rating"))
    met = aims.select("user", "target").distinct().join(near, "target").join(past, ["user", "item"])
    first = Window.partitionBy("user", "target").orderBy(F.desc("similarity"), "item")
    best = met.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    guess = best.groupBy("user", "target").agg((F.sum(F.col("similarity") * F.col("item_rating")) / F.sum("similarity")).alias("near"))
    mean = past.groupBy("user").agg(F.avg("item_rating").alias("mean"))
    out = aims.join(guess, ["user", "target"], "left").join(mean, "user", "left")
    return out.select("user", "target", "rating", F.coalesce("near", "mean", F.lit(0.0)).alias("predicted"), F.col("near").isNotNull().alias("hit"))


def graph_hits(items: DataFrame, vertices: DataFrame, item: str = "item") -> DataFrame:
    """`items` plus in_graph."""
    known = vertices.select(F.col(vertices.columns[0]).alias(item)).distinct().withColumn("in_graph", F.lit(True))
    return items.join(known, item, "left").withColumn("in_graph", F.coalesce("in_graph", F.lit(False)))
