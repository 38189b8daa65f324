"""Making contexts: from sequences, sliding windows, n-grams, baskets, ratings and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.ids import RECURRENT_START


def tokens_of(line: Column) -> Column:
    """Tokens between runs of spaces, without empty ones."""
    return F.filter(F.split(line, " +"), lambda t: t != "")


def cleaned_tokens(line: Column) -> Column:
    """Tokens of the lower-cased line with all but letters, digits and spaces replaced by spaces."""
    return tokens_of(F.lower(F.regexp_replace(line, "[^a-zA-Z0-9 ]", " ")))


def indexed(collections: DataFrame, id_col: str, array_col: str, offset: int = 0) -> DataFrame:
    """Contexts from one array a row."""
    return collections.select((F.col(id_col) + offset if offset else F.col(id_col)).alias("context_id"), F.explode(array_col).alias("concept_id"))


def collected(contexts: DataFrame) -> DataFrame:
    """(context_id, concepts): the reverse of indexed(), concepts sorted."""
    return contexts.groupBy("context_id").agg(F.array_sort(F.collect_list("concept_id")).alias("concepts"))


def vocabulary(labels: DataFrame, label_col: str = "label", min_count: int = 1) -> DataFrame:
    """(concept_id, label, n): labels that occur `min_count` times or more, numbered from 0 in their order.

    The numbers come from range partitions: each sorts its labels, and counts of the partitions before shift them, so no
    task sees them all.
    """
    counts = labels.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= min_count) & F.col("label").isNotNull())
    return ranked(counts, ["label"], "concept_id").select("concept_id", "label", "n")


def ranked(df: DataFrame, order: list, out: str, start: int = 0) -> DataFrame:
    """Number the rows of `df` by `order`, which must tell them apart, without a single-task sort."""
    from kinweave.runtime import spool

    part = spool(df.repartitionByRange(*[F.col(c) if isinstance(c, str) else c for c in order]).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = part.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return part.withColumn("__rank", inside).join(F.broadcast(before), "__part").withColumn(out, (F.col("__rank") - 1 + F.col("__before") + start).cast("long")).drop("__part", "__rank", "__before")


def running_sums(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """`df` plus the sum of `value` over the rows up to this one by `order`, which must tell rows apart, without a single-task
    sort: each range of rows sums its own, shifted by the sums of the ranges before."""
    from kinweave.runtime import spool

    part = spool(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "ranges")
    own = part.groupBy("__part").agg(F.sum(value).alias("__n"))
    before = own.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row a range
    inside = F.sum(value).over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return part.withColumn("__sum", inside).join(F.broadcast(before), "__part").withColumn(out, F.col("__sum") + F.col("__before")).drop("__part", "__sum", "__before")


def moving_window(contexts: DataFrame, width: int) -> DataFrame:
    """Each row is copied to contexts x to x + width - 1."""
    if width < 2:
        raise ValueError("windows of fewer than two contexts change nothing")
    return contexts.select(F.explode(F.sequence(F.col("context_id"), F.col("context_id") + (width - 1))).alias("context_id"), "concept_id")


def ngrams(tokens: Column, width: int) -> Column:
    """Windows of `width` tokens; a shorter array is one window, an empty one none."""
    many = F.transform(F.sequence(F.lit(1), F.size(tokens) - (width - 1)), lambda i: F.slice(tokens, i, width))
    return F.when(F.size(tokens) >= width, many).when(F.size(tokens) > 0, F.array(tokens)).otherwise(F.filter(F.array(tokens), lambda t: F.lit(False)))


def window_pairs(sequences: DataFrame, id_col: str, array_col: str, width: int) -> DataFrame:
    """(id, a, b): distinct ordered pairs of tokens closer than `width` positions, both ways."""
    spots = sequences.select(F.col(id_col).alias("id"), F.posexplode(array_col).alias("p", "t"))
    near = spots.select("id", F.col("t").alias("a"), F.explode(F.sequence(F.col("p") + 1, F.col("p") + (width - 1))).alias("p")).join(spots, ["id", "p"]).select("id", "a", F.col("t").alias("b"))
    return near.unionByName(near.select("id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def encode(tokens: DataFrame, vocab: DataFrame, token_col: str = "label") -> DataFrame:
    """Rows whose label is in the vocabulary, with concept_id for it. Spark broadcasts the vocabulary if it is small."""
    words = vocab.select("concept_id", F.col("label").alias(token_col))
    return tokens.join(words, token_col).drop(token_col)


def multiset(tokens: Column) -> Column:
    """Canonical array of (token, count) structs, sorted."""
    return F.array_sort(F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("token"), F.size(F.filter(tokens, lambda x: x == t)).alias("count"))))


def context_multisets(contexts: DataFrame) -> DataFrame:
    """context_counts from contexts: equal concept SETS become one context with their count; sets of one concept go."""
    sets = contexts.groupBy("context_id").agg(F.array_sort(F.collect_set("concept_id")).alias("s")).where("size(s) > 1")
    counted = sets.groupBy("s").agg(F.count(F.lit(1)).alias("context_count"))
    return ranked(counted, ["s"], "context_id").select(F.explode("s").alias("concept_id"), "context_id", "context_count")


def ngram_counts(lines: DataFrame, text_col: str, width: int) -> DataFrame:
    """(tokens, n): ordered n-grams of cleaned lines with two tokens or more."""
    if width < 2:
        raise ValueError("n-grams need two tokens or more")
    # tokens are a lambda's argument, so that a line is cleaned once and no filter on them is pushed below
    windows = F.transform(F.array(cleaned_tokens(F.col(text_col))), lambda t: F.when(F.size(t) > 1, ngrams(t, width)))[0]
    return lines.select(F.explode(windows).alias("tokens")).groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))


def ngrams_to_context_counts(counted: DataFrame, min_count: int = 1) -> dict[str, DataFrame]:
    """From (tokens, n): contexts are n-grams as multisets.

    Equal multisets are summed; those with `min_count` or more and at least two different (token, count) entries stay. A
    token that a multiset holds m > 1 times stands for the recurrent concept (token, m) there instead of itself. Returns
    context_counts, concepts (concept_id, label), recurrent (rec_id, concept_id, n) and count (one row, n).
    """
    from kinweave.runtime import spool

    sets = counted.select(multiset(F.col("tokens")).alias("m"), F.col("n").alias("c")).groupBy("m").agg(F.sum("c").cast("long").alias("context_count"))
    sets = sets.where((F.size("m") > 1) & (F.col("context_count") >= min_count))
    rows = spool(ranked(sets, ["m"], "context_id").select("context_id", "context_count", F.explode("m").alias("e")).select("context_id", "context_count", F.col("e.token").alias("label"), F.col("e.count").alias("n")), "ngrams")
    concepts = vocabulary(rows).select("concept_id", "label")
    single = encode(rows.where("n = 1"), concepts).select("concept_id", "context_id", "context_count")
    repeated = rows.where("n > 1")
    recurrent = encode(ranked(repeated.select("label", "n").distinct(), ["label", "n"], "rec_id", RECURRENT_START), concepts).select("rec_id", "concept_id", "n")
    again = encode(repeated, concepts).join(recurrent, ["concept_id", "n"]).select(F.col("rec_id").alias("concept_id"), "context_id", "context_count")
    total = rows.select("context_id", "context_count").distinct().agg(F.coalesce(F.sum("context_count"), F.lit(0)).alias("n"))
    return {"context_counts": single.unionByName(again), "concepts": concepts, "recurrent": recurrent, "count": total}


def same_rating_pairs(ratings: DataFrame, keys: tuple[str, ...] = ("user", "rating", "day"), item: str = "item") -> DataFrame:
    """(a, b, n): ordered pairs of different items that share all of `keys`, and how often."""
    left, right = ratings.select(*keys, F.col(item).alias("a")), ratings.select(*keys, F.col(item).alias("b"))
    return left.join(right, list(keys)).where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def near_rating_pairs(ratings: DataFrame, days: tuple[int, int] = (0, 0), stars: tuple[int, int] = (0, 0), item: str = "item") -> DataFrame:
    """(a, b, n): ordered pairs of different items of one user where b's day is within [day - days[0], day + days[1]] and its
    rating within [rating - stars[0], rating + stars[1]].

    The day range becomes an equi-join: days are cut into bins as wide as the range, and a row looks into the bins that its
    range meets. So a user with very many ratings is dealt out by bins and not compared as a whole.
    """
    width = max(1, days[0] + days[1] + 1)
    left = ratings.select("user", F.col(item).alias("a"), F.col("day").alias("d"), F.col("rating").alias("r"))
    left = left.withColumn("bin", F.explode(F.sequence(F.floor((F.col("d") - days[0]) / width), F.floor((F.col("d") + days[1]) / width))))
    right = ratings.select("user", F.col(item).alias("b"), "day", "rating", F.floor(F.col("day") / width).alias("bin"))
    inside = F.col("day").between(F.col("d") - days[0], F.col("d") + days[1]) & F.col("rating").between(F.col("r") - stars[0], F.col("r") + stars[1])
    return left.join(right, ["user", "bin"]).where(inside & (F.col("a") != F.col("b"))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def sequence_bigrams(events: DataFrame, user: str, order: list[str], item: str, min_count: int = 3) -> DataFrame:
    """(a, b, n): items that directly follow each other for a user and differ, at least `min_count` times."""
    follow = F.lag(item).over(Window.partitionBy(user).orderBy(*order))
    pairs = events.select(follow.alias("a"), F.col(item).alias("b")).where("a <> b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def popularity_buckets(items: DataFrame, item: str = "item") -> DataFrame:
    """One row: items with n in [500, 600), [600, 700), 700 or more, 200 or more ratings."""
    n = items.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    c = F.col("n")
    return n.agg(F.count_if((c >= 500) & (c < 600)).alias("from_500"), F.count_if((c >= 600) & (c < 700)).alias("from_600"), F.count_if(c >= 700).alias("from_700"), F.count_if(c >= 200).alias("from_200"))


def popular_items(items: DataFrame, item: str = "item", min_count: int = 200) -> DataFrame:
    return items.groupBy(item).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def systematic_sample(items: DataFrame, item: str = "item", step: int = 5) -> DataFrame:
    """(item, n): every `step`-th item in the order of (count, item), the first included."""
    counts = items.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    return ranked(counts, ["n", item], "__r").where(F.col("__r") % step == 0).drop("__r")


def dense_subset(ratings: DataFrame, min_item: int, min_user: int, also: DataFrame | None = None) -> DataFrame:
    """Ratings of items with `min_item` ratings or more by users with `min_user` or more of all ratings, users in `also` too."""
    items = ratings.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_item).select("item")
    users = ratings.groupBy("user").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_user).select("user")
    if also is not None:
        users = users.intersect(also.select("user"))
    return ratings.join(items, "item", "left_semi").join(users, "user", "left_semi").select(ratings.columns)


def sampled_subset(ratings: DataFrame, min_user: int = 10, step: int = 5) -> DataFrame:
    """Ratings of a systematic sample of items by users with `min_user` or more of them."""
    some = ratings.join(systematic_sample(ratings, "item", step).select("item"), "item", "left_semi")
    users = some.groupBy("user").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_user).select("user")
    return some.join(users, "user", "left_semi").select(ratings.columns)


def lift_items(ratings: DataFrame, tracks: DataFrame, albums: DataFrame, kinds: DataFrame) -> DataFrame:
    """`ratings` with tracks and albums replaced by their artists.

    tracks: (track_id, artist_id); albums: (album_id, artist_id); kinds: (item, kind) with track, album, artist or genre.
    Genres and artists stay, an unknown artist leaves the item as it is, items of no known kind go.
    """
    t = tracks.select(F.col("track_id").alias("item"), F.col("artist_id").alias("by_track"))
    a = albums.select(F.col("album_id").alias("item"), F.col("artist_id").alias("by_album"))
    rows = ratings.join(kinds, "item").join(t, "item", "left").join(a, "item", "left")
    artist = F.when(F.col("kind") == "track", F.col("by_track")).when(F.col("kind") == "album", F.col("by_album"))
    return rows.where(F.col("kind").isin("track", "album", "artist", "genre")).withColumn("item", F.coalesce(artist, "item")).select(ratings.columns)


def note_groups(notes: DataFrame, gap: int = 50, track: str = "track", onset: str = "onset") -> DataFrame:
    """`notes` plus group: consecutive notes of a track whose onsets are within `gap` ticks of the one before."""
    w = Window.partitionBy(track).orderBy(onset)
    new = F.coalesce((F.col(onset) - F.lag(onset).over(w) > gap).cast("int"), F.lit(0))
    return notes.withColumn("__new", new).withColumn("group", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def of_type(items: DataFrame, kinds: DataFrame, kind: str) -> DataFrame:
    """The rows of `items` (with item) whose kind (item, kind) is the one given."""
    return items.join(kinds.where(F.col("kind") == kind).select("item"), "item", "left_semi")


def artist_of(tracks: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """`tracks` (with track_id) plus artist_id from the hierarchy, null where it is unknown."""
    return tracks.join(hierarchy.select("track_id", "artist_id"), "track_id", "left")
