"""Cases in which an operator once did less than the whole job."""

import random
import re

import pytest
from kinweave.llm.arrow import BATCH_BYTES, map_batches
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def plain_shingles(text, size=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_similar_groups(texts, similarity=0.8):
    """Least id of each document's group, over all pairs that share a shingle."""
    sets = {d: plain_shingles(t) for d, t in texts}
    parent, having = {d: d for d in sets}, {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    empty = [d for d, s in sets.items() if not s]
    for d in empty:
        parent[root(d)] = root(empty[0])
    for d, s in sets.items():
        both = {}
        for x in s:
            for e in having.setdefault(x, []):
                both[e] = both.get(e, 0) + 1
            having[x].append(d)
        for e, n in both.items():
            if n >= similarity * (len(s) + len(sets[e]) - n):
                parent[root(d)] = root(e)
    least = {}
    for d in sets:
        least[root(d)] = min(d, least.get(root(d), d))
    return {d: least[root(d)] for d in sets}


def test_near_copies_beyond_four_bits_go(spark):
    import corpus_pipeline
    from kinweave.llm.simhash import fingerprint

    rng = random.Random(5)
    rows, copies = [], 0
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        rows.append((2 * i, " ".join(words)))
        for at in (30, 80):  # two words changed: 106 of 126 shingles shared
            words[at] = "changed"
        rows.append((2 * i + 1, " ".join(words)))
        copies += (fingerprint(rows[-2][1].encode()) ^ fingerprint(rows[-1][1].encode())).bit_count() > 4
    assert copies > 20  # these were left by SimHash
    rows += [(1000, None), (1001, " "), (1002, "a b"), (1003, "A B"), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted([*(str(2 * i) for i in range(60)), "1000", "1002", "None"])


def test_near_duplicates_on_a_table_are_those_of_all_pairs(spark):
    from kinweave.llm.shingles import shingle_groups

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: r.component_id for r in shingle_groups(docs).collect()} == plain_similar_groups(texts)


@pytest.mark.parametrize("block_words", [200_000, 15])
def test_benchmark_hits_belong_to_rows_and_not_to_ids(spark, block_words):
    from kinweave.llm.decontaminate import clean_texts, contamination, drop_contaminated

    first, second = " ".join(f"a{i}" for i in range(13)), " ".join(f"b{i}" for i in range(13))
    items = spark.createDataFrame([(1, first), (2, second)], "item_id long, text string")
    rows = [(None, first), (None, second + " x"), (None, "clean"), (7, first + " " + second), (7, "other"), (7, first), (8, "w " * 400 + second), (8, "w " * 400), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, ",".join(r["items"])) for r in contamination(docs, items, block_words=block_words).collect())
    want = [("None", 13, 13, "1"), ("None", 14, 13, "2"), ("None", 1, 0, ""), ("7", 26, 26, "1,2"), ("7", 1, 0, ""), ("7", 13, 13, "1"), ("8", 413, 13, "2"), ("8", 400, 0, ""), ("9", 0, 0, "")]
    assert got == sorted(want)
    kept = drop_contaminated(docs, items, block_words=block_words).collect()
    left = [(None, "clean"), (7, "other"), (8, "w " * 400 + second), (8, "w " * 400), (9, None)]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, left))
    cut = clean_texts(docs, items, block_words=block_words).collect()
    left[2] = (8, "w " * 400)
    assert sorted(map(str, map(tuple, cut))) == sorted(map(str, left))


def test_url_scores_come_from_exact_counts_of_bytes(spark):
    from collections import Counter
    from math import log

    from kinweave.llm.url_filter import filter_urls

    rng = random.Random(3)
    urls = ["http://" + "".join(rng.choice("abcdefghij0123456789é中") for _ in range(30)) for _ in range(400)] + ["http://x/é", "http://x/中", "http://x/1", "http://x/2", "", None]
    labels = [i % 2 == 0 for i in range(len(urls))]
    df = spark.createDataFrame([(i, u, x) for i, (u, x) in enumerate(zip(urls, labels))], "page_id long, url string, ok boolean")
    from pyspark.sql import functions as F

    held = {r.page_id for r in df.where(F.pmod(F.xxhash64(F.col("url").cast("binary")), F.lit(5)) == 0).collect()}
    got = {r.page_id: r.score for r in filter_urls(df, [], accepted=F.col("ok")).collect()}
    counts = {True: Counter(), False: Counter()}
    ends = lambda u: [(b"\xff" * 4 + u)[i : i + 5] for i in range(len(u))]
    for i, u in enumerate(urls):
        if u and i not in held:
            counts[labels[i]].update(g[4 - k :] for g in ends(u.encode()) for k in range(5))
    mass, kinds = {}, {}
    for x in counts:
        mass[x], kinds[x] = Counter(), Counter()
        for g, n in counts[x].items():
            mass[x][g[:-1], len(g)] += n
            kinds[x][g[:-1], len(g)] += 1

    def plain(u):
        total = 0.0
        for g in ends(u):
            for x, sign in ((True, 1), (False, -1)):
                p = 1 / 256
                for k in range(5):
                    e = g[4 - k :]
                    m, d = mass[x][e[:-1], len(e)], kinds[x][e[:-1], len(e)]
                    p = (counts[x][e] + d * p) / (m + d) if m else p
                total += sign * log(p)
        return total / len(u) if u else 0.0

    for i, u in enumerate(urls):
        assert abs(got[i] - plain((u or "").encode())) < 1e-8, u


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    from kinweave.llm.shingles import keep_one_similar
    from kinweave.llm.simhash import keep_one

    rows = [(3, "a b c d e", 1), (5, "a b c d e", 2), (5, "q r s t u v", 3), (5, "q r s t u v", 4), (None, "a b c d e", 5), (None, "a b c d e", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)
    want = [(3, "a b c d e"), (5, "q r s t u v"), (None, "a b c d e"), (None, "a b c d e")]
    for keep in (keep_one, keep_one_similar):
        got = keep(docs)
        assert got.columns == docs.columns
        assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))


def test_chains_and_groups_of_near_copies_lose_no_link(spark):
    from kinweave.llm.shingles import shingle_groups

    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for _ in range(6):  # copies of a text, and copies of these, some links beyond any hub
        base = [word() for _ in range(90)]
        for _ in range(8):
            mine = list(base)
            for _ in range(6):
                texts.append(" ".join(mine))
                mine[rng.randrange(90)] = word()
    for _ in range(5):  # windows over one text, each like the next alone
        long = [word() for _ in range(600)]
        texts += [" ".join(long[i : i + 100]) for i in range(0, 500, 10)]
    rng.shuffle(texts)
    docs = list(enumerate([*texts, None, "", "x"]))
    got = {r.doc_id: r.component_id for r in shingle_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == plain_similar_groups(docs)


def test_batches_of_long_texts_are_small(spark):
    texts = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    sizes = [r.n for r in map_batches(texts, lambda: lambda cols: {"n": [sum(map(len, cols["t"]))]}, "n long").collect()]
    assert sum(sizes) == 40 << 20 and max(sizes) <= BATCH_BYTES + (1 << 20)


@pytest.mark.parametrize("n", [1000, 200_000, 12_000_000])
def test_near_copies_share_a_block_of_their_simhash(n):
    import numpy as np
    from kinweave.llm.shingles import block_bits, long_fingerprint, plan, shingle_set
    from kinweave.llm.simhash import fingerprint

    rng = random.Random(11)
    chosen, found, most = block_bits(*plan(n, 0.8)), 0, 0
    assert all(len(set(x)) == len(x) for x in chosen.tolist())
    for _ in range(200):
        words = [f"w{rng.randrange(10**6)}" for _ in range(184)]
        texts = []
        for _ in range(2):  # the first has its words, the second four others: 160 of 200 shingles shared
            texts.append(" ".join(words).encode())
            for at in (20, 60, 100, 140):
                words[at] = f"v{rng.randrange(10**6)}"
        a, b = (shingle_set(t) for t in texts)
        assert len(np.intersect1d(a, b)) == 0.8 * len(np.union1d(a, b))
        x, y = (long_fingerprint(s) for s in (a, b))
        assert int.from_bytes(x[:8], "big") == fingerprint(texts[0], 5)  # that of op10, on words of five
        x, y = (np.unpackbits(np.frombuffer(z, np.uint8)) for z in (x, y))
        found += (x[chosen] == y[chosen]).all(axis=1).any()
        most = max(most, np.count_nonzero(x[:128] != y[:128]))
    assert found >= 198 and most <= 36


def test_near_duplicates_send_no_text_through_a_shuffle(spark, monkeypatch):
    from kinweave.llm import arrow, shingles, simhash

    plans, name = [], "spark.sql.autoBroadcastJoinThreshold"
    seen = lambda df: plans.append(df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted"))
    for module in (m for m in (arrow, shingles, simhash) if hasattr(m, "spool")):
        monkeypatch.setattr(module, "spool", lambda df, name="step", write=module.spool: seen(df) or write(df, name))
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")  # as with tables too large for Spark to broadcast
    try:
        words = [" ".join(f"w{i}_{j}" for j in range(60)) for i in range(40)]
        docs = list(enumerate([*words, *(f"{w} more" for w in words[:20]), *words[:5]]))
        kept = shingles.keep_one_similar(spark.createDataFrame(docs, "doc_id long, text string"))
        seen(kept)
        assert sorted(r.doc_id for r in kept.collect()) == list(range(40))
    finally:
        spark.conf.set(name, before)
    sent = [got for plan in plans for got in re.findall(r"\) Exchange\nInput [^\n]*", plan)]
    assert sent and not [x for x in sent if re.search(r"[\[ ](row|text)#", x)]


@pytest.mark.parametrize("most", [1 << 20, 2])
@pytest.mark.parametrize("inside", [True, False])
def test_rows_are_found_by_their_numbers(spark, monkeypatch, most, inside):
    from kinweave.llm import arrow
    from kinweave.runtime import spool

    monkeypatch.setattr(arrow, "MARKS", most)  # marks that are sent at a time
    table = spool(spark.range(0, 700, 1, 3).select(F.monotonically_increasing_id().alias("n"), F.col("id").alias("x")))
    ends = {0, 63, 64, 127, 128, 699}
    for chosen in (set(range(0, 700, 7)) | ends, ends, set(), set(range(700))):
        numbers = table.where(F.col("x").isin(list(chosen))).select("n") if chosen else table.select("n").limit(0)
        got = arrow.numbered(table, numbers.unionByName(numbers), inside)
        assert got.columns == ["n", "x"]
        assert sorted(r.x for r in got.collect()) == sorted(x for x in range(700) if (x in chosen) == inside)
