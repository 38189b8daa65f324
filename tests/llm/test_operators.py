"""Each operator against a plain brute-force version, on the driver's small tables and on awkward rows."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from kinweave.llm import chat, rollup, sharding
from kinweave.llm.decontaminate import SuffixAutomaton, clean_texts, contamination, cut_spans, words_of
from kinweave.llm.importance import _cut, resample
from kinweave.llm.packing import plan_packing
from kinweave.llm.quality import quality
from kinweave.llm.queries import CHAT_TOKENIZER, HOSTILE, PACKING_TOKENIZER, QUERIES
from kinweave.llm.simhash import block_masks, fingerprint, keep_one, links, plan_blocks, simhash_groups
from kinweave.llm.url_filter import Rule, filter_urls
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
AWKWARD = [None, "", " ", "a", "\n\n", "a b c d", "A B C D", "a b c d", "x " * 30000, "é" * 40000, "ab\x00c \x0b d\x1ce\x85f\xa0g", "𝔘𝔫𝔦 ß ﬁ İ ſ K", "word's can't 12.5% <|endoftext|> </w>"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows] + [(10_000 + i, t) for i, t in enumerate(AWKWARD)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "clash", i) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, fp long").repartition(5).cache()


# SimHash


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=4):
    parent = {f: f for f in set(prints.values())}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keys = list(parent)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    least = {}
    for d, f in prints.items():
        least[root(f)] = min(d, least.get(root(f), d))
    return {d: least[root(f)] for d, f in prints.items()}


def test_simhash_groups(spark, docs, texts):
    prints = {d: plain_fingerprint(t) for d, t in texts}
    assert all(fingerprint(t.encode() if t else None) == prints[d] for d, t in texts)
    want = plain_components(prints)
    got = {r.doc_id: r for r in simhash_groups(docs).collect()}
    assert {d: int(r.fingerprint, 16) for d, r in got.items()} == prints
    assert {d: r.component_id for d, r in got.items()} == want
    kept = keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))
    assert simhash_groups(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("blocks", "limit"), [(5, 32768), (6, 32768), (7, 4), (6, 2)])
def test_links_of_dense_and_far_fingerprints(spark, blocks, limit):
    rng = np.random.default_rng(7)
    centre = int(rng.integers(1 << 62))
    near = {centre ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in (0, 1, 2, 3, 4, 5, 8, 9) for _ in range(12)}
    fps = near | {int(x) for x in rng.integers(1 << 62, size=200)} | {0}
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    df = spark.createDataFrame([*rows, *rows[:50], (None,)], "fp long")
    edges = [(r.src % (1 << 64), r.dst % (1 << 64)) for r in links(df, 4, blocks, limit).collect()]
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    got = defaultdict(set)
    for f in fps:
        got[root(f)].add(f)
    want = defaultdict(set)
    for f, c in plain_components({f: f for f in fps}).items():
        want[c].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert len(edges) < 40 * len(fps)


def test_blocks_cover_every_close_pair():
    for blocks in (5, 6, 7, 8):
        masks = [m % (1 << 64) for m in block_masks(blocks)]
        rng = np.random.default_rng(1)
        for _ in range(300):
            x = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(x & m == 0 for m in masks)
    assert plan_blocks(1000) == 5 < plan_blocks(10**6) <= plan_blocks(10**10)


def test_repeated_ids_keep_one_row_and_null_ids_stay(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (1, "q r s t u v"), (None, "a b c d e"), (2, "a b c d e"), (3, "z z y y x")]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "None"]


# Decontamination


def plain_hits(text, items, window=13):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, names = norm(text), set(), set()
    for name, item in items:
        iw = norm(item)
        size = min(window, len(iw))
        wins = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if iw else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                if name is not None:
                    names.add(str(name))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("block_words", [200_000, 60])
def test_contamination(spark, docs, texts, block_words):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, None), (901, ""), (902, "a b c d"), (903, "B c"), (904, "x"), (904, "x x x x x x x x x x x x x x"), (None, "ß"), (905, items[0][1])]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in contamination(docs, df, block_words=block_words).collect()}
    assert got == {d: plain_hits(t, items) for d, t in texts}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab c", max_size=24), max_size=4), st.text("ab cd", max_size=60), st.integers(1, 4))
def test_automaton_on_random_words(items, text, window):
    named = [(str(i), words_of(t.encode())) for i, t in enumerate(items)]
    spans, names = SuffixAutomaton(named, window).scan(words_of(text.encode()))
    n, hit, want = plain_hits(text, [(str(i), t) for i, t in enumerate(items)], window)
    assert (sum(b - a for a, b in spans), sorted(names)) == (hit, want)
    assert all(a[1] < b[0] or a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_cutting_spans(spark):
    assert cut_spans("One, two THREE four.", [(1, 3)]) == "One,  four."
    assert cut_spans(None, []) is None
    item = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi"
    docs = spark.createDataFrame([(1, item), (2, "w " * 400 + item + " end"), (3, "clean text"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in clean_texts(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {2: "w " * 400 + " end", 3: "clean text", 4: None}


# Packing


def test_packing_query_matches_the_tokenizer(spark):
    tok = Tokenizer.from_file(PACKING_TOKENIZER)
    rows = QUERIES["op3_best_fit_packing"](spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    want = {}
    for d, t in docs.items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[d, k] = (at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    check_sequences(rows)
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 2048) + 1


def check_sequences(rows, capacity=2048):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity


def test_awkward_texts_are_encoded_as_by_the_tokenizer():
    from kinweave.llm.tokens import WordEncoder

    tok, own = Tokenizer.from_file(PACKING_TOKENIZER), WordEncoder(PACKING_TOKENIZER)
    for t in [*AWKWARD, "a <|endoftext|> b", "x<|startoftext|>y <|ENDOFTEXT|>", "<|endoftext|><|endoftext|>.", "<|endof text|>", "Ünï don't DON'T'll 3.14 e\u0301 \u2003x ½ ² µ ª º × ÷ \xad a\xadb", "ΑΣ ΑΣ. Dž ŉ ẞ", "\ufeffa \u200bb"]:
        assert list(struct.unpack(f"<{len(own.encode((t or '').encode())) // 4}I", own.encode((t or "").encode()))) == tok.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), max_size=25))
def test_plans_use_each_piece_once_and_fill_well(histogram):
    plan = plan_packing(histogram, 40)
    used = Counter()
    for p in plan:
        assert sum(p.lengths) <= 40 and p.times > 0
        for x in p.lengths:
            used[x] += p.times
    assert used == Counter(histogram)
    bins = first_fit(histogram, 40)
    assert sum(p.times for p in plan) <= bins * 1.07 + 1


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), max_size=25))
def test_plans_never_have_more_sequences_than_best_fit(histogram):
    assert sum(p.times for p in plan_packing(histogram, 40)) <= first_fit(histogram, 40)


def test_small_pieces_are_left_for_the_gaps_of_long_ones():
    number = lambda h, capacity: sum(p.times for p in plan_packing(h, capacity))
    assert number({1: 1, 10: 8, 21: 8}, 40) == 8 and number({10: 800, 21: 800, 1: 1}, 40) == 800
    assert number({512: 4000, 1100: 4000}, 2048) == 4000


def first_fit(histogram, capacity):
    room = []
    for x in sorted(Counter(histogram).elements(), reverse=True):
        best = min((i for i, g in enumerate(room) if g >= x), key=lambda i: room[i], default=None)
        if best is None:
            room.append(capacity - x)
        else:
            room[best] -= x
    return len(room)


# Quality


def test_quality_measures(spark, docs, texts):
    got = {r.doc_id: r for r in quality(docs).collect()}
    for d, t in texts:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[d]
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)), t
        assert r.q_base_failed == (len(words) < 20 or 100 * len(hit) > 30 * len(words))
        assert not (r.q_base_failed and r.q_kept)
        assert (r.id, r.fp) == ("clash", d)
    assert dict(quality(docs.withColumn("Q_KEPT", F.lit("x"))).dtypes)["q_kept"] == "boolean"


def test_good_documents_are_kept_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not q_base_failed").groupBy("quality").agg(F.avg(F.col("q_kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.99 and kept[0] < 0.5


# URLs


def test_url_rules_and_models(spark):
    urls = [
        "http://A.com/x", "HTTP://www.Example.COM/en/1?q=/z", "https://m.example.com/en/1", "https://www.example.com/en/2#t", "https://x.net/es/", "https://x.net/es", "https://net/fr/1",
        "https://xcom/", "foo.com/x", None, "", "://", "a://b?c/d", "x://y.com", "https://u@H.org:80/p?x#y", "http://example.com/en/\n/z?q",
    ]
    good = [f"https://news{i}.site.org/en/story-{i}" for i in range(200)]
    bad = [f"https://casino-win{i}.site.org/en/{i}" for i in range(60)]
    rules = [Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]
    df = spark.createDataFrame(list(enumerate(urls + good + bad)), "page_id long, url string")
    got = {r.page_id: r for r in filter_urls(df, rules).collect()}
    assert len(got) == len(urls + good + bad)

    def plain(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        return host, path, best

    for i, u in enumerate(urls):
        host, path, best = plain(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best.text), u
        if best:
            assert got[i].verdict == best.verdict
    n = len(urls)
    assert sum(got[n + i].verdict == "allow" for i in range(200)) >= 198
    assert sum(got[n + 200 + i].verdict == "block" for i in range(60)) >= 57
    alone = filter_urls(df.where("page_id < 3"), rules).collect()
    assert all(r.score is None for r in alone) and filter_urls(df.limit(0), rules).count() == 0


# Importance resampling


def test_resampling_takes_exactly_k_and_prefers_the_target(spark, docs):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    out = resample(d, good, 0.7).cache()
    assert out.count() == 1000 and out.where("selected").count() == 700
    assert [r.doc_id for r in out.where("selected").orderBy("doc_id").collect()] == [r.doc_id for r in resample(d, good, 0.7).where("selected").orderBy("doc_id").collect()]
    keys = sorted((r.key for r in out.collect()), reverse=True)
    assert {r.key for r in out.where("selected").collect()} == set(keys[:700])
    mean = {r.quality: r.m for r in out.join(labels, "doc_id").groupBy("quality").agg(F.avg("log_weight").alias("m")).collect()}
    assert mean[1] > mean[0]
    assert resample(docs, {1}, 0.5).where("selected").count() == -(-docs.count() // 2)
    assert resample(docs.limit(0), set()).count() == 0


def test_weights_are_log_ratios_of_hashed_counts(spark):
    from math import log

    from kinweave.llm.importance import BUCKETS, features, log_ratios, log_weights

    texts = ["a b c a", "A b", None, "", "x y z " * 40, "b c"]
    df = spark.createDataFrame([(i, t.encode() if t is not None else None) for i, t in enumerate(texts)], "id long, text binary").repartition(3)
    got = {r.id: r.log_weight for r in log_weights(df, log_ratios(df, {0, 5})).collect()}
    cells = [features(t.encode() if t else None).tolist() for t in texts]
    raw, target = Counter(x for c in cells for x in c), Counter(x for i in (0, 5) for x in cells[i])
    n, m = sum(raw.values()) + BUCKETS, sum(target.values()) + BUCKETS
    for i, c in enumerate(cells):
        assert abs(got[i] - sum(log((target[x] + 1) / m) - log((raw[x] + 1) / n) for x in c)) < 1e-9
    assert [len(c) for c in cells] == [7, 3, 0, 0, 239, 3]


def test_buckets_grow_with_the_input(spark):
    from math import log

    from kinweave.llm.importance import bits_for, features, log_ratios, log_weights

    assert [bits_for(n) for n in (0, 10**6, 512 * 10**6, 30 * 10**9, 100 * 10**12)] == [14, 14, 16, 19, 25]
    texts = [" ".join(f"w{i * j % 9973}" for j in range(40_000)) for i in range(400, 420)]
    df = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "id long, text binary").repartition(3)
    ratios = log_ratios(df, {1, 3}, bits=17)
    assert len(ratios) == 1 << 17 and len(log_ratios(df, {1, 3})) == 1 << bits_for(sum(map(len, texts)))
    cells = [features(t.encode(), 17).tolist() for t in texts]
    assert max(map(max, cells)) >= 1 << 16
    raw, target = Counter(x for c in cells for x in c), Counter(x for i in (1, 3) for x in cells[i])
    n, m = sum(raw.values()) + (1 << 17), sum(target.values()) + (1 << 17)
    for r in log_weights(df, ratios).collect():
        want = sum(log((target[x] + 1) / m) - log((raw[x] + 1) / n) for x in cells[r.id])
        assert abs(r.log_weight - want) < 1e-9 * len(cells[r.id])


def test_cut_with_ties(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 2, 2, 2, 3, 9]], "key double")
    assert [_cut(df, k, bins=4) for k in (1, 2, 3, 6, 7)] == [(9.0, 1), (3.0, 1), (2.0, 1), (2.0, 4), (1.0, 1)]


# Sharding


def test_shards_are_even_and_places_gapless(spark):
    rows = QUERIES["op7_virtual_slots"](spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    load, places = Counter(), defaultdict(list)
    for r in rows:
        assert (r["size"], r.text_crc32) == (len(docs[r.doc_id].encode()) + 16, zlib.crc32(docs[r.doc_id].encode()))
        load[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert sorted(load) == list(range(40)) and max(load.values()) < 1.05 * min(load.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_maps_are_versioned_and_edited(spark, tmp_path):
    rng = np.random.default_rng(3)
    sizes = {i: int(x) for i, x in enumerate(rng.integers(1, 1000, 512))}
    first = sharding.new_map(sizes, 8, 512)
    bigger = {k: v * (3 if first.shards[k] == 2 else 1) for k, v in sizes.items()}
    second = sharding.rebalanced(first, bigger)
    third = sharding.grown(second, bigger)
    assert max(second.loads(bigger)) <= 1.02 * sum(bigger.values()) / 8
    moved = [(a, b) for a, b in zip(second.shards, third.shards, strict=True) if a != b]
    assert moved and all(b == 8 for _, b in moved)
    assert max(third.loads(bigger)) < 1.1 * min(third.loads(bigger))
    for m in (first, second, third):
        sharding.save_map(spark, m, f"file://{tmp_path}/map")
    assert sharding.load_map(spark, f"file://{tmp_path}/map", 2) == second and sharding.load_map(spark, f"file://{tmp_path}/map") == third
    with pytest.raises(Exception, match="(?i)already exists"):
        sharding.save_map(spark, first, f"file://{tmp_path}/map")


def test_shards_follow_the_stored_map(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = f"file://{tmp_path}/maps"
    rows = sharding.shard_documents(docs, 8, slots=512, maps=path).collect()
    first, second = sharding.load_map(spark, path, 1), sharding.load_map(spark, path)
    assert (first.version, second.version) == (1, 2) and [first.shards.count(s) for s in range(8)] == [64] * 8
    assert all(r.shard == second.shards[r.virtual_slot] for r in rows)
    again = sharding.shard_documents(docs, 8, slots=512, maps=path).collect()
    assert {(r.doc_id, r.shard) for r in again} == {(r.doc_id, r.shard) for r in rows}


def test_sharding_awkward_rows(spark, docs):
    out = sharding.shard_documents(docs.unionByName(docs).withColumn("doc_id", F.when(F.col("doc_id") < 5, None).otherwise(F.col("doc_id"))), 4).collect()
    assert len(out) == 2 * docs.count()
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sharding.shard_documents(docs.limit(0), 4).count() == 0


# Rollups


def test_ledger(spark, tmp_path):
    ledger = rollup.Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.totals().count() == 0 and ledger.batches() == []
    rows = [("a", "en", 5), ("a", "en", 7), (None, "en", 1), ("b", None, None), ("a", "en", 5)]
    docs = spark.createDataFrame(rows, "source string, lang string, n long")
    assert ledger.commit("b1", rollup.inserts(docs, "t1", F.col("n")))
    assert not ledger.commit("b1", rollup.inserts(docs, "t1", F.col("n")))
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in ledger.totals().collect()}
    assert got == {("a", "en"): (3, 17), (None, "en"): (1, 1), ("b", None): (1, 0)}
    with pytest.raises(ValueError, match="other content"):
        ledger.commit("b1", rollup.inserts(docs.limit(2), "t1", F.col("n")))
    ledger.commit("b2", rollup.deletes(docs.where("source = 'a'"), "t1", F.col("n")))
    ledger.commit("b3", rollup.revisions(docs.where("source is null"), "t1", F.col("n"), F.lit(9)))
    broken = tmp_path / "ledger" / "batch=b4"
    broken.mkdir()
    assert ledger.batches() == ["b1", "b2", "b3"]
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in ledger.totals().collect()}
    assert got == {(None, "en"): (1, 9), ("b", None): (1, 0)}
    small = ledger.compact(rollup.Ledger(spark, f"file://{tmp_path}/small"))
    assert sorted(map(str, small.totals().collect())) == sorted(map(str, ledger.totals().collect()))


def test_rollup_counts_whole_texts_of_all_documents(spark, texts, docs, tmp_path):
    import base64

    import tiktoken
    from kinweave.llm.queries import COUNTING_TOKENIZERS, TOKEN_PATTERN

    old, new = COUNTING_TOKENIZERS
    plain = Tokenizer.from_file(COUNTING_TOKENIZERS[old])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(COUNTING_TOKENIZERS[new], "rb"))}
    ranked = tiktoken.Encoding("own", pat_str=TOKEN_PATTERN, mergeable_ranks=ranks, special_tokens={})
    count = {old: lambda t: len(plain.encode(t, add_special_tokens=False).ids), new: lambda t: len(ranked.encode_ordinary(t))}

    def totals(rows):
        out = defaultdict(lambda: (0, 0))
        for source, lang, text in rows:
            for name, f in count.items():
                n, m = out[source, lang, name]
                out[source, lang, name] = n + 1, m + f(text or "")
        return out

    rows = [(r.source, r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op8_token_rollup"](spark, SF).collect()
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in got} == totals(rows) and sum(r.n_docs for r in got) == 2 * len(rows)

    odd = [(None if i % 3 else "s", None if i % 2 else "en", t, i) for i, (_, t) in enumerate(texts[-len(AWKWARD) :])]
    spark.createDataFrame(odd, "source string, lang string, text string, counts long").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op8_token_rollup"](spark, str(tmp_path)).collect()
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in got} == totals([r[:3] for r in odd])
    spark.createDataFrame([], "source string, lang string, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op8_token_rollup"](spark, f"{tmp_path}/none").count() == 0


# Chat


def test_chat_query(spark):
    rows = {r.conv_id: r for r in QUERIES["op9_chat_masks"](spark, SF).collect()}
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-1] = [(0, "user", HOSTILE), (1, "assistant", HOSTILE)]
    assert set(rows) == set(turns)
    for c, ts in turns.items():
        ts.sort()
        said = "".join(t for _, role, t in ts if role == "assistant")
        assert rows[c].n_turns == len(ts)
        assert rows[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in ts).encode()).hexdigest()
        assert (rows[c].loss_chars, rows[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


bits = st.sampled_from([*chat.CONTROLS, "<", "\\", "|", "[", "\n", " ", "é", "𝔘", "end|>", "/s>", "INST]", "a"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", chat.SAY, ""]), st.lists(bits, max_size=8).map("".join)), max_size=5))
def test_chat_round_trip(turns):
    made = chat.render(turns)
    assert chat.parse(made.text) == turns
    tokenizer = _chat_tokenizer()
    code = tokenizer.encode(made.text, add_special_tokens=False)
    loss = chat.loss_ranges(code.offsets, made.spans)
    assert [chat.unescape("".join(made.text[a:b] for a, b in chat.covered(x[1], x[2]))) for x in loss] == [t for r, t in turns if r == "assistant"]


_kept = []


def _chat_tokenizer():
    if not _kept:
        _kept.append(chat.load(CHAT_TOKENIZER))
    return _kept[0]


def test_chat_awkward_rows(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", "x"), (1, 2, "assistant", "b"), (1, 1, "user", None), (1, 2, "assistant", "b"), (2, 1, "assistant", "é" * 30000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df, CHAT_TOKENIZER)).collect()}
    assert {c: (r.n_turns, r.loss_chars) for c, r in got.items()} == {None: (2, 1), 1: (3, 2), 2: (1, 30000)}


# Pipeline


def plain_mask(text):
    from test_pii import KINDS, brute

    out, done = [], 0
    for start, kind, end in brute(text):
        if start < done:
            done = max(done, end)
            continue
        out += [text[done:start], f"<{KINDS[kind]}>"]
        done = end
    return "".join([*out, text[done:]])


def plain_cut(text, items, window=13):
    """`text` without its runs of 13 or more words in occurrences of items' windows."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]
    words, hit = [low[a:b] for a, b in places], set()
    for _, item in items:
        iw = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item))
        size = min(window, len(iw))
        wins = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if iw else set()
        hit |= {k for i in range(len(words) - size + 1 if size else 0) if tuple(words[i : i + size]) in wins for k in range(i, i + size)}
    out, done, at = [], 0, 0
    while at < len(words):
        end = at
        while end in hit:
            end += 1
        if end - at >= window:
            out.append(text[done : places[at][0]])
            done = places[end - 1][1]
        at = max(end, at + 1)
    return "".join([*out, text[done:]])


def test_pipeline_against_a_plain_version(spark):
    import corpus_pipeline
    from test_whole import plain_similar_groups

    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    good = {r.doc_id for r in QUERIES["op2_quality_rules"](spark, sf).where("kept").collect()}
    docs = [(d, t) for d, t in docs if d in good]
    groups = plain_similar_groups(docs)  # what the stage is told to link: a similarity of 5-word shingles of 0.8
    docs = [(d, t) for d, t in docs if groups[d] == d]
    hits = {d: plain_hits(t, items) for d, t in docs}
    docs = [(d, plain_mask(plain_cut(t, items))) for d, t in docs if not (hits[d][1] and 20 * hits[d][1] >= hits[d][0])]
    tok, want = Tokenizer.from_file(PACKING_TOKENIZER), {}
    for d, t in docs:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[d, k] = (at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    check_sequences(rows)
    assert len(docs) > 500


def test_pipeline_stages_keep_columns_and_survive_awkward_tables(spark):
    import corpus_pipeline

    rows = [(i, t, None, None, None) for i, t in enumerate(AWKWARD)] + [(None, None, "en", "s", 3), (1, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("id", "row", "spans", "text_hash", "n", "q_kept", "out", "m"):
        docs = docs.withColumn(name, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs, SF).count() >= 0
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
