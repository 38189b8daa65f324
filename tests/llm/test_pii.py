import hashlib
import re

from kinweave.llm.pii import KINDS, mask_documents, pii_spans, running_ends, span_text
from pyspark.sql import functions as F

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(RULES[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


HARD = [
    None, "", "a@b.c_d@e.f x@y z a@@b.com a@b@c.d a..b@c.d-e.f.", "mail me.now%x@host.example.com.", "a@b.c.d..e@f.g", "@a.b a@.b a@-.-",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3.400 001.002.003.255 1.2.3.4x", "12 34 56-78  4111 1111 1111 1111 5 4111-1111-1111-1111 41111111111111112",
    "4111111111111111 4111 1111-1111 1111\n4111111111111111", "+1 (743) 555-3824 é +12 +1 ((((((1 +123456789012345678 +1-2-3-4-5-6-7-8-9-0.",
    " ab@c.d 12", "𝔘𝔫𝔦 a@b.co 𝔘 1.2.3.4 ﬁ +1 555 555 5555", "1 " * 3000, "9" * 5000, "a." * 4000 + "@" + "b." * 4000 + "c", "a@b" + ".c" * 5000,
    "x" * 50000, "+" * 2000 + "1" * 30, " ".join(["a@b.cd 1.2.3.4"] * 700),
]


def test_base_spans_match_the_plain_rules(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.base] for r in pii_spans(docs).collect()}
    for i, t in enumerate(HARD):
        assert got[i] == brute(t), t and t[:80]


def test_base_spans_match_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pii_spans(docs).select("doc_id", span_text("base").alias("s"), F.sha2(span_text("base").cast("binary"), 256).alias("h")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in brute(texts[r.doc_id]))
        assert (r.s, r.h) == (want, hashlib.sha256(want.encode()).hexdigest())


def test_contexts_discover_unseen_identifiers_and_leave_others(spark):
    seeds = [f"Please call me at +1 (555) 010-{1000 + i} today" for i in range(30)]
    docs = [*seeds, "Please call me at (555) 010-7777 today", "the part no 555-010-8888 is sold", "Please call me at 4 today"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii_spans(df).select("doc_id", span_text("spans").alias("s")).collect()}
    assert got[30] == "phone:18:32"
    assert got[31] == got[32] == ""
    assert all(got[i].startswith("phone:18:") for i in range(30))
    text = {r.doc_id: r.text for r in mask_documents(df).collect()}
    assert text[30] == "Please call me at <phone> today" and text[31] == docs[31]


def test_masking_keeps_rows_columns_and_the_rest_of_the_text(spark):
    long = "word " * 3000 + "a@b.cd " + "é" * 9000 + " 1.2.3.4 end"
    rows = [(1, long, "x"), (1, long, "x"), (None, "a@b.cd", None), (2, None, "y"), (3, "", "z"), (4, "+1 4111 1111 1111 11", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((tuple(r) for r in mask_documents(df).collect()), key=repr)
    clean = long.replace("a@b.cd", "<email>").replace("1.2.3.4", "<ip>")
    want = [(1, clean, "x"), (1, clean, "x"), (None, "<email>", None), (2, None, "y"), (3, "", "z")]
    assert [g for g in got if g[0] != 4] == sorted(want, key=repr)
    assert mask_documents(df.limit(0)).count() == 0


def test_running_ends(spark):
    for n in (0, 1, 255, 256, 257, 1500):
        row = spark.range(1).select(running_ends(F.array(*[F.lit(i).cast("long") for i in range(n)]).cast("array<long>")).alias("x")).first()
        assert row.x == [sum(range(i + 1)) for i in range(n)]


def plain_mentions(text):
    """[start, end, kind or None, instance, patterns] of every mention, by the rules as the module states them."""
    import regex
    from kinweave.llm import pii

    text = re.sub(f"[{pii.GAP}{pii.DOT}{pii.CUT}{pii.BLANK}]", pii.OTHER, text or "")
    digits = lambda v: re.sub("[^0-9]", "", v)
    dotted = regex.sub(rf"(?<=[{pii.LABEL}])\.(?=[{pii.LABEL}])", pii.DOT, text)
    joined = regex.sub(r"(?<=[0-9])[\x20\-](?=[0-9])", pii.GAP, text)
    words = lambda s: regex.findall(pii.CONTEXT_WORD, re.sub("[0-9]+", "0", s.lower()))
    found = []

    def by(rule, where, kind, seed, candidate):
        matches = list(regex.finditer(rule, where))
        ends = [0, *(x for m in matches for x in m.span()), len(where)]
        for i, m in enumerate(matches):
            is_seed = seed(m[0])
            if not (is_seed or candidate(m[0], where[m.start() - 1 : m.start()])):
                continue
            b, a = words(where[ends[2 * i] : m.start()][-60:]), words(where[m.end() : ends[2 * i + 3]][:60])
            shapes = [("two", b[-2:], 2), ("three", b[-3:], 3), ("around", b[-1:] + a[:1], 2)]
            patterns = {(name, *ws) for name, ws, n in shapes if len(ws) == n and any(regex.search(r"\p{L}", w) for w in ws)}
            own = (kind, m[0].lower() if kind in (0, 4) else digits(m[0])) if is_seed else re.sub("[^0-9a-z]", "", m[0].lower())
            found.append((m.start(), m.end(), kind if is_seed else None, own, patterns))

    yes, no = (lambda *v: True), (lambda *v: False)
    by(pii.EMAIL, dotted, 0, yes, no)
    by(pii.LOOSE_EMAIL, text, None, no, yes)
    by(pii.IP, text, 1, lambda v: all(int(p) <= 255 for p in v.split(".")), yes)
    by(pii.CARD, joined, 2, lambda v: 14 <= len(digits(v)) <= 19 and luhn(digits(v)), lambda v, before: 13 <= len(digits(v)) <= 19 and not re.match(r"[A-Za-z_./\-]", before))
    by(pii.PHONE, text, 3, lambda v: 10 <= len(digits(v)) <= 15, no)
    by(pii.LOOSE_PHONE, text, None, no, yes)
    by(pii.SECRET, text, 4, lambda v: len(digits(v)) >= 4 and len(re.sub("[^A-Za-z]", "", v)) >= 4, no)
    blank = list(text)
    for a, b, *_ in found:
        blank[a:b] = pii.BLANK * (b - a)
    by(pii.TOKEN, regex.sub(r"(?<=[A-Za-z0-9])[_./\-](?=[A-Za-z0-9])", pii.DOT, "".join(blank)), None, no, yes)
    return found


def plain_spans(texts, min_known=5):
    from collections import Counter, defaultdict
    from math import prod

    mentions = {d: plain_mentions(t) for d, t in texts}
    holds, known = defaultdict(set), {}
    for ms in mentions.values():
        for _, _, kind, own, patterns in ms:
            for p in patterns:
                holds[p].add(own)
            if kind is not None and patterns:
                known[own] = kind
    of = defaultdict(set)
    for p, owns in holds.items():
        for own in owns:
            of[own].add(p)
    while True:
        good = {}
        for p, owns in holds.items():
            kinds = Counter(known[o] for o in owns if o in known)
            k, kind = max(((n, -x) for x, n in kinds.items()), default=(0, 0))
            total = sum(kinds.values())
            if k >= min_known and k >= len(owns) - total and 1 - k / (total + 0.5) <= 1 - 0.9:
                good[p] = (1 - k / (total + 0.5), -kind)
        new = {}
        for own, ps in of.items():
            votes = [good[p] for p in ps if p in good]
            if own not in known and votes and 1 - prod(d for d, _ in votes) >= 0.9 and len(votes) >= 0.25 * len(ps):
                new[own] = min(votes)[1]
        if not new:
            break
        known |= new
    out = {}
    for d, ms in mentions.items():
        base = sorted((a, kind, b) for a, b, kind, _, _ in ms if kind is not None and kind < 4)
        others = sorted({(a, 0, kind, b) for a, b, kind, _, _ in ms if kind == 4} | {(a, 1, known[own], b) for a, b, kind, own, _ in ms if kind is None and own in known})
        taken, last = [], 0
        for a, _, kind, b in others:
            if a >= last:
                taken.append((a, kind, b))
                last = b
        out[d] = sorted(base + [s for s in taken if not any(x[0] < s[2] and s[0] < x[2] for x in base)])
    return out


def planted(n=120):
    """Texts with identifiers of shapes that no rule lists, in contexts that known ones vouch for, and as many without any."""
    import random

    rng = random.Random(4)
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    words = lambda: " ".join(rng.choice("lorem ipsum dolor sit amet velit nisi erat quam orci".split()) for _ in range(rng.randint(3, 9)))
    texts, hidden, clean = [], {}, []
    for i in range(n):
        texts += [f'{words()} api token = "{hexes(40)}" {words()}', f"{words()} please call me at +1 (555) 010-{1000 + i} {words()}", f"{words()} my account number is {4111_0000_0000_0000 + luhn_tail(i)} {words()}"]
    for i in range(n // 2):
        for shape, kind in ((f'api token = "{hexes(10)}4321"', 4), (f"please call me at 0{rng.randrange(10**8)}11", 3), (f"my account number is DE{rng.randrange(10**12):012d}-{i}77", 2)):
            hidden[len(texts)] = (shape.split()[-1].strip('"'), kind)
            texts.append(f"{words()} {shape} {words()}")
        clean.append(len(texts))
        texts.append(f"{words()} in the year {1900 + i} the part no {100000 + i} was sold for {i}0,000.00 on 2024-01-{i % 28 + 1:02d} {words()}")
    return texts, hidden, clean


def luhn_tail(i):
    return next(x for x in range(i * 100, i * 100 + 10) if luhn(str(4111_0000_0000_0000 + x)))


def test_contexts_find_unlisted_shapes_and_leave_clean_texts(spark):
    texts, hidden, clean = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in pii_spans(docs).collect()}
    caught = sum(any(texts[d][a:b] == token and k == kind for a, k, b in got[d]) for d, (token, kind) in hidden.items())
    assert caught >= 0.9 * len(hidden)
    assert not any(got[d] for d in clean)
    assert got == plain_spans(enumerate(texts))


def test_spans_match_a_plain_bootstrap(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(HARD)] + [(20_000 + i, t) for i, t in enumerate(planted(12)[0])]
    rows += [(30_000, 'token="abcd1234abcd1234abcd1234abcd1234" x@y.zz  12-34/56.78_90 john [at] mail (dot) com')]
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_spans(rows)
    assert {d: x for d, x in got.items() if x != want[d]} == {}


def test_no_identifiers_and_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii_spans(empty).count() == 0 and mask_documents(empty).count() == 0
    plain = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "no 1 2 3", 3)], "doc_id long, text string, mentions int")
    assert sorted(map(str, mask_documents(plain).collect())) == sorted(map(str, plain.collect()))
