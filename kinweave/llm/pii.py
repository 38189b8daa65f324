"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the entities that fixed rules find. Every mention of a seed, and of any other token that looks like an identifier,
yields lexical patterns from the words around it. Patterns and instances form a bipartite graph of distinct edges. Rounds
score it, until one finds nothing: a pattern is trusted for the kind of entity that it holds most, by what speaks against it
(entities of other kinds, more unknown instances than known ones); an instance's score combines its patterns'; instances above
the bar become known, whatever their shape, and vouch for further patterns. Only the graph, a few numbers an edge, is shuffled.

Regular expressions are written so that they need neither backtracking over long runs nor recursion: runs start where the
character before isn't of their class (or where the last match ended), quantifiers are possessive on single classes, and
separators that may stand only inside a run are first replaced by a private character of the same length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.runtime import spool

#: The base kinds, and what only this method adds.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: Private characters: inner separator of digits, inner separator of a domain or token, what stands for these in the input, a cut, what was found before.
GAP, DOT, OTHER, CUT, BLANK = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
LOCAL, LABEL = r"A-Za-z0-9._%+\-", r"A-Za-z0-9\-"
SPACE = r"\x20\x09-\x0D"

EMAIL = rf"(?:(?<![{LOCAL}{DOT}])|\G)[{LOCAL}{DOT}]++@[{LABEL}]++{DOT}[{LABEL}{DOT}]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9{GAP}]{{13,}}+"
PHONE = r"\+[0-9][\x20().0-9\-]+[0-9]"
#: A quoted literal after = or :, long and of letters and digits.
SECRET = r"(?<=[=:]\x20?[\"'])[A-Za-z0-9+/_=\-]{32,}+(?=[\"'])"
#: Looser shapes, for candidates; and any token with four digits or more and no known shape.
LOOSE_EMAIL = rf"(?<![{LOCAL}])[{LOCAL}]++\x20?[\[(](?i:at)[\])]\x20?[{LABEL}]++(?:(?:\.|\x20?[\[(](?i:dot)[\])]\x20?)[{LABEL}]++){{1,4}}"
LOOSE_PHONE = r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.\-][0-9]{3}[\x20.\-][0-9]{4}(?![0-9])"
TOKEN = rf"(?<![A-Za-z0-9{DOT}])(?=(?:[A-Za-z{DOT}]*+[0-9]){{4}})[A-Za-z0-9{DOT}]{{6,}}+"
#: Context: what stands within so many characters of a mention, and not beyond the next mention by the same rule.
CONTEXT = 60
#: Words of a context: runs of letters and digits, and other characters one by one, but for those that tokens hold inside.
CONTEXT_WORD = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}\p{Co}._/\-]"

MENTION = "struct<kind: int, start: long, end: long, seed: boolean, instance: long, patterns: array<long>>"


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running_ends(lengths: Column, block: int = 256) -> Column:
    """Running sums of an array, in blocks so that appending stays cheap for long arrays."""

    def scan(part: Column) -> Column:
        start = F.array().cast("array<long>")
        return F.aggregate(part, start, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)))

    cuts = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int"))
    blocks = F.transform(cuts, lambda c: scan(F.slice(lengths, c * block + 1, block)))
    shifted = lambda bs: let(scan(F.transform(bs, lambda b: F.element_at(b, -1))), lambda before: F.flatten(F.transform(bs, lambda b, i: F.transform(b, lambda x: x + F.when(i > 0, F.get(before, i - 1)).otherwise(F.lit(0))))))
    return F.when(F.size(lengths) == 0, F.array().cast("array<long>")).otherwise(let(blocks, shifted))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _patterns(left: Column, right: Column) -> Column:
    """Hashes of three lexical patterns: the two and the three words before; the word before and the word after. Digits
    count as one; a pattern without letters is none."""
    words = lambda s: F.regexp_extract_all(F.regexp_replace(F.lower(s), "[0-9]+", "0"), F.lit(CONTEXT_WORD), 0)

    def of(before: Column, after: Column) -> Column:
        at = lambda n: F.try_element_at(before, F.lit(-n))
        shapes = {"two": [at(2), at(1)], "three": [at(3), at(2), at(1)], "around": [at(1), F.try_element_at(after, F.lit(1))]}
        keys = F.array(*[F.when(reduce(Column.__and__, [w.isNotNull() for w in ws]), F.concat_ws("\n", F.lit(name), *ws)) for name, ws in shapes.items()])
        return F.transform(F.filter(keys, lambda k: k.isNotNull() & k.rlike(r"\n[^\n]*\p{L}")), lambda k: F.xxhash64(k))

    return let(words(F.right(left, F.lit(CONTEXT))), lambda b: let(words(F.left(right, F.lit(CONTEXT))), lambda a: of(b, a)))


#: Rules by number: the first ones are those of ALL_KINDS.
EMAILS, IPS, CARDS, PHONES, SECRETS, LOOSE_EMAILS, LOOSE_PHONES, TOKENS = range(8)


def _kind(rule: Column, value: Column) -> Column:
    """The kind of a seed, else null."""
    size = lambda a, b: F.length(_digits(value)).between(a, b)
    low = F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)
    luhn = size(14, 19) & F.call_function("luhn_check", F.when(size(14, 19), _digits(value)).otherwise(F.lit("0")))
    mixed = (F.length(_digits(value)) >= 4) & (F.length(F.regexp_replace(value, "[^A-Za-z]", "")) >= 4)
    return F.when((rule == EMAILS) | (rule == IPS) & low | (rule == CARDS) & luhn | (rule == PHONES) & size(10, 15) | (rule == SECRETS) & mixed, rule)


def _mentions(rules: list[tuple[int, Column, Column, str]]) -> Column:
    """Mentions by (rule, condition, text, pattern): matches split off by a cut mark, their places from running lengths.
    Matches that are neither seeds nor candidates are dropped; a failed card is a candidate unless it ends a longer token."""
    nothing = F.array().cast("array<string>")
    parted = F.array(*[F.struct(F.lit(n).alias("rule"), F.when(test, F.split(F.regexp_replace(text, pattern, f"{CUT}$0{CUT}"), CUT, -1)).otherwise(nothing).alias("parts")) for n, test, text, pattern in rules])

    def of(x: Column) -> Column:
        rule, parts = x["rule"], x["parts"]

        def one(ends: Column) -> Column:
            def mention(i: Column) -> Column:
                value = F.get(parts, i)
                whole = (rule == CARDS) & F.length(_digits(value)).between(13, 19) & ~F.right(F.get(parts, i - 1), F.lit(1)).rlike(r"[A-Za-z_./\-]")

                def made(kind: Column) -> Column:
                    own = F.xxhash64(kind, F.when(kind.isin(EMAILS, SECRETS), F.lower(value)).otherwise(_digits(value)))
                    loose = F.xxhash64(F.lit("candidate"), F.regexp_replace(F.lower(value), "[^0-9a-z]", ""))
                    return F.when(kind.isNotNull() | rule.isin(IPS, LOOSE_EMAILS, LOOSE_PHONES, TOKENS) | whole, F.struct(
                        kind.alias("kind"), F.get(ends, i - 1).alias("start"), F.get(ends, i).alias("end"), kind.isNotNull().alias("seed"),
                        F.when(kind.isNotNull(), own).otherwise(loose).alias("instance"), _patterns(F.get(parts, i - 1), F.get(parts, i + 1)).alias("patterns"),
                    ))

                return let(_kind(rule, value), made)

            return F.filter(F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), mention), lambda m: m.isNotNull()).cast(f"array<{MENTION}>")

        return F.when(F.size(parts) < 3, F.array().cast(f"array<{MENTION}>")).otherwise(let(running_ends(F.transform(parts, lambda p: F.length(p).cast("long"))), one))

    return F.flatten(F.transform(parted, of))


def find_mentions(text: Column) -> Column:
    """All mentions in a text: seeds by the fixed rules, candidates of looser shape, and tokens of any shape with digits that
    touch none of these. Null counts as empty."""
    text = F.translate(F.coalesce(text.cast("string"), F.lit("")), GAP + DOT + CUT + BLANK, OTHER * 4)

    def of(t: Column) -> Column:
        dotted = F.regexp_replace(t, rf"(?<=[{LABEL}])\.(?=[{LABEL}])", DOT)
        joined = F.regexp_replace(t, r"(?<=[0-9])[\x20\-](?=[0-9])", GAP)
        has_digit = t.rlike("[0-9]")
        shaped = _mentions([
            (EMAILS, F.contains(t, F.lit("@")), dotted, EMAIL),
            (IPS, t.rlike(r"[0-9]\.[0-9]"), t, IP),
            (CARDS, has_digit, joined, CARD),
            (PHONES, F.contains(t, F.lit("+")), t, PHONE),
            (SECRETS, t.rlike(r"[=:]\x20?[\"'][A-Za-z0-9+/_=\-]{32}"), t, SECRET),
            (LOOSE_EMAILS, t.rlike(r"[\[(](?i:at)[\])]"), t, LOOSE_EMAIL),
            (LOOSE_PHONES, t.rlike(r"[0-9]{3}[\x20.\-][0-9]{4}"), t, LOOSE_PHONE),
        ])

        def rest(found: Column) -> Column:
            inner = F.regexp_replace(blanked(t, found), r"(?<=[A-Za-z0-9])[_./\-](?=[A-Za-z0-9])", DOT)
            return F.concat(found, _mentions([(TOKENS, has_digit, inner, TOKEN)]))

        none = F.array().cast(f"array<{MENTION}>")
        return F.when(t.rlike(r"[0-9@]|[\[(](?i:at)[\])]"), let(shaped, rest)).otherwise(none)

    return let(text, of)


def bootstrap(mentions: DataFrame, min_known: int = 5, min_confidence: float = 0.9, min_score: float = 0.9, min_share: float = 0.25) -> DataFrame:
    """(instance, kind) of candidates that patterns vouch for. `mentions` has instance, kind (null: not known) and patterns.

    A pattern is trusted for the kind most of its known instances have (of two, the first), if these are `min_known` or more,
    no fewer than its unknown ones, and at least `min_confidence` of all its known ones and half an instance more. An
    instance's score is 1 minus the product of its trusted patterns' doubts; its kind is that of the pattern with the least
    doubt. It becomes known from `min_score` on, if `min_share` of its patterns are trusted: what stands in all kinds of
    places, such as a year, is not drawn in by one of them. Rounds go on until one finds nothing.
    """
    edges = mentions.select("instance", "kind", F.explode("patterns").alias("pattern")).groupBy("instance", "pattern").agg(F.max("kind").alias("kind"))
    edges = spool(edges, "graph")
    none = edges.where("false").select("instance", "kind")
    if edges.where("kind is null").isEmpty():
        return none
    known = edges.where("kind is not null").groupBy("instance").agg(F.max("kind").alias("kind"))
    edges, new = edges.select("instance", "pattern"), none
    while True:
        state = edges.join(known, "instance", "left")
        counts = state.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n"))
        held = F.when(F.col("kind").isNotNull(), F.col("n"))
        by = counts.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum(held).alias("known"), F.max(F.when(held.isNotNull(), F.struct("n", -F.col("kind")))).alias("top"))
        by = by.select("pattern", (F.col("n") - F.col("known")).alias("unknown"), "known", F.col("top.n").alias("k"), (-F.col("top.col2")).alias("of"))
        doubt = 1 - F.col("k") / (F.col("known") + 0.5)
        good = by.where((F.col("k") >= min_known) & (F.col("k") >= F.col("unknown"))).select("pattern", "of", doubt.alias("doubt")).where(F.col("doubt") <= 1 - min_confidence)
        votes = state.where("kind is null").join(good, "pattern", "left").groupBy("instance")
        votes = votes.agg(F.count(F.lit(1)).alias("n"), F.count("doubt").alias("good"), F.sum(F.ln("doubt")).alias("logs"), F.min(F.when(F.col("doubt").isNotNull(), F.struct("doubt", "of"))).alias("best"))
        votes = votes.where((1 - F.exp("logs") >= min_score) & (F.col("good") >= min_share * F.col("n")))
        found = spool(votes.select("instance", F.col("best.of").alias("kind")), "found")
        if found.isEmpty():
            return new
        new, known = new.unionByName(found), spool(known.unionByName(found), "known")


SPANS = "array<struct<start: long, kind: int, end: long>>"


def _marked(docs: DataFrame, id_col: str, text_col: str, keep: list[Column], **options) -> DataFrame:
    """`keep` columns, base and spans for each row of `docs`; rows without candidates are neither shuffled nor joined."""
    rows = docs.select(F.monotonically_increasing_id().alias("n"), *keep, find_mentions(F.col(text_col)).alias("mentions"))
    rows = spool(rows, "mentions")
    flat = rows.select("n", F.explode("mentions").alias("m")).select("n", "m.*")
    new = bootstrap(flat, **options).withColumnRenamed("kind", "as")
    more = flat.where("not seed").join(new, "instance").groupBy("n").agg(F.array_sort(F.collect_set(F.struct("start", F.col("as").alias("kind"), "end"))).cast(SPANS).alias("more"))
    of = lambda test: F.array_sort(F.transform(F.filter("mentions", lambda m: m["seed"] & test(m["kind"])), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))).cast(SPANS)
    names = [c for c in rows.columns if c not in ("n", "mentions")]
    left = rows.select("n", *names, of(lambda k: k < len(KINDS)).alias("base"), of(lambda k: k >= len(KINDS)).alias("own"), F.exists("mentions", lambda m: ~m["seed"]).alias("open"))
    none = F.array().cast(SPANS)
    met = left.where("not open").withColumn("more", none).unionByName(left.where("open").join(more, "n", "left").withColumn("more", F.coalesce("more", none)))
    return met.select(*names, "base", _with_others("base", "own", "more").alias("spans"))


def _with_others(base: str, own: str, more: str) -> Column:
    """All base spans, and from left to right those of the others that touch no base span and none taken before. Spans are
    sorted once, so that the work stays near linear; a base span ends at most once a place."""
    rank = lambda c, r: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(r).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    free = lambda spans: let(_joined_spans(F.col(base)), lambda taken: F.filter(spans, lambda s: ~F.exists(taken, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    others = F.array_sort(F.concat(rank(own, 0), rank(more, 1)))
    plain = F.transform(_first_of_overlapping(others), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.when((F.size(own) == 0) & (F.size(more) == 0), F.col(base)).otherwise(F.array_sort(F.concat(base, free(plain))).cast(SPANS))


def _first_of_overlapping(spans: Column) -> Column:
    empty = F.array().cast("array<struct<start: long, rank: int, kind: int, end: long>>")
    return F.aggregate(spans.cast("array<struct<start: long, rank: int, kind: int, end: long>>"), empty, lambda acc, s: F.when(F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)) <= s["start"], F.concat(acc, F.array(s))).otherwise(acc))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, base, spans) for every row of `docs`.

    base and spans are arrays of (start, kind, end) in code points, sorted: what the fixed rules for KINDS find; and that plus
    what the contexts vouch for, and quoted secrets, where they touch none of it. kind is the number of a name in ALL_KINDS. Null
    texts are empty; repeated rows each get a row, and ids are not used; extra columns are not read. The texts are read
    once; what is shuffled are mentions.
    """
    return _marked(docs, id_col, text_col, [F.col(id_col)], **options).select(id_col, "base", "spans")


def span_text(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _joined_spans(spans: Column) -> Column:
    """Sorted spans with overlapping ones merged; the first one's kind stays."""
    empty = F.array().cast("array<struct<start: long, kind: int, end: long>>")

    def add(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (last["end"] > s["start"]), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, empty, add)


def _replaced(text: Column, spans: Column, by, block: int = 4096) -> Column:
    """`text` with each span replaced by by(span). The text is cut into blocks once, so that the work is near linear for long
    texts with many spans."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / block).cast("int")), lambda i: F.substring(text, i * block + 1, block))

    def cut(bs: Column, a: Column, b: Column) -> Column:
        at = F.floor(a / block).cast("int")
        part = F.array_join(F.slice(bs, at + 1, F.floor(b / block).cast("int") - at + 1), "")
        return F.substring(part, (a % block + 1).cast("int"), (b - a).cast("int"))

    def of(bs: Column) -> Column:
        def parts(ss: Column) -> Column:
            pieces = F.transform(ss, lambda s, i: F.concat(cut(bs, F.when(i > 0, F.get(ss, i - 1)["end"]).otherwise(F.lit(0).cast("long")), s["start"]), by(s)))
            return F.concat(F.array_join(pieces, ""), cut(bs, F.element_at(ss, -1)["end"], F.length(text).cast("long")))

        return let(_joined_spans(spans), parts)

    return F.when(F.coalesce(F.size(spans), F.lit(0)) <= 0, text).otherwise(let(blocks, of))


def masked(text: Column, spans: Column) -> Column:
    """`text` with each span replaced by its kind in angle brackets."""
    names = F.array(*[F.lit(f"<{k}>") for k in ALL_KINDS])
    return _replaced(text, spans, lambda s: F.get(names, s["kind"]))


def blanked(text: Column, mentions: Column) -> Column:
    """`text` with each mention replaced by as many blanks."""
    spans = F.array_sort(F.transform(mentions, lambda m: F.struct(m["start"].alias("start"), F.coalesce(m["kind"], F.lit(-1)).alias("kind"), m["end"].alias("end")))).cast(SPANS)
    return _replaced(text, spans, lambda s: F.repeat(F.lit(BLANK), (s["end"] - s["start"]).cast("int")))


def mask_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with every span that pii_spans() finds masked; all rows and columns stay, and a null text stays null. Each row
    is masked by its own spans, whatever its id; ids are not read."""
    found = _marked(docs, id_col, text_col, [F.struct("*").alias("row")], **options)
    own = F.col("row")
    return found.select(own.withField(text_col, masked(own[text_col], F.col("spans"))).alias("row")).select("row.*")
