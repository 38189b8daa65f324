"""URL filter: character language-model ratio, under domain rules.

Two variable-order Markov models of bytes, one of accepted and one of rejected URLs, are counted by Spark over all labelled
URLs. Counts are exact, for each n-gram as it is, in tables that grow with the input and stay distributed; each order backs
off to the shorter one by Witten-Bell smoothing. The log ratio of a character depends on its n-gram alone, so it is worked
out once a distinct n-gram and joined to the n-grams of URLs. A URL's score is the sum divided by its length. The threshold
comes from URLs held out of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.runtime import spool

#: An n-gram is a number of ORDER + 1 symbols of WIDTH bits, the last one lowest: 0 before the URL, else its byte plus one, A-Z lower-cased.
ORDER, SYMBOLS, WIDTH = 4, 256, 9
#: Log ratios are summed as whole multiples of 1 / SCALE, so that no order of summing matters.
SCALE = 1 << 32

#: Words in host names that mark a URL as rejected when no labels are given.
REJECT_WORDS = ("casino", "poker", "bets", "lottery", "jackpot", "pills", "pharma", "viagra", "replica", "spam", "ads-", "adserv", "porn", "xxx", "escort", "payday", "warez", "torrent")


@dataclass(frozen=True)
class Rule:
    """Fits a host and all its subdomains where the path starts with the rule's. Written as host + path."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ? or #, A-Z lower-cased. Path: on up to ? or #. Both empty without ://."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, upper, upper.lower()), path


def first_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits as a struct (verdict, rule), else null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.text).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<verdict: string, rule: string>")


_SYMBOL = np.array([c + 33 if 65 <= c <= 90 else c + 1 for c in range(256)], np.int64)


def grams(url: bytes) -> np.ndarray:
    """For each byte the n-gram that ends there."""
    padded = np.concatenate([np.zeros(ORDER, np.int64), _SYMBOL[np.frombuffer(url, np.uint8)]])
    out = np.zeros(len(url), np.int64)
    for at in range(ORDER + 1):
        out = (out << WIDTH) | padded[at : at + len(url)]
    return out


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, accepted, gram, times): the n-grams of each row that is counted or scored."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            ns, labels, found = [], [], []
            for n, label, url in zip(*(part.column(c).to_pylist() for c in ("n", "accepted", "url")), strict=True):
                if url:
                    found.append(np.unique(grams(url), return_counts=True))
                    ns.append(n)
                    labels.append(label)
            if not found:
                continue
            sizes = [len(g) for g, _ in found]
            which = pa.array(np.repeat(np.arange(len(ns)), sizes))
            columns = [pa.array(ns, pa.int64()).take(which), pa.array(labels, pa.bool_()).take(which)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True))], names=["n", "accepted", "gram", "times"])


def log_ratios(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, ratio) for each of `wanted` (gram, distinct): log-likelihood of its last symbol when accepted minus when
    rejected, from `counts` (gram, yes, no). The shorter orders' counts are sums over the n-grams' ends."""
    out = wanted.select("gram", F.lit(1.0 / SYMBOLS).alias("p_yes"), F.lit(1.0 / SYMBOLS).alias("p_no"))
    for order in range(ORDER + 1):
        end = F.col("gram").bitwiseAND(F.lit((1 << WIDTH * (order + 1)) - 1))
        own = counts.groupBy(end.alias("end")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        mass = own.groupBy(F.shiftright("end", WIDTH).alias("context")).agg(
            *[f for x in ("yes", "no") for f in (F.sum(x).alias(f"sum_{x}"), F.count(F.when(F.col(x) > 0, 1)).alias(f"kinds_{x}"))]
        )
        joined = out.withColumn("end", end).withColumn("context", F.shiftright("end", WIDTH)).join(own, "end", "left").join(mass, "context", "left")
        p = {x: F.when(F.col(f"sum_{x}") > 0, (F.coalesce(x, F.lit(0)) + F.col(f"kinds_{x}") * F.col(f"p_{x}")) / (F.col(f"sum_{x}") + F.col(f"kinds_{x}"))).otherwise(F.col(f"p_{x}")) for x in ("yes", "no")}
        out = joined.select("gram", p["yes"].alias("p_yes"), p["no"].alias("p_no"))
    return out.select("gram", (F.ln("p_yes") - F.ln("p_no")).alias("ratio"))


def scored(rows: DataFrame) -> DataFrame | None:
    """`rows` (n distinct, url binary, accepted boolean, held boolean) with a score, 0 for an empty URL, from models of the
    labelled rows that are not held; None if either label has no URL."""
    every = spool(rows.select("n", F.when(~F.col("held"), F.col("accepted")).alias("accepted"), "url").mapInArrow(_grams_of, "n long, accepted boolean, gram long, times long"), "grams")
    yes, no = (F.sum(F.when(x, F.col("times")).otherwise(F.lit(0))) for x in (F.col("accepted"), ~F.col("accepted")))
    table = spool(every.groupBy("gram").agg(yes.alias("yes"), no.alias("no")), "counts")
    counts = table.where("yes > 0 or no > 0")
    seen = counts.agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).first()
    if not seen.yes or not seen.no:
        return None
    ratios = log_ratios(counts, table.select("gram")).select("gram", F.round(F.col("ratio") * SCALE).cast("long").alias("ratio"))
    sums = every.select("n", "gram", "times").join(ratios, "gram").groupBy("n").agg(F.sum(F.col("ratio") * F.col("times")).alias("total"))
    return rows.join(sums, "n", "left").withColumn("score", F.coalesce(F.col("total") / F.lit(float(SCALE)) / F.length("url"), F.lit(0.0))).drop("total")


def calibrate(scored: DataFrame, max_false_rejects: float = 0.01, bins: int = 1024, reach: float = 8.0) -> float:
    """The threshold below which URLs are rejected: over bins of held-out scores, the one with the most rejected URLs below
    it less accepted ones, in shares, among those with at most `max_false_rejects` of the accepted below."""
    at = F.least(F.greatest(F.floor((F.col("score") + reach) / (2 * reach) * bins), F.lit(0)), F.lit(bins - 1))
    rows = scored.where("accepted is not null").groupBy(at.alias("bin"), "accepted").agg(F.count(F.lit(1)).alias("n")).collect()
    hist = np.zeros((2, bins))
    for r in rows:
        hist[int(r.accepted), int(r.bin)] += r.n
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(hist, axis=1)], axis=1) / np.maximum(hist.sum(axis=1, keepdims=True), 1)
    gain = np.where(below[1] <= max_false_rejects, below[0] - below[1], -1.0)
    best = np.flatnonzero(gain == gain.max())
    return float(best[len(best) // 2] / bins * 2 * reach - reach)


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", accepted: Column | None = None, max_false_rejects: float = 0.01) -> DataFrame:
    """(id_col, host, path, rule, verdict, score) for every row of `pages`.

    verdict is the longest fitting rule's, else block where the score is under the threshold, else allow. `accepted`: a
    boolean over the columns of `pages` that labels URLs for the models, null for no label; by default a host with one of
    REJECT_WORDS is rejected, any other accepted, and a URL without a host has no label. One labelled URL in five, by hash, only calibrates. Null, empty and
    malformed URLs score 0 like any text; without URLs of both labels all scores are null and the method allows.
    """
    host, path = host_and_path(F.col(url_col))
    if accepted is None:
        accepted = F.when(host != "", ~host.rlike("|".join(REJECT_WORDS).replace("-", r"\-")))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").cast("binary").alias("url"), host.alias("host"), path.alias("path"), accepted.alias("accepted"))
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    rows = spool(rows.withColumn("held", held).withColumn("n", F.monotonically_increasing_id()), "urls")
    found = scored(rows)
    if found is None:
        found, low = rows.withColumn("score", F.lit(None).cast("double")), 0.0
    else:
        found = spool(found, "scores")
        low = calibrate(found.where("held"), max_false_rejects)
    rule = first_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("score") < low) & (F.length("url") > 0), F.lit("block")).otherwise(F.lit("allow"))
    out = found.withColumn("__rule", rule)
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", own).alias("verdict"), "score")
