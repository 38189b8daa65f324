"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Measures are Column expressions over the text; a rule bounds one of them from below and above. All rules of a table and
all measures they need become a single projection: no join, no shuffle, no user function.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"

#: Frequent function words of the languages served. Fixed values.
STOP_WORDS = (
    "the of and to in a is that for it was on are as with he be this at by from or have an they which not but "
    "le la les de des du et un une en que qui dans pour pas sur il elle est au ne se ce plus par avec son sa "
    "el los las y del se con por su para una al lo como más o pero sus le ya este sí porque "
    "der die das und zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei"
).split()

#: As written in lower case, at the start of a sentence, and in capitals.
STOP_FORMS = sorted({form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())})


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high; a bound that is None is open, and so is a null measure."""

    measure: str
    low: float | None = None
    high: float | None = None

    def column(self, of: dict[str, Column]) -> Column:
        bounds = [of[self.measure] >= self.low] if self.low is not None else []
        bounds += [of[self.measure] <= self.high] if self.high is not None else []
        return F.coalesce(reduce(Column.__and__, bounds, F.lit(True)), F.lit(True))


#: Bounds that ordinary prose of any length meets.
RULES = (
    Rule("mean_word_chars", 2.0, 16.0),
    Rule("symbol_ratio", None, 0.08),
    Rule("stop_word_ratio", 0.015, None),
    Rule("dup_line_ratio", None, 0.40),
    Rule("repeat_ratio", None, 0.30),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once: a lambda's argument isn't expanded into its uses."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The runs of characters other than space and \\t to \\r."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def n_repeat_words(ws: Column, window: int = 8) -> Column:
    """Words inside windows of `window` words that occur twice or more in the text, the first occurrence included.

    Hashes of 4 and then 8 words are compared first; only where they repeat are the windows themselves sorted and compared,
    so the result is exact. Work grows as n log n with the number of words, however often a passage repeats.
    """

    if window != 8:
        raise ValueError("hashes are doubled three times: windows have 8 words")

    def doubled(step: int) -> Callable[[Column], Column]:
        """Hashes of 2 x step words from those of step words; those at the end cover fewer words and only cost a look."""
        return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    def exact(w: Column) -> Column:
        spots = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.struct(F.concat_ws(" ", F.slice(w, i + 1, window)).alias("s"), i.alias("i")))

        def twice(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["s"] == x["s"], F.lit(False))
            return F.filter(s, lambda x, j: F.when(j > 0, same(x, j - 1)).otherwise(F.lit(False)) | same(x, j + 1))

        def covered(at: Column) -> Column:
            step = F.transform(at, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - x, F.lit(window))))
            return F.aggregate(step, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return let(F.array_sort(spots), lambda s: let(F.array_sort(F.transform(twice(s), lambda x: x["i"])), covered))

    none = F.lit(0).cast("long")
    repeats = lambda h: F.size(F.array_distinct(h)) < F.size(h)
    fours = let(let(F.transform(ws, lambda w: F.xxhash64(w)), doubled(1)), doubled(2))
    return F.when(F.size(ws) <= window, none).otherwise(let(fours, lambda h: F.when(repeats(h) & let(doubled(4)(h), repeats), exact(ws)).otherwise(none)))


def measures(text: Column) -> Column:
    """A struct of all counts for one text; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def of(ws: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        number = lambda c: c.cast("long")
        return F.struct(
            number(F.size(ws)).alias("n_words"),
            number(F.length(F.array_join(ws, ""))).alias("word_chars"),
            number(F.length(F.regexp_replace(text, SYMBOLS, ""))).alias("n_symbols"),
            let(lines, lambda x: F.struct(number(F.size(x)).alias("n"), number(F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
            n_repeat_words(ws).alias("n_repeat_words"),
            number(F.size(F.filter(ws, lambda w: w.isin(*STOP_FORMS)))).alias("n_stop_words"),
        )

    return let(words(text), of)


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", prefix: str = "q_") -> DataFrame:
    """`docs` plus one column for each measure and {prefix}kept, all named with `prefix`.

    Ratios of a text without words or lines are null, and null meets every rule; the base test fails it (n_words < 20, or
    over 30 of 100 words inside repeated windows). A column of `docs` with the name of a new one gives way to it.
    """
    m = lambda name: F.col(f"m.{name}")
    counts = {k: m(k) for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_stop_words")} | {"n_lines": m("lines.n"), "n_dup_lines": m("lines.dup")}
    share = lambda a, b: F.when(counts[b] > 0, counts[a] / counts[b])
    ratios = {
        "mean_word_chars": share("word_chars", "n_words"), "symbol_ratio": share("n_symbols", "word_chars"), "stop_word_ratio": share("n_stop_words", "n_words"),
        "dup_line_ratio": share("n_dup_lines", "n_lines"), "repeat_ratio": share("n_repeat_words", "n_words"),
    }
    failed = (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])
    passed = reduce(Column.__and__, [r.column(counts | ratios) for r in rules], F.lit(True))
    out = {prefix + k: v for k, v in (counts | ratios | {"base_failed": failed, "kept": ~failed & passed}).items()}
    names = {k.lower() for k in out}
    rows = docs.select(F.struct("*").alias("row"), measures(F.col(text_col)).alias("m"))
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in names], *[v.alias(k) for k, v in out.items()])


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that pass the base test and all rules, columns as they were."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return quality(rows, rules, "text").where("q_kept").select("row.*")
