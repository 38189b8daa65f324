"""Correlation measures: functions of Columns (n_ij, n_i, n_j, n) that give the weights of i to j and of j to i."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.functions.special import beta_quantile, digamma, normal_quantile, trigamma

Pair = tuple[Column, Column]
Measure = Callable[[Column, Column, Column, Column], Pair]


def _real(*counts: Column) -> list[Column]:
    return [c.cast("double") for c in counts]


def _same(weight: Column) -> Pair:
    return weight, weight


def existence(nij, ni, nj, n) -> Pair:
    return _same(F.when(nij > 0, 1.0).otherwise(0.0))


def pairwise_count(nij, ni, nj, n) -> Pair:
    return _same(nij.cast("double"))


def weighted_count(nij, ni, nj, n) -> Pair:
    nij, ni, nj = _real(nij, ni, nj)
    return _same(nij * nij / (ni * nj))


def overlap(nij, ni, nj, n) -> Pair:
    return _same(nij.cast("double") / F.least(ni, nj))


def sorensen_dice(nij, ni, nj, n) -> Pair:
    return _same(2 * nij.cast("double") / (ni + nj))


def jaccard(nij, ni, nj, n) -> Pair:
    return _same(nij.cast("double") / (ni + nj - nij))


def conditional_probability(nij, ni, nj, n) -> Pair:
    nij = nij.cast("double")
    return nij / ni, nij / nj


def bayesian_conditional_probability(nij, ni, nj, n, alpha: float = 0.0, confidence: float | None = None) -> Pair:
    """With a confidence, the lower quantile of the Beta posterior; parameters are moved off zero by 1e-8."""
    nij, ni, nj = _real(nij, ni, nj)
    hits = nij + alpha / 2
    if confidence is None:
        return tuple(F.when(total + alpha > 0, hits / (total + alpha)).otherwise(0.0) for total in (ni, nj))
    return tuple(beta_quantile(hits + 1e-8, total + alpha / 2 - nij + 1e-8, 1 - confidence) for total in (ni, nj))


def pmi(nij, ni, nj, n) -> Pair:
    """Pointwise mutual information in natural logarithms."""
    nij, ni, nj, n = _real(nij, ni, nj, n)
    return _same(F.ln(nij / n) - F.ln(ni / n) - F.ln(nj / n))


def normalised_pmi(nij, ni, nj, n) -> Pair:
    """pmi over -ln p_ij; NaN where p_ij is 1."""
    log_p = F.ln(nij.cast("double") / n)
    return _same(F.when(log_p == 0, F.lit(float("nan"))).otherwise(-pmi(nij, ni, nj, n)[0] / log_p))


def _smoothed(nij, ni, nj, n, alpha: float) -> list[Column]:
    nij, ni, nj, n = _real(nij, ni, nj, n)
    return [nij + alpha / 4, ni + alpha / 2, nj + alpha / 2, n + alpha]


def bayesian_pmi(nij, ni, nj, n, alpha: float = 0.0, confidence: float | None = None) -> Pair:
    """Expected pmi under a uniform prior of weight alpha; 0 where a smoothed count isn't positive. With a confidence, it is
    moved towards 0 by a normal quantile of its deviation, never past 0."""
    a, b, c, total = _smoothed(nij, ni, nj, n, alpha)
    positive = (a > 0) & (b > 0) & (c > 0) & (total > 0)
    mean = digamma(a) - digamma(b) - digamma(c) + digamma(total)
    if confidence is not None:
        base = trigamma(total)
        parts = [trigamma(a + 1e-4), trigamma(b), trigamma(c)]
        over = [p - base for p in parts]
        cross = [F.sqrt(over[i] * over[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
        step = F.sqrt(sum(parts[1:], parts[0]) - 3 * base + 2 * sum(cross[1:], cross[0])) * normal_quantile(confidence)
        moved = F.when(mean >= 0, F.greatest(mean - step, F.lit(0.0))).otherwise(F.least(mean + step, F.lit(0.0)))
        mean = F.when(step <= 0, mean).otherwise(moved)
    return _same(F.when(positive, mean).otherwise(0.0))


def normalised_bayesian_pmi(nij, ni, nj, n, alpha: float = 0.0, confidence: float | None = None, fix_log: bool = False) -> Pair:
    """bayesian_pmi over -ln(E[ln p_ij]). That expectation is negative when n_ij < n, so the result is NaN there; with
    `fix_log` the expectation itself divides."""
    a, _, _, total = _smoothed(nij, ni, nj, n, alpha)
    mean_log = digamma(a + 1) - digamma(total + 1)
    scale = mean_log if fix_log else F.when(mean_log > 0, F.ln(mean_log)).otherwise(F.lit(float("nan")))
    return _same(-bayesian_pmi(nij, ni, nj, n, alpha, confidence)[0] / F.when(scale != 0, scale))


def _cells(nij, ni, nj, n) -> list[Pair]:
    """The four cells of the contingency table as (count, row total, column total)."""
    return [(nij, ni, nj), (ni - nij, ni, n - nj), (nj - nij, n - ni, nj), (n - ni - nj + nij, n - ni, n - nj)]


def mutual_information(nij, ni, nj, n) -> Pair:
    """Of two indicators; empty cells add 0."""
    nij, ni, nj, n = _real(nij, ni, nj, n)
    terms = [F.when(c > 0, c / n * (F.ln(c / n) - F.ln(r / n) - F.ln(k / n))).otherwise(0.0) for c, r, k in _cells(nij, ni, nj, n)]
    return _same(sum(terms[1:], terms[0]))


def bayesian_mutual_information(nij, ni, nj, n, alpha: float = 0.0, confidence: float | None = None) -> Pair:
    """Expected mutual information under a uniform prior of weight alpha. With a confidence, the lower quantile of a
    log-normal with that mean and an approximate variance; NaN where the mean isn't positive."""
    smooth = _smoothed(nij, ni, nj, n, alpha)
    total = smooth[3]
    terms = [F.when(c > 0, c * (digamma(c + 1) - digamma(r + 1) - digamma(k + 1) + digamma(total + 1))).otherwise(0.0) for c, r, k in _cells(*smooth)]
    mean = sum(terms[1:], terms[0]) / total
    if confidence is None:
        return _same(mean)
    raw = _real(nij, ni, nj, n)
    logs = [(c / total, F.ln(c / total) - F.ln(r / raw[3]) - F.ln(k / raw[3])) for (c, _, _), (_, r, k) in zip(_cells(*smooth), _cells(*raw), strict=True)]
    first = [F.when(p > 0, p * x).otherwise(0.0) for p, x in logs]
    second = [F.when(p > 0, p * x * x).otherwise(0.0) for p, x in logs]
    m1, m2 = sum(first[1:], first[0]), sum(second[1:], second[0])
    spread = F.ln(1 + (m2 - m1 * m1) / (total + 1) / (mean * mean))
    quantile = F.exp(F.ln(mean) - spread / 2 + F.sqrt(spread) * normal_quantile(1 - confidence))
    return _same(F.when(mean > 0, F.greatest(quantile, F.lit(0.0))).otherwise(F.lit(float("nan"))))


#: By the names that the command line takes; those in BAYESIAN also take alpha and confidence.
MEASURES: dict[str, Callable] = {
    "existence": existence, "pairwiseCount": pairwise_count, "weightedCount": weighted_count, "overlap": overlap, "sorensenDice": sorensen_dice, "jaccard": jaccard,
    "condprob": conditional_probability, "pwmi": pmi, "bpwmi": bayesian_pmi, "normpwmi": normalised_pmi, "normbpwmi": normalised_bayesian_pmi,
    "mutualinfo": mutual_information, "bmi": bayesian_mutual_information, "bcondprob": bayesian_conditional_probability,
}
BAYESIAN = {"bpwmi", "normbpwmi", "bmi", "bcondprob"}
#: Measures that are never negative, for which similarity has a cheaper form.
NON_NEGATIVE = {"existence", "pairwiseCount", "weightedCount", "overlap", "sorensenDice", "jaccard", "condprob", "mutualinfo", "bcondprob"}


def measure(name: str, alpha: float = 0.0, confidence: float | None = None) -> Measure:
    """A measure by name, bound to its parameters; an unknown name is an error."""
    if name not in MEASURES:
        raise ValueError(f"unknown measure {name!r}; known: {', '.join(sorted(MEASURES))}")
    return partial(MEASURES[name], alpha=alpha, confidence=confidence) if name in BAYESIAN else MEASURES[name]


def recurs(n_recurrence: Column, n_concept: Column, n: Column, rule: str = "existence", bound: float = 1) -> Column:
    """Whether a recurrence counts: existence, always, countThreshold, conceptFraction or totalFraction with its bound."""
    rules = {
        "existence": n_recurrence >= 1,
        "always": n_recurrence >= n_concept,
        "countThreshold": n_recurrence >= bound,
        "conceptFraction": n_recurrence.cast("double") / n_concept >= bound,
        "totalFraction": n_recurrence.cast("double") / n >= bound,
    }
    return rules[rule]
