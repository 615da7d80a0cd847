"""Formulas of paired inference that need no table."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence

import numpy as np

MDD_FACTOR = 2.801585218112968  # quantiles .975 and .80 of the normal distribution
RESAMPLES = 10_000
TIE = 1e-12


def percentile_indices(resamples: int) -> tuple[int, int]:
    """Places (from 0) of the 2.5 % and 97.5 % order statistics, by the (R + 1) convention."""
    low = math.floor(0.025 * (resamples + 1) + 1e-9) - 1
    high = math.ceil(0.975 * (resamples + 1) - 1e-9) - 1
    return max(0, low), min(resamples - 1, high)


def minimum_detectable_difference(standard_error: float) -> float:
    return MDD_FACTOR * standard_error


def mcnemar_exact(b: int, c: int) -> float:
    """Two-sided exact binomial p of discordant counts, at most 1."""
    n = b + c
    tail = sum(math.comb(n, i) for i in range(min(b, c) + 1))
    return 1.0 if not n else min(1.0, float(2 * tail / 2**n))


def binomial_standard_error(rate: float, count: int) -> float:
    return math.sqrt(rate * (1 - rate) / count) if count else 0.0


def expected_max_of_k(k: int, panels: int = 4000, bound: float = 8.0) -> float:
    """Expected largest of k standard normals, by Simpson's rule."""
    if k <= 1:
        return 0.0
    step = 2 * bound / panels
    total = 0.0
    for i in range(panels + 1):
        x = -bound + i * step
        density = math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        below = 0.5 * math.erfc(-x / math.sqrt(2))
        weight = 1 if i in (0, panels) else 4 if i % 2 else 2
        total += weight * x * k * density * below ** (k - 1)
    return total * step / 3


def winners_curse_correction(standard_error: float, k: int) -> float:
    return standard_error * expected_max_of_k(k)


def holm(p_values: Sequence[float]) -> list[float]:
    order = sorted(range(len(p_values)), key=lambda i: (p_values[i], i))
    out, running = [0.0] * len(p_values), 0.0
    for rank, i in enumerate(order):
        running = max(running, min(1.0, (len(p_values) - rank) * p_values[i]))
        out[i] = running
    return out


def exact_sign_flip(differences: Sequence[float]) -> float:
    """Two-sided p over all sign patterns of at most 20 differences."""
    if len(differences) > 20:
        raise ValueError("exact enumeration takes at most 20 differences")
    n = max(1, len(differences))
    observed = abs(sum(differences)) / n
    count = sum(
        abs(sum(-d if mask >> i & 1 else d for i, d in enumerate(differences))) / n >= observed - TIE for mask in range(1 << len(differences))
    )
    return count / (1 << len(differences))


POINTS = 1 << 16  # of the transform that are summed at once


def lattice_points(sizes: Mapping[int, int], observed: int, first: int, last: int) -> float:
    """What the points first..last-1 of 1..total add to P(|sum| < observed), times 2 total + 1.

    The sum of sizes under random signs has the characteristic function prod cos(size x)^count. On 2 total + 1 points around
    the circle, of which x and -x add the same, its inverse transform summed from -(observed - 1) to observed - 1 is a sum
    over points of that product times a Dirichlet kernel.
    """
    n = 2 * sum(v * m for v, m in sizes.items()) + 1
    at = np.arange(first, last, dtype=np.int64)
    product = np.ones(len(at))
    for v, m in sorted(sizes.items(), key=lambda x: -x[1]):
        product *= np.cos(2 * np.pi / n * (at * v % n)) ** m
        at, product = at[keep := np.abs(product) > 1e-40], product[keep]  # what is left out adds less than 1e-40 of the sum's span
    kernel = np.sin(np.pi / n * (at * (2 * observed - 1) % (2 * n))) / np.sin(np.pi / n * at)
    return float(2 * (product * kernel).sum())


def reduced(counts: Mapping[int, int]) -> tuple[dict[int, int], int]:
    """Sizes of the differences with their counts, and the absolute sum of all, both in units of the sizes' divisor."""
    sizes: dict[int, int] = {}
    for d, m in counts.items():
        if d and m:
            sizes[abs(d)] = sizes.get(abs(d), 0) + m
    unit = math.gcd(*sizes) or 1
    return {v // unit: m for v, m in sizes.items()}, abs(sum(d * m for d, m in counts.items())) // unit


def two_sided(inside: float, total: int, observed: int) -> float:
    """p from the summed points: one minus the chance of a smaller absolute sum."""
    return min(1.0, max(0.0, 1 - (2 * observed - 1 + inside) / (2 * total + 1))) if observed else 1.0


def sign_flip_lattice(counts: Mapping[int, int]) -> float:
    """Two-sided p over all sign patterns of any number of whole differences; counts: how often each occurs.

    Exact but for rounding, whose error is near 1e-12; POINTS points are held at once."""
    sizes, observed = reduced(counts)
    total = sum(v * m for v, m in sizes.items())
    inside = sum(lattice_points(sizes, observed, a, min(a + POINTS, total + 1)) for a in range(1, total + 1, POINTS)) if observed else 0.0
    return two_sided(inside, total, observed)


def pair_seed(baseline: str, candidate: str, label: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{baseline}\0{candidate}\0{label}".encode()).digest()[:8], "big")


CRITERIA = ("holm_significance", "practical_floor", "hr10_exchange_rate")
ALPHA, FLOOR, EXCHANGE = 0.05, 0.01, 0.0667


def failed_criteria(holm_p: float, corrected_delta: float, hit_rate_delta: float, mrr_delta: float, mttc_delta: float) -> tuple[str, ...]:
    """What keeps a candidate from being a win, in the order of CRITERIA; a lost hit rate must be paid for in rank."""
    met = (holm_p < ALPHA, corrected_delta >= FLOOR, hit_rate_delta >= 0 or (mrr_delta > 0 and mrr_delta > EXCHANGE * abs(mttc_delta)))
    return tuple(name for name, ok in zip(CRITERIA, met, strict=True) if not ok)


def classify_verdict(holm_p: float, delta: float, detectable: float, failed: Sequence[str]) -> str:
    """A win exactly when nothing failed; else by what the data can show."""
    return "win" if not failed else "significant, below ship bar" if holm_p < ALPHA else "not detectable" if abs(delta) < detectable else "no difference"
