"""Ranking expressions: BM25 over phrases, phrase occurrences, dot products, reciprocal ranks."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the ranking: saturation, length share, field weights, least inverse document frequency, fusion constant.
K1, B = 1.2, 0.75
HEADING_WEIGHT, TEXT_WEIGHT = 2.0, 1.0
LEAST_IDF = 1e-6
FUSION_K = 60


def idf(n: Column, df: Column) -> Column:
    value = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(value <= 0, F.lit(LEAST_IDF)).otherwise(value)


def bm25(weight: Column, heading_hits: Column, text_hits: Column, length: Column, mean_length: Column) -> Column:
    """One phrase's share of a row's score; `weight` is its inverse document frequency."""
    f = HEADING_WEIGHT * heading_hits + TEXT_WEIGHT * text_hits
    return weight * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean_length))


def phrase_hits(positions: list[Column]) -> Column:
    """How often tokens stand one after the other, from the places of each."""
    back = lambda p, n: F.transform(p, lambda x: x - n)
    shifted = [back(p, n) if n else p for n, p in enumerate(positions)]
    return F.size(functools.reduce(F.array_intersect, shifted))


def exact_sum(part: Column) -> Column:
    """The sum of numbers of at most 2^40 in size, the same in whatever order they come: two sums of whole numbers, in steps of 2^-20 and 2^-60."""
    steps = part * F.lit(float(1 << 20))
    high = F.floor(steps)
    low = F.floor((steps - high) * F.lit(float(1 << 40)))
    return F.sum(high.cast("long")) / F.lit(float(1 << 20)) + F.sum(low.cast("long")) / F.lit(float(1 << 60))


def dot(a: Column, b: Column) -> Column:
    """The product of two vectors, summed in double precision."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector at length 1 (zero stays zero)."""
    v = vector.cast("array<double>")
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(x))


def reciprocal_rank(rank: Column) -> Column:
    """The share that a place (1 is the first) gives in a fusion of rankings."""
    return 1.0 / (FUSION_K + rank)
