"""Signatures of square grey grids as Column expressions: hash bits, packed words, distances, turned and mirrored variants."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE = 8


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def median(values: Column) -> Column:
    """The middle of the values, or the mean of the two in the middle."""
    half = lambda s: (F.get(s, ((F.size(s) - 1) / 2).cast("int")) + F.get(s, (F.size(s) / 2).cast("int"))) / 2
    return let(F.array_sort(values), half)


def above(values: Column, limit: Column) -> Column:
    """A bit for each value: whether it is over the limit."""
    return let(limit, lambda m: F.transform(values, lambda x: (x > m).cast("int")))


def ahash_bits(px: Column) -> Column:
    """Over the mean."""
    return above(px, total(px) / F.size(px))


def dhash_bits(px: Column, width: int = SIDE, height: int = SIDE) -> Column:
    """Over the left neighbour; a row of width pixels gives width - 1 bits."""
    at = [r * width + c for r in range(height) for c in range(width - 1)]
    return F.transform(F.lit(at), lambda i: (F.get(px, i + 1) > F.get(px, i)).cast("int"))


@cache
def cosine_matrix(n: int) -> np.ndarray:
    """Rows are the orthonormal cosine basis (type two) of n points."""
    k, x = np.mgrid[0:n, 0:n]
    return np.cos(math.pi * (2 * x + 1) * k / (2 * n)) * np.where(k == 0, math.sqrt(1 / n), math.sqrt(2 / n))


@cache
def cosine_weights(n: int, low: int) -> tuple[tuple[float, ...], ...]:
    """For each of the low x low lowest frequencies, the weight of each of n x n pixels."""
    m = cosine_matrix(n)[:low]
    return tuple(tuple(float(v) for v in row) for row in np.einsum("ux,vy->uvxy", m, m).reshape(low * low, n * n).round(12))


def phash_bits(px: Column, side: int = SIDE, low: int = SIDE) -> Column:
    """Lowest frequencies, the constant one with them, over their median."""
    weights = F.lit([list(row) for row in cosine_weights(side, low)])
    freq = F.transform(weights, lambda w: F.round(total(F.zip_with(px, w, lambda a, b: a * b)), 9))
    return let(freq, lambda f: above(f, median(f)))


def block_means(px: Column, side: int = SIDE, block: int = 2) -> Column:
    """Means of block x block squares: what two levels of an averaging wavelet leave in its low corner, for block 4."""
    corner = [r * side + c for r in range(0, side, block) for c in range(0, side, block)]
    inner = [r * side + c for r in range(block) for c in range(block)]
    return F.transform(F.lit(corner), lambda i: F.aggregate(F.lit(inner), F.lit(0.0), lambda a, j: a + F.get(px, i + j)) / len(inner))


def whash_bits(px: Column, side: int = SIDE, block: int = 2) -> Column:
    return let(block_means(px, side, block), lambda m: above(m, median(m)))


BITS = {"ahash": ahash_bits, "dhash": dhash_bits, "phash": phash_bits, "whash": whash_bits}


def hash_bits(px: Column, algorithm: str = "phash") -> Column:
    if algorithm not in BITS:
        raise ValueError(f"unknown hash algorithm {algorithm!r}; known: {', '.join(BITS)}")
    return BITS[algorithm](px)


def bit_string(bits: Column) -> Column:
    return F.array_join(F.transform(bits, lambda b: b.cast("string")), "")


def pack(bits: Column) -> Column:
    """Up to 64 bits as a long, first bit highest."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("long")))


def pack_words(bits: Column) -> Column:
    """Any number of bits, as longs of 64 each."""
    begins = F.sequence(F.lit(1), F.greatest(F.size(bits), F.lit(1)), F.lit(64))
    return F.transform(begins, lambda i: pack(F.slice(bits, i, F.lit(64))))


def word_to_blob(word: Column) -> Column:
    return F.unhex(F.lpad(F.hex(word), 16, "0"))


def blob_to_word(blob: Column) -> Column:
    return F.conv(F.hex(blob), 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def hamming_words(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, d: s + d)


@cache
def variant_places(side: int = SIDE) -> tuple[tuple[int, ...], ...]:
    """Where each pixel comes from, in the eight variants: each quarter turn, and it mirrored."""
    own = np.arange(side * side).reshape(side, side)
    turned = [np.rot90(own, k) for k in range(4)]
    return tuple(tuple(int(i) for i in v.ravel()) for t in turned for v in (t, np.fliplr(t)))


def variants(px: Column, side: int = SIDE) -> Column:
    return F.transform(F.lit([list(p) for p in variant_places(side)]), lambda p: F.transform(p, lambda i: F.get(px, i)))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def normalized(v: Column) -> Column:
    """Of unit length; a zero vector stays as it is."""
    return let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def share_histogram(v: Column) -> Column:
    """Absolute values that add up to one; all zero stay zero."""
    sizes = F.transform(v, lambda x: F.abs(x))
    return let(total(sizes), lambda s: F.transform(sizes, lambda x: F.when(s > 0, x / s).otherwise(x)))


def histogram_similarity(a: Column, b: Column) -> Column:
    """The histograms' common part; a missing one has none."""
    return F.coalesce(total(F.zip_with(a, b, lambda x, y: F.least(x, y))), F.lit(0.0))


def hamming_score(distance: Column, bits: int = 64) -> Column:
    return F.lit(1.0) - distance / F.lit(float(bits))


def cosine_score(cosine: Column) -> Column:
    return (cosine + 1) / 2


def blend(pattern: Column, color: Column, alpha: float) -> Column:
    return F.lit(1 - alpha) * pattern + F.lit(alpha) * F.coalesce(color, F.lit(0.0))
