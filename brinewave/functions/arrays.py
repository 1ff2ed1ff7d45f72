"""Column functions over arrays of samples; all of them run inside the JVM, a row at a time and without shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column, f=lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + f(v))


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def moment(x: Column, k: int) -> Column:
    """Central moment of order k, population form."""
    m = mean(x)
    return total(F.transform(x, lambda v: F.pow(v - m, F.lit(k)))) / F.size(x)


def differences(x: Column) -> Column:
    n = F.size(x)
    return F.zip_with(F.slice(x, F.lit(2), n - 1), F.slice(x, F.lit(1), n - 1), lambda a, b: a - b)


def dft_energy(x: Column, k: int, n: int) -> Column:
    """Squared magnitude of bin k of the discrete Fourier transform of n samples."""
    turn = 2 * math.pi * k / n
    re = F.aggregate(F.transform(x, lambda v, j: v * F.cos(F.lit(turn) * j)), F.lit(0.0), lambda s, v: s + v)
    im = F.aggregate(F.transform(x, lambda v, j: v * F.sin(F.lit(turn) * j)), F.lit(0.0), lambda s, v: s + v)
    return re * re + im * im


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
