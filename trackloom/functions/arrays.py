"""Vectors and small matrices as Column expressions over arrays of doubles; a matrix is an array of its rows.

All are whole-row functions of the JVM. A null input gives null; the inverse and the logarithm of the determinant of a matrix
that is not positive definite are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def times(m: Column, x: Column) -> Column:
    """Matrix times vector."""
    return F.transform(m, lambda row: dot(row, x))


def quadratic_form(m: Column, x: Column) -> Column:
    """x' m x"""
    return dot(times(m, x), x)


def outer(a: Column, b: Column) -> Column:
    return F.transform(a, lambda x: F.transform(b, lambda y: x * y))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda p, q: p + q))


def diagonal(*values: Column) -> Column:
    return F.array(*(F.array(*(v if i == k else F.lit(0.0) for k in range(len(values)))) for i, v in enumerate(values)))


def _at(m: Column, i: int, k: int) -> Column:
    return F.get(F.get(m, F.lit(i)), F.lit(k))


def determinant(m: Column, size: int) -> Column:
    """Of a matrix of size 2 or 3."""
    a = lambda i, k: _at(m, i, k)
    if size == 2:
        return a(0, 0) * a(1, 1) - a(0, 1) * a(1, 0)
    minor = lambda k: a(1, (k + 1) % 3) * a(2, (k + 2) % 3) - a(1, (k + 2) % 3) * a(2, (k + 1) % 3)
    return a(0, 0) * minor(0) + a(0, 1) * minor(1) + a(0, 2) * minor(2)


def positive_definite(m: Column, size: int) -> Column:
    """By the leading minors of a symmetric matrix of size 2 or 3."""
    fine = (_at(m, 0, 0) > 0) & (determinant(m, 2) > 0)
    return fine if size == 2 else fine & (determinant(m, 3) > 0)


def inverse(m: Column, size: int) -> Column:
    """Of a positive definite matrix of size 2 or 3, by cofactors."""
    a, d = lambda i, k: _at(m, i, k), determinant(m, size)
    if size == 2:
        cofactors = [[a(1, 1), -a(0, 1)], [-a(1, 0), a(0, 0)]]
    else:
        c = lambda i, k: a((k + 1) % 3, (i + 1) % 3) * a((k + 2) % 3, (i + 2) % 3) - a((k + 1) % 3, (i + 2) % 3) * a((k + 2) % 3, (i + 1) % 3)
        cofactors = [[c(i, k) for k in range(3)] for i in range(3)]
    return F.when(positive_definite(m, size), F.array(*(F.array(*(x / d for x in row)) for row in cofactors)))


def log_determinant(m: Column, size: int) -> Column:
    return F.when(positive_definite(m, size), F.ln(determinant(m, size)))


def mahalanobis(m: Column, x: Column, size: int) -> Column:
    """Squared distance of x under the covariance m."""
    return quadratic_form(inverse(m, size), x)


def log_likelihood(m: Column, x: Column, size: int) -> Column:
    """Of a Gaussian innovation x of covariance m."""
    import math

    return -0.5 * (mahalanobis(m, x, size) + log_determinant(m, size) + size * math.log(2 * math.pi))


def log_sum_exp(values: Column) -> Column:
    """Logarithm of a sum of exponentials, scaled by the largest; of no values null."""
    top = F.array_max(values)
    return top + F.ln(_sum(F.transform(values, lambda x: F.exp(x - top))))


def posterior(prior: Column, log_likelihoods: Column) -> Column:
    """Probabilities in proportion to prior times likelihood."""
    joint = F.zip_with(prior, log_likelihoods, lambda p, v: F.ln(p) + v)
    total = log_sum_exp(joint)
    return F.transform(joint, lambda x: F.exp(x - total))


def polar_covariance(r: Column, az: Column, el: Column, s_r: Column, s_az: Column, s_el: Column) -> Column:
    """Covariance of a place measured by range, azimuth (from x to y) and elevation with independent errors: J R J'."""
    ce, se, ca, sa = F.cos(el), F.sin(el), F.cos(az), F.sin(az)
    turned = F.array(F.array(ce * ca, -r * ce * sa, -r * se * ca), F.array(ce * sa, r * ce * ca, -r * se * sa), F.array(se, F.lit(0.0), r * ce))
    variances = F.array(s_r * s_r, s_az * s_az, s_el * s_el)
    return F.transform(turned, lambda a: F.transform(turned, lambda b: dot(F.zip_with(a, variances, lambda x, v: x * v), b)))
