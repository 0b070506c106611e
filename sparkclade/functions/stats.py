"""Distribution tails and counting functions, as plain functions, columns and vectorised UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by its series below a + 1 and its continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi_squared_tail_np(x: float, dof: int) -> float:
    return gamma_q(dof / 2, x / 2)


@F.pandas_udf(DoubleType())
def chi_squared_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution; null for null or without degrees of freedom."""
    return pd.Series([None if pd.isna(a) or pd.isna(k) or k <= 0 else chi_squared_tail_np(a, k) for a, k in zip(x, dof)], dtype="float64")


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def students_t_tail(t: float, dof: float) -> float:
    """Two-tailed probability of Student's t."""
    return beta_i(dof / 2, 0.5, dof / (dof + t * t))


def gamma_inverse(p: float, a: float) -> float:
    """x at which the lower regularised incomplete gamma function of ``a`` is ``p``."""
    low, high = 0.0, max(1.0, a)
    while 1 - gamma_q(a, high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - gamma_q(a, mid) < p else (low, mid)
    return (low + high) / 2


def tail_area(null: DataFrame, statistic: float, value: str = "value", *by: str) -> DataFrame:
    """(by..., p, least, most): share of the null distribution at or above ``statistic``, and its range."""
    return null.groupBy(*by).agg(F.avg((F.col(value) >= statistic).cast("int")).alias("p"), F.min(value).alias("least"), F.max(value).alias("most"))


def students_t_statistic(values: DataFrame, mean: float = 0.0, value: str = "value") -> DataFrame:
    """(t, dof): of the mean of a column against ``mean``."""
    return values.agg(((F.avg(value) - mean) / (F.stddev_samp(value) / F.sqrt(F.count(value)))).alias("t"), (F.count(value) - 1).alias("dof"))


def students_t_two(values: DataFrame, group: str, value: str = "value") -> DataFrame:
    """(group_a, group_b, t, dof): of the difference of the means of each two groups, variances pooled."""
    s = values.groupBy(group).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(value).alias("n"))
    a, b = (s.select(F.col(group).alias(f"group_{x}"), *[F.col(c).alias(c + x) for c in "mvn"]) for x in "ab")
    dof = F.col("na") + F.col("nb") - 2
    pooled = ((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / dof
    return a.join(b, F.col("group_a") < F.col("group_b")).select("group_a", "group_b", ((F.col("ma") - F.col("mb")) / F.sqrt(pooled * (1 / F.col("na") + 1 / F.col("nb")))).alias("t"), dof.alias("dof"))


def n_choose_k(n: int, k: int) -> int:
    return math.comb(n, k)


def factorial(n: Column) -> Column:
    return F.factorial(n)


def n_unrooted_trees(n_tax: int) -> int:
    """Bifurcating unrooted trees of ``n_tax`` labelled leaves: (2n - 5)!!"""
    return math.prod(range(1, 2 * n_tax - 4, 2))


def n_rooted_trees(n_tax: int) -> int:
    return n_unrooted_trees(n_tax + 1)


def n_rooted_by_internal_nodes(n_tax: int) -> list[int]:
    """Rooted trees, polytomies allowed, of ``n_tax`` leaves by their number of internal nodes, from 0.

    A leaf is added to one of the branches (a new internal node) or to an internal node.
    """
    row = [0, 1]
    for n in range(3, n_tax + 1):
        row = [0] + [(m * row[m] if m < len(row) else 0) + ((n + m - 2) * row[m - 1] if m - 1 < len(row) else 0) for m in range(1, n)]
    return row


def n_unrooted_by_internal_nodes(n_tax: int) -> list[int]:
    return n_rooted_by_internal_nodes(n_tax - 1)


def polar_to_square(angle: Column, length: Column) -> tuple[Column, Column]:
    return length * F.cos(angle), length * F.sin(angle)


def square_to_polar(x: Column, y: Column) -> tuple[Column, Column]:
    return F.pmod(F.atan2(y, x), F.lit(2 * math.pi)), F.hypot(x, y)


def lower_to_upper_triangle(values: list[float], dim: int) -> list[float]:
    """The lower triangle of a symmetric matrix, by rows without the diagonal, as its upper one."""
    m = np.zeros((dim, dim))
    m[np.tril_indices(dim, -1)] = values
    return m.T[np.triu_indices(dim, 1)].tolist()
