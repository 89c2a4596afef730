"""Association and keyness measures as column expressions over a two-by-two table.

o11 study frequency, n1 study size, o21 reference frequency, n2 reference size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The statistic's least score by default, and the bounds of one, two and three stars.
THRESHOLDS = {"log_likelihood": 6.63, "chi_squared": 6.63, "log_ratio": 1.0, "dice": 0.0, "mi": 0.0, "mi3": 0.0, "t_score": 1.96, "simple": 0.0, "fisher": 2.0}
STARS = ((10.83, "***", 0.001), (6.64, "**", 0.01), (3.84, "*", 0.05))


def _cells(o11: Column, n1: Column, o21: Column, n2: Column) -> list[tuple[Column, Column]]:
    """Observed and expected counts of the four cells."""
    o11, n1, o21, n2 = (c.cast("double") for c in (o11, n1, o21, n2))
    n, c1, c2 = n1 + n2, o11 + o21, n1 + n2 - o11 - o21
    return [(o11, n1 * c1 / n), (n1 - o11, n1 * c2 / n), (o21, n2 * c1 / n), (n2 - o21, n2 * c2 / n)]


def log_likelihood(o11, n1, o21, n2) -> Column:
    return 2 * sum((F.when((o > 0) & (e > 0), o * F.log(o / e)).otherwise(0.0) for o, e in _cells(o11, n1, o21, n2)), F.lit(0.0))


def chi_squared(o11, n1, o21, n2) -> Column:
    """With Yates' correction, which is not cut off at zero."""
    return sum((F.when(e > 0, F.pow(F.abs(o - e) - 0.5, F.lit(2.0)) / e).otherwise(0.0) for o, e in _cells(o11, n1, o21, n2)), F.lit(0.0))


def log_ratio(o11, n1, o21, n2) -> Column:
    return F.log2(((o11 + 0.5) / (n1 + 1)) / ((o21 + 0.5) / (n2 + 1)))


def dice(o11, n1, o21, n2) -> Column:
    return F.when(n1 + o11 + o21 > 0, 2.0 * o11 / (n1 + o11 + o21)).otherwise(0.0)


def mi(o11, n1, o21, n2, power: int = 1) -> Column:
    o, a, b = o11.cast("double"), n1.cast("double"), (o11 + o21).cast("double")
    top = o
    for _ in range(power - 1):
        top = top * o
    return F.when((o > 0) & (a > 0) & (b > 0), F.log2(top * (a + n2.cast("double")) / (a * b))).otherwise(0.0)


def mi3(o11, n1, o21, n2) -> Column:
    return mi(o11, n1, o21, n2, 3)


def t_score(o11, n1, o21, n2) -> Column:
    o, a, b = o11.cast("double"), n1.cast("double"), (o11 + o21).cast("double")
    return F.when(o > 0, (o - a * b / (a + n2)) / F.sqrt(o)).otherwise(0.0)


def simple(o11, n1, o21, n2) -> Column:
    """Ratio of the shares; a million times the study's where the reference has none."""
    s, r = o11.cast("double") / n1, o21.cast("double") / n2
    return F.when(o21 > 0, s / r).otherwise(s * 1e6)


def log_dice(joint, first, second) -> Column:
    return F.when(joint > 0, F.round(14 + F.log2(2.0 * joint / (first + second)), 3)).otherwise(0.0)


def _log_weights(a: int, end: int, row: int, column: int, n: int) -> np.ndarray:
    """Logarithms of how likely the tables after `a`, up to `end`, are against that of `a`: sums of the logarithms of
    quotients of neighbours, in blocks, until they add nothing to a double."""
    sign, blocks, last = (1 if end >= a else -1), [np.zeros(0)], 0.0
    while a != end and last > -745:
        x = np.arange(a, a + sign * min(abs(end - a), 1 << 14), sign, dtype=np.float64)
        if sign > 0:
            up = (row - x) * (column - x) / ((x + 1) * (n - row - column + x + 1))
        else:
            up = x * (n - row - column + x) / ((row - x + 1) * (column - x + 1))
        blocks.append(last + np.cumsum(np.log(up)))
        last, a = blocks[-1][-1], a + sign * len(x)
    return np.concatenate(blocks)


def fisher_p(o11: int, n1: int, o21: int, n2: int) -> float:
    """Two-sided exact probability: all tables as likely as this one or less, over all tables. 0 beyond a double's reach."""
    column, n = o11 + o21, n1 + n2
    low, high = max(0, column - n2), min(n1, column)
    mode = min(max((n1 + 1) * (column + 1) // (n + 2), low), high)
    up, down = (_log_weights(mode, end, n1, column, n) for end in (high, low))
    side, far = (up, o11 - mode) if o11 >= mode else (down, mode - o11)
    if far > len(side):
        return 0.0
    here = side[far - 1] if far else 0.0
    logs = np.concatenate([down[::-1], [0.0], up])
    weights = np.exp(logs)
    return min(1.0, float(weights[logs <= here + 1e-7].sum() / weights.sum()))


@F.pandas_udf(T.DoubleType())
def fisher(o11: pd.Series, n1: pd.Series, o21: pd.Series, n2: pd.Series) -> pd.Series:
    """-log10 of the exact probability: few distinct tables, so each is worked out once per batch."""
    table = pd.DataFrame({"a": o11, "b": n1, "c": o21, "d": n2})
    seen = {k: -math.log10(fisher_p(*map(int, k)) + 1e-300) for k in set(table.itertuples(index=False, name=None))}
    return pd.Series([seen[k] for k in table.itertuples(index=False, name=None)], dtype="float64")


MEASURES = {"log_likelihood": log_likelihood, "chi_squared": chi_squared, "log_ratio": log_ratio, "dice": dice, "mi": mi, "mi3": mi3, "t_score": t_score, "simple": simple, "fisher": fisher}


def stars(score: Column, measure: str) -> tuple[Column, Column]:
    """(significance, p_value): bounds for the two tests, else nothing and zero."""
    if measure not in ("log_likelihood", "chi_squared"):
        return F.lit(""), F.lit(0.0)
    mark, p = F.lit(""), F.lit(1.0)
    for bound, m, v in reversed(STARS):
        mark, p = F.when(score >= bound, m).otherwise(mark), F.when(score >= bound, v).otherwise(p)
    return mark, p
