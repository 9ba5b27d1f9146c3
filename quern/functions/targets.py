"""V2: targets over value bins, which need the normal distribution and so run on arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quern.operators.shaping import SIGMA


def erf(x: np.ndarray, terms: int = 200) -> np.ndarray:
    """The error function of an array, by the series of :func:`quern.operators.shaping.erf`."""
    z = np.clip(np.asarray(x, float), -6, 6)
    term, total = z.copy(), z.copy()
    for k in range(1, terms + 1):
        term = term * (2 * z * z / (2 * k + 1))
        total += term
    return total * np.exp(-z * z) * (2 / math.sqrt(math.pi))


def value_bins(expected: np.ndarray, bins: int, sigma: float = SIGMA) -> np.ndarray:
    """Shares of a normal around each expected score over even bins of [0, 1], cut off there and made whole."""
    edges = np.linspace(0, 1, bins + 1)
    z = (edges[None, :] - np.clip(expected, 0, 1)[:, None]) * bins / sigma / math.sqrt(2)
    below = erf(z) / 2 + 0.5
    return np.diff(below, axis=1) / np.maximum(below[:, -1:] - below[:, :1], 1e-12)


def value_targets(expected: Column, bins: int, sigma: float = SIGMA) -> Column:
    @F.pandas_udf(ArrayType(DoubleType()))
    def run(values: pd.Series) -> pd.Series:
        known = values.notna().to_numpy()
        found = iter(value_bins(values[known].to_numpy(float), bins, sigma).tolist()) if known.any() else iter(())
        return pd.Series([next(found) if k else None for k in known], dtype=object)

    return run(expected)


def outcome_targets(value: Column, bins: int, sigma: float = SIGMA) -> Column:
    """The same for results in [-1, 1]."""
    return value_targets((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value.cast("double"))) + 1) / 2, bins, sigma)
