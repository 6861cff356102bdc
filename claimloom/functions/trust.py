"""Evidential arithmetic on logit arrays (array<double>)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def evidence(z: Column) -> Column:
    """Softplus of each logit."""
    return F.transform(z, softplus)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def strength(e: Column) -> Column:
    return total(e) + F.size(e)


def confidence(e: Column) -> Column:
    return (F.array_max(e) + 1.0) / strength(e)


def probabilities(e: Column) -> Column:
    """The expected probability of each class."""
    s = strength(e)
    return F.transform(e, lambda x: (x + 1.0) / s)


def vacuity(e: Column) -> Column:
    return F.size(e) / strength(e)


@F.pandas_udf(DoubleType())
def dissonance(e: pd.Series) -> pd.Series:
    """Conflict among the belief masses of all pairs of classes; rows of one size are worked out together. Null where a mass is."""
    out, rows = np.full(len(e), np.nan), e.to_numpy()
    sizes = np.array([-1 if x is None else len(x) for x in rows], np.int64)
    for k in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == k)
        mass = np.array([rows[i] for i in at.tolist()], np.float64).T
        belief = mass / (mass.sum(axis=0) + k)
        conflict = np.zeros(len(at))
        for i in range(k):
            weighed, others = np.zeros(len(at)), np.zeros(len(at))
            for j in range(k):
                if j != i:
                    weighed += belief[j] * (1.0 - np.abs(belief[i] - belief[j]) / (belief[i] + belief[j] + 1e-10))
                    others += belief[j]
            conflict += belief[i] * weighed / (others + 1e-10)
        out[at] = conflict
    return pd.Series(out)


def at_temperature(z: Column, temperature: float) -> Column:
    """Logits divided by a temperature held within 0.25 and 5; 1 leaves them as they are."""
    t = min(5.0, max(0.25, temperature))
    return z if t == 1.0 else F.transform(z, lambda x: x / t)
