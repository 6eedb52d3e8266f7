"""Functions of Columns, numpy arrays or numbers, so that one formula serves all three."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _one(name: str):
    of_column, of_array, of_number = getattr(F, name), getattr(np, name), getattr(math, name)

    def f(x):
        if not isinstance(x, np.ndarray):
            return of_column(x) if isinstance(x, Column) else of_number(x)
        with np.errstate(all="ignore"):  # what is too large is infinite, as in Spark
            return of_array(x)

    f.__name__ = name
    return f


cos, exp, log, sqrt = (_one(name) for name in ("cos", "exp", "log", "sqrt"))


def where(condition, yes, no):
    """``yes`` where the condition holds, else ``no``."""
    if isinstance(condition, Column):
        return F.when(condition, yes).otherwise(no)
    return np.where(condition, yes, no) if isinstance(condition, np.ndarray) else yes if condition else no


def greatest(a, b):
    if isinstance(a, Column) or isinstance(b, Column):
        return F.greatest(*[x if isinstance(x, Column) else F.lit(x) for x in (a, b)])
    return np.maximum(a, b)
