"""Columns that the vector operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether an array column is a vector: not null, no null or non-finite component, not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(rows, kind: str = "f8") -> np.ndarray:
    """Arrays of one length as the rows of a matrix."""
    return np.array(list(rows), dtype=kind)
