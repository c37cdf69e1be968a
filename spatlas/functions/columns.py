"""Column functions that several operators share."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Quadrant codes and their labels.
LABELS = {0: "not valid", 1: "HH", 2: "LH", 3: "LL", 4: "HL", 5: "island"}


def hashed_int(*parts: Column) -> Column:
    """A number under 2 ** 52 from the md5 of the parts joined by colons: the same on any cluster layout."""
    key = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("long")


def quadrant(z: Column, lag: Column) -> Column:
    """1 HH, 2 LH, 3 LL, 4 HL; only values strictly above 0 are high."""
    high, near = z > 0, lag > 0
    return F.when(high & near, 1).when(~high & near, 2).when(~high & ~near, 3).otherwise(4).cast("byte")


def quadrant_label(code: Column) -> Column:
    out = F.when(code == 0, LABELS[0])
    for k in range(1, 6):
        out = out.when(code == k, LABELS[k])
    return out


def significant(p: Column, alpha: float = 0.05) -> Column:
    return p <= alpha


def cluster_label(label: Column, is_significant: Column) -> Column:
    return F.when(is_significant, label).otherwise("not significant")


def inferential_mask(valid: Column, island: Column, is_significant: Column, code: Column) -> Column:
    """Cells that may be reported as clusters: valid, with neighbours, significant and in a quadrant."""
    return F.coalesce(valid & ~island & is_significant & code.between(1, 4), F.lit(False))


def _tails(z: pd.Series) -> pd.Series:
    x = np.abs(z.to_numpy(float)) / math.sqrt(2)
    return pd.Series(np.frompyfunc(math.erfc, 1, 1)(x).astype(float))


def two_sided_p(z: Column | str) -> Column:
    """2 * P(Z > |z|); Spark has no complementary error function. It runs on aggregated rows only."""
    return F.pandas_udf(_tails, T.DoubleType())(z)
