"""Bounded, deterministic samples of labelled rows, drawn without gathering a group anywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash values are compared with a share of this many.
PARTS = 1 << 30


def draw(df: DataFrame, by: str, most: int, key: str = "doc_id") -> DataFrame:
    """About ``most`` rows of each value of ``by`` (all, if fewer), by a hash of the key; null values are left out.

    ``by`` must have few values (languages, classes): one count a value comes to the driver. A share is chosen for each
    value such that about 0.9 ``most`` rows are expected.
    """
    counts = {r[0]: r[1] for r in df.where(F.col(by).isNotNull()).groupBy(by).count().collect()}
    place = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(PARTS))
    tests = [(F.col(by) == F.lit(v)) & (place < F.lit(PARTS if n <= most else int(0.9 * most / n * PARTS))) for v, n in sorted(counts.items())]
    return df.where(reduce(lambda a, b: a | b, tests, F.lit(False)))
