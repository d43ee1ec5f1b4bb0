"""Folds that put out elements."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hippolake.functions import arrays


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 128 * 128 + 300, 40_000])
def test_running_sums(spark, n):
    row = spark.range(1).select((F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")).alias("x"))
    step = lambda at, x: (at + x, F.when(x % 3 != 0, at + x))
    got = row.select(arrays.scan(F.col("x"), F.lit(0).cast("long"), lambda at, x: step(at, x.cast("long")), "bigint").alias("s")).first().s
    total, expected = 0, []
    for x in range(1, n + 1):
        total += x
        if x % 3:
            expected.append(total)
    assert got == expected
