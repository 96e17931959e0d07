"""Rounding as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A double from 0.008 to 1 is a whole number of these parts.
PARTS = 1 << 60


def rounded(x: Column, places: int) -> Column:
    """A double from 0 to 1 at so many decimal places, by its exact binary value and not by its decimal spelling: 0.575, which
    is a little less than that, gives 0.57. Exact halves go to the even digit."""
    whole = lambda n: F.lit(n).cast("decimal(20,0)")
    twice = (x * float(PARTS)).cast("long").cast("decimal(20,0)") * F.lit(2 * 10**places).cast("decimal(6,0)")
    halves, rest = F.call_function("div", twice, whole(PARTS)), twice % whole(PARTS)
    low = F.call_function("div", halves, F.lit(2).cast("long"))
    up = (halves % 2 == 1) & ((rest > 0) | (low % 2 == 1))
    return (low + F.when(up, 1).otherwise(0)) / float(10**places)


def rounded_sql(x: str, places: int) -> str:
    """The same in SQL with 128-bit integers."""
    twice = f"(({x}) * {PARTS}::DOUBLE)::HUGEINT * {2 * 10**places}"
    return f"((({twice}) // {PARTS}) // 2 + CASE WHEN (({twice}) // {PARTS}) % 2 = 1 AND (({twice}) % {PARTS} > 0 OR ((({twice}) // {PARTS}) // 2) % 2 = 1) THEN 1 ELSE 0 END) / {float(10**places)}"
