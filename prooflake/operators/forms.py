"""Rows that are equal up to their one number: each form is worked out once, and the others take its result.

What reads sentences and formulas here has no rule that tells one digit from another. So a row whose texts have one number is read
with nines for its digits, as many as there are, and what comes out gets its number again; rows with several numbers are read as
they stand. What has more than FORMS forms is worked out row by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut
from .translate import FORMS, let

DIGITS, NINES = "012345678", "999999999"


def masked(text: Column) -> Column:
    """The text with a nine for each digit."""
    return F.translate(text, DIGITS, NINES)


def runs(text: Column) -> Column:
    """The distinct runs of digits of a text, as they come."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)))


def number(*texts: Column) -> Column:
    """The one run of digits of all the texts, empty if there is none; null if there are two that differ."""
    return let(runs(F.concat_ws("\n", *texts)), lambda r: F.when(F.size(r) == 0, "").when(F.size(r) == 1, r[0]))


def told(text: Column, number: Column) -> Column:
    """A text read with nines, with the number of its row again."""
    return F.when(F.length(number) > 0, F.replace(text, masked(number), number)).otherwise(text)


def key(*cols: Column) -> Column:
    """One text for the values of columns, another for others; nulls are values."""
    one = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.concat(*[one(c.cast("string")) for c in cols])


def distinct(rows: DataFrame) -> DataFrame | None:
    """The distinct rows, written once; None if there are more than FORMS."""
    some = cut(rows.distinct().limit(FORMS + 1))
    return None if some.count() > FORMS else some


def met(rows: DataFrame, done: DataFrame, cols: list[str], new: list[str]) -> DataFrame:
    """rows with the columns new of done, which has a row for each value of cols."""
    found = F.broadcast(done.select(key(*[F.col(c) for c in cols]).alias("_form"), *new))
    return rows.withColumn("_form", key(*[F.col(c) for c in cols])).join(found, "_form", "left").drop("_form")


def by_form(rows: DataFrame, cols: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with the columns that work adds, which it is asked for once for each form: the values of cols, all that it reads."""
    some = distinct(rows.select(*cols))
    if some is None:
        return work(rows)
    done = cut(work(some))
    return met(rows, done, cols, [c for c in done.columns if c not in cols])
