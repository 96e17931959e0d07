"""Spans, labels, word matches and JSON out of free text, as Column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .morph import lemma


def span(text: Column, snippet: Column) -> Column:
    """struct(start, end) of the first place where the snippet's words stand in text, whatever white space is between them;
    null if there is none or the snippet has no words. Offsets count characters from 0."""
    quoted = F.transform(F.split(F.trim(F.regexp_replace(snippet, r"\s+", " ")), " "), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    pattern = F.when(F.rlike(snippet, F.lit(r"\S")), F.array_join(quoted, r"\s+"))
    start = F.regexp_instr(text, pattern) - 1
    return F.when(start >= 0, F.struct(start.alias("start"), (start + F.length(F.regexp_substr(text, pattern))).alias("end")))


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 3)), F.lit("..."))).otherwise(text)


def xml_escaped(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def word_matches(word: Column, lemmas: Column) -> Column:
    """Whether a word stands among lemmas: itself, its lemma, or one with the same first four letters."""
    root = lambda base: F.exists(lemmas, lambda w: (F.length(w) >= 4) & (F.left(w, F.lit(4)) == F.left(base, F.lit(4))))
    match = lambda base: F.array_contains(lemmas, word) | F.array_contains(lemmas, base) | ((F.length(base) >= 4) & root(base))
    return F.transform(F.array(lemma(word)), match)[0]


def unfenced(text: Column) -> Column:
    """Text without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(json)?\s*", ""), r"\s*```$", ""))


_MARKS = re.compile(r'"(?:\\.|[^"\\])*(?:"|$)|[\[\]{}]', re.S)


def first_balanced(text: str | None) -> str | None:
    """First balanced JSON object of a text, else its first balanced array, else None. Brackets in strings don't count."""
    for pair in ("{}", "[]"):
        start = (text or "").find(pair[0])
        depth = 0
        for m in _MARKS.finditer(text, start) if start >= 0 else ():
            depth += (m[0] == pair[0]) - (m[0] == pair[1])
            if m[0] == pair[1] and depth == 0:
                return text[start : m.end()]
    return None


def _balanced(batch: pd.Series) -> pd.Series:
    return batch.map(first_balanced)


def balanced(text: Column) -> Column:
    """first_balanced of each text."""
    return F.pandas_udf(_balanced, StringType())(text)
