"""Word forms as Column expressions: lemma, plural, name words, predicate and constant keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lemmatizer's irregular forms and its suffix rules (suffix, replacement, least word length), first match
# in this order.
IRREGULAR = {"people": "person", "children": "child", "men": "man", "women": "woman", "feet": "foot", "teeth": "tooth", "mice": "mouse", "geese": "goose"}
SUFFIXES = [
    ("ization", "", 8), ("isation", "", 8), ("ational", "", 9), ("ation", "", 6), ("ition", "ite", 7), ("ness", "", 6), ("ments", "ment", 7),
    ("ment", "", 6), ("ities", "ity", 7), ("ity", "", 6), ("ence", "ent", 6), ("ance", "ant", 6), ("encies", "ent", 8), ("ancies", "ant", 8),
    ("ism", "", 5), ("ist", "", 5), ("ors", "", 5), ("ers", "", 5), ("or", "", 5), ("er", "", 5), ("ions", "", 6), ("ion", "", 6), ("ally", "al", 6),
    ("ical", "ic", 6), ("ies", "y", 5), ("ses", "s", 5), ("es", "", 5), ("s", "", 4),
]
# Nouns that add nothing to a predicate, number words, and negative prefixes in the order they are tried.
LIGHT_HEADS = ("number", "creature", "thing", "object", "entity", "being", "individual")
NUMBER_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
NEGATIVE_PREFIXES = ("non", "un", "im", "ir", "dis", "in")


def strip_once(word: Column) -> Column:
    """One pass of the lemmatizer: an irregular form, else the first suffix rule that fits. The rules are gone through only
    for words that end in one of their suffixes."""
    rules = F.array(*[F.struct(F.lit(x).alias("suffix"), F.lit(new).alias("new"), F.lit(max(least, len(x) + 3 - len(new))).alias("least")) for x, new, least in SUFFIXES])
    fits = F.slice(F.filter(rules, lambda r: (F.length(word) >= r["least"]) & F.endswith(word, r["suffix"])), 1, 1)
    stems = F.transform(fits, lambda r: F.concat(F.left(word, F.length(word) - F.length(r["suffix"])), r["new"]))
    repaired = F.transform(stems, lambda x: F.when((F.length(x) >= 4) & x.endswith("i"), F.concat(F.left(x, F.length(x) - 1), F.lit("y"))).otherwise(x))
    irregular = F.element_at(F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv]), word)
    ends = F.rlike(word, F.lit(f"(?:{'|'.join(x for x, _, _ in SUFFIXES)})\\z"))
    return F.when(ends, F.coalesce(irregular, F.get(repaired, F.lit(0)), word)).otherwise(F.coalesce(irregular, word))


def words_of(name: Column) -> Column:
    """Lower-case words of a CamelCase or snake_case name."""
    return F.transform(F.regexp_extract_all(name, F.lit("[A-Z][a-z0-9]*|[a-z0-9]+"), F.lit(0)), F.lower)


def plural_strip(word: Column) -> Column:
    n = F.length(word)
    short = lambda k: F.substr(word, F.lit(1), n - k)
    return (
        F.when((n > 4) & word.endswith("es") & F.rlike(word, F.lit("(ses|xes|zes|ches|shes)$")), short(2))
        .when((n > 4) & word.endswith("ies"), F.concat(short(3), F.lit("y")))
        .when((n > 3) & word.endswith("s") & ~word.endswith("ss"), short(1))
        .otherwise(word)
    )


def const_key(name: Column) -> Column:
    """One spelling for code-like constants; other names in lower case."""
    low = F.lower(name)
    word = F.regexp_extract(low, r"^([a-z]+)_?\d", 1)
    digit = F.element_at(F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv]), F.when(word.isin(*NUMBER_WORDS), word))
    n = F.when(digit.isNotNull(), F.concat(digit, F.substr(low, F.length(word) + 1))).otherwise(low)
    code = F.rlike(n, F.lit(r"^[a-z]{0,3}\d"))
    spelled = digit.isNotNull() | n.contains("_") | (F.length(F.regexp_replace(n, "[^0-9]", "")) >= 2)
    core = F.regexp_replace(F.regexp_replace(n, "[^0-9a-z]", ""), r"^[a-z]{1,3}(?=\d)", "")
    return F.when(code & spelled, F.concat(F.lit("c"), core)).otherwise(n)


def lemma(word: Column) -> Column:
    """Fixed point of at most three passes. Lambdas bind each pass once."""
    return F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lower(word), lambda w, _: strip_once(w))


def pred_key(name: Column) -> Column:
    ws = words_of(name)
    last = F.element_at(F.when(F.size(ws) > 0, ws), -1)
    kept = F.when((F.size(ws) > 1) & last.isin(*LIGHT_HEADS), F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(1)))).otherwise(ws)
    return F.array_join(F.transform(kept, lemma), "")


# --- the same rules as SQL text, for the oracle ---------------------------------------------------------------------


def strip_once_sql(w: str) -> str:
    cases = [f"WHEN {w} = '{a}' THEN '{b}'" for a, b in IRREGULAR.items()]
    for suffix, new, least in SUFFIXES:
        stem = f"(substr({w}, 1, length({w}) - {len(suffix)}) || '{new}')"
        cases.append(
            f"WHEN length({w}) >= {max(least, len(suffix) + 3 - len(new))} AND {w} LIKE '%{suffix}' THEN "
            f"CASE WHEN length{stem} >= 4 AND {stem} LIKE '%i' THEN substr({stem}, 1, length{stem} - 1) || 'y' ELSE {stem} END"
        )
    return f"CASE {' '.join(cases)} ELSE {w} END"


def lemma_sql(source: str, word: str) -> str:
    """SELECT of every column of `source` and `lemma`."""
    return (
        f"SELECT * EXCLUDE (w0, w1, w2), {strip_once_sql('w2')} AS lemma FROM (SELECT *, {strip_once_sql('w1')} AS w2 FROM "
        f"(SELECT *, {strip_once_sql('w0')} AS w1 FROM (SELECT *, lower({word}) AS w0 FROM ({source}))))"
    )
