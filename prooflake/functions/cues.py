"""Cue words of statements as Column expressions: hedges, norms, shapes, polarity, retyping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases are looked for as substrings in this order, then words as whole words, the alphabetically first.
HEDGE_PHRASES = ("ceteris paribus", "other things equal", "other things being equal", "all else equal", "all else being equal", "as a rule", "as a general rule", "as a general matter", "in general", "for the most part", "by and large", "more often than not", "in most cases", "rule of thumb")
HEDGE_WORDS = ("typically", "usually", "generally", "normally", "ordinarily", "often", "frequently", "mostly", "commonly", "customarily", "tend", "tends", "tended", "tendency", "tendencies")
DEONTIC_PHRASES = ("have to", "has to", "had to", "ought to", "supposed to", "right to", "entitled to", "obligation to", "duty to", "may not", "must not", "permitted to", "required to", "allowed to", "free to")
DEONTIC_WORDS = ("must", "should", "shall", "ought", "obligated", "obliged", "required", "permitted", "prohibited", "forbidden", "entitled", "impermissible", "obligatory", "mandatory", "permissible")
# Buckets of the shape classifier, first match in this order; cues are substrings.
SHAPES = {
    "modal-deontic": ("must", "should", "ought", "shall", "may not", "obligated", "obliged", "required", "permitted", "prohibited", "forbidden", "allowed", "entitled", "necessarily", "possibly", "have to", "has to", "cannot", "duty", "right to"),
    "comparative-numeric": (" than ", "more than", "less than", "fewer", "at least", "at most", "majority", "minority", "percent", "%", "greater", "smaller", "larger", "exceeds", "outnumber", "twice", "double", "half", "proportion"),
    "causal": ("because", "cause", "causes", "caused", "causing", "leads to", "lead to", "results in", "result in", "due to", "therefore", "hence", "thus", "consequently", "brings about", "gives rise", "so that", "owing to"),
    "transitive-ordering": ("before", "after", "precedes", "preceded", "follows", "followed", "earlier than", "later than", "part of", "contains", "within", "inside", "above", "below", "ancestor", "descendant", "north of", "south of", "ranks above", "ranks below", "higher than", "lower than"),
    "relational": (" in ", " of ", " on ", " at ", " owns ", " own ", " has ", " have ", " belongs ", " belong ", " member ", " located ", " located in ", " to ", " from ", " with ", " between ", " among ", " governs ", " elects ", " appoints ", " keeps ", " serves ", " stored ", " bound "),
}
UNIVERSALS = ("every ", "all ", "each ", "any ", "no ")
# Marks of a conclusion, and the pattern of a bare instance.
DERIVATION = r"(?i)\b(therefore|thus|hence|so|consequently|it follows|follows that|as a result|accordingly|then)\b"
INSTANCE = r"(?i)^\s*(the\s+|a\s+|an\s+|this\s+|that\s+)?[A-Z0-9][\w'\-]*(\s+[\w'\-]+){0,3}\s+(is|was|are|were)\s+(not\s+)?(a|an)\s+[\w'\-]+(\s+[\w'\-]+){0,2}\.?\s*$"


def _cue(text: Column, phrases: tuple, words: tuple) -> Column:
    low = F.lower(text)
    found = F.array_intersect(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)), F.array(*map(F.lit, words)))
    out = F.when(text.isNull(), F.lit(None).cast("string"))
    for p in phrases:
        out = out.when(low.contains(p), F.lit(p))
    return out.otherwise(F.array_min(found))


def hedge_cue(*texts: Column) -> Column:
    """The first hedge of the texts, in their order; null if none."""
    return F.coalesce(*[_cue(t, HEDGE_PHRASES, HEDGE_WORDS) for t in texts])


def deontic_cue(*texts: Column) -> Column:
    return F.coalesce(*[_cue(t, DEONTIC_PHRASES, DEONTIC_WORDS) for t in texts])


def _any(low: Column, cues: tuple) -> Column:
    return F.rlike(low, F.lit("|".join(rf"\Q{c}\E" for c in cues)))


def quarantine_shape(text: Column) -> Column:
    low = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    out = F.when(F.coalesce(text, F.lit("")) == "", "other")
    for shape, cues in SHAPES.items():
        if shape != "relational":
            out = out.when(_any(low, cues), shape)
    related = _any(low, SHAPES["relational"])
    return out.when(related & _any(low, UNIVERSALS), "relational-role(∀∃)").when(related, "relational-ground").otherwise("other")


def retyped(kind: Column, text: Column) -> Column:
    """derived_claim becomes axiom for a bare instance that no word marks as a conclusion."""
    return F.when((kind == "derived_claim") & F.rlike(text, F.lit(INSTANCE)) & ~F.rlike(text, F.lit(DERIVATION)), "axiom").otherwise(kind)


# --- SQL of the same tables, for the oracle ------------------------------------------------------------------------


def cue_sql(text: str, phrases: tuple, words: tuple) -> str:
    cases = " ".join(f"WHEN contains(lower({text}), '{p}') THEN '{p}'" for p in phrases)
    hits = f"list_min(list_filter(regexp_extract_all(lower({text}), '[a-z]+'), lambda w: list_contains([{', '.join(repr(w) for w in words)}], w)))"
    return f"CASE {cases} ELSE {hits} END"


def shape_sql(text: str) -> str:
    low = f"(' ' || lower({text}) || ' ')"
    some = lambda cues: "(" + " OR ".join(f"contains({low}, '{c}')" for c in cues) + ")"
    cases = " ".join(f"WHEN {some(c)} THEN '{s}'" for s, c in SHAPES.items() if s != "relational")
    return f"CASE WHEN coalesce({text}, '') = '' THEN 'other' {cases} WHEN {some(SHAPES['relational'])} AND {some(UNIVERSALS)} THEN 'relational-role(∀∃)' WHEN {some(SHAPES['relational'])} THEN 'relational-ground' ELSE 'other' END"
