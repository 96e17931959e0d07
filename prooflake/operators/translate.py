"""Rule translation of simple sentences, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.morph import plural_strip
from .runtime import cut

# Words that put a sentence out of the fragment, with what is in each of them, sentence patterns in their
# order, and words dropped from phrases.
REFUSING = ("who", "that", "which", "if", "then", "because", "unless", "when", "while", "and", "or", "but")
REFUSED = r"\b(who|whom|whose|that|which|if|then|because|unless|when|while|and|or|but)\b"
PATTERNS = {
    "no": r"^no\s+(.+?)\s+(?:are|is)\s+(?:a\s+|an\s+)?(.+)$",
    "all": r"^(?:all|every|each)\s+(.+?)\s+(?:are|is)\s+(?:a\s+|an\s+)?(.+)$",
    "some": r"^(?:some|there\s+are|there\s+is)\s+(.+?)\s+(?:are|is)\s+(?:a\s+|an\s+)?(.+)$",
    "isnot": r"^([a-z]\w*)\s+(?:is|was)\s+not\s+(?:a\s+|an\s+)?(.+)$",
    "is": r"^([a-z]\w*)\s+(?:is|was)\s+(?:a\s+|an\s+)?(.+)$",
}
#: What a text that a pattern fits must have; a look that spares the pattern.
HINTS = {
    "no": lambda s: s.startswith("no"),
    "all": lambda s: s.startswith("all") | s.startswith("every") | s.startswith("each"),
    "some": lambda s: s.startswith("some") | s.startswith("there"),
    "isnot": lambda s: s.contains("not"),
    "is": lambda s: s.contains("is") | s.contains("was"),
}
QUANTIFIERS = ("all", "every", "each", "some", "no", "everyone", "someone", "nobody", "everything")
ARTICLES = ("a", "an", "the")
#: Words that are no name at the head of a sentence, and forms of sentences that are broadcast at most.
NO_NAMES = (*QUANTIFIERS, *REFUSING, "whom", "whose", "there")
FORMS = 50_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def shape(text: Column) -> Column:
    """struct(kind, subject, object) of the first pattern that fits; null if none does or a word refuses."""

    def read(s: Column) -> Column:
        refused = reduce(or_, [s.contains(w) for w in REFUSING]) & F.rlike(s, F.lit(REFUSED))
        out = F.when(refused | (s == ""), F.lit(None).cast("struct<kind:string,subject:string,object:string>"))
        for kind, pattern in PATTERNS.items():
            fits = HINTS[kind](s) & F.rlike(s, F.lit(pattern))
            if kind in ("isnot", "is"):
                fits = fits & ~F.substring_index(s, " ", 1).isin(*QUANTIFIERS)
            out = out.when(fits, F.struct(F.lit(kind).alias("kind"), F.regexp_extract(s, pattern, 1).alias("subject"), F.regexp_extract(s, pattern, 2).alias("object")))
        return out

    return let(F.lower(F.trim(let(F.trim(text), _unstopped))), read)


def _unstopped(text: Column) -> Column:
    """Without the points and exclamation marks at the end. A lone point, which most have, takes no pattern."""
    lone = text.endswith(".") & ~text.endswith("..") & ~text.endswith("!.")
    return F.when(lone, F.left(text, F.length(text) - 1)).otherwise(F.regexp_replace(text, r"[.!]+\s*$", ""))


def _words(phrase: Column) -> Column:
    kept = F.filter(F.split(F.trim(phrase), r"[\s\-]+"), lambda w: (w != "") & ~w.isin(*ARTICLES))
    return F.filter(F.transform(kept, lambda w: F.regexp_replace(w, "[^a-z0-9]", "")), lambda w: w != "")


def _capital(word: Column) -> Column:
    """initcap of a word of a-z and 0-9; one that begins with a letter needs no word breaks."""
    return F.when(word >= "a", F.concat(F.translate(F.left(word, F.lit(1)), ascii_lowercase, ascii_uppercase), F.substr(word, F.lit(2)))).otherwise(F.initcap(word))


def symbol(phrase: Column) -> Column:
    """struct(name, flip): the CamelCase name of a phrase, words in the singular, null without words; flip for a leading not
    or non before more words."""

    def name(ws: Column) -> Column:
        flip = (F.size(ws) > 1) & F.coalesce(F.get(ws, F.lit(0)).isin("not", "non"), F.lit(False))
        kept = F.when(flip, F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(1)))).otherwise(ws)
        return F.struct(F.nullif(F.array_join(F.transform(kept, lambda w: let(plural_strip(w), _capital)), ""), F.lit("")).alias("name"), flip.alias("flip"))

    one = F.rlike(phrase, F.lit(r"\A[a-z0-9]+\z")) & ~phrase.isin(*ARTICLES)
    return F.when(one, F.struct(let(plural_strip(phrase), _capital).alias("name"), F.lit(False).alias("flip"))).otherwise(let(_words(phrase), name))


def parts(text: Column) -> Column:
    """struct(kind, subject, object, negative): symbols instead of phrases. For is and isnot the subject is a constant."""

    def read(p: Column) -> Column:
        ground = p["kind"].isin("is", "isnot")

        def joined(two: Column) -> Column:
            negative = p["kind"].isin("no", "isnot") != two["o"]["flip"]
            subject = F.when(ground, p["subject"]).otherwise(two["s"]["name"])
            return F.when(p.isNotNull() & (ground | ~two["s"]["flip"]), F.struct(p["kind"].alias("kind"), subject.alias("subject"), two["o"]["name"].alias("object"), negative.alias("negative")))

        return let(F.struct(F.when(~ground, symbol(p["subject"])).alias("s"), symbol(p["object"]).alias("o")), joined)

    return let(shape(text), read)


def formula(text: Column) -> Column:
    """The formula of a sentence by rules alone; null if it is out of the fragment."""
    return let(parts(text), written)


def written(p: Column) -> Column:
    """The formula of parts()."""
    sign = F.when(p["negative"], F.lit("not ")).otherwise(F.lit(""))
    body = lambda v: F.concat(sign, p["object"], F.lit("("), v, F.lit(")"))
    return (
        F.when(p["kind"].isin("all", "no"), F.concat(F.lit("forall x. ("), p["subject"], F.lit("(x) -> "), body(F.lit("x")), F.lit(")")))
        .when(p["kind"] == "some", F.concat(F.lit("exists x. ("), p["subject"], F.lit("(x) and "), body(F.lit("x")), F.lit(")")))
        .when(p["kind"].isin("is", "isnot"), body(p["subject"]))
    )


def read(rows: DataFrame) -> DataFrame:
    """rows (text, ...) with p, the parts() of their texts. A sentence that begins with a name and is or was has the form of any
    other name's. Each form is read once and broadcast; if there are more than FORMS, rows are read one by one."""
    head = F.substring_index("text", " ", 1)
    named = F.rlike("text", F.lit(r"\A[A-Za-z][A-Za-z0-9]* (?:is|was) ")) & ~F.lower(head).isin(*NO_NAMES)
    own = rows.withColumn("_own", F.when(named, F.lower(head))).withColumn("_form", F.when(named, F.concat(F.lit("q"), F.substr("text", F.length(head) + 1))).otherwise(F.col("text")))
    forms = cut(own.select("_form").distinct().limit(FORMS + 1))
    if forms.count() > FORMS:
        return rows.withColumn("p", parts(F.col("text")))
    met = own.join(F.broadcast(forms.select("_form", parts(F.col("_form")).alias("_p"))), "_form", "left")
    mine = F.struct("_p.kind", F.col("_own").alias("subject"), "_p.object", "_p.negative")
    return met.select(*rows.columns, F.when(F.col("_own").isNotNull() & F.col("_p").isNotNull(), mine).otherwise(F.col("_p")).alias("p"))


def ascii_formula(text: Column) -> Column:
    """Unicode logic signs to this language's."""
    for sign, word in (("∀", "forall "), ("∃", "exists "), ("→", "->"), ("↔", "<->"), ("∧", " and "), ("∨", " or "), ("¬", " not "), ("⊕", " xor "), ("≠", " != ")):
        text = F.replace(text, F.lit(sign), F.lit(word))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\b(forall|exists)\s+([A-Za-z]\w*)\s*\(", "$1 $2. ("), r"\s+", " "))


# Forms of a sentence, tried in this order, and the form of their denial.
DENIALS = (
    (r"(?i)^(.*?)\s+is\s+not\s+(.*)$", "$1 is $2."),
    (r"(?i)^(.*?)\s+is\s+(.*)$", "$1 is not $2."),
    (r"(?i)^(.*?)\s+(?:does not|doesn't)\s+(.*)$", "$1 $2."),
    (r"(?i)^(.*?)\s+(see|like|visit|chase|eat|need)s\s+(.*)$", "$1 does not $2 $3."),
)


def negation(text: Column) -> Column:
    """The denial of a copular or simple transitive sentence; null for others."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"\.+$", ""))
    denied = [F.when(F.rlike(bare, F.lit(form)), F.regexp_replace(bare, form, denial)) for form, denial in DENIALS]
    return F.coalesce(*denied)

