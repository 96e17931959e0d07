"""Vocabulary operators: ordered first-seen names, negation map, alias merges, guard stripping. All by document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.formulas import predicates, renamed, swapped
from ..functions.morph import NEGATIVE_PREFIXES, lemma, plural_strip, pred_key, words_of

# Constants that name a single author; content words of relations with group and argument order; particles.
SELF = ("i", "me", "myself", "author", "speaker", "narrator", "writer", "presenter", "oneself", "we", "us")
RELATIONS = {
    "require": ("prereq", False), "requir": ("prereq", False), "required": ("prereq", False), "prerequisite": ("prereq", True),
    "prerequisit": ("prereq", True), "prereq": ("prereq", True), "depend": ("prereq", False), "need": ("prereq", False),
    "locate": ("containment", False), "located": ("containment", False), "situate": ("containment", False), "situated": ("containment", False),
    "within": ("containment", False), "inside": ("containment", False), "contain": ("containment", True),
}
PARTICLES = ("of", "for", "to", "on", "in", "at", "by", "with", "over", "upon", "from", "is", "are", "was", "were", "a", "an", "the")
# Fixed value: a relation that nothing of a kind has to itself.
GUARD = r"^forall\s+(\w+)\s*\.\s*\(\s*(\w+)\s*\(\s*\1\s*\)\s*->\s*(not\s+\w+\s*\(\s*\1\s*,\s*\1\s*\))\s*\)$"


def first_seen(names: DataFrame) -> DataFrame:
    """(doc_id, key, display, first_pos, name) of (doc_id, pos, name): a key's display is its first name with each word's
    plural stripped. Keys are made once per distinct name."""
    shown = F.array_join(F.transform(words_of(F.col("name")), lambda w: F.initcap(plural_strip(w))), "")
    keys = names.select("name").distinct().select("name", pred_key(F.col("name")).alias("key"), shown.alias("display"))
    first = names.join(keys, "name").groupBy("doc_id", "key").agg(F.min_by(F.struct("display", "name"), F.struct("pos", "name")).alias("x"), F.min("pos").alias("first_pos"))
    return first.select("doc_id", "key", "x.display", "first_pos", "x.name")


def negation_map(vocab: DataFrame) -> DataFrame:
    """(doc_id, key, base) of first_seen(): names that begin with the word not or non, or keys with a negative prefix, before a
    key that was seen before and is no negation itself; after a prefix it has three letters or more. Bases are looked up by
    equal keys, one candidate per way; the word comes before prefixes, these in their order."""
    words = words_of(F.col("name"))
    spoken = vocab.where((F.size(words) > 1) & F.get(words, F.lit(0)).isin("not", "non"))
    spoken = spoken.select("doc_id", "key", "first_pos", F.lit(-1).alias("rank"), F.array_join(F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lemma), "").alias("base"))
    prefixes = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(p).alias("prefix")) for i, p in enumerate(NEGATIVE_PREFIXES)])
    cut = vocab.select("doc_id", "key", "first_pos", F.explode(prefixes).alias("p")).where(F.expr("startswith(key, p.prefix) AND length(key) - length(p.prefix) >= 3"))
    cut = cut.select("doc_id", "key", "first_pos", "p.rank", F.expr("substr(key, length(p.prefix) + 1)").alias("base"))
    cut = cut.unionByName(spoken)
    seen = vocab.select("doc_id", F.col("key").alias("base"), F.col("first_pos").alias("base_pos"))
    found = cut.join(seen, ["doc_id", "base"]).where("base_pos < first_pos")
    found = found.join(found.select("doc_id", F.col("key").alias("base")).distinct(), ["doc_id", "base"], "left_anti")
    return found.groupBy("doc_id", "key").agg(F.min_by("base", "rank").alias("base"))


def modifier_aliases(names: DataFrame) -> DataFrame:
    """(doc_id, old, new) of distinct (doc_id, name): a head word with exactly one bare and one longer name merges them."""
    w = names.select("name").distinct().select("name", F.size(words_of(F.col("name"))).alias("n"), lemma(F.get(words_of(F.col("name")), F.lit(0))).alias("head")).where("n > 0")
    g = names.distinct().join(w, "name").groupBy("doc_id", "head").agg(F.count_if(F.col("n") == 1).alias("bare"), F.count_if(F.col("n") > 1).alias("more"), F.max(F.when(F.col("n") > 1, F.col("name"))).alias("old"), F.max(F.when(F.col("n") == 1, F.col("name"))).alias("new"))
    return g.where("bare = 1 and more = 1").select("doc_id", "old", "new")


def self_aliases(consts: DataFrame) -> DataFrame:
    """(doc_id, old, new) of (doc_id, const): names of the author become one, author or else the first."""
    g = consts.where(F.col("const").isin(*SELF)).groupBy("doc_id").agg(F.sort_array(F.collect_set("const")).alias("all")).where("size(all) > 1")
    g = g.withColumn("new", F.when(F.array_contains("all", "author"), "author").otherwise(F.get("all", F.lit(0))))
    return g.select("doc_id", F.explode("all").alias("old"), "new").where("old <> new")


def relation_aliases(atoms: DataFrame) -> DataFrame:
    """(doc_id, old, new, swap) of atoms (doc_id, stmt_id, pred, arity[, n]): binary relations of one curated group become the one
    that most statements use, then the unflipped one, then the first by name; swap if their argument orders differ. n: how many
    statements a row stands for."""
    names = atoms.select("pred").distinct().withColumn("ws", F.filter(words_of(F.col("pred")), lambda x: ~x.isin(*PARTICLES))).where("size(ws) = 1")
    table = F.create_map(*[F.lit(x) for w, (g, f) in RELATIONS.items() for x in (w, f"{g}|{int(f)}")])
    word = F.get("ws", F.lit(0))
    entry = F.coalesce(table[word], table[lemma(word)])
    names = names.select("pred", F.split(entry, r"\|").alias("e")).where("e is not null").select("pred", F.col("e")[0].alias("grp"), (F.col("e")[1] == "1").alias("flip"))
    many = F.max("n") if "n" in atoms.columns else F.max(F.lit(1))
    used = atoms.groupBy("doc_id", "pred", "stmt_id").agg(many.alias("n"), F.min("arity").alias("lo"), F.max("arity").alias("hi"))
    used = used.groupBy("doc_id", "pred").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo = 2 and hi = 2")
    members = used.join(names, "pred")
    w = W.partitionBy("doc_id", "grp")
    first = F.first(F.struct("pred", "flip")).over(w.orderBy(F.desc("n"), "flip", "pred"))
    ranked = members.withColumn("canon", first)
    return ranked.where(F.col("pred") != F.col("canon.pred")).select("doc_id", F.col("pred").alias("old"), F.col("canon.pred").alias("new"), (F.col("flip") != F.col("canon.flip")).alias("swap"))


def strip_guards(formulas: DataFrame) -> DataFrame:
    """(doc_id, stmt_id, fol, stripped) of (doc_id, stmt_id, fol): `forall v. (P(v) -> not R(v, v))` loses P if P occurs
    nowhere but as such a guard in the document."""
    f = formulas.withColumn("guard", F.nullif(F.regexp_extract("fol", GUARD, 2), F.lit("")))
    names = F.filter(F.regexp_extract_all("fol", F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1)), lambda x: ~x.isin("and", "or", "not", "forall", "exists"))
    total = f.select("doc_id", F.explode(names).alias("guard")).groupBy("doc_id", "guard").agg(F.count("*").alias("total"))
    guards = f.where("guard is not null").groupBy("doc_id", "guard").agg(F.count("*").alias("n"))
    loose = guards.join(total, ["doc_id", "guard"]).where("n = total").select("doc_id", "guard", F.lit(True).alias("loose"))
    out = f.join(loose, ["doc_id", "guard"], "left")
    new = F.when(F.col("loose"), F.regexp_replace("fol", GUARD, "forall $1. ($3)")).otherwise(F.col("fol"))
    return out.select("doc_id", "stmt_id", new.alias("fol"), F.coalesce("loose", F.lit(False)).alias("stripped"))


def inventory(formulas: DataFrame) -> DataFrame:
    """Predicates of each document's formulas: doc_id, pred, first_pos, statements."""
    names = formulas.select("doc_id", "pos", F.explode(predicates(F.col("fol"))).alias("pred"))
    return names.groupBy("doc_id", "pred").agg(F.min("pos").alias("first_pos"), F.count("*").alias("statements"))


def known_before(formulas: DataFrame) -> DataFrame:
    """(doc_id, pos, pred, known): whether a statement's predicate occurs before it in its document."""
    names = formulas.select("doc_id", "pos", F.explode(predicates(F.col("fol"))).alias("pred"))
    first = F.min("pos").over(W.partitionBy("doc_id", "pred"))
    return names.withColumn("known", first < F.col("pos"))


def apply_aliases(formulas: DataFrame, aliases: DataFrame) -> DataFrame:
    """Formulas with their document's aliases (doc_id, old, new, swap) applied, all at once; swap turns the arguments of a
    two-place atom round before it is renamed. Documents without aliases keep their formulas."""
    maps = aliases.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("names"), F.collect_list(F.when(F.col("swap"), F.col("old"))).alias("swaps")
    )
    return formulas.join(maps, "doc_id", "left").withColumn("fol", renamed(swapped(F.col("fol"), F.col("swaps")), F.col("names"))).drop("names", "swaps")
