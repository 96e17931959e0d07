from pyspark.sql import functions as F

from prooflake.functions import cues, morph
from prooflake.operators import relational, segment, translate, vocab


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_words(spark):
    words = ["taxation", "taxes", "tax", "mortality", "happiness", "equality", "theft", "state", "road", "idea"]
    assert column(spark, words, morph.lemma) == ["tax", "tax", "tax", "mortal", "happy", "equal", "theft", "state", "road", "idea"]
    assert column(spark, ["PrimeNumber", "Prime", "Number", "Taxation"], morph.pred_key)[:3] == ["prime", "prime", "numb"]
    assert column(spark, ["c65060", "c6_5060", "six_5060", "six5060", "socrates", "old_ferry", "two", "date_2000"], morph.const_key) == ["c65060"] * 4 + ["socrates", "old_ferry", "two", "date_2000"]


def test_cues(spark):
    assert column(spark, ["Birds typically fly.", "As a rule, it rains.", "Most usual things.", None], cues.hedge_cue) == ["typically", "as a rule", None, None]
    assert column(spark, ["You must go.", "Pass the mustard.", "He has a duty to pay."], cues.deontic_cue) == ["must", None, "duty to"]
    assert column(spark, ["He must go", "more than two", "because of it", "a comes before b", "every cat is in some box", "cat on mat", "zebra", ""], cues.quarantine_shape) == ["modal-deontic", "comparative-numeric", "causal", "transitive-ordering", "relational-role(∀∃)", "relational-ground", "other", "other"]


def test_translation(spark):
    got = column(spark, ["All philosophers are human.", "Socrates is not mortal.", "No politician is honest.", "If a is b, c is d.", "Some cats are not gray"], translate.formula)
    assert got == ["forall x. (Philosopher(x) -> Human(x))", "not Mortal(socrates)", "forall x. (Politician(x) -> not Honest(x))", None, "exists x. (Cat(x) and not Gray(x))"]
    assert column(spark, ["∀x (P(x) → ¬Q(x))"], translate.ascii_formula) == ["forall x. (P(x) -> not Q(x))"]


def test_paragraphs_and_chunks(spark):
    raw = "  Ann: Hello  there.\n\nMore.\n \n\nBob: Bye.\n"
    got = [tuple(r) for r in segment.paragraphs(spark.createDataFrame([(1, raw)], "doc_id int, raw_text string")).orderBy("para_ix").collect()]
    assert [(g[4], g[5]) for g in got] == [("Ann", "Hello there."), ("Ann", "More."), ("Bob", "Bye.")]
    assert [raw[g[2] : g[3]] for g in got] == ["Ann: Hello  there.", "More.", "Bob: Bye."]
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate([50, 60, 30, 300, 20, 20])], "doc_id int, para_ix int, n int")
    spans = [(r["first"], r["last"]) for r in segment.chunks(rows, max_chars=100).orderBy("chunk_ix").collect()]
    assert spans == [(0, 0), (0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]
    spans = [(r["first"], r["last"]) for r in segment.chunks(rows, max_chars=140, overlap=2).orderBy("chunk_ix").collect()]
    assert spans == [(0, 2), (1, 3), (2, 4), (3, 5)]
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    assert [tuple(r) for r in segment.chunks(rows, docs=docs).where("doc_id = 2").collect()] == [(2, 0, 0, -1)]


def test_screener(spark):
    rows = [(1, 1, "The tax is fair."), (1, 2, "The tax is not fair."), (1, 3, "The tax is unfair."), (1, 4, "Cats purr."), (2, 1, "The tax is fair.")]
    got = {(r.a, r.b): r.signal for r in relational.screener(spark.createDataFrame(rows, "doc_id int, pos int, text string")).collect()}
    assert got[(1, 2)].startswith("shared") and got[(1, 3)] == "prefix antonym pair: unfair/fair" and len(got) == 3


def test_guard(spark):
    f = "forall x. (Person(x) -> not Ancestor(x, x))"
    rows = [(1, "a", f), (1, "b", "Ancestor(p, q)"), (2, "a", f), (2, "b", "Person(adam)")]
    got = {(r.doc_id, r.stmt_id): r.fol for r in vocab.strip_guards(spark.createDataFrame(rows, "doc_id int, stmt_id string, fol string")).collect()}
    assert got[(1, "a")] == "forall x. (not Ancestor(x, x))" and got[(2, "a")] == f


def test_streaming(spark, tmp_path):
    from prooflake.streaming.ingest import stream_gate

    docs = spark.createDataFrame([(1, "All cats are gray. Tom is typically a cat.")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    q = stream_gate(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert {r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"accepted", "quarantined"}


def test_screener_meets_by_rare_words(spark):
    """A word that every statement has makes no pair, and pairs equal those of all pairs."""
    import random

    from prooflake.operators import relational

    r = random.Random(3)
    pool = ["active", "inactive", "possible", "impossible", "cat", "dog", "bird", "fish", "tree", "stone"]
    rows = [(1, i, " ".join(["Common", *r.sample(pool, r.randint(1, 4)), *(["not"] if r.random() < 0.4 else [])])) for i in range(60)]
    own = lambda i: "q" + chr(97 + i % 26) + chr(97 + i // 26)
    rows += [(2, i, f"common {own(i)}x {own(i)}y {own(i)}z" + (" not" if i % 2 else "")) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id int, pos int, text string")
    assert relational.candidate_pairs(df.where("doc_id = 2")).count() == 0

    def words(text):
        t = set(text.lower().split())
        return t - {"not"}, "not" in t

    def opposed(a, b):
        return any(p + v == u for p in relational.NEGATIVE_PREFIXES for x, y in ((a, b), (b, a)) for u in x for v in y if len(v) >= 3)

    want = set()
    for d, i, s in rows:
        for e, j, t in rows:
            if d == e and i < j and s != t:
                (a, na), (b, nb) = words(s), words(t)
                share = len(a & b) / len(a | b)
                if (na != nb and share >= 0.5) or (opposed(a, b) and share >= 0.3):
                    want.add((d, i, j, round(share, 2)))
    assert {(x.doc_id, x.a, x.b, x.jaccard) for x in relational.screener(df).collect()} == want


def test_components_of_small_and_large_documents(spark, monkeypatch):
    """Small documents are clustered without rounds of joins, large ones by them; both like plain merging."""
    import random

    r, rows = random.Random(3), [(None, 1, 1), (None, 2, 1), (3, None, 1), (3, 4, None), (3, 5, None), (4, 9, None)]
    for d in range(60):
        rows += [(d, r.randint(0, 9), r.randint(0, 14)) for _ in range(r.randint(1, 12))]
    rows += [(100, i, i // 2 + k % 2) for i in range(40) for k in range(2)]
    want = {(d, s): s for d, s, _ in rows}
    for _ in rows:
        for d, p in {(d, p) for d, s, p in rows if None not in (d, s, p)}:
            met = [(d, s) for e, s, q in rows if (e, q) == (d, p) and s is not None]
            least = min(want[m] for m in met)
            want |= {m: least for m in met}
    df = spark.createDataFrame(rows, "doc_id int, stmt_id int, pred int")
    contracted, seen = relational._contracted, []
    monkeypatch.setattr(relational, "_contracted", lambda pairs: seen.append(1) or contracted(pairs))
    got = sorted(map(tuple, relational.components(df).collect()), key=str)
    assert got == sorted([(*k, v) for k, v in want.items()], key=str) and not seen
    monkeypatch.setattr(relational, "CLUSTERED", 8)
    assert sorted(map(tuple, relational.components(df).collect()), key=str) == got and seen


def test_closure_by_distances(spark, monkeypatch):
    """Circles, loops, nulls and a node in which more pairs meet than a task is dealt."""
    import random

    from prooflake.operators import runtime

    def plain(edges):
        out = set(edges)
        while more := {(a, d) for a, b in out for c, d in edges if b is not None and b == c} - out:
            out |= more
        return out

    r = random.Random(7)
    cases = [[(r.randint(0, 12), r.randint(0, 12)) for _ in range(n)] for n in (1, 9, 14, 25)]
    cases += [[(1, 1)], [(1, 2), (2, 1), (2, None), (None, 1)], [(i, i + 1) for i in range(21)]]
    df = lambda e: spark.createDataFrame(e, "src int, dst int")
    for e in cases:
        assert sorted(map(tuple, relational.closure(df(e)).collect()), key=str) == sorted(plain(e), key=str)
    star, tasks, dealt = [(i, 0) for i in range(1, 60)] + [(0, -1), (-1, -2), (-2, 0)], runtime.tasks, []
    monkeypatch.setattr(runtime, "TASK_ROWS", 20)
    monkeypatch.setattr(runtime, "tasks", lambda d, n: dealt.append(tasks(d, n)) or dealt[-1])
    assert sorted(map(tuple, relational.closure(df(star)).collect())) == sorted(plain(star)) and max(dealt) > 8
