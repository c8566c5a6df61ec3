import random

from folioflow.llm.toxicity import Lexicon, features, fit, fold, matches, score, scored_documents, without_toxic


def corpus():
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("lm", "rt", "n")]
    rows, labels = [], []
    for i in range(900):
        t = rng.choices(words, k=rng.randint(5, 80))
        toxic = i % 6 == 0
        if toxic:
            t[rng.randrange(len(t))] = rng.choice(["grumpol", "grumpolist", "Grump0l", "grumpоl"])
        rows.append((i, " ".join(t)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return [*rows, (2000, None), (2001, "")], labels


def test_learns_and_holds_out(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, id string, score double")
    labs = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in scored_documents(docs, labs).collect()}
    assert len(got) == len(rows)
    for i, _ in rows[:900]:
        assert got[i].predicted == int(i % 6 == 0)
        assert 0 <= got[i].score <= 1
    assert got[2000].predicted == got[2001].predicted == 0
    kept = without_toxic(docs, labs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 150


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in score(docs, fit(docs, none)).collect()] == [0, 0]
    assert scored_documents(docs.limit(0), none).collect() == []


def test_fold_and_exceptions():
    assert fold("L0SER, idі0t! 2024") == " loser idiot "
    lex = Lexicon({" trash ": 5.0, " lowei": 4.0}, [" trash can "])
    a = lex.automaton()
    assert [m[0] for m in matches(a, fold("the trash can and TRASH loweix"))] == [" trash ", " lowei"]
    assert features(a, "trash can") == (0.0, 0.0)
    assert features(a, "trash a b")[1] > features(a, "trash " + "a " * 50)[1]


def test_brute_force(spark):
    """Scores of a lexicon by plain search in place of the automaton."""
    import math

    rng = random.Random(4)
    words = ["bad", "badger", "worse", "worst", "fine", "so", "can", "é", "b4d", "WORSE"]
    lex = Lexicon({" bad ": 3.0, " badg": 2.0, " wors": 4.5, " worst ": 6.0}, [" so bad ", " worst can ", " fine badger "], -4.0, 1.1, 0.7)
    rows = [(i, rng.choice([" ", "  ", "\n", ". "]).join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(300)] + [(900, None), (901, "bad " * 20_000)]

    def plain(text):
        t = fold(text or "")
        places = lambda s: [(p, p + len(s)) for p in range(len(t)) if t.startswith(s, p)] if len(t) < 5000 else [(m.start(), m.start() + len(s)) for m in __import__("re").finditer(f"(?={s})", t)]
        out = [x for s in lex.exceptions for x in places(s)]
        at = {}
        for term, w in lex.weights.items():
            for a, b in places(term):
                if not any(x <= a and b <= y for x, y in out):
                    at[a] = max(w, at.get(a, 0.0))
        if not at:
            return 1 / (1 + math.exp(-lex.bias))
        return 1 / (1 + math.exp(-(lex.bias + lex.heaviest * max(at.values()) + lex.density * sum(at.values()) / t.count(" ") ** 0.5)))

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for r in score(df, lex).collect():
        assert abs(r.score - min(1.0, plain(dict(rows)[r.doc_id]))) < 1e-9 and r.predicted == int(r.score >= 0.5)


def test_repeated_rows_ties_and_long_texts(spark):
    rows, labels = corpus()
    rows = [*rows, rows[0], (None, rows[0][1]), (None, None), (7000, "grumpol can " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labs = spark.createDataFrame([*labels, (0, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    got = scored_documents(docs, labs).collect()
    assert len(got) == len(rows) and {r.predicted for r in got if r.doc_id == 0} == {1} and [r.predicted for r in got if r.doc_id == 7000] == [1]
    assert sorted(r.predicted for r in got if r.doc_id is None) == [0, 1]
