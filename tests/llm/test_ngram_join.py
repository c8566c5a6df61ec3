import random
import re

from folioflow.llm.ngram_join import ngram_components


def brute(rows, k=5):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * o >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=220):
    rng = random.Random(seed)
    words = ["ab", "Cd", "efg", "h", "ijk", "LM", "é", "nop", "q.", "rs"] + [f"w{i}" for i in range(60)]
    rows, passage = [], " ".join(rng.choices(words, k=30))
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.5:
            w = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.3:
                w = w[: max(1, int(len(w) * rng.uniform(0.7, 1)))]
            t = rng.choice([" ", "  ", "\n"]).join(w)
        elif kind < 0.65:
            t = passage + " " + " ".join(rng.choices(words, k=rng.randint(0, 12)))
        else:
            t = " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 5, 6, 9, 40, 90])))
        rows.append((i * 3 + 1, t))
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "one two"), (5004, "One TWO"), (5005, "x " * 3000)]
    return rows


def test_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, n int, label string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(df.repartition(3)).collect()}
        assert got == brute(rows)


def test_empty(spark):
    assert ngram_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated_and_missing_ids(spark):
    """Rows of one id are one document; rows without an id link, but name nothing."""
    from folioflow.llm.ngram_join import one_of_each

    say = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    rows = [(7, say("a", 30)), (7, say("b", 30)), (9, say("a", 29)), (3, say("b", 31)), (None, say("b", 30)), (None, say("c", 30)), (None, None), (4, say("d", 9)), (4, say("d", 9)), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(df).collect()), key=str)
    want = [(7, 26, 3), (7, 26, 3), (9, 25, 3), (3, 27, 3), (None, 26, 3), (None, 26, None), (None, 0, None), (4, 5, 4), (4, 5, 4), (5, 0, 5)]
    assert got == sorted(want, key=str)
    kept = sorted((str(r.doc_id) for r in one_of_each(df).collect()))
    assert kept == ["3", "4", "4", "5", "None", "None", "None"]


def test_hot_group(spark):
    """Nine of ten rows near copies, most of them equal sets."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(1500):
        w = list(base)
        if i % 10 == 0:
            w = [f"x{rng.random()}" for _ in range(30)]
        elif i % 3 == 0:
            w[rng.randrange(60)] = "y"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert all(got[i] == (i if i % 10 == 0 else 1) for i, _ in rows)
