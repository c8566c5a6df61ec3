import collections
import hashlib
import random
import re

from pyspark.sql import functions as F

from folioflow.llm.exact_dedup import drop_duplicates, duplicate_groups
from folioflow.llm.mixing import mix, mixed_documents, sainte_lague, targets


def texts():
    rng = random.Random(8)
    base = ["a b", "a  b", "a\nb", " a b", "a b ", "", " ", None, "c" * 5000, "é x", "É x", "a b"]
    return [(i * 2, rng.choice(base)) for i in range(150)]


def test_exact_groups(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, keep_id string, kept int").repartition(5)
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups = collections.defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    want = {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}
    read = lambda d: {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in d.collect()}
    assert read(duplicate_groups(df)) == want
    # A digest under which different texts meet changes nothing.
    assert read(duplicate_groups(df, digest=lambda c: F.length(c) % 3, salts=3)) == want
    kept = drop_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(map(min, groups.values()))
    assert duplicate_groups(df.limit(0)).collect() == []


def test_sainte_lague(spark):
    rng = random.Random(2)
    for seats in (0, 1, 7, 100, 12345):
        votes = {k: rng.choice([0, 1, rng.randint(1, 50), rng.randint(1, 10_000)]) for k in range(40)}
        votes[3] = 30_000
        df = spark.createDataFrame([(0, k, float(v), seats) for k, v in votes.items()], "g int, k int, v double, s long")
        got = {r.k: r.quota for r in sainte_lague(df, ["g"], "k", "v", "s").collect()}
        want = collections.Counter()
        for _ in range(seats):
            want[max((v / (2 * want[k] + 1), -k) for k, v in votes.items() if v)[1] * -1] += 1
        assert got == {k: want[k] for k in votes}


def corpus(spark, n=400):
    rng = random.Random(6)
    sources = ["b", "a", None, "É", "z", "hot", "hot", "hot", "hot"]
    rows = [(i, rng.choice([None, "", " w\n"] + ["w x\ty "] * 3) if i % 50 == 0 else "\n".join(rng.choices(["w", "xx", "é"], k=rng.randint(1, 300))), rng.choice(sources), 0) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long"), rows


def test_mix(spark):
    df, rows = corpus(spark)
    got = {r.doc_id: r for r in mix(df, shard_docs=50).collect()}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = collections.Counter()
    for _, t, s, _ in rows:
        size[s] += words(t)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    total, target, open_ = 1.5 * sum(size.values()), {}, set(size)
    while open_:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        for s in over or open_:
            target[s] = 2.0 * size[s] if over else share[s]
        open_ -= over or open_
    taken = collections.Counter()
    for i, t, s, _ in rows:
        r = got[i]
        assert r["size"] == words(t) and r.source_size == size[s] and abs(r.target - target[s]) < 1e-6
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= 40
    assert {r.doc_id: r.taken for r in mix(df.repartition(7), shard_docs=50).collect()} == {i: r.taken for i, r in got.items()}
    out = collections.Counter()
    texts = dict((i, t) for i, t, _, _ in rows)
    for r in mixed_documents(df).collect():
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        out[r.doc_id] += words(r.text)
    whole = {r.doc_id: r.taken for r in mix(df).collect()}
    assert out == {i: n for i, n in whole.items() if n}


def test_edges(spark):
    df, _ = corpus(spark)
    assert mix(df.limit(0)).collect() == []
    none = mix(df.withColumn("text", F.lit(None).cast("string"))).collect()
    assert {(r["size"], r.target, r.taken) for r in none} == {(0, 0.0, 0)}
    s = spark.createDataFrame([("a", 10), ("b", 0)], "source string, source_size long")
    assert {r.source: r.target for r in targets(s).collect()} == {"a": 15.0, "b": 0.0}


def test_mix_of_repeated_and_missing_ids(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choices(["w", "xx", "é"], k=n))
    one, two = text(40), text(70)
    rows = [(1, one, "a", "p"), (1, one, "a", "p"), (1, one, "a", "p"), (1, two, "a", "q"), (None, two, "b", "r"), (None, two, "b", "r"), (None, text(9), None, "s"), (2, None, "a", "t")]
    rows += [(k, text(rng.randint(1, 90)), "ab"[k % 2], "u") for k in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra string").repartition(4)
    words = lambda t: len((t or "").split())
    taken, out = collections.Counter(), collections.Counter()
    for r in mix(df).collect():
        assert r.taken <= 2 * r["size"]
        taken[r.doc_id] += r.taken
    for r in mixed_documents(df).collect():
        out[r.doc_id] += words(r.text)
    assert out == {i: n for i, n in taken.items() if n}
