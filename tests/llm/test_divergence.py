import random
import re
from collections import Counter
from functools import partial

import pyarrow as pa
import pytest

from folioflow.llm.divergence import _counted, divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, top):
    groups, df = {}, Counter()
    for text, lang, source in docs:
        words = TERM.findall((text or "").translate(LOWER))
        groups.setdefault((lang or "", source or ""), Counter()).update(words)
        df.update((lang or "", w) for w in set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (g, w), n in df.items() if g == lang and n >= least]
        own = {s: c for (g, s), c in groups.items() if g == lang}
        whole = sum(own.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        for s in own:
            pair = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in own if o != s]
            term = [(p[s][w] - q[w], w) for w in kept if own[s][w] and p[s][w] > q[w]]
            for part, rows, most in (("pair", pair, None), ("term", term, top)):
                rows.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(rows[:most], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(2)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}{'é' * (k % 3 == 0)}" for k in range(300)]
    docs = []
    for k in range(400):
        lang, source = rng.choice(["en", "en", "de", "fr"]), f"s{min(rng.randrange(12), rng.randrange(12))}"
        words = [vocabulary[min(int(rng.expovariate(0.02)), 299)] for _ in range(rng.randrange(60))]
        docs.append((rng.choice([" ", ", ", "7", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in words), lang, source))
    docs += [docs[0], docs[0], (None, "en", "s1"), ("", "zz", "only"), (None, "zz", None), ("wa alone", None, None), ("zeta " * 5000, "en", "s3"), ("!?", "yy", "one")]
    return docs


@pytest.mark.parametrize("sizes", [{}, {"stripe": 3, "block_counts": 40, "columns": 8}, {"stripe": 1, "block_counts": 10_000, "columns": 3}])
def test_divergence_equals_brute_force(spark, sizes):
    docs = corpus()
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "text string, lang string, source string, term string, n int").repartition(5)
    got = divergence(table, least_docs=5, top=7, **sizes).collect()
    assert sorted(map(tuple, got)) == brute(docs, 5, 7)


def test_no_terms_and_no_rows(spark):
    docs = [("a b", "en", "x"), ("a c", "en", "y"), (None, None, None)]
    table = spark.createDataFrame(docs, "text string, lang string, source string")
    assert sorted(map(tuple, divergence(table).collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert divergence(table.limit(0)).collect() == []


def test_counts_are_handed_on_before_they_are_too_many():
    docs = corpus()
    batch = pa.RecordBatch.from_pydict({"lang": [d[1] or "" for d in docs], "source": [d[2] or "" for d in docs], "text": [(d[0] or "").encode() for d in docs]})
    whole, cut = Counter(), Counter()
    for run, into in ((_counted, whole), (partial(_counted, most_held=50, slice_bytes=10), cut)):
        for part in run([batch]):
            for row in part.to_pylist():
                into[row["lang"], row["source"], row["term"], "n"] += row["n"]
                into[row["lang"], row["source"], row["term"], "docs"] += row["docs"]
    assert whole == cut
