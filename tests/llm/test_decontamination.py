import hashlib
import random
import re

import pytest

from folioflow.llm import decontamination
from folioflow.llm.suffix_automaton import SuffixAutomaton

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, length=10):
    """(n_words, hit positions, ids of items) from all windows at all places."""
    own, hit, found = words(text), set(), set()
    for item, said in items:
        w = words(said)
        k = min(length, len(w))
        windows = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()
        for a in range(len(own) - k + 1 if k else 0):
            if tuple(own[a : a + k]) in windows:
                hit |= set(range(a, a + k))
                found.add("" if item is None else str(item))
    return len(own), hit, found


def expected(doc_id, text, items):
    n, hit, found = brute(text, items)
    return doc_id, n, len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def corpus(seed):
    """Texts of few words with passages of items, so that many windows nearly occur."""
    rng = random.Random(seed)
    some = ["ab", "Ab", "c", "été", "7x", "d", "e", "ÄB"]
    make = lambda n: [rng.choice(some) for _ in range(n)]
    items = [(k, " ".join(make(rng.randint(1, 40) if k > 5 else rng.randint(4, 12)))) for k in range(30)]
    items += [(3, "again, with the same id: ab c d e ab c d"), (None, "z y x w v u t s r q p o n m"), (90, ""), (91, None), (92, "!?"), (9, items[9][1])]
    docs = []
    for k in range(120):
        parts = make(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            w = rng.choice([t for _, t in items if t]).split()
            a = rng.randrange(len(w))
            parts += [*w[a : a + rng.randint(1, 30)], *make(rng.randint(0, 5))]
        docs.append((k, rng.choice([" ", "; ", "\n"]).join(parts)))
    docs += [(7, "ab " * 40), (7, None), (None, "z-y-x W v;u t s r q p"), (200, ""), (201, "!!"), (202, "z y x w v u t s r q " * 9000)]
    return docs, items


@pytest.mark.parametrize("shard_words", [50_000, 60])
def test_contamination_equals_brute_force(spark, monkeypatch, shard_words):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 7)
    monkeypatch.setattr(decontamination, "SLICE_BYTES", 999)
    docs, items = corpus(shard_words)
    items = [x for x in items if len(words(x[1])) != 1]  # a single known word is a case of its own
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = decontamination.contamination(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(i, t, items) for i, t in docs), key=str)


def test_items_of_one_word_hit_it_everywhere(spark):
    docs, items = [(1, "a b a"), (2, "c"), (3, "b")], [(1, "A"), (2, "b a"), (3, "c c")]
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [expected(i, t, items) for i, t in docs]


def test_automaton_finds_the_longest_match(spark):
    rng = random.Random(5)
    items = [(k, [rng.choice("abc") for _ in range(rng.randint(1, 25))]) for k in range(40)]
    automaton = SuffixAutomaton(items, 4)
    stream = [rng.choice("abcd") for _ in range(3000)]
    ids = [automaton.vocabulary.get(w, -1) for w in stream]
    got = {end: automaton.named(set(states)) for _, end, states in automaton.matches(ids, 0)}
    for end in range(1, len(stream) + 1):
        want = set()
        for k, w in items:
            n = min(4, len(w))
            if n <= end and any(w[a : a + n] == stream[end - n : end] for a in range(len(w) - n + 1)):
                want.add(k)
        assert got.get(end, set()) == want


def test_passages_go_and_covered_documents_with_them(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [
        (1, "Before, ONE two-three four (five) six seven eight nine TEN, after it all we say more and more of it. ", "x", 1),
        (2, f"({item})", "y", 2), (3, None, "z", 3), (4, "", None, None), (5, "clean   text\n", "q", 4), (5, "clean   text\n", "q", 4),
        (6, f"A b c d e f g h i j k l. {item} {item}! End é", "w", 5),
    ]
    table = spark.createDataFrame(docs, "doc_id long, text string, __marks string, stays int")
    got = decontamination.decontaminated(table, spark.createDataFrame([(1, item)], "item_id long, text string"), coverage=0.7)
    assert got.columns == table.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "Before, , after it all we say more and more of it. ", "x", 1), *docs[2:6], (6, "A b c d e f g h i j k l. ! End é", "w", 5)], key=str
    )


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b", "x")], "item_id long, text string, n_words string")
    assert decontamination.contamination(none, items).collect() == []
    docs = spark.createDataFrame([(1, "a b c", 5, "i")], "doc_id long, text string, n_words int, item_id string")
    assert [tuple(r)[:4] for r in decontamination.contamination(docs, items).collect()] == [(1, 3, 2, 1)]
    nothing = decontamination.contamination(docs, items.limit(0)).collect()
    assert [tuple(r) for r in nothing] == [(1, 3, 0, 0, hashlib.sha256(b"").hexdigest(), False)]
    assert decontamination.decontaminated(docs, items.limit(0)).collect() == docs.collect()
