import random

from folioflow.llm.suffix_dedup import drop_repeats, removed_repeats


def brute(rows, length):
    seen = {}
    raws = {i: (t or "").encode() for i, t in rows}
    for i, r in raws.items():
        for p in range(len(r) - length + 1):
            seen.setdefault(r[p : p + length], []).append((i, p))
    gone = {i: bytearray(len(r)) for i, r in raws.items()}
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + length] = b"\1" * length
    return {i: bytes(c for c, g in zip(r, gone[i]) if not g) for i, r in raws.items()}, gone


def test_brute_force(spark):
    rng = random.Random(7)
    say = lambda n: "".join(rng.choices("abcdefghij é", k=n))
    base = say(300)
    rows = [(0, base), (1, base), (2, base[:150] + "!" + base[150:]), (3, say(120) + base[40:140] + say(30)), (4, None), (5, ""), (6, "ab" * 90), (7, say(400)), (8, base[:39]), (9, "zz" + base[:41]), (10, base[100:200] * 2), (11, "q" * 60), (12, say(80) + base[260:] + base[:60])]
    df = spark.createDataFrame([(i, t, "r", 0) for i, t in rows], "doc_id long, text string, rid string, off int").repartition(3)
    got = {r.doc_id: r for r in drop_repeats(df, length=40).collect()}
    want, gone = brute(rows, 40)
    for i, _ in rows:
        assert bytes(got[i].kept) == want[i], i
        assert sum(s.end - s.start for s in got[i].spans) == sum(gone[i])


def test_empty(spark):
    assert removed_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated_rows(spark):
    rng = random.Random(8)
    say = lambda n: "".join(rng.choices("abcdefghij", k=n))
    base = say(120)
    rows = [(1, base), (1, base), (2, say(60)), (2, say(70)), (2, base[:50] + say(30)), (3, "short"), (3, "short"), (4, say(90))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, _ = brute([(k, t) for k, (_, t) in enumerate(rows)], 40)
    got = sorted((r.doc_id, bytes(r.kept)) for r in drop_repeats(df, length=40).collect())
    assert got == sorted((i, want[k]) for k, (i, _) in enumerate(rows))


def test_real_texts(spark):
    """All of the smallest table at the length in use."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, gone = brute(rows, 400)
    got = {r.doc_id: r for r in drop_repeats(docs).collect()}
    assert {i: bytes(r.kept) for i, r in got.items()} == want
    assert {i: sum(s.end - s.start for s in r.spans) for i, r in got.items()} == {i: sum(g) for i, g in gone.items()}


def test_text_that_ends_at_a_cut(spark):
    rng = random.Random(12)
    base = "".join(rng.choices("abcdefghij ", k=600))
    rows = [(n, base[:n] + ("" if n % 2 else "".join(rng.choices("xyz", k=50)))) for n in range(440, 520)]
    want, _ = brute(rows, 400)
    got = {r.doc_id: bytes(r.kept) for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_hot_passage_null_ids_and_long_text(spark, monkeypatch):
    """One passage in nine of ten rows, rows without an id, a text of several pieces."""
    from folioflow.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 1000)
    rng = random.Random(13)
    say = lambda n: "".join(rng.choices("abcdefghij é", k=n))
    hot = say(90)
    rows = [(k if k % 7 else None, (say(rng.randint(0, 40)) + hot if k % 10 else "") + say(rng.randint(0, 40))) for k in range(300)]
    long = say(5000)
    rows += [(None, None), (None, hot), (None, hot), (900, long), (901, long[100:4000]), (902, "ab" * 3000)]
    want, _ = brute(list(enumerate(t for _, t in rows)), 40)
    got = sorted(((r.doc_id, bytes(r.kept)) for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), length=40).collect()), key=str)
    assert got == sorted(((i, want[k]) for k, (i, _) in enumerate(rows)), key=str)


def test_a_bucket_is_compared_in_little_memory():
    """Columns stay as narrow as their numbers are, and are put in order in parts."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from folioflow.llm import suffix_array

    rng, n, slices = np.random.default_rng(3), 20_000, 40
    rows = []
    for _ in range(slices):
        klass = rng.integers(0, 3, n).astype(np.uint64)
        columns = [np.sort(rng.integers(0, 1 << 40, n)).astype(np.uint64), klass, *(rng.integers(0, m, n).astype(np.uint64) for m in (1 << 40, 1 << 24, 1 << 24, 1 << 62, 2))]
        rows.append([suffix_array.press(np.diff(columns[0], prepend=np.uint64(0))), *(suffix_array.press(suffix_array._narrow(c)) for c in columns[1:])])
    table = pa.table({"bucket": [0] * slices, "pack": list(range(slices)), "columns": rows})
    tracemalloc.start()
    out = suffix_array._compare_bucket(table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["many"].to_pylist() == [n * slices] * slices
    assert most < 100 * n * slices


def test_copies_of_a_passage_are_put_in_order_once(spark, monkeypatch):
    """A passage of forty texts, whole or with a word changed, goes on about once."""
    from folioflow.llm import suffix_dedup

    ordered, real = [], suffix_dedup.repeated_strings

    def counted(packs, length):
        ordered.append(sum(n for r in packs.select("sizes").collect() for n in r.sizes))
        return real(packs, length)

    monkeypatch.setattr(suffix_dedup, "repeated_strings", counted)
    rng = random.Random(14)
    say = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    passage = say(3000)
    rows = [(k, say(60) + (passage if k % 4 else passage[:1500] + "XY" + passage[1500:]) + say(60)) for k in range(40)]
    want, _ = brute(rows, 400)
    got = {r.doc_id: bytes(r.kept) for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == want
    assert ordered[0] < 15 * len(passage)
