import random

from folioflow.llm.cdc_dedup import dedup_substrings


def rows():
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfglmn" for b in ("a", "é", "io", "urn", "est")]
    say = lambda n: " ".join("".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(n))
    passage = say(60)
    clean = [(i, say(rng.randint(1, 300))) for i in range(60)]
    out = list(clean)
    for i in range(60, 90):
        out.append((i, f"{say(rng.randint(0, 60))} {passage} {say(rng.randint(0, 60))}"))
    return [*out, (100, None), (101, ""), (102, "x" * 500), (103, "x" * 500), (104, "漢字" * 200)], passage


def test_passages_go_and_clean_texts_stay(spark):
    data, passage = rows()
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in data], "doc_id long, text string, pack string, id int")
    got = {r.doc_id: r for r in dedup_substrings(df.repartition(4)).collect()}
    assert sorted(got) == [i for i, _ in data]
    for i, t in data:
        raw, r = (t or "").encode(), got[i]
        kept, at = b"", 0
        for s in r.spans:
            kept, at = kept + raw[at : s.start], s.end
        assert (kept + raw[at:]).decode() == r.text and r.n_bytes == len(raw)
        if i < 61:
            assert not r.spans  # clean, or the first that has the passage
        elif i < 90:
            gone = sum(s.end - s.start for s in r.spans)
            assert 0.4 * len(passage.encode()) <= gone <= len(passage.encode()) + 40
    assert not got[102].spans and got[103].text == ""


def test_shifts(spark):
    base = rows()[0][70][1] * 3
    df = spark.createDataFrame([(1, base), (2, "an insertion " + base[:200] + " one more " + base[200:])], "doc_id long, text string")
    got = {r.doc_id: r for r in dedup_substrings(df).collect()}
    assert len(got[2].text) < 0.4 * len(base)


def test_empty(spark):
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def brute(data, average=16, least=128):
    """The rules one after another, on bytes: no digests, no packs."""
    from folioflow.llm.gear import _GEAR

    raws = {i: (t or "").encode() for i, t in data}
    chunks = {}
    for i, raw in raws.items():
        ends = [n + 1 for n in range(len(raw)) if sum(int(_GEAR[raw[n - k]]) << k for k in range(min(16, n + 1))) % 65536 < 65536 // average]
        ends = sorted({*ends, len(raw)} - {0})
        chunks[i] = list(zip([0, *ends[:-1]], ends)) if raw else []
    pairs = {}
    for i in sorted(chunks):
        own = chunks[i]
        both = [(k, k + 1) for k in range(len(own) - 1)] or [(0, 0) for a, b in own if b - a >= least]
        for a, b in both:
            pairs.setdefault(raws[i][own[a][0] : own[b][1]], []).append((i, a, b))
    bad = {i: set() for i in raws}
    for places in pairs.values():
        for i, a, b in sorted(places)[1:]:
            bad[i] |= {a, b}
    out = {}
    for i, own in chunks.items():
        spans, k = [], 0
        while k < len(own):
            m = k
            while m < len(own) and m in bad[i]:
                m += 1
            if m > k and own[m - 1][1] - own[k][0] >= least:
                a, b, raw = own[k][0], own[m - 1][1], raws[i]
                while a < b and raw[a] & 0xC0 == 0x80:
                    a += 1
                while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b -= 1
                spans.append((a, b))
            k = max(m, k + 1)
        out[i] = spans
    return out


def test_brute_force(spark):
    data, _ = rows()
    rng = random.Random(6)
    data = data + [(200 + k, data[rng.randrange(60)][1][: rng.randint(50, 900)] + data[rng.randrange(90)][1]) for k in range(40)]
    want = brute(data)
    got = dedup_substrings(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: [(s.start, s.end) for s in r.spans] for r in got} == want


def test_repeated_and_missing_ids(spark):
    """Every row is there; of a text in many rows one keeps it, one with an id if any has."""
    data, passage = rows()
    many = [(None, passage), (None, passage), (5, passage), (5, passage), (7, passage), (None, None)]
    got = dedup_substrings(spark.createDataFrame(many, "doc_id long, text string").repartition(3)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in many)
    whole = [r.doc_id for r in got if r.text and not r.spans]
    assert whole == [5]
