import hashlib
import random
import zlib

import numpy as np
import pytest

from folioflow.llm.gear import chunk_ends
from folioflow.llm.media import chunk_store, from_media, read_media, stored_features, to_media


def test_round_trip(spark):
    rng = random.Random(3)
    base = "".join(rng.choices("abcdefgh é漢\n ", k=60_000))
    rows = [(i, base[i * 7 :][: rng.choice([0, 1, 63, 64, 65, 5000, 50_000])]) for i in range(40)]
    rows += [(90, None), (91, ""), (92, base), (93, base), (94, "insert" + base), (95, "a" * 200_000)]
    df = spark.createDataFrame([(i, t, b"x", 1) for i, t in rows], "doc_id long, text string, piece binary, nth int").repartition(3)
    got = {r.doc_id: r for r in stored_features(df).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert (r.media_bytes, r.media_sha256) == (len(to_media(raw)), hashlib.sha256(to_media(raw)).hexdigest())
    assert got[92].feature == got[93].feature
    store, recipes, dictionary = chunk_store(df)
    assert store.count() < recipes.count()
    with pytest.raises(Exception, match="not what was stored"):
        read_media(store, recipes.where("not (doc_id = 92 and nth = 1)".replace("doc_id", "id")), dictionary).collect()


def test_media_codec():
    assert from_media(to_media(b"")) == (0, bytes(64))
    with pytest.raises(ValueError):
        from_media(to_media(b"abc")[:-1])


def test_cuts_resist_shifts():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, 20_000, dtype=np.uint8).tobytes()
    b = b"shifted by this" + a
    x, y = (set(np.diff(e[1:]).tolist()) for e in chunk_ends([a, b], 256))
    ends = chunk_ends([a, b], 256)
    assert set((ends[1] - 15).tolist()) >= set(ends[0][1:].tolist())


def test_empty(spark):
    assert stored_features(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated_rows(spark):
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefgh \n", k=150_000))
    rows = [(1, long), (1, long), (1, "other"), (2, "x"), (2, "x"), (2, "x"), (2, None), (3, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.media_sha256) for r in stored_features(df).collect())
    assert got == sorted((i, hashlib.sha256(to_media((t or "").encode())).hexdigest()) for i, t in rows)


def test_hot_chunk_null_ids_and_repeats_inside_texts(spark):
    """Nine of ten rows hold one long passage; it is stored once, with or without ids."""
    rng = random.Random(4)
    say = lambda n: "".join(rng.choices("abcdefgh \n", k=n))
    hot = say(60_000)
    rows = [(i if i % 9 else None, (hot if i % 10 else "") + say(50)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((str(r.doc_id), r.media_sha256) for r in stored_features(df).collect()))
    assert got == sorted((str(i), hashlib.sha256(to_media(t.encode())).hexdigest()) for i, t in rows)
    store, recipes, _ = chunk_store(df)
    assert store.count() < 0.4 * recipes.count()


def test_no_turn_moves_much_of_the_store():
    """A turn's shuffle files are scratch disk, so each has a small part of the chunks."""
    import random

    import pyarrow as pa

    from folioflow.llm import media

    rng = random.Random(8)
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(["".join(rng.choices("abcdefghij \n", k=20_000)) for _ in range(60)])], ["id", "text"])
    moved, digests = [], set()
    for part in range(media.PARTS):
        rows = [r for b in media._payloads(b"", part, media.PARTS)([batch]) for r in b.to_pylist()]
        moved.append(sum(len(r["piece"]) for r in rows))
        digests |= {r["digest"] for r in rows}
    assert max(moved) < 0.35 * sum(moved)
    assert digests == {r["digest"] for b in media._recipes([batch]) for r in b.to_pylist()}
