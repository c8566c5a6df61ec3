import hashlib
import random

import numpy as np
import pytest

from folioflow.llm.bpe import encode, round_trip

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(5)
    odd = [" ", "  ", "\n", "\t", "\r\n", "a", "Bc", "é", "ñ", "漢字", "😀", "'s", "'ll", "12", "½²", " ", " ", "\x1c", "\x85", "_", "-", "<|endoftext|>", "<|", "é", "‍", "\x00", "ẞ", "don't", "I'M"]
    out = ["".join(rng.choices(odd, k=rng.randint(1, 30))) for _ in range(800)]
    return [*out, None, "", " ", "   ", " x", "x ", "x  ", "\n x", " \n  x", "a" * 3000, "word " * 5000]


def test_same_as_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, x, "q") for i, x in rows], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in round_trip(df.repartition(3), PATH).collect()}
    assert len(got) == len(rows)
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids), (i, x)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), (i, x)
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_repeated_rows_and_no_id(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    one = spark.createDataFrame([(1, "one two"), (None, "no id"), (None, None), (0, "no id"), (2, "two  three"), (2, "two  three")], "doc_id long, text string").coalesce(1)
    got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in encode(one.union(one), PATH).collect()]
    want = [(i, t.encode(x, add_special_tokens=False).ids) for i, x in [(1, "one two"), (None, "no id"), (None, ""), (0, "no id"), (2, "two  three"), (2, "two  three")] * 2]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_decoding_is_of_the_ids(spark):
    """Any ids decode to their pieces, whatever text they came from."""
    from tokenizers import Tokenizer

    from folioflow.llm.bpe import decode

    t, rng = Tokenizer.from_file(PATH), random.Random(2)
    seqs = [[rng.randrange(t.get_vocab_size()) for _ in range(rng.randint(0, 40))] for _ in range(200)]
    rows = [(i if i % 5 else None, bytearray(np.array(s, "<u4").tobytes())) for i, s in enumerate(seqs)] + [(1000, None)]
    got = sorted((str(r.doc_id), r.decoded) for r in decode(spark.createDataFrame(rows, "doc_id long, ids binary").repartition(3), PATH).collect())
    assert got == sorted([(str(i if i % 5 else None), t.decode(s, skip_special_tokens=False)) for i, s in enumerate(seqs)] + [("1000", "")])


def test_one_pack_is_held_at_a_time(monkeypatch):
    """While the next pack is made, nobody holds the words of the one before."""
    import gc

    import pyarrow as pa

    from folioflow.llm import bpe

    held = []

    def batches():
        for i in range(12):
            gc.collect()
            held.append(sum(len(o) > 3 for o in gc.get_objects() if type(o) is bpe._Numbers))
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([" ".join(f"w{i}x{j}" for j in range(20))])], ["id", "text"])

    monkeypatch.setattr(bpe, "PACK_PIECES", 60)
    assert sum(1 for _ in bpe._to_buckets(["<|endoftext|>"], 1)(batches())) == 4 and max(held) <= 1
    assert sum(1 for _ in bpe._numbers_of(["<|endoftext|>"])(batches())) == 4 and max(held) <= 1


def test_words_go_in_few_bytes():
    """Sizes of words cost less than a byte each beside the text."""
    import zstandard

    from folioflow.llm import bpe

    rng = random.Random(4)
    words = [" " + "".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 9))) for _ in range(1000)] + ["", "é", "漢字\x00 ", "a" * 70_000]
    blob = bpe._squeeze_words(words)
    assert bpe._unsqueeze_words(blob) == words and bpe._unsqueeze_words(bpe._squeeze_words([""])) == [""]
    assert len(blob) < len(zstandard.ZstdCompressor(level=3).compress("".join(words).encode())) + 0.8 * len(words)


def test_pieces_are_those_between_cuts():
    import re

    from folioflow.llm import bpe

    cut = re.compile(r"(?= \S)|(?<=[A-Za-z])(?=[!-/:-@\[-`{-~])")
    for x in texts():
        assert bpe._PIECE.findall(x or "") == [p for p in cut.split(x or "") if p]
