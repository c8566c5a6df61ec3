"""Byte-pair encoding and decoding of whole texts through a distinct-word table.

1. Texts are split where byte-level pre-tokenization always cuts and never looks
   back over the cut: before each space that a non-space follows, and between an
   ASCII letter and an ASCII mark. The ids of a text are those of its pieces, one
   after another. Each input partition makes packs: its own distinct pieces once,
   and each text as numbers of pieces.
2. The distinct pieces of packs go by hash to buckets; a bucket encodes each piece
   once, for however many packs and texts it occurs in.
3. The ids come back to their pack and are put in by position.

Packs are made twice from the same partition, once for their pieces and once for
their numbers, as that moves less than to keep them; a pack's name is a hash of all
it holds, so packs that differ can't be mixed up. Packs that hold the same rows share
a name and the answers, and each gives its own rows.

Decoding joins the distinct ids of packs of rows with the vocabulary, a table of ids
and pieces of fixed size.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tasks import key_runs, text_or_empty, tidy, tidy_group

PACK_PIECES = 500_000
BUCKET_CHARS = 8_000_000
DECODE_BYTES = 1 << 20
#: A piece, from its first character to the next cut.
_MARKS = r"!-/:-@\[-`{-~"
_PIECE = re.compile(rf"(?s).[^ {_MARKS}]*+(?:(?:(?<![A-Za-z])[{_MARKS}]| (?!\S))[^ {_MARKS}]*+)*+")


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _squeeze(a: np.ndarray) -> bytes:
    """An array, byte planes apart and compressed; its first byte is the width."""
    width = a.dtype.itemsize
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, width).T).tobytes()
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(planes)


def _unsqueeze(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(f"<u{width}")


def _squeeze_words(words: list[str]) -> bytes:
    """Words as one text, and apart from it their sizes, which are small numbers."""
    raw = [w.encode() for w in words]
    sizes = _squeeze(np.fromiter(map(len, raw), np.uint32, len(raw)))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.ZstdCompressor(level=3).compress(b"".join(raw))


def _unsqueeze_words(blob: bytes) -> list[str]:
    n = int.from_bytes(blob[:4], "little")
    ends = np.cumsum(_unsqueeze(blob[4 : 4 + n])).tolist()
    raw, starts = zstandard.ZstdDecompressor().decompress(blob[4 + n :]), [0, *ends[:-1]]
    return [raw[a:b].decode() for a, b in zip(starts, ends)]


class _Numbers(dict):
    """Numbers of keys in the order in which they were first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _packs(added: list[str]):
    """(name, numbers, ids, sizes, seqs) of each pack of a partition's texts. A text
    that holds one of the vocabulary's ``added`` tokens is one piece."""

    def run(batches):
        numbers, ids, sizes, seqs, held = _Numbers(), [], [], [], 0

        def named():
            name = hashlib.sha256("\0".join(numbers).encode())
            null = np.array([i is None for i in ids])
            for s in (np.array([i or 0 for i in ids], np.int64), null, np.array(sizes, np.uint32), *seqs):
                name.update(s.tobytes())
            return int.from_bytes(name.digest()[:8], "little") >> 1, numbers, ids, sizes, seqs

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                parts = [text] if any(a in text for a in added) else _PIECE.findall(text) or [text]
                ids.append(i)
                sizes.append(len(parts))
                seqs.append(np.fromiter(map(numbers.__getitem__, parts), np.uint32, len(parts)))
                held += len(parts)
                if held >= PACK_PIECES:
                    pack = [named()]
                    numbers, ids, sizes, seqs, held = _Numbers(), [], [], [], 0
                    yield pack.pop()  # nobody holds a pack while the next one is made
        if ids:
            yield named()

    return run


def _numbers_of(added: list[str]):
    def run(batches):
        for name, numbers, ids, sizes, seqs in _packs(added)(batches):
            del numbers
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([_squeeze(np.array(sizes, np.uint32))], pa.binary()),
                    pa.array([_squeeze(np.concatenate(seqs))], pa.binary()),
                ],
                ["pack", "ids", "sizes", "seq"],
            )
            del ids, sizes, seqs

    return run


def _to_buckets(added: list[str], buckets: int):
    def run(batches):
        for name, numbers, *rest in _packs(added)(batches):
            words = list(numbers)
            del numbers, rest
            at = np.array([zlib.crc32(w.encode()) % buckets for w in words], np.int64)
            order = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                own = order[a:b]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(at[own[0]])], pa.int64()),
                        pa.array([name], pa.int64()),
                        pa.array([_squeeze_words([words[i] for i in own.tolist()])], pa.binary()),
                        pa.array([_squeeze(np.diff(own, prepend=0).astype(np.uint32))], pa.binary()),
                    ],
                    ["bucket", "pack", "words", "at"],
                )
            del words

    return run


def _encode_words(path: str):
    """Encodes each distinct piece of a bucket once and answers each pack."""

    def run(table):
        # Of a pack's words only their numbers stay.
        number, lists = _Numbers(), []
        for blob in table.column("words"):
            words = _unsqueeze_words(blob.as_py())
            lists.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        distinct, tok = list(number), _tokenizer(path)
        del number
        sizes, flat = np.zeros(len(distinct) + 1, np.int64), []
        for a in range(0, len(distinct), 4096):
            got = [e.ids for e in tok.encode_batch(distinct[a : a + 4096], add_special_tokens=False)]
            sizes[a + 1 : a + 1 + len(got)] = [len(x) for x in got]
            flat.append(np.fromiter((i for x in got for i in x), np.uint32))
        flat, starts = np.concatenate(flat), np.cumsum(sizes)
        answers = []
        for own in lists:
            n = sizes[own + 1]
            ids = flat[_ranges(starts[own], n)]
            answers.append((_squeeze(n.astype(np.uint32)), _squeeze(ids)))
        return pa.table(
            {
                "pack": table.column("pack"),
                "at": table.column("at"),
                "n": pa.array([x for x, _ in answers], pa.binary()),
                "tokens": pa.array([x for _, x in answers], pa.binary()),
            }
        )

    return run


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + sizes[0] - 1, then the same of the next, and so on."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def _put_in(batches):
    for table in key_runs(batches, ["pack"]):
        answers, mine = {}, []
        for r in table.to_pylist():
            if r["at"] is None:
                mine.append(r)
            else:
                answers[r["at"]] = r  # equal packs get equal answers
        at = [np.cumsum(_unsqueeze(r["at"])) for r in answers.values()]
        n = [_unsqueeze(r["n"]) for r in answers.values()]
        tokens = [_unsqueeze(r["tokens"]) for r in answers.values()]
        if not mine or not at:
            raise ValueError("the input gave other rows when it was read again; write it to a table first")
        words = int(max(int(x[-1]) for x in at)) + 1
        sizes, starts, before = np.zeros(words, np.int64), np.zeros(words, np.int64), 0
        for a, m, t in zip(at, n, tokens):
            sizes[a] = m
            starts[a] = before + np.cumsum(m, dtype=np.int64) - m
            before += len(t)
        flat = np.concatenate(tokens)
        for docs in mine:
            yield from _filled(docs, flat, starts, sizes)


def _filled(docs: dict, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """The rows of one pack, with the ids of their pieces."""
    seq, first = _unsqueeze(docs["seq"]), 0
    out_ids, out, held = [], [], 0
    for i, size in zip(docs["ids"], _unsqueeze(docs["sizes"]).tolist()):
        own = seq[first : first + size]
        first += size
        out_ids.append(i)
        out.append(flat[_ranges(starts[own], sizes[own])].astype("<u4").tobytes())
        held += len(out[-1])
        if held > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out, pa.binary())], ["id", "ids"])
            out_ids, out, held = [], [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out, pa.binary())], ["id", "ids"])


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id and ``ids``, the token ids of the
    whole text as little-endian unsigned 32-bit integers. Rows that occur twice give
    two, rows without an id keep none.

    Ids equal those of the tokenizers library for byte-level vocabularies. Null
    and empty texts give no tokens, a table without rows none. A vocabulary's
    special tokens that occur in a text are encoded as the library does it. Texts of any
    length are encoded whole. Other
    columns are not looked at.
    """
    return _answered(docs, tokenizer_path, id_col, text_col).mapInArrow(tidy(_put_in), "id long, ids binary").withColumnRenamed("id", id_col)


def _answered(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str) -> DataFrame:
    """Packs with the ids of their pieces, each pack's rows together."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    # Only the tasks that encode load the vocabulary.
    added = [t.content for t in _tokenizer(tokenizer_path).get_added_tokens_decoder().values()]
    packs = texts.mapInArrow(tidy(_numbers_of(added)), "pack long, ids array<long>, sizes binary, seq binary")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(16, -(-chars // BUCKET_CHARS))
    asked = texts.mapInArrow(tidy(_to_buckets(added, buckets)), "bucket long, pack long, words binary, at binary")
    answered = asked.groupBy("bucket").applyInArrow(tidy_group(_encode_words(tokenizer_path)), "pack long, at binary, n binary, tokens binary")
    both = packs.unionByName(answered, allowMissingColumns=True)
    return both.repartition("pack").sortWithinPartitions("pack")


def vocabulary(spark: SparkSession, tokenizer_path: str) -> DataFrame:
    """(token, piece): the bytes of each id of a byte-level vocabulary, added tokens
    included. Its size is that of the vocabulary, whatever the texts are."""
    vocab = _tokenizer(tokenizer_path).get_vocab(with_added_tokens=True)
    # Printable Latin characters stand for themselves; the other bytes, in order,
    # for the characters from U+0100 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain}
    byte |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
    raw = lambda piece: bytearray(byte[c] for c in piece) if all(c in byte for c in piece) else bytearray(piece.encode())
    return spark.createDataFrame([(i, raw(piece)) for piece, i in vocab.items()], "token int, piece binary")


TOKENS = "pack long, token int, docs array<long>, seqs array<binary>"


def _tokens_of(batches):
    """Rows in packs of about DECODE_BYTES bytes of ids, and after each pack one row for
    each distinct id in it."""
    names = ["pack", "token", "docs", "seqs"]

    def rows(docs, seqs):
        pack = uuid.uuid4().int >> 65
        used = np.unique(np.frombuffer(b"".join(seqs), "<u4")).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([pack]), pa.array([None], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([seqs], pa.list_(pa.binary()))], names)
        if len(used):
            none = lambda kind: pa.nulls(len(used), pa.list_(kind))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), pack, np.int64)), pa.array(used), none(pa.int64()), none(pa.binary())], names)

    docs, seqs, held = [], [], 0
    for batch in batches:
        for i, ids in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist()):
            docs.append(i)
            seqs.append(ids or b"")
            held += len(seqs[-1]) + 16
            if held >= DECODE_BYTES:
                yield from rows(docs, seqs)
                docs, seqs, held = [], [], 0
    if docs:
        yield from rows(docs, seqs)


def _texts_of(id_col: str):
    def run(batches):
        for table in key_runs(batches, ["pack"]):
            token = table.column("token").combine_chunks()
            known = table.filter(token.is_valid())
            pieces = dict(zip(known.column("token").to_pylist(), known.column("piece").to_pylist()))
            for own in table.filter(token.is_null()).select(["docs", "seqs"]).to_pylist():
                for a in range(0, len(own["docs"]), 512):
                    seqs = own["seqs"][a : a + 512]
                    texts = [b"".join(map(pieces.__getitem__, np.frombuffer(x, "<u4").tolist())).decode("utf-8", "replace") for x in seqs]
                    yield pa.RecordBatch.from_arrays([pa.array(own["docs"][a : a + 512], pa.int64()), pa.array(seqs, pa.binary()), pa.array(texts, pa.string())], [id_col, "ids", "decoded"])

    return run


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id") -> DataFrame:
    """``encoded`` (id, ids) with ``decoded``, the text of the ids, special tokens
    included; bytes that are no UTF-8 become the replacement character.

    The distinct ids of each pack of rows are joined with the vocabulary, a table of
    fixed size that is broadcast, so the join moves no row; the pieces that come back
    with a pack are put in by position. Ids that the vocabulary lacks are an error;
    null ids are an empty text.
    """
    asked = encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(tidy(_tokens_of), TOKENS)
    return _decoded(asked, tokenizer_path, id_col)


def _decoded(asked: DataFrame, tokenizer_path: str, id_col: str) -> DataFrame:
    vocab = vocabulary(asked.sparkSession, tokenizer_path)
    found = asked.join(F.broadcast(vocab), "token", "left").select("pack", "token", "docs", "seqs", "piece")
    return found.mapInArrow(tidy(_texts_of(id_col)), f"`{id_col}` long, ids binary, decoded string")


def encode_and_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))``; a task's ids go from one step to the other in one Python
    worker."""
    asked = _answered(docs, tokenizer_path, id_col, text_col).mapInArrow(tidy(lambda batches: _tokens_of(_put_in(batches))), TOKENS)
    return _decoded(asked, tokenizer_path, id_col)


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of each row's encoding."""
    both = encode_and_decode(docs, tokenizer_path, id_col, text_col)
    return both.select(
        id_col,
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
