"""Substring dedup by content-defined chunks.

A gear rolling hash cuts each text into small variable chunks, so an insertion
moves the cuts around it only. Every pair of neighbouring chunks goes by digest to
a hash bucket; of equal pairs the one in the smallest (id, position) stays. Chunks
of the other pairs are repeats, and runs of repeats of at least ``least`` bytes are
cut out of their text.

Texts travel once, in packs. A pack finds its own repeats and sends each distinct
pair once, so a passage that a third of all texts share is one entry a pack; digests
of 128 bits stand for the pairs, as packed numbers of their pack.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gear import chunk_ends
from .tasks import keep, key_runs, mix, text_or_empty

AVERAGE = 16
LEAST = 128
PACK_BYTES = 4 << 20
BUCKET_CHARS = 16_000_000
LAST = 2**63 - 1

_NUMBER = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(int(_BASE), -1, 2**64))


_SECOND = np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SECOND_BASE = np.uint64(0xD1342543DE82EF95)
_SECOND_UNDO = np.uint64(pow(int(_SECOND_BASE), -1, 2**64))


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each data[begin:end], all in one go from prefix sums; with
    ``second`` another one, of other numbers."""
    number, base, undo = (_SECOND, _SECOND_BASE, _SECOND_UNDO) if second else (_NUMBER, _BASE, _UNDO)
    up, down = np.full(len(data) + 1, base, np.uint64), np.full(len(data) + 1, undo, np.uint64)
    up[:1], down[:1] = 1, 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(number[data] * up[:-1], out=run[1:])
    return mix((run[end] - run[begin]) * down[begin] + (end - begin).astype(np.uint64))


def pack_rows(pack_bytes: int = PACK_BYTES):
    """Packs of whole texts: (pack, ids, sizes, data), data being compressed UTF-8."""

    def row(ids, raws):
        return pa.RecordBatch.from_arrays(
            [
                pa.array([uuid.uuid4().int >> 65], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(r) for r in raws]], pa.list_(pa.int64())),
                pa.array([zstandard.ZstdCompressor(level=6).compress(b"".join(raws))], pa.binary()),
            ],
            ["pack", "ids", "sizes", "data"],
        )

    def run(batches):
        ids, raws, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                raws.append(t.as_py().encode())
                held += len(raws[-1])
                if held >= pack_bytes or len(ids) >= 50_000:
                    yield row(ids, raws)
                    ids, raws, held = [], [], 0
        if ids:
            yield row(ids, raws)

    return run


PACK_SCHEMA = "pack long, ids array<long>, sizes array<long>, data binary"


def unpack(data: bytes, sizes: list[int]) -> list[bytes]:
    raw, at = zstandard.ZstdDecompressor().decompress(data), np.cumsum([0, *sizes]).tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def _chunks(raws: list[bytes], average: int):
    """(begin, end, number of text) of all chunks in the joined texts."""
    ends = chunk_ends(raws, average)
    base = np.cumsum([0, *(len(r) for r in raws)])
    of = np.repeat(np.arange(len(raws)), [len(e) for e in ends])
    end = np.concatenate([e + b for e, b in zip(ends, base)]) if raws else np.zeros(0, np.int64)
    begin = np.concatenate([[0], end[:-1]]) if len(end) else end
    return begin.astype(np.int64), end.astype(np.int64), of


def _pairs(begin, end, of, least: int):
    """First and last chunk of each pair; a text of one long chunk pairs it with itself."""
    if not len(of):
        return of, of
    same = np.flatnonzero(of[1:] == of[:-1])
    first = np.concatenate([[True], of[1:] != of[:-1]])
    last = np.concatenate([of[1:] != of[:-1], [True]])
    alone = np.flatnonzero(first & last & (end - begin >= least))
    a, b = np.concatenate([same, alone]), np.concatenate([same + 1, alone])
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def _press(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _unpress(raw: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _order_of(ids: list) -> np.ndarray:
    """Ids as numbers, those that are null last."""
    return np.array([LAST if i is None else i for i in ids], np.int64)


def _own_pairs(row: dict, average: int, least: int):
    """Of a pack: its texts, their chunks (begin, end, of), the pairs (a, b), and of the
    distinct pairs the two digests and the number of the first, by id and position."""
    raws = unpack(row["data"], row["sizes"])
    begin, end, of = _chunks(raws, average)
    a, b = _pairs(begin, end, of, least)
    data = np.frombuffer(b"".join(raws), np.uint8)
    one, two = (span_hashes(data, begin[a], end[b], second) for second in (False, True))
    order = np.lexsort((np.arange(len(a)), _order_of(row["ids"])[of[a]], two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    return raws, begin, end, of, a, b, one, two, order[new]


def _digests(average: int, least: int, buckets: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                _, _, _, of, a, _, one, two, first = _own_pairs(r, average, least)
                if not len(first):
                    continue
                first = np.sort(first)
                ids = _order_of(r["ids"])[of[a]]
                bucket = (one[first] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                for x, y in zip(cuts, [*cuts[1:], len(order)]):
                    own = first[order[x:y]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(bucket[order[x]])], pa.int64()),
                            pa.array([r["pack"]], pa.int64()),
                            pa.array([one[own].tobytes() + two[own].tobytes()], pa.binary()),
                            pa.array([_press(np.diff(ids[own], prepend=0))], pa.binary()),
                            pa.array([_press(np.diff(own, prepend=0).astype(np.uint32))], pa.binary()),
                        ],
                        ["bucket", "pack", "keys", "ids", "nth"],
                    )

    return run


def _repeats(table):
    """Of the pairs that packs have sent to a bucket, those that come later than an equal one."""
    rows = table.to_pylist()
    keys = [np.frombuffer(r["keys"], np.uint64).reshape(2, -1) for r in rows]
    ids = np.concatenate([np.cumsum(_unpress(r["ids"], np.int64)) for r in rows])
    nth = np.concatenate([np.cumsum(_unpress(r["nth"], np.uint32)) for r in rows])
    bounds = np.cumsum([0, *(k.shape[1] for k in keys)])
    one, two = np.concatenate(keys, axis=1)
    # Packs that hold rows of one id are told apart by their place in the bucket.
    order = np.lexsort((np.arange(len(one)), nth, ids, two, one))
    again = np.zeros(len(one), bool)
    again[order[1:]] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
    out = [nth[a:b][again[a:b]].astype(np.uint32) for a, b in zip(bounds, bounds[1:])]
    return pa.table(
        {
            "pack": table.column("pack"),
            "nth": pa.array([_press(np.diff(x, prepend=np.uint32(0))) if len(x) else None for x in out], pa.binary()),
        }
    )


def _inside(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """The part of a:b that holds whole characters."""
    while a < b and raw[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def _cut_out(average: int, least: int):
    def run(batches):
        for table in key_runs(batches, ["pack"]):
            rows = table.select(["nth", "ids", "sizes", "data"]).to_pylist()
            (own,) = [r for r in rows if r["ids"] is not None]
            raws, begin, end, of, a, b, _, _, first = _own_pairs(own, average, least)
            # Repeats are the pairs that come later in the pack, and the first ones that
            # other packs have earlier.
            repeat = np.ones(len(a), bool)
            repeat[first] = False
            for r in rows:
                if r["nth"] is not None:
                    repeat[np.cumsum(_unpress(r["nth"], np.uint32))] = True
            bad = np.zeros(len(begin), bool)
            bad[a[repeat]] = bad[b[repeat]] = True
            # Runs of repeats within a text.
            new = np.ones(len(bad), bool)
            new[1:] = (bad[1:] != bad[:-1]) | (of[1:] != of[:-1])
            start = np.flatnonzero(new)
            stop = np.append(start[1:], len(bad)) - 1
            long = bad[start] & (end[stop] - begin[start] >= least) if len(bad) else np.zeros(0, bool)
            spans: dict[int, list] = {}
            base = np.cumsum([0, *own["sizes"]])
            for s, t in zip(start[long], stop[long]):
                i = int(of[s])
                p, q = _inside(raws[i], int(begin[s] - base[i]), int(end[t] - base[i]))
                spans.setdefault(i, []).append((p, q))
            chunks = np.bincount(of, minlength=len(raws))
            out = []
            for i, raw in enumerate(raws):
                cut, parts, at = spans.get(i, []), [], 0
                for p, q in cut:
                    parts.append(raw[at:p])
                    at = q
                out.append((own["ids"][i], len(raw), int(chunks[i]), [{"start": p, "end": q} for p, q in cut], b"".join([*parts, raw[at:]])))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[j] for o in out], t) for j, t in enumerate(types)], ["id", "n_bytes", "n_chunks", "spans", "kept"]
            )

    return run


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", average: int = AVERAGE, least: int = LEAST
) -> DataFrame:
    """One row for each row of ``docs``: its id, n_bytes, n_chunks, spans (byte
    offsets removed) and text, what is left.

    Null and empty texts have no chunks. Spans never split a character. Rows of one
    id, or of none, are rows of their own; rows without an id come last where the first
    of equal pairs stays, and which of several rows of one id has it is not said. Extra
    columns are not looked at; an empty table gives no rows. Texts of any length are cut whole.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    packs = keep(texts.mapInArrow(pack_rows(), PACK_SCHEMA), "cdc-packs")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(16, -(-chars // BUCKET_CHARS))
    digests = packs.mapInArrow(_digests(average, least, buckets), "bucket long, pack long, keys binary, ids binary, nth binary")
    repeats = digests.groupBy("bucket").applyInArrow(_repeats, "pack long, nth binary").where("nth is not null")
    both = packs.unionByName(repeats, allowMissingColumns=True).repartition("pack").sortWithinPartitions("pack")
    found = both.mapInArrow(
        _cut_out(average, least), "id long, n_bytes long, n_chunks long, spans array<struct<start: long, end: long>>, kept binary"
    )
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_chunks", "spans", F.decode("kept", "UTF-8").alias("text"))


def repeats_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_removed, n_spans and kept_sha256."""
    found = dedup_substrings(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", "n_chunks", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")
    )
