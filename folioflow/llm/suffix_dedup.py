"""Substring dedup by a distributed suffix array (difference cover modulo 3).

1. Of equal texts one is looked at, long ones in pieces that overlap by a string less
   a byte. Content-defined chunks that occur once rule out all strings that hold them;
   what is left are regions of the texts. Regions that share chunks go to one pack.
   A second look at the regions takes smaller pieces: strings around one that occurs
   once are ruled out, and of equal pieces, with all strings that start in them, one
   stays to be put in order for all.
2. The suffixes of the regions are put in order (suffix_array): sampled triples, names
   of names, and the merge of the rest.
3. Suffixes next to each other are compared over their first ``length`` bytes: where
   these are equal the string occurs again, and its bytes go.

Matches never cross texts, as each region is a string of its own.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .gear import WINDOW, chunk_ends
from .suffix_array import _Layout, press, repeated_strings, unpress
from .tasks import discard, hot_join, keep, mix, text_or_empty, tidy

LENGTH = 400
AVERAGE = 32
#: The same for the second look.
PIECE_AVERAGE = 16
#: Bytes of text in a pack and of regions in a pack; strings that start in one piece.
TEXT_BYTES = 2 << 20
REGION_BYTES = 1 << 20
PIECE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(int(_BASE), -1, 2**64))
_NUMBER = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OTHER = np.random.default_rng(13).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


PACK = "pack long, reps array<long>, starts array<long>, sizes array<long>, text binary"


def _packed(rows: list, data: list[bytes], *more):
    """One row: a name, the text and the offset of each string, and the strings' bytes,
    compressed."""
    text = zstandard.ZstdCompressor(level=3).compress(b"".join(data))
    longs = [[r[0] for r in rows], [r[1] for r in rows], [len(d) for d in data]]
    return pa.RecordBatch.from_arrays(
        [pa.array([uuid.uuid4().int >> 65], pa.int64()), *(pa.array([x], pa.list_(pa.int64())) for x in longs), *(pa.array([x], pa.binary()) for x in (text, *more))],
        ["pack", "reps", "starts", "sizes", "text", *(["cuts"] if more else [])],
    )


def _text_packs(length: int):
    def run(batches):
        rows, data, held = [], [], 0
        for batch in batches:
            for rep, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                for a in range(0, max(1, len(raw) - length + 1), PIECE_BYTES):
                    rows.append((rep, a))
                    data.append(raw[a : a + PIECE_BYTES + length - 1])
                    held += len(data[-1])
                    if held >= TEXT_BYTES:
                        yield _packed(rows, data, _cuts(data))
                        rows, data, held = [], [], 0
        if rows:
            yield _packed(rows, data, _cuts(data))

    return run


def _cuts(raws: list[bytes]) -> bytes:
    """Where the chunks of the joined strings end."""
    base = np.cumsum([0, *map(len, raws)])
    ends = np.concatenate([e + b for e, b in zip(chunk_ends(raws, AVERAGE), base)])
    return press(np.diff(ends, prepend=0).astype(np.uint32))


def _chunk_keys(row: dict):
    """Of a pack: its bytes, where its strings start, and (begin, end, number of string,
    key) of their chunks."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]), np.uint8)
    base = np.cumsum([0, *row["sizes"]])
    end = np.cumsum(unpress(row["cuts"]).astype(np.int64))
    begin = np.concatenate([[0], end[:-1]])
    of = np.searchsorted(base, end, "left") - 1
    return data, base, begin, end, of, _hashes(data, _NUMBER, (begin, end))[0]


def _hashes(data: np.ndarray, number: np.ndarray, *spans) -> list[np.ndarray]:
    """A hash of the bytes of each span, for each pair (begins, ends)."""
    up, down = np.full(len(data) + 1, _BASE, np.uint64), np.full(len(data) + 1, _UNDO, np.uint64)
    up[:1], down[:1] = 1, 1
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(number[data] * np.multiply.accumulate(up)[:-1], out=run[1:])
    down = np.multiply.accumulate(down)
    return [mix((run[end] - run[begin]) * down[begin] + (end - begin).astype(np.uint64)) for begin, end in spans]


def _keys(batches):
    """The distinct chunks of each pack, and whether they occur there more than once. Those
    at an end of a text count too: the text may end where others have a cut."""
    for batch in batches:
        for r in batch.to_pylist():
            key, n = np.unique(_chunk_keys(r)[-1], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(np.full(len(key), r["pack"], np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["key", "pack", "n"]
            )


def _regions(length: int):
    """(near, rep, start, region) of what may hold a string of ``length`` bytes that
    occurs again: strings around a chunk of one occurrence, and the bytes that its
    cuts depend on, can't. ``near`` is the least key of the region's chunks."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in ("reps", "starts", "sizes", "text", "cuts")}
                once = batch.column("once")[k].values
                r["once"] = np.zeros(0, np.uint64) if once is None else once.to_numpy(zero_copy_only=False).view(np.uint64)
                data, base, begin, end, of, key = _chunk_keys(r)
                once = np.isin(key, r["once"])
                low, high = np.maximum(end - length, base[of]), np.minimum(begin - WINDOW, base[of + 1] - length) + 1
                inner = (begin > base[of]) & (end < base[of + 1])  # with a cut at both ends
                fit = once & inner & (low < high)
                # Starts of strings that are left: from a text's start, or where what is ruled
                # out ends, to where it begins again, or the text has no more such strings.
                a = np.concatenate([base[:-1], high[fit]])
                b = np.concatenate([low[fit], np.maximum(base[1:] - length + 1, base[:-1])])
                a, b = np.sort(a), np.sort(b)
                left = a < b
                a, b = a[left], b[left] - 1
                if not len(a):
                    continue
                a, b, who = _runs_of(a, b, base, length)
                near = []
                for x, y in zip(np.searchsorted(begin, a), np.searchsorted(end, b, "right")):
                    near.append(int(key[x:y].min().view(np.int64)) if x < y else 0)
                reps, starts = np.asarray(r["reps"], np.int64)[who], np.asarray(r["starts"], np.int64)[who] + a - base[who]
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near, pa.int64()), pa.array(reps), pa.array(starts), pa.array([raw[x:y] for x, y in zip(a, b)], pa.binary())],
                    ["near", "rep", "start", "region"],
                )

    return run


def _runs_of(a: np.ndarray, b: np.ndarray, base: np.ndarray, length: int):
    """(begin, end, number of string) of the bytes of strings that start from ``a`` to
    ``b``; those that lie close in a string of the pack are one run."""
    own = np.searchsorted(base, a, "right") - 1
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] - b[:-1] > length) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    return a[first], b[np.append(first[1:], len(b)) - 1] + length, own[first]


def _region_packs(batches):
    rows, data, held = [], [], 0
    for batch in batches:
        for rep, start, region in zip(*(batch.column(c).to_pylist() for c in ("rep", "start", "region"))):
            if held and held + len(region) > REGION_BYTES:
                yield _packed(rows, data)
                rows, data, held = [], [], 0
            rows.append((rep, start))
            data.append(region)
            held += len(region)
    if rows:
        yield _packed(rows, data)


class _Pieces:
    """The pieces of a pack's regions, from cut to cut, that strings of ``length`` bytes
    start in, each with its last string's end, and the first half of a string after each
    cut. Pieces are told by two hashes, halves by one, as for those a clash costs work
    alone."""

    def __init__(self, row: dict, length: int):
        raw = zstandard.ZstdDecompressor().decompress(row["text"])
        self.data, self.base = np.frombuffer(raw, np.uint8), np.cumsum([0, *row["sizes"]])
        base, half = self.base, length // 2
        raws = [raw[a:b] for a, b in zip(base, base[1:])]
        cut = np.concatenate([e + b for e, b in zip(chunk_ends(raws, PIECE_AVERAGE), base)])
        begin = np.concatenate([[0], cut[:-1]])
        own = np.searchsorted(base, cut, "left") - 1
        self.last_start = np.maximum(base[1:] - length, base[:-1] - 1)
        after = np.minimum(cut, self.last_start[own] + 1)
        piece = begin < after
        self.begin, self.after = begin[piece], after[piece]
        inner = (begin > base[own]) & (begin + half <= base[own + 1])
        self.at, self.own = begin[inner], own[inner]
        self.low = np.maximum(self.at + half - length, base[self.own])
        self.high = np.minimum(self.at - WINDOW, self.last_start[self.own]) + 1
        spans = (self.begin, self.after + length - 1), (self.at, self.at + half)
        key = np.concatenate(_hashes(self.data, _NUMBER, *spans))
        other = np.zeros(len(key), np.uint64)  # 0 is for halves
        other[: len(self.begin)] = _hashes(self.data, _OTHER, spans[0])[0] | np.uint64(1)
        order = np.lexsort((other, key))
        new = np.ones(len(key), bool)
        new[1:] = (np.diff(key[order]) != 0) | (np.diff(other[order]) != 0)
        group = np.empty(len(key), np.int64)
        group[order] = np.cumsum(new) - 1
        self.group, self.half_group = group[: len(self.begin)], group[len(self.begin) :]
        self.first = order[new]  # of each distinct one its first place
        self.key, self.other, self.n = key[self.first], other[self.first], np.bincount(group, minlength=len(self.first))


def _piece_keys(length: int):
    """The distinct pieces and halves of each pack, by number, and whether they occur
    there more than once."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                p = _Pieces(r, length)
                columns = p.key.view(np.int64), p.other.view(np.int64), np.full(len(p.key), r["pack"], np.int64), np.arange(len(p.key), dtype=np.int32), np.minimum(p.n, 2).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "other", "pack", "nth", "n"])

    return run


SETTLED = pa.list_(pa.struct([("rep", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def _second_look(length: int):
    """Packs of what is left to put in order, and the bytes of pieces that occur again:
    strings around a half that occurs once can't, and a piece that another pack, or an
    earlier place of the pack, stands for is put in order there."""

    def settled(r: dict, p: _Pieces, again: np.ndarray):
        a, b = p.begin[again], p.after[again] + length - 1
        own = np.searchsorted(p.base, a, "right") - 1
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] > b[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(new)
        a, b, own = a[first], b[np.append(first[1:], len(b)) - 1], own[first]
        start = np.asarray(r["starts"], np.int64)[own] - p.base[own]
        parts = [pa.array(x) for x in (np.asarray(r["reps"], np.int64)[own], start + a, start + b)]
        spans = pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.StructArray.from_arrays(parts, ["rep", "start", "end"]))
        pack = [pa.nulls(1, t) for t in (pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary())]
        return pa.RecordBatch.from_arrays([*pack, spans], ["pack", "reps", "starts", "sizes", "text", "spans"])

    def packed(rows, data):
        return _packed(rows, data).append_column("spans", pa.nulls(1, SETTLED))

    def run(batches):
        rows, data, held = [], [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in ("reps", "starts", "sizes", "text")}
                p = _Pieces(r, length)
                once, here, there = (np.zeros(len(p.key), bool) for _ in range(3))
                for c, marks in (("once", once), ("here", here), ("there", there)):
                    marks[batch.column(c)[k].as_py() or []] = True
                again = (here | there)[p.group]
                if again.any():
                    yield settled(r, p, again)
                alone = once[p.half_group] & (p.low < p.high)
                copy = again & (there[p.group] | (p.first[p.group] != np.arange(len(p.group))))
                edges = [(p.base[:-1], p.last_start + 1, 1), (p.low[alone], p.high[alone], -1), (p.begin[copy], p.after[copy], -1)]
                total, out = len(p.data) + 2, []
                for a, b, _ in edges:
                    out.append(np.cumsum(np.bincount(a, minlength=total) - np.bincount(b, minlength=total)) > 0)
                left = np.diff(np.concatenate([[0], (out[0] & ~out[1] & ~out[2]).view(np.int8), [0]]))
                a, b = np.flatnonzero(left == 1), np.flatnonzero(left == -1) - 1
                if not len(a):
                    continue
                a, b, who = _runs_of(a, b, p.base, length)
                starts, raw = np.asarray(r["starts"], np.int64)[who] + a - p.base[who], p.data.tobytes()
                for rep, start, x, y in zip(np.asarray(r["reps"], np.int64)[who].tolist(), starts.tolist(), a.tolist(), b.tolist()):
                    if held and held + y - x > REGION_BYTES:
                        yield packed(rows, data)
                        rows, data, held = [], [], 0
                    rows.append((rep, start))
                    data.append(raw[x:y])
                    held += y - x
        if rows:
            yield packed(rows, data)

    return run


def _spans(length: int):
    """(rep, start, end) of the bytes that flagged strings cover."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                layout = _Layout(r["sizes"], r["text"])
                at = layout.needed(0, length)[unpress(r["flags"]) > 0]
                if not len(at):
                    continue
                own = np.searchsorted(layout.starts, at, "right") - 1
                new = np.ones(len(at), bool)
                new[1:] = (np.diff(at) > length) | (own[1:] != own[:-1])
                first = np.flatnonzero(new)
                a, b, who = at[first], at[np.append(first[1:], len(at)) - 1] + length, own[first]
                start = np.asarray(r["starts"], np.int64)[who] - layout.starts[who]
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(r["reps"], np.int64)[who]), pa.array(start + a), pa.array(start + b)], ["rep", "start", "end"])

    return run


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(rep, start, end) of docs (rep, text): bytes of strings of ``length`` bytes that
    start elsewhere too. Spans of one text may touch where it was looked at in pieces."""
    packs = keep(texts.mapInArrow(tidy(_text_packs(length)), f"{PACK}, cuts binary"), "suffix-texts")
    found = packs.mapInArrow(_keys, "key long, pack long, n int").groupBy("key").agg(F.sum("n").alias("n"), F.min("pack").alias("pack"))
    once = found.where("n = 1").groupBy("pack").agg(F.collect_list("key").alias("once"))
    regions = packs.join(once, "pack", "left").select("reps", "starts", "sizes", "text", "cuts", "once").mapInArrow(tidy(_regions(length)), "near long, rep long, start long, region binary")
    regions = keep(regions, "suffix-regions")
    discard(packs)
    near = regions.repartitionByRange("near", "rep", "start").sortWithinPartitions("near", "rep", "start")
    strings = keep(near.mapInArrow(_region_packs, PACK), "suffix-strings")
    discard(regions)
    same = Window.partitionBy("key", "other")
    pieces = strings.mapInArrow(tidy(_piece_keys(length)), "key long, other long, pack long, nth int, n int")
    pieces = pieces.withColumn("n", F.sum("n").over(same)).withColumn("least", F.min("pack").over(same)).where("(n = 1) = (other = 0)")
    kinds = {"once": F.col("other") == 0, "here": (F.col("other") != 0) & (F.col("pack") == F.col("least")), "there": F.col("pack") != F.col("least")}
    marks = pieces.groupBy("pack").agg(*(F.collect_list(F.when(at, F.col("nth"))).alias(k) for k, at in kinds.items()))
    looked = keep(
        strings.join(marks, "pack", "left").select("reps", "starts", "sizes", "text", *kinds).mapInArrow(tidy(_second_look(length)), f"{PACK}, spans array<struct<rep: long, start: long, end: long>>"),
        "suffix-looked",
    )
    discard(strings)
    strings, settled = looked.where("text is not null").drop("spans"), looked.where("spans is not null").select(F.inline("spans"))
    flags = repeated_strings(strings, length)
    spans = strings.join(flags, "pack").select("reps", "starts", "sizes", "text", "flags").mapInArrow(_spans(length), "rep long, start long, end long")
    spans = keep(spans.unionByName(settled), "suffix-spans")
    discard(looked, flags)
    return spans


def _cut(batches):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part, kept = batch.slice(a, 500), []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                raw, at, out, joined = text.encode("utf-8", "surrogatepass"), 0, [], []
                for s in spans or []:
                    if joined and s["start"] <= joined[-1]["end"]:
                        joined[-1]["end"] = max(joined[-1]["end"], s["end"])
                    else:
                        joined.append(dict(s))
                for s in joined:
                    out.append(raw[at : s["start"]])
                    at = s["end"]
                kept.append((b"".join([*out, raw[at:]]), len(raw), joined))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], span), pa.array([k[0] for k in kept], pa.binary())],
                ["id", "n_bytes", "spans", "kept"],
            )


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each row of ``docs``: its id, n_bytes, spans (byte offsets removed)
    and kept, the bytes that are left.

    Texts are UTF-8 bytes; every byte that a string of ``length`` bytes covers which
    starts anywhere else too is removed, overlaps included; cuts may fall inside a
    character, so ``kept`` is binary. Null and empty texts have nothing to remove.
    Ids are integers; rows of one id, or of none, stay rows of their own, each a copy
    of the others where texts are equal. Texts of any length are looked at whole. Other
    columns are not looked at; an empty
    table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    named = texts.select("id", "text", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n"))
    groups = named.groupBy("sha", "n").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("id").isNull(), "id")).alias("first"))
    # A text of its own that is looked at has a number, as ids may repeat.
    groups = keep(groups.withColumn("rep", F.monotonically_increasing_id()), "suffix-groups")
    long = groups.where(F.col("n") >= length).select("sha", "n", F.col("first.id").alias("id"), "rep")
    # Rows of one id and text are looked at more than once, which changes nothing: they
    # are copies, and what they hold does start elsewhere.
    first = (named["sha"] == long["sha"]) & (named["n"] == long["n"]) & named["id"].eqNullSafe(long["id"])
    chosen = named.where(F.col("n") >= length).join(long, first).select("rep", "text")
    spans = repeated_spans(chosen, length).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    whole = F.when((F.col("copies") > 1) & (F.col("n") >= length), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))))
    told = keep(groups.join(spans, "rep", "left").select("sha", "n", "copies", F.coalesce(whole, F.col("spans")).alias("spans")), "suffix-told")
    out = hot_join(named, told, ["sha", "n"], "copies").select("id", "text", "spans").mapInArrow(
        tidy(_cut), "id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    )
    return out.withColumnRenamed("id", id_col)


def removed_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return drop_repeats(docs).select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
