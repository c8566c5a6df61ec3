"""Suffix order of many strings by a distributed difference cover modulo 3.

Strings come in packs of bytes. A symbol is up to 8 bytes of text (5 where ``length``
is 400), so a string of bytes is as many strings of symbols, one for each offset modulo
that. At each level the triples at the positions 1 and 2 modulo 3 are sorted; their
ranks are the symbols of the next level, until a rank covers ``length`` bytes. On the
way back the positions 0 modulo 3 are merged in by one symbol, or two, and the rank of
what follows.

A pack sends each distinct triple (or merge key) once, to the bucket of its range of
text, and gets ranks back in the same order. So a string that a third of all texts
share is one entry of a pack, however often it occurs. Ranges are cut at sampled
strings of KEY_BYTES bytes; how they fall changes the balance, never the result.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tasks import discard, free_shuffles, keep, key_runs, mix, tidy

KEY_BYTES = 64
#: Zero bytes after each string of a pack: a step of as many needs no test for its end.
GAP = 96
#: Bytes of regions for each bucket. Strings that the cuts are chosen from: so many at
#: least, and so many for each bucket, so that buckets stay as small when the input grows.
BUCKET_BYTES = 2 << 20
SAMPLE = 50_000
#: Entries of a bucket that are put in order at once.
PART_ENTRIES = 1 << 18
SAMPLE_EACH = 4

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(int(_BASE), -1, 2**64))
_NUMBER = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def press(a: np.ndarray) -> bytes:
    """An array, byte planes apart and compressed; its first byte is the width."""
    width = a.dtype.itemsize
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, width).T).tobytes())


def unpress(raw: bytes, wide: bool = True) -> np.ndarray:
    """The array, of 64 bits or as wide as it was."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    a = np.ascontiguousarray(planes.T).reshape(-1).view(f"u{raw[0]}")
    return a.astype(np.uint64) if wide else a


def _narrow(a: np.ndarray) -> np.ndarray:
    most = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if most < 1 << 8 else np.uint32) if most < 1 << 32 else a


def levels_for(length: int) -> tuple[int, int]:
    """(bytes of a symbol, levels until a rank covers ``length`` bytes): as few levels as
    symbols of 8 bytes allow, then symbols as short as that leaves them, so that ranks
    tell little apart beyond ``length``."""
    depth = 1
    while 8 * 3**depth < length:
        depth += 1
    return -(-length // 3**depth), depth


class _Layout:
    """The strings of a pack in one array, zero bytes after each."""

    def __init__(self, sizes: list[int], text: bytes, symbol: int = 1):
        self.symbol = symbol
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8)
        sizes = np.asarray(sizes, np.int64)
        starts = np.cumsum(sizes + GAP) - sizes - GAP
        total = int(sizes.sum() + GAP * len(sizes))
        self.text = np.zeros(total + GAP, np.uint8)
        own = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(raw))
        self.text[own] = raw
        self.off, self.left = np.zeros(total, np.uint32), np.zeros(total, np.int32)
        off = (own - np.repeat(starts, sizes)).astype(np.uint32)
        self.off[own] = off
        self.left[own] = np.repeat(sizes, sizes) - off
        self.total, self.starts, self.known = total, starts, {0: own}

    def digit(self, level: int, at: np.ndarray) -> np.ndarray:
        q = self.off[at] // np.uint32(self.symbol * 3**level)
        return q - q // np.uint32(3) * np.uint32(3)

    def members(self, level: int) -> np.ndarray:
        """The positions of a level's strings: those that no earlier level left out."""
        if level not in self.known:
            at = self.members(level - 1)
            self.known[level] = at[self.digit(level - 1, at) > 0]
        return self.known[level]

    def needed(self, level: int, length: int) -> np.ndarray:
        """The members of a level that some string of ``length`` bytes is compared by: up
        to 2 * (1 + 3 + ...) symbols after its start."""
        at = self.members(level)
        return at[self.left[at] >= length - self.symbol * (3**level - 1)]

    def first_symbols(self) -> np.ndarray:
        """The symbol at each position as a number, in the order of text."""
        out = np.zeros(self.total + GAP, np.uint64)
        for k in range(self.symbol):
            out[: self.total] |= self.text[k : k + self.total].astype(np.uint64) << np.uint64(8 * (self.symbol - 1 - k))
        return out

    def prefixes(self, at: np.ndarray, width: int) -> np.ndarray:
        rows = np.lib.stride_tricks.sliding_window_view(self.text, width)[at]
        return np.ascontiguousarray(rows).view(f"S{width}").reshape(-1)

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        up, down = np.full(self.total + 1, _BASE, np.uint64), np.full(self.total + 1, _UNDO, np.uint64)
        up[:1], down[:1] = 1, 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        run = np.zeros(self.total + 1, np.uint64)
        np.cumsum(_NUMBER[self.text[: self.total]] * up[:-1], out=run[1:])
        return mix((run[at + length] - run[at]) * down[at])

    def ahead(self, values: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
        """``values`` a step further on in the same string, 0 beyond its end."""
        if step <= GAP:
            return values[at + step]
        there = self.left[at] > step
        return np.where(there, values[np.where(there, at + step, 0)], np.uint64(0))


def _dense(layout: _Layout, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(layout.total + GAP, np.uint64)
    out[at] = values
    return out


def _symbols(layout: _Layout, level: int, blob: bytes | None) -> np.ndarray:
    return layout.first_symbols() if level == 0 else _dense(layout, layout.members(level), unpress(blob))


def _words(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The columns, each with as many bits as its largest number needs, one after another
    in as few numbers of 64 bits as hold them: in the same order, and equal alike."""
    out, word, free = [], None, 0
    for c in columns:
        bits = max(1, int(c.max()).bit_length() if len(c) else 1)
        c = c.astype(np.uint64, copy=False)
        if word is not None and free:
            take = min(free, bits)
            word = (word << np.uint64(take)) | (c >> np.uint64(bits - take))
            free, bits = free - take, bits - take
            c = c & np.uint64((1 << bits) - 1)
        if bits:
            if word is not None:
                out.append(word)
            word, free = c, 64 - bits
    return [*out, word]


class _Distinct:
    """The distinct rows of some columns, in the order (bucket, first column)."""

    def __init__(self, columns: list[np.ndarray], by: list[np.ndarray] | None = None):
        """``by``: columns that tell rows apart instead of all."""
        words = _words(by or columns)
        key = words[0]
        for k, w in enumerate(words[1:]):
            key = mix((key ^ (key >> np.uint64(29))) * _BASE + w + np.uint64(k))
        order = np.argsort(key)
        new = np.ones(len(order), bool)
        own = key[order]
        new[1:] = own[1:] != own[:-1]
        if len(words) > 1:  # rows that share the hash are told apart by another one
            other = words[-1] * _UNDO
            for w in words[:-1]:
                other = mix(other + w) * _UNDO
            other = other[order]
            if (~new[1:] & (other[1:] != other[:-1])).any():
                order, new = _runs(by or columns)
        self.first = order[new]
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.columns = columns

    def put_in_order(self, bucket: np.ndarray) -> None:
        """Orders the distinct rows by ``bucket`` (one number for each of them)."""
        words = _words([bucket.astype(np.uint64), self.columns[0][self.first]])
        order = np.argsort(words[0]) if len(words) == 1 else np.lexsort(words[::-1])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.first, self.group, self.bucket = self.first[order], place[self.group], bucket[order]


def _buckets(layout: _Layout, at: np.ndarray, cuts: list[bytes], width: int) -> np.ndarray:
    """The number of cuts at or before the text at each position. ``width`` bytes of
    it count; most positions are told by their first 8."""
    if not cuts or not len(at):
        return np.zeros(len(at), np.int64)
    cuts = sorted({c[:width].ljust(width, b"\0") for c in cuts})
    heads = np.array([int.from_bytes(c[:8].ljust(8, b"\0"), "big") for c in cuts], np.uint64)
    mine = np.zeros(len(at), np.uint64)
    for k in range(min(8, width)):
        mine |= layout.text[at + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    out, high = np.searchsorted(heads, mine, "left"), np.searchsorted(heads, mine, "right")
    unclear = np.flatnonzero(out < high)
    if len(unclear):
        texts = layout.prefixes(at[unclear], width).tolist()  # numpy strips zero bytes at the end, which keeps the order
        stripped = [c.rstrip(b"\0") for c in cuts]
        out[unclear] = [bisect.bisect_right(stripped, t) for t in texts]
    return out


def _slices(d: _Distinct, extra: list[np.ndarray] = ()):
    """(bucket, columns) of each bucket that has entries of the pack."""
    columns = [*d.columns, *extra]
    edges = np.flatnonzero(np.diff(d.bucket, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(d.bucket)]):
        rows = d.first[a:b]
        head = columns[0][rows]
        yield int(d.bucket[a]), [press(np.diff(head, prepend=np.uint64(0))), *(press(_narrow(c[rows])) for c in columns[1:])]


ANSWER = "bucket long, pack long, ranks binary, many long"


def _read_slices(table) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of a bucket's slices, each as narrow as its numbers allow, and where
    slices start. One column at a time is held in parts."""
    rows, columns = table.column("columns").to_pylist(), []
    for k in range(len(rows[0])):
        parts = [unpress(r[k], wide=False) for r in rows]
        if not k:
            bounds = np.cumsum([0, *map(len, parts)])
            parts = [np.cumsum(x, dtype=np.uint64) for x in parts]
        columns.append(np.concatenate(parts))
        del parts
    return columns, bounds


def _answer(table, values: np.ndarray, bounds: np.ndarray, many: int):
    values = _narrow(values)
    return pa.table(
        {
            "bucket": table.column("bucket"),
            "pack": table.column("pack"),
            "ranks": pa.array([press(values[a:b]) for a, b in zip(bounds, bounds[1:])], pa.binary()),
            "many": pa.array([many] * table.num_rows, pa.int64()),
        }
    )


def _runs(keys: list[np.ndarray]):
    """Order of rows by ``keys`` (the first counts most), and for each place in it
    whether a run of equal rows starts there."""
    keys = _words(keys)
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        own = k[order]
        new[1:] |= own[1:] != own[:-1]
    return order, new


def _parts(first: np.ndarray):
    """The places of a bucket's entries in parts of about PART_ENTRIES, which are ranges of
    the first symbol in rising order. So entries that are equal are in one part, and a
    part needs no other one but for how many entries come before it."""
    many = -(-len(first) // PART_ENTRIES)
    some = np.sort(first[:: max(1, len(first) // (64 * max(1, many)))])
    edges = np.unique(some[[len(some) * k // many for k in range(1, many)]])
    part = np.searchsorted(edges, first, "right").astype(np.uint16)
    for k in range(len(edges) + 1):
        yield np.flatnonzero(part == k)


def _rank_triples(table):
    """Dense ranks of the triples of a bucket."""
    columns, bounds = _read_slices(table)
    rank, many = np.empty(len(columns[0]), np.uint32), 0
    for own in _parts(columns[0]):
        order, new = _runs([c[own] for c in columns])
        rank[own[order]] = many + np.cumsum(new) - 1
        many += int(new.sum())
    del columns
    return _answer(table, rank, bounds, many)


def _less(keys: list[np.ndarray], flags: list[np.ndarray]):
    """For each row and flag, how many flagged rows are less."""
    order, new = _runs(keys)
    start, out = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)), []
    for flag in flags:
        before = np.concatenate([[0], np.cumsum(flag[order])])[start]
        n = np.empty(len(order), np.int64)
        n[order] = before
        out.append(n)
    return out


def _merged(sym, klass, s1, a, b) -> np.ndarray:
    """How many entries are less than each: positions 0 modulo 3 meet positions 1 by a
    symbol and the next rank, positions 2 by two symbols; 1 and 2 go by their ranks."""
    rank = np.zeros(len(sym), np.int64)
    at = np.flatnonzero(klass < 2)
    zero, (n0, n1) = klass[at] == 0, _less([sym[at], a[at]], [klass[at] == 0, klass[at] == 1])
    rank[at] += np.where(zero, n0 + n1, n0)
    at = np.flatnonzero(klass != 1)
    zero, (n0, n2) = klass[at] == 0, _less([sym[at], s1[at], b[at]], [klass[at] == 0, klass[at] == 2])
    rank[at] += np.where(zero, n2, n0)
    del zero, n0, n1, n2
    at = np.flatnonzero(klass > 0)
    own = np.where(klass[at] == 1, b[at], a[at])
    (n,) = _less([own], [np.ones(len(own), bool)])
    rank[at] += n
    return rank


def _merge_bucket(table):
    columns, bounds = _read_slices(table)
    rank, many = np.empty(len(columns[0]), np.uint32), 0
    for own in _parts(columns[0]):
        rank[own] = many + _merged(*(c[own] for c in columns))
        many += len(own)
    del columns
    return _answer(table, rank, bounds, many)


def _compare_bucket(table):
    """1 for each entry whose first bytes an entry next to it in the order has too, or
    whose string occurs more than once in its pack."""
    (*columns, prefix, often), bounds = _read_slices(table)
    out = np.zeros(len(prefix), np.uint8)
    for own in _parts(columns[0]):
        order = own[np.lexsort((prefix[own], _merged(*(c[own] for c in columns))))]
        same, again = np.diff(prefix[order]) == 0, often[order] > 0
        again[1:] |= same
        again[:-1] |= same
        out[order] = again
    del columns, prefix, often
    return _answer(table, out, bounds, len(out))


def _triples(layout: _Layout, level: int, sym: np.ndarray, cuts: list[bytes]):
    step = layout.symbol * 3**level
    at = layout.members(level)
    at = at[layout.digit(level, at) > 0]
    d = _Distinct([sym[at], layout.ahead(sym, at, step), layout.ahead(sym, at, 2 * step)])
    d.put_in_order(_buckets(layout, at[d.first], cuts, min(KEY_BYTES, 3 * step)))
    return at, d


def _merge_keys(layout: _Layout, level: int, length: int, sym, ranks, cuts: list[bytes]):
    step = layout.symbol * 3**level
    at = layout.needed(level, length)
    klass, own = layout.digit(level, at).astype(np.uint8), ranks[at]
    a = np.where(klass == 2, own, layout.ahead(ranks, at, step))
    b = np.where(klass == 1, own, layout.ahead(ranks, at, 2 * step))
    del own
    symbol = sym[at]
    columns = [symbol, klass, np.where(klass == 1, np.uint64(0), layout.ahead(sym, at, step)), a, b]
    # Entries are as good as one where a rank of ``length`` bytes is the same, or, at the
    # lowest level, the hash of the string itself.
    if level:
        by = [klass, np.where(klass == 0, symbol, np.uint64(0)), np.where(klass == 1, b, a)]
    else:
        by = [layout.hashes(at, length)]
        columns += by
    d = _Distinct(columns, by)
    d.put_in_order(_buckets(layout, at[d.first], cuts, min(KEY_BYTES, length)))
    if level:
        return at, d, []
    often = np.zeros(len(at), np.uint64)
    often[d.first] = np.bincount(d.group, minlength=len(d.first)) > 1
    return at, d, [often]


#: What a pass over the packs writes, in rows of three kinds: the pack with the number
#: of the entry of each position, its slices for the buckets, and its new symbols.
PASS = "pack long, sizes array<long>, text binary, group binary, bucket long, columns array<binary>, sym binary"


def _row(pack: int, **values):
    types = {"sizes": pa.list_(pa.int64()), "text": pa.binary(), "group": pa.binary(), "bucket": pa.int64(), "columns": pa.list_(pa.binary()), "sym": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([pack], pa.int64()), *(pa.array([values.get(k)], t) for k, t in types.items())], ["pack", *types])


def _asked(pack: int, own: dict, at_and_entries):
    """The pack's row and its slices."""
    _, d, *extra = at_and_entries
    yield _row(pack, sizes=own["sizes"], text=own["text"], group=press(_narrow(d.group.astype(np.uint64))))
    for bucket, columns in _slices(d, *extra):
        yield _row(pack, bucket=bucket, columns=columns)


def _first_pass(symbol: int, cuts: list[bytes]):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                layout = _Layout(r["sizes"], r["text"], symbol)
                yield from _asked(r["pack"], r, _triples(layout, 0, layout.first_symbols(), cuts))

    return run


def _told(table, before: dict | None) -> tuple[dict, np.ndarray, bytes | None]:
    """A pack's row, the answer to each of its positions, and symbols of an earlier level."""
    rows = table.to_pylist()
    (own,) = [r for r in rows if r["text"] is not None]
    answers = sorted((r for r in rows if r["ranks"] is not None), key=lambda r: r["bucket"])
    parts = [unpress(r["ranks"]) + np.uint64(before[r["bucket"]] + 1 if before is not None else 0) for r in answers]
    group = unpress(own["group"]).astype(np.int64)
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if len(group) and int(group.max()) + 1 != len(values):
        raise ValueError("answers of a pack are missing")
    return own, values[group], next((r["sym"] for r in rows if r["sym"] is not None), None)


def _name_pass(level: int, length: int, cuts: list[bytes], before: dict):
    """From the names of a level's triples to the triples of the next level, or, when
    names cover ``length`` bytes, to the merge of the last level."""
    symbol, depth = levels_for(length)

    def run(batches):
        for table in key_runs(batches, ["pack"]):
            own, names, sym = _told(table, before)
            layout = _Layout(own["sizes"], own["text"], symbol)
            if level < depth - 1:
                blob = press(_narrow(names))
                yield from _asked(own["pack"], own, _triples(layout, level + 1, _dense(layout, layout.members(level + 1), names), cuts))
                yield _row(own["pack"], sym=blob)
            else:
                ranks = _dense(layout, layout.members(level + 1), names)
                yield from _asked(own["pack"], own, _merge_keys(layout, level, length, _symbols(layout, level, sym), ranks, cuts))

    return run


def _merge_pass(level: int, length: int, cuts: list[bytes], before: dict):
    """From the ranks of a level to the merge of the one below."""
    symbol, _ = levels_for(length)

    def run(batches):
        for table in key_runs(batches, ["pack"]):
            own, values, sym = _told(table, before)
            layout = _Layout(own["sizes"], own["text"], symbol)
            ranks = _dense(layout, layout.needed(level, length), values)
            yield from _asked(own["pack"], own, _merge_keys(layout, level - 1, length, _symbols(layout, level - 1, sym), ranks, cuts))

    return run


def _flags(batches):
    for table in key_runs(batches, ["pack"]):
        own, values, _ = _told(table, None)
        yield pa.RecordBatch.from_arrays([pa.array([own["pack"]], pa.int64()), pa.array([press(values.astype(np.uint8))], pa.binary())], ["pack", "flags"])


def _by_pack(passed: DataFrame, answers: DataFrame, symbols: DataFrame | None) -> DataFrame:
    rows = passed.where("text is not null").select("pack", "sizes", "text", "group")
    rows = rows.unionByName(answers.select("pack", "bucket", "ranks"), allowMissingColumns=True)
    if symbols is None:
        rows = rows.withColumn("sym", F.lit(None).cast("binary"))
    else:
        rows = rows.unionByName(symbols, allowMissingColumns=True)
    return rows.repartition("pack").sortWithinPartitions("pack")


def repeated_strings(packs: DataFrame, length: int) -> DataFrame:
    """``packs`` (pack, sizes, text: the pack's strings one after another, compressed)
    to (pack, flags): for each position of its strings with ``length`` bytes to their
    end, in order, whether these bytes start at any other such position of all packs.
    """
    size = packs.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y)).alias("bytes"), F.count(F.lit(1)).alias("packs")).first()
    if not size["packs"]:
        return packs.select("pack", F.lit(None).cast("binary").alias("flags"))
    cuts = _sampled_cuts(packs, size["packs"], -(-(size["bytes"] or 0) // BUCKET_BYTES))
    symbol, depth = levels_for(length)

    def answered(passed, bucket):
        """The buckets' answers, and how many entries come before each bucket's."""
        slices = passed.where("columns is not null").select("bucket", "pack", "columns")
        before, total = {}, 0
        answers = keep(slices.groupBy("bucket").applyInArrow(bucket, ANSWER), "suffix-answers")
        free_shuffles(passed.sparkSession)  # the slices, which are many
        for r in sorted(answers.select("bucket", "many").distinct().collect()):  # one number for each bucket
            before[r["bucket"]] = total
            total += r["many"]
        return answers, before

    symbols: dict[int, DataFrame] = {}
    now = keep(packs.mapInArrow(tidy(_first_pass(symbol, cuts)), PASS), "suffix-pass")
    for level in range(depth):
        answers, before = answered(now, _rank_triples)
        rows = _by_pack(now, answers, symbols.get(level) if level == depth - 1 else None)
        after = keep(rows.mapInArrow(tidy(_name_pass(level, length, cuts, before)), PASS), "suffix-pass")
        if level < depth - 1:
            symbols[level + 1] = keep(after.where("sym is not null").select("pack", "sym"), "suffix-symbols")
        discard(answers, now)
        now = after
    for level in range(depth - 1, 0, -1):
        answers, before = answered(now, _merge_bucket)
        rows = _by_pack(now, answers, symbols.get(level - 1))
        after = keep(rows.mapInArrow(tidy(_merge_pass(level, length, cuts, before)), PASS), "suffix-pass")
        discard(answers, now, symbols.pop(level))
        now = after
    answers, _ = answered(now, _compare_bucket)
    flags = keep(_by_pack(now, answers, None).mapInArrow(tidy(_flags), "pack long, flags binary"), "suffix-flags")
    discard(answers, now)
    return flags


def _sampled_cuts(packs: DataFrame, many: int, buckets: int) -> list[bytes]:
    """The strings at which buckets start, from a sample: KEY_BYTES for each BUCKET_BYTES
    of regions go to all tasks."""
    if buckets < 2:
        return []
    wanted = max(SAMPLE, SAMPLE_EACH * buckets)
    each = max(1, wanted // max(1, many))
    share = min(1.0, wanted / max(1, many))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                layout, rng = _Layout(r["sizes"], r["text"]), np.random.default_rng(r["pack"] & 0xFFFFFFFF)
                at = np.flatnonzero(layout.left > 0)
                if rng.random() < share and len(at):
                    at = rng.choice(at, min(each, len(at)), replace=False)
                    rows = np.lib.stride_tricks.sliding_window_view(layout.text, KEY_BYTES)[at]
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in rows], pa.binary())], ["s"])

    found = sorted({bytes(r["s"]) for r in packs.mapInArrow(tidy(run), "s binary").collect()})
    return sorted({found[k * len(found) // buckets] for k in range(1, buckets)}) if found else []
