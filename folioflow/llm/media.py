"""Media columns in a store of content-defined chunks.

Each text becomes a grey image of 64 columns, one byte a sample (binary PGM, its
unpadded length in a comment), so it is stored without loss. A gear rolling hash
cuts the media into chunks; the store holds each chunk once by its SHA-256, and a
recipe for each row lists its chunks in order. Reading joins recipes with the
store, puts the chunks together, checks the whole against the recipe's SHA-256,
and decodes the payload.

The store is a table of its own, bucketed by digest, so recipes come to it and no
chunk moves to be found. It is written and read in PARTS turns, as each turn's
shuffle files can go before the next: scratch disk is a part of the media, not all.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gear import chunk_ends
from .tasks import LEAST_HOT, MOST_HOT, bucket_count, discard, free_shuffles, hot_join, keep, key_runs, shared_dir, text_or_empty, text_slices

AVERAGE = 4096
MOST = 65536
PARTS = 4
BUCKET_CHARS = 128_000_000
MOST_BUCKETS = 100_000
MOST_SEEN = 200_000
WIDTH = 64
LEVEL = 9
#: Chunks are compressed with a dictionary trained on about so many texts, chosen by
#: a hash of the id, never over four times as many, and so many of their characters.
DICTIONARY_TEXTS = 2000
DICTIONARY_CHARS = 8192
DICTIONARY_BYTES = 112_640


def to_media(raw: bytes) -> bytes:
    rows = max(1, -(-len(raw) // WIDTH))
    return b"P5\n# %d\n%d %d\n255\n" % (len(raw), WIDTH, rows) + raw + bytes(rows * WIDTH - len(raw))


def from_media(media: bytes) -> tuple[int, bytes]:
    """(unpadded length, payload) of a stored image; raises if it is damaged."""
    magic, note, size, depth, payload = media.split(b"\n", 4)
    width, rows = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(payload) != width * rows:
        raise ValueError("damaged media")
    return int(note[2:]), payload


def train_dictionary(texts: DataFrame) -> bytes:
    """A compression dictionary from a bounded sample of (id, text); empty where the
    sample is too small for one."""
    id_col, text_col = texts.columns
    every = max(1, texts.count() // DICTIONARY_TEXTS)
    some = texts.where(F.pmod(F.xxhash64(id_col), F.lit(every)) == 0).select(id_col, F.substring(text_col, 1, DICTIONARY_CHARS).alias("t"))
    some = some.limit(4 * DICTIONARY_TEXTS)
    samples = [r["t"].encode() for r in sorted(some.collect(), key=lambda r: (r[id_col] is None, r[id_col] or 0, r["t"])) if r["t"]]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 10), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _codec(make, dictionary: bytes, **options):
    return make(**options, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else make(**options)


def _media_chunks(texts, ids):
    """(id, number, of, digest, digest of the whole, bytes) of the chunks of some texts."""
    media = [to_media(r) for r in texts]
    for i, m, ends in zip(ids, media, chunk_ends(media, AVERAGE, MOST)):
        whole, start = hashlib.sha256(m).digest(), 0
        for k, end in enumerate(ends.tolist()):
            piece = m[start:end]
            start = end
            yield i, k, len(ends), hashlib.sha256(piece).digest(), whole, piece


def _table(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names)


def _recipes(batches):
    names, kinds = ["id", "nth", "of", "digest", "whole"], [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    for batch in batches:
        for ids, raws in text_slices(batch.column(0), batch.column(1), 4 << 20):
            yield _table(list(_media_chunks(raws, ids)), names, kinds)


def _payloads(dictionary: bytes, part: int, parts: int):
    """(digest, piece) of the chunks whose digest falls into a part."""

    def run(batches):
        press, seen = _codec(zstandard.ZstdCompressor, dictionary, level=LEVEL), set()
        for batch in batches:
            for ids, raws in text_slices(batch.column(0), batch.column(1), 4 << 20):
                own = {r[3]: r[5] for r in _media_chunks(raws, ids) if r[3][-1] % parts == part and r[3] not in seen}
                seen = set() if len(seen) > MOST_SEEN else seen  # what a task forgets, the shuffle finds
                seen.update(own)
                yield _table([(d, press.compress(p)) for d, p in own.items()], ["digest", "piece"], [pa.binary(), pa.binary()])

    return run


def chunk_store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS) -> tuple[DataFrame, DataFrame, bytes]:
    """(store, recipes, dictionary): (digest, piece) once for each distinct chunk,
    compressed with the dictionary, in a table of the session's catalogue that is
    bucketed by digest; and (id, nth, of, digest, whole) for each chunk of each row,
    ``whole`` being the digest of the row's media.

    Copies of a chunk are dropped in the task that makes them before any is moved. Null texts count as empty ones; these have one row of zeros.
    Ids are integers and may repeat or be null, with equal texts or others.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    dictionary, name = train_dictionary(texts), f"media_store_{uuid.uuid4().hex}"
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), bucket_count(texts, "text", BUCKET_CHARS)))
    for part in range(parts):
        found = texts.mapInArrow(_payloads(dictionary, part, parts), "digest binary, piece binary")
        once = found.repartition(buckets, "digest").groupBy("digest").agg(F.min("piece").alias("piece"))
        once.write.mode("append").option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, "digest").format("parquet").saveAsTable(name)
        free_shuffles(spark)
    recipes = keep(texts.mapInArrow(_recipes, "id long, nth int, of int, digest binary, whole binary"), "media-recipes")
    return spark.table(name), recipes, dictionary


def _rebuild(dictionary: bytes):
    def run(batches):
        inflate, rows = _codec(zstandard.ZstdDecompressor, dictionary), []
        for table in key_runs(batches, ["__none", "__id", "whole"]):
            own = table.to_pylist()
            media = b"".join(inflate.decompress(r["piece"]) for r in own if r["piece"] is not None)
            whole, copies = hashlib.sha256(media), own[0]["copies"]
            if any(r["piece"] is None for r in own) or len(own) != own[0]["of"] or whole.digest() != own[0]["whole"] or any(r["copies"] != copies for r in own):
                raise ValueError(f"media of row {own[0]['id']} is not what was stored")
            n, payload = from_media(media)
            row = (own[0]["id"], n, payload, len(media), whole.hexdigest())
            for _ in range(copies - 1):
                rows.append(row)
                if len(rows) >= 500:
                    yield _media_rows(rows)
                    rows = []
            rows.append(row)
            if len(rows) >= 500:
                yield _media_rows(rows)
                rows = []
        if rows:
            yield _media_rows(rows)

    return run


def _feature(payload: bytes) -> str:
    """Mean, deviation, and which sixteenths of the payload lie above the mean."""
    a = np.frombuffer(payload, np.uint8)
    cuts = np.linspace(0, len(a), 17).astype(int)
    bits = "".join("1" if a[p:q].mean() > a.mean() else "0" for p, q in zip(cuts, cuts[1:]))
    return f"rows={len(a) // WIDTH};mean={a.mean():.4f};std={a.std():.4f};zeros={int((a == 0).sum())};bits={int(bits, 2):04x}"


def _media_rows(rows):
    cols = [
        pa.array([r[0] for r in rows], pa.int64()),
        pa.array([r[1] for r in rows], pa.int64()),
        pa.array([len(r[2]) for r in rows], pa.int64()),
        pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows]),
        pa.array([zlib.crc32(r[2][-64:]) for r in rows], pa.int64()),
        pa.array([r[3] for r in rows], pa.int64()),
        pa.array([r[4] for r in rows]),
        pa.array([_feature(r[2]) for r in rows]),
    ]
    return pa.RecordBatch.from_arrays(cols, ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def read_media(store: DataFrame, recipes: DataFrame, dictionary: bytes, id_col: str = "doc_id", parts: int = PARTS) -> DataFrame:
    """One row for each recipe, of the media read back: id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256 and feature. A missing or
    damaged chunk is an error. Chunks that very many rows have are salted."""
    # Rows that repeat are read once and given as often as they occur.
    once = keep(recipes.groupBy("id", "nth", "of", "digest", "whole").agg(F.count(F.lit(1)).alias("copies")), "media-once")
    wanted = keep(once.groupBy("digest").agg(F.count(F.lit(1)).alias("many")), "media-wanted")
    total = wanted.agg(F.sum("many")).first()[0] or 0
    hot = keep(wanted.where(F.col("many") > max(LEAST_HOT, -(-total // MOST_HOT))), "media-hot")  # fewer than MOST_HOT
    any_hot = not hot.isEmpty()
    out = []
    for part in range(parts):
        mine = once.where(F.pmod(F.xxhash64("id", "whole"), F.lit(parts)) == part)
        cold = mine.join(F.broadcast(hot.select("digest")), "digest", "left_anti") if any_hot else mine
        chunks = cold.join(store, "digest", "left")
        if any_hot:
            few = store.join(F.broadcast(hot), "digest")
            chunks = chunks.unionByName(hot_join(mine.join(F.broadcast(hot.select("digest")), "digest", "left_semi"), few, ["digest"], "many").drop("many"))
        none = F.col("id").isNull().cast("int").alias("__none")
        rows = chunks.select("id", none, F.coalesce("id", F.lit(0)).alias("__id"), "nth", "of", "whole", "copies", "piece")
        rebuilt = rows.repartition("__none", "__id", "whole").sortWithinPartitions("__none", "__id", "whole", "nth").mapInArrow(
            _rebuild(dictionary),
            "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
        )
        out.append(keep(rebuilt, "media-read"))
        free_shuffles(store.sparkSession)
    discard(once, wanted, hot)
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.withColumnRenamed("id", id_col)


def stored_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The features of each row's media after a way through the chunk store, which goes
    when all is read back."""
    store, recipes, dictionary = chunk_store(docs, id_col, text_col)
    found = read_media(store, recipes, dictionary, id_col)
    names = {f.split("/")[-2] for f in store.inputFiles()}
    discard(store, recipes)
    for name in names:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    return found
