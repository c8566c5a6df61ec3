"""N-gram Jaccard join of whole texts by prefix trees, exact for the threshold.

Sets are put in one global order, rare shingles first. Two sets that link must
share shingles among their first ones, so

1. equal sets become one class, held by its smallest id;
2. the first shingles of each class go to hash buckets as packed numbers; classes
   of which too few are shared with any other set to allow a link leave the join;
3. what is left is blocked twice by min-hash and each block joined in a trie
   (prefix_tree), which yields links that span the block's components;
4. sets that share a first shingle but not yet a component go to blocks of such
   sets, where they walk a trie of the block: no link between components is
   missed, and no pairs are made;
5. components come from the links, and equal sets take those of their class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .ngrams import shingle_sets
from .prefix_tree import PrefixTree, spanning_links
from .tasks import hot_join, keep, key_runs, mix, text_or_empty, text_slices, tidy, tidy_group

#: Share of the shingles, in hundredths beyond what a linked pair may differ in,
#: that step 2 looks at. More finds more sets without partner, and moves more.
MARGIN = 10
#: Most shingles that are broadcast as frequent ones (8 bytes each).
MOST_FREQUENT = 500_000
#: Most min-hash keys that are broadcast as too frequent for one block.
MOST_HOT_KEYS = 100_000
BUCKET_CHARS = 6_000_000
#: Shingles that the sets of one block hold in step 4, and probes that walk it.
BLOCK_SHINGLES = 300_000
BLOCK_PROBES = 128
#: Ratio of sizes that a block spans.
SIZE_STEP = 1.1
FLUSH = 1 << 20


def _prefix(n, percent: int):
    """Shingles that a set of n must show so that a linked set has one of them."""
    return n - (-(-percent * n // 100)) + 1


def _name(shingles: np.ndarray) -> int:
    """The number that a set goes by."""
    return int(np.sum(mix(shingles), dtype=np.uint64)) if len(shingles) else 0


def _fingerprints(k: int):
    def run(batches):
        for batch in batches:
            at = 0
            for ids, raws in text_slices(batch.column(0), batch.column(1)):
                sets = shingle_sets(raws, k)
                one = [_name(s) for s in sets]
                two = [_name(s ^ np.uint64(0x5851F42D4C957F2D)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        batch.column(2).slice(at, len(ids)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(np.array(one, np.uint64).view(np.int64)),
                        pa.array(np.array(two, np.uint64).view(np.int64)),
                    ],
                    ["id", "h", "n", "f1", "f2"],
                )
                at += len(ids)

    return run


def _first_shingles(k: int, percent: int, buckets: int):
    """Packs the first shingles, in hash order, of the distinct sets of each slice
    by bucket: 32 bits of the shingle and the number of its set in the pack."""

    def pack(sets):
        sids = np.array([s for s, _ in sets], np.uint64)
        tokens = np.concatenate([t for _, t in sets])
        of = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(t) for _, t in sets])
        bucket = (tokens % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((tokens, bucket))
        tokens, of, bucket = tokens[order], of[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        names, blobs = [], []
        for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
            used, local = np.unique(of[a:b], return_inverse=True)
            head = np.array([b - a, len(used)], np.uint32).tobytes()
            short = (tokens[a:b] >> np.uint64(8)).astype(np.uint32)
            blobs.append(head + sids[used].tobytes() + short.tobytes() + local.astype(np.uint16).tobytes())
            names.append(int(bucket[a]))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "pack"])

    def run(batches):
        held, n = {}, 0
        for batch in batches:
            for _, raws in text_slices(batch.column(0), batch.column(1)):
                for s in shingle_sets(raws, k):
                    if not len(s):
                        continue
                    sid = _name(s)
                    if sid not in held:
                        size = max(-(-(100 - percent + MARGIN) * len(s) // 100), _prefix(len(s), percent))
                        held[sid] = s[:size].copy()
                        n += len(held[sid])
                    if n >= FLUSH or len(held) > 50_000:  # numbers in a pack have 16 bits
                        yield pack(list(held.items()))
                        held, n = {}, 0
        if held:
            yield pack(list(held.items()))

    return run


def _shared(frequent_from: int):
    """Of one bucket: (0, set, its shingles that another set shows too), and (1,
    shingle, number of sets) for shingles of at least ``frequent_from`` sets."""

    def run(table):
        tokens, sids = [], []
        for blob in table.column("pack").to_pylist():
            n, m = np.frombuffer(blob, np.uint32, 2)
            own = np.frombuffer(blob, np.uint64, m, 8)
            at = 8 + 8 * int(m)
            tokens.append(np.frombuffer(blob, np.uint32, n, at))
            sids.append(own[np.frombuffer(blob, np.uint16, n, at + 4 * int(n))])
        tokens, sids = np.concatenate(tokens), np.concatenate(sids)
        order = np.lexsort((sids, tokens))
        tokens, sids = tokens[order], sids[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (sids[1:] != sids[:-1])
        tokens, sids = tokens[new], sids[new]
        cuts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        counts = np.diff([*cuts, len(tokens)])
        who, many = np.unique(sids[np.repeat(counts >= 2, counts)], return_counts=True)
        often = counts >= frequent_from
        bucket = np.uint64(table.column("bucket")[0].as_py())
        names = (bucket << np.uint64(32)) | tokens[cuts[often]].astype(np.uint64)
        return pa.table(
            {
                "kind": pa.array(np.repeat(np.array([0, 1], np.int32), [len(who), len(names)])),
                "name": pa.array(np.concatenate([who, names]).view(np.int64)),
                "many": pa.array(np.concatenate([many, counts[often]]).astype(np.int64)),
            }
        )

    return run


def _ordered_sets(k: int, buckets: int, frequent):
    """The sets in the global order: shingles by the logarithm of their number of
    sets (0 where infrequent), then by hash; 58 bits of it are kept."""

    def run(batches):
        names, level = frequent.value
        for batch in batches:
            for names_, raws in text_slices(batch.column(0), batch.column(1)):
                sets = []
                for s in shingle_sets(raws, k):
                    key = ((s % np.uint64(buckets)) << np.uint64(32)) | ((s >> np.uint64(8)) & np.uint64(0xFFFFFFFF))
                    rank = s >> np.uint64(6)
                    if len(names):
                        at = np.minimum(np.searchsorted(names, key), len(names) - 1)
                        rank = rank | np.where(names[at] == key, level[at], 0).astype(np.uint64) << np.uint64(58)
                    sets.append(np.sort(rank))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names_, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["rep", "n", "items"],
                )

    return run


def _min_hashes(rounds: int):
    def run(batches):
        for batch in batches:
            reps, items = batch.column("rep"), batch.column("items")
            for r in range(rounds):
                salt = np.uint64(0x632BE59BD9B4E019 * (r + 1) & (2**64 - 1))
                keys = [int(mix(np.frombuffer(x, np.uint64) ^ salt).min()) for x in items.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), reps, items], ["key", "rep", "items"])

    return run


def _block_links(percent: int):
    def run(batches):
        for table in key_runs(batches, ["key", "block"]):
            if table.num_rows < 2:
                continue
            names = table.column("rep").to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
            found = list(spanning_links(names, sets, percent))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _prefix_rows(percent: int):
    def run(batches):
        for batch in batches:
            sets = [np.frombuffer(x, np.uint64) for x in batch.column("items").to_pylist()]
            sizes = [_prefix(len(s), percent) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([s[:p] for s, p in zip(sets, sizes)]).view(np.int64)),
                    pa.array(np.repeat(np.asarray(batch.column("rep")), sizes)),
                    pa.array(np.repeat([len(s) for s in sets], sizes).astype(np.int32)),
                    pa.array(np.repeat(np.asarray(batch.column("label")), sizes)),
                ],
                ["token", "rep", "n", "label"],
            )

    return run


def _probe_links(percent: int):
    """Of one block, its members in a trie that the probes walk: a link for each
    component (of labels, joined as links are found) that a probe reaches."""

    def run(batches):
        for table in key_runs(batches, ["block", "salt"]):
            names, labels, probes = (table.column(c).to_pylist() for c in ("rep", "label", "probe"))
            tree, top, label = PrefixTree(percent), {x: x for x in labels}, dict(zip(names, labels))

            def find(x):
                while top[x] != x:  # noqa: B023
                    top[x] = top[top[x]]  # noqa: B023
                    x = top[x]  # noqa: B023
                return x

            found = []
            for i in sorted(range(len(names)), key=lambda i: probes[i]):  # noqa: B023
                items = np.frombuffer(table.column("items")[i].as_py(), np.uint64)
                if not probes[i]:
                    tree.add(items, names[i])
                    continue
                for other in tree.links(items, lambda o: find(label[o]) == find(labels[i])):  # noqa: B023
                    found.append((names[i], other))
                    top[find(labels[i])] = find(label[other])
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def ngram_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, rounds: int = 2
) -> DataFrame:
    """One row for each row of ``docs``: its id, n_shingles, component_id.

    ``k``-word shingles of lower-cased (A-Z) whole texts; sets link from a Jaccard
    similarity of ``percent`` hundredths, compared in whole numbers. component_id is
    the smallest id reached by links. Null and empty texts, and texts of white
    space alone, have no shingles and link with nothing.

    Ids are integers. Rows of one id are one document, so what any of its texts links
    with hangs together; each keeps its own n_shingles. Rows without an id link like
    others; their component_id is null where nothing with an id is reached. Other
    columns are not looked at; an empty table gives no rows. Texts of any length are compared whole.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    prints = keep(texts.mapInArrow(tidy(_fingerprints(k)), "id long, h long, n long, f1 long, f2 long"), "ngram-prints")
    # A class of equal sets goes by the number f1; its text is that of its smallest id.
    first = F.min(F.struct(F.col("id").isNull(), "id", "h")).alias("first")
    classes = prints.where("n > 0").groupBy("f1", "f2", "n").agg(first, F.count(F.lit(1)).alias("copies"))
    classes = classes.select("f1", "f2", "n", "copies", F.col("first.id").alias("rep"), F.col("first.h").alias("h"))

    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(16, -(-chars // BUCKET_CHARS))
    # Each shingle takes two characters at least, so fewer than MOST_FREQUENT pass.
    frequent_from = max(16, -(-chars * (100 - percent + MARGIN) // (200 * MOST_FREQUENT)))
    packs = texts.mapInArrow(tidy(_first_shingles(k, percent, buckets)), "bucket long, pack binary")
    shared = keep(
        packs.groupBy("bucket").applyInArrow(tidy_group(_shared(frequent_from)), "kind int, name long, many long"), "ngram-shared"
    )
    counted = shared.where("kind = 0").groupBy(F.col("name").alias("f1")).agg(F.sum("many").alias("shared"))
    near = classes.join(counted, "f1").where(F.col("shared") >= F.greatest(F.lit(1), F.floor(F.col("n") * MARGIN / 100) - 2))
    rows = shared.where("kind = 1").select("name", "many").toPandas()
    names = rows["name"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(names)
    level = np.minimum(63, np.log2(np.maximum(1, rows["many"].to_numpy().astype(np.float64)))).astype(np.uint64)
    frequent = spark.sparkContext.broadcast((names[order], level[order]))

    chosen = texts.join(near.select("f1", "rep", near["h"].alias("of")), (F.col("h") == F.col("of")) & F.col("id").eqNullSafe(F.col("rep"))).select("f1", "text")
    sets = keep(chosen.mapInArrow(tidy(_ordered_sets(k, buckets, frequent)), "rep long, n long, items binary"), "ngram-sets")

    # Blocks of equal min-hash; a frequent one is split, each part with its first set.
    keyed = sets.mapInArrow(tidy(_min_hashes(rounds)), "key long, rep long, items binary")
    stats = keep(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("rep").alias("pivot")), "ngram-keys")
    total = stats.agg(F.sum("many")).first()[0] or 0
    per_block = max(256, -(-total // MOST_HOT_KEYS))
    hot = stats.where(F.col("many") > per_block).select("key", F.ceil(F.col("many") / per_block).cast("int").alias("blocks"), "pivot")
    own = F.pmod(F.xxhash64("rep"), F.coalesce("blocks", F.lit(1))).cast("int")
    block = F.when(F.col("rep") == F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    blocks = keyed.join(F.broadcast(hot), "key", "left").select("key", F.explode(block).alias("block"), "rep", "items")
    links = keep(
        blocks.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(tidy(_block_links(percent)), "a long, b long"),
        "ngram-links",
    )

    # Pairs over components: those of all labels but the most frequent of a shingle
    # against all its sets.
    labels = components(links)
    labelled = sets.join(labels, sets["rep"] == labels["id"], "left").select(
        "rep", "items", F.coalesce("component", "rep").alias("label")
    )
    firsts = keep(labelled.mapInArrow(tidy(_prefix_rows(percent)), "token long, rep long, n int, label long"), "ngram-firsts")
    mixed = (
        firsts.groupBy("token", "label").agg(F.count(F.lit(1)).alias("many"))
        .groupBy("token").agg(F.max_by("label", F.struct("many", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
        .where("labels > 1").select("token", "main")
    )
    rows_of = keep(firsts.join(mixed, "token"), "ngram-mixed")
    # Blocks of the sets in question, near ones together; each probe goes to the
    # blocks that hold one of its first shingles.
    size = F.floor(F.log(F.col("n")) / float(np.log(SIZE_STEP)))
    asked = rows_of.groupBy("rep").agg(F.min("main").alias("near"), F.min("label").alias("label"), F.first("n").alias("n")).withColumn("size", size)
    parts = asked.groupBy("near", "size").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("parts"))
    members = keep(
        asked.join(parts, ["near", "size"]).select("rep", "label", "n", F.xxhash64("near", "size", F.pmod(F.xxhash64("rep"), "parts")).alias("block")),
        "ngram-members",
    )
    ends = members.groupBy("block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    held = rows_of.join(members.select("rep", "block"), "rep").select("token", "block").distinct()
    # A probe must share so many of its first shingles with a block that a set of
    # the block's smallest or largest size could link with it.
    must = lambda m: (
        F.ceil(percent * (F.col("n") + F.col(m)) / (100 + percent)) - F.greatest(F.ceil(percent * F.col("n") / 100), F.ceil(percent * F.col(m) / 100)) + 1
    )
    asking = rows_of.where("label <> main").select("rep").distinct()
    probes = (
        rows_of.join(asking, "rep", "left_semi").select("token", "rep", "label", "n").join(held, "token")
        .groupBy("rep", "label", "n", "block").agg(F.count(F.lit(1)).alias("common"))
        .join(ends, "block")
        .where((100 * F.col("n") >= percent * F.col("low")) & (100 * F.col("high") >= percent * F.col("n")))
        .where(F.col("common") >= F.least(must("low"), must("high")) - 2)  # 2: for roundings in between
    )
    probes = keep(probes.select("rep", "label", "block"), "ngram-probes")
    salts = probes.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK_PROBES).cast("int").alias("salts"))
    walked = probes.join(salts, "block").select(
        "block", F.pmod(F.xxhash64("rep"), "salts").cast("int").alias("salt"), "rep", "label", F.lit(1).alias("probe")
    )
    stored = members.join(salts, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "rep", "label", F.lit(0).alias("probe")
    )
    more = (
        walked.unionByName(stored).join(sets.select("rep", "items"), "rep")
        .repartition("block", "salt").sortWithinPartitions("block", "salt")
        .mapInArrow(tidy(_probe_links(percent)), "a long, b long")
    )
    more = keep(more, "ngram-more")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    # From here on nodes are ids again: each class hangs on the smallest id of its
    # component, and so do the ids that have texts in several classes.
    named = classes.join(labels, classes["f1"] == labels["id"], "left").select("f1", "f2", "n", "copies", "rep", F.coalesce("component", "f1").alias("component"))
    named = keep(named, "ngram-named")
    low = keep(named.groupBy("component").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("classes")), "ngram-low")
    named = keep(hot_join(named, low, ["component"], "classes").select("f1", "f2", "n", "copies", "low"), "ngram-components")
    found = hot_join(prints, named, ["f1", "f2", "n"], "copies").select("id", "n", F.coalesce("low", "id").alias("component"))
    several = found.groupBy("id").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("id is not null and a <> b").select("id")
    several = keep(several, "ngram-several")
    if not several.isEmpty():
        joins = components(found.join(several, "id").select(F.col("component").alias("a"), F.col("id").alias("b")))
        joins = joins.select(F.col("id").alias("component"), F.col("component").alias("top"))
        found = found.join(joins, "component", "left").select("id", "n", F.coalesce("top", "component").alias("component"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document for each group of near copies, that of the smallest
    id; all columns as they were. All rows of that id stay, and rows without an id, as
    nothing tells them apart."""
    found = ngram_components(docs, id_col)
    first = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__first")).distinct()
    # Whole rows go in one column, so no name of theirs can clash.
    rows = docs.select(F.struct("*").alias("__doc"), F.col(id_col).alias("__id"))
    kept = rows.join(first, F.col("__id") == F.col("__first"), "left_semi")
    return kept.select("__doc.*").unionByName(rows.where("__id is null").select("__doc.*"))
