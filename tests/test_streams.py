import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from folioflow.sources.page_tree import PageTree
from folioflow.sources.watch import WatchSource, pruned
from folioflow.streaming import events as E

T0 = datetime.datetime(2024, 1, 1)
PARTS = "key string, seq long, part string, ts timestamp"


def run(stream, folder, name):
    """All that is there, from where the checkpoint stands."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}")


def fed(spark, folder, batches, op, name):
    for rows in batches:
        spark.createDataFrame(rows, PARTS).coalesce(1).write.mode("append").parquet(f"{folder}/in-{name}")
        parts = spark.readStream.schema(PARTS).parquet(f"{folder}/in-{name}").withWatermark("ts", "1 second")
        out = run(op(parts), folder, name)
    return out


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def test_unfinished_lines_come_out_when_their_key_rests(spark, tmp_path):
    batches = [[("a", 0, "one\ntw", at(0)), ("b", 0, "x\n", at(0))], [("a", 1, "o\nthree", at(1))], [("c", 0, "later\n", at(200))], [("d", 0, "last", at(400))]]
    got = fed(spark, tmp_path, batches, lambda s: E.complete_lines(s, at="ts", idle=30), "lines")
    found = sorted(map(tuple, got.collect()))
    assert found == [("a", 0, "one"), ("a", 1, "two"), ("a", 2, "three"), ("b", 0, "x"), ("c", 0, "later")]
    table = spark.createDataFrame([r for b in batches for r in b], PARTS)
    assert found == sorted(tuple(r) for r in E.lines_of(table.where("key <> 'd'"), "key", "part", "seq").collect())


def test_a_key_that_rested_starts_anew(spark, tmp_path):
    batches = [[("a", 0, "one\nhalf", at(0))], [("z", 0, "", at(100))], [("z", 1, "", at(101))], [("a", 1, "new\n", at(120))]]
    got = fed(spark, tmp_path, batches, lambda s: E.complete_lines(s, at="ts", idle=10), "anew")
    assert sorted(map(tuple, got.collect())) == [("a", 0, "new"), ("a", 0, "one"), ("a", 1, "half")]


@pytest.mark.parametrize("cut", [1, 50])
def test_output_between_tags_equals_the_batch(spark, tmp_path, cut):
    texts = {"a": "x<output>hello <b>world</output>tail", "b": "no tag < here", "c": "<output>open end</out", "d": "<output></output>", "e": "<out<output>1</output><output>2</output>"}
    rows = [(k, n, t[i : i + cut], at(n)) for k, t in texts.items() for n, i in enumerate(range(0, len(t), cut))]
    ordered = sorted(rows, key=lambda r: r[1])
    half = [ordered[: len(ordered) // 2], ordered[len(ordered) // 2 :]]
    got = fed(spark, tmp_path, [*half, [("z", 0, "", at(900))], [("z", 1, "", at(901))]], lambda s: E.safe_output(s, at="ts", idle=60), "tags")
    pieces = {}
    for r in got.collect():
        text, over = pieces.get(r["key"], ([], False))
        pieces[r["key"]] = (text + [r["piece"]], over or r["over"])
    batch = E.output_of(spark.createDataFrame(rows, PARTS), "key", "part", "seq").collect()
    assert {k: len("".join(t)) for k, (t, _) in pieces.items()} == {r["key"]: len(r["output"]) for r in batch}
    assert {r["key"]: r["output"] for r in batch} == {"a": "hello <b>world", "c": "open end</out", "d": "", "e": "1"}
    assert {r["key"]: r["over"] for r in batch} == {"a": True, "c": False, "d": True, "e": True}
    assert all(over for _, over in pieces.values())


def write(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_changes_of_a_tree_are_a_stream(spark, tmp_path):
    root, journal = str(tmp_path / "lib"), str(tmp_path / "journal")
    write(root, "a.md", "1")
    write(root, "sub/b.PDF", "1")
    spark.dataSource.register(WatchSource)
    stream = spark.readStream.format("folder_watch").option("path", root).option("journal", journal).option("slices", 3).load()
    seen = lambda: sorted((r["path"], r["type"]) for r in run(stream, tmp_path, "events").collect())
    assert seen() == []  # what is there at the start is no event
    write(root, "a.md", "12")
    write(root, "sub/c.json", "{}")
    write(root, "node_modules/d.md", "no")
    write(root, "e.exe", "no")
    os.remove(os.path.join(root, "sub/b.PDF"))
    first = [("a.md", "change"), ("sub/b.PDF", "unlink"), ("sub/c.json", "add")]
    assert seen() == first
    write(root, "sub/b.PDF", "back")
    os.remove(os.path.join(root, "a.md"))
    assert seen() == sorted([*first, ("a.md", "unlink"), ("sub/b.PDF", "add")])
    # A reader that starts over sees the same events, with the same ids and times.
    again = run(stream.sparkSession.readStream.format("folder_watch").option("path", root).option("journal", journal).option("slices", 3).option("initial", "true").load(), tmp_path, "again")
    known = {r["event_id"]: tuple(r) for r in spark.read.parquet(str(tmp_path / "events")).collect()}
    replayed = {r["event_id"]: tuple(r) for r in again.collect()}
    assert known.items() <= replayed.items() and {k.split(":")[0] for k in replayed.keys() - known.keys()} == {"1"}
    pruned(journal, 2)
    assert sorted(os.listdir(journal)) == ["2", "3"]


def test_changes_feed_the_debouncer(spark, tmp_path):
    root = str(tmp_path / "lib")
    write(root, "a.md", "1")
    spark.dataSource.register(WatchSource)
    stream = spark.readStream.format("folder_watch").option("path", root).option("journal", str(tmp_path / "j")).option("initial", "true").load()
    rows = run(stream, tmp_path, "events")
    assert [tuple(r.changes) for r in E.debounced(E.timed(rows)).collect()] == [("a.md=add",)]
    assert E.debounced(E.timed(stream)).isStreaming


def test_page_trees(spark, tmp_path):
    root = str(tmp_path / "tree")
    for n in (0, 2, 10, 1):
        write(root, f"doc/page_{n}.json", json.dumps({"n": n}))
    write(root, "doc/page_3.json", "{broken")
    write(root, "doc/page_x.json", "{}")
    write(root, "doc/apage_4.json", "{}")
    write(root, "other/deep/page_7.json", "[]")
    write(root, "p.pdf", "")
    write(root, "p.ocr.json", "{}")
    write(root, "q.ocr.json", "")
    spark.dataSource.register(PageTree)
    rows = spark.read.format("page_tree").option("path", root).option("files", 2).load()
    assert rows.rdd.getNumPartitions() >= 4
    got = sorted((tuple(r) for r in rows.collect()), key=str)
    page = lambda d, k, n, raw, ok=True: (d, "page", k, f"page_{n}.json", raw, ok, False)
    assert got == sorted(
        [page("doc", 0, 0, '{"n": 0}'), page("doc", 1, 1, '{"n": 1}'), page("doc", 2, 2, '{"n": 2}'), page("doc", 3, 3, "{broken", False), page("doc", 4, 10, '{"n": 10}'), page("other/deep", 0, 7, "[]"),
         ("p", "sidecar", None, "p.ocr.json", "{}", True, True), ("q", "sidecar", None, "q.ocr.json", "", False, False)], key=str,
    )
    os.makedirs(tmp_path / "none")
    assert spark.read.format("page_tree").option("path", str(tmp_path / "none")).load().collect() == []
