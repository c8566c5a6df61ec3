"""Documents, fusion, graphs, tables and streams on small fixtures."""

import datetime

from pyspark.sql import functions as F

from folioflow.operators import documents as D
from folioflow.operators import fusion, graph
from folioflow.sources import ocr
from folioflow.sources import tables as T
from folioflow.streaming import events as E

B = "k string, page int, nth int, label string, content string, height double, width double, x0 double, y0 double, x1 double, y1 double"


def block(page, nth, label, content, box=(50.0, 200.0, 550.0, 250.0)):
    return ("d", page, nth, label, content, 1000.0, 600.0, *map(float, box))


def test_chunks_and_sections(spark):
    long = "plain words " * 12
    rows = [
        block(0, 0, "doc_title", "T"), block(0, 1, "paragraph_title", "Intro"), block(0, 2, "text", long + "one"), block(0, 3, "text", long + "two"),
        block(0, 4, "paragraph_title", "Methods"), block(0, 5, "text", long + "three"), block(1, 0, "paragraph_title", "References"),
        block(1, 1, "text", "gone"), block(1, 2, "paragraph_title", "Other"), block(1, 3, "text", "gone too"), block(1, 4, "header", "x"),
    ]
    df = spark.createDataFrame(rows, B)
    got = [r.content for r in D.chunks(df, "k").orderBy("page", "nth").collect()]
    assert got == ["Intro\n" + long + "one", long + "two", "Methods\n" + long + "three"]
    s = D.sections(df, "k").first()
    assert "one" in s.main_text and "three" in s.methods and "gone" not in s.main_text + s.methods
    assert D.markdown(df, "k").first().markdown.startswith("\n# T\n\n\n## Intro\n")


def test_noise_and_figures(spark):
    rows = [block(p, 0, "text", "Running  Head", (0, 10, 500, 30)) for p in range(3)]
    rows += [block(0, 1, "image", "", (100, 300, 300, 500)), block(0, 2, "chart", "", (110, 520, 290, 700)), block(0, 3, "text", "axis", (120, 310, 200, 330)), block(0, 4, "figure_title", "Fig. 1 | A", (100, 720, 400, 740)), block(0, 5, "image", "", (0, 0, 3, 3))]
    df = spark.createDataFrame(rows, B)
    assert [r.noise for r in D.repeated_edges(df, "k").collect()] == ["running head"]
    r = D.figure_regions(df, "k").collect()
    assert len(r) == 1 and (r[0].x0, r[0].y1, r[0].caption) == (100, 700, "Fig. 1 | A")
    assert "axis" not in [x.content for x in D.outside_figures(df, "k").collect()]


def test_graph_and_tables(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (4, 1), (5, 2), (5, 9), (4, 6)], "src long, dst long")
    assert {(r.id, r.depth) for r in graph.layers(e, 1, 2).collect()} == {(2, 1), (3, 1), (4, 1), (5, 2), (6, 2)}
    c = {r.id: (r.bc, r.cc, r.score) for r in graph.coupling(e, spark.createDataFrame([(5,)], "id long"), 1).collect()}
    assert c == {5: (0.5, 0.0, 0.25)}
    s = spark.createDataFrame([(1, 0.2), (2, 0.6), (3, 1.0)], "id int, score double")
    assert [round(r.score, 6) for r in graph.spread(s).orderBy("id").collect()] == [0, 0.5, 1]
    assert [r.score for r in graph.spread(s.withColumn("score", F.lit(0.5))).collect()] == [0.5] * 3
    old, new = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, at int"), spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, at int")
    once = T.upserted(old, new, ["k"], "at")
    assert {(r.k, r.v) for r in once.collect()} == {(1, "a"), (2, "d"), (3, "e")} == {(r.k, r.v) for r in T.upserted(once, new, ["k"], "at").collect()}
    assert {(r.k, r.v) for r in T.inserted_or_ignored(old, new, ["k"]).collect()} >= {(1, "a"), (2, "b")}
    ids = T.with_new_ids(spark.range(10).select(F.col("id").alias("z")), spark.createDataFrame([(7,)], "id long"), "id", ["z"])
    assert {r.z: r.id for r in ids.collect()} == {i: i + 8 for i in range(10)}


def test_replace_partitions(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.partitionBy("k").parquet(p)
    T.replace_partitions(spark.createDataFrame([(2, "c")], "k int, v string").select("v", "k"), p, "k")
    assert {(r.k, r.v) for r in spark.read.parquet(p).collect()} == {(1, "a"), (2, "c")}


def test_ocr_files(spark, tmp_path):
    (tmp_path / "a.ocr.json").write_text('{"source": "a", "pages": [{"page": 0, "data": {"height": 9, "parsing_res_list": [{"block_label": "text", "block_content": "hi", "block_bbox": [1, 2, 3, 4]}]}}]}')
    docs = ocr.read_sidecars(spark, str(tmp_path))
    r = ocr.blocks(docs, "source").first()
    assert (r.source, r.label, r.content, r.y1, r.height) == ("a", "text", "hi", 4.0, 9.0)
    (tmp_path / "pages").mkdir()
    for n, t in ((10, '{"a": 1}'), (2, "not json"), (1, "{}")):
        (tmp_path / "pages" / f"page_{n}.json").write_text(t)
    got = [(r.page, r.raw, r.bad) for r in ocr.read_page_files(spark, str(tmp_path)).select("page", "raw", F.col("parsed").isNull().alias("bad")).orderBy("page").collect()]
    assert got == [(0, "{}", False), (1, "not json", True), (2, '{"a": 1}', False)]


def test_fusion(spark):
    rows = spark.createDataFrame([(0, 1, "u1"), (1, 1, "u1"), (1, 2, "https://www.nature.com/x"), (2, 1, "u3")], "query_idx int, rank int, url string")
    got = [(r.nth, r.url) for r in fusion.reputable_first(fusion.fused(rows, 10)).orderBy("nth").collect()]
    assert got == [(1, "https://www.nature.com/x"), (2, "u1"), (3, "u3")]
    none = spark.createDataFrame([], "nth int")
    assert fusion.judged(fusion.fused(rows, 10), none, fallback=2).count() == 2
    a = spark.createDataFrame([("see [2] ![1] [x] [2,9]", ["a", "b"])], "answer string, urls array<string>")
    assert fusion.linked_citations(a).first().linked == 'see <citation href="b">2</citation> ![1] [x] <citation href="b">2</citation>'
    large = spark.createDataFrame([("call [4155551234] or [99999999999999999999999, 1] not [-4155551234] [002] [0]", ["a", "b"])], "answer string, urls array<string>")
    assert fusion.linked_citations(large).first().linked == 'call  or <citation href="a">1</citation> not [-4155551234] <citation href="b">002</citation> [0]'


def test_streams_equal_batches(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    at = lambda ms: t0 + datetime.timedelta(milliseconds=ms)
    rows = [(1, at(0), "f", "a", "add"), (2, at(300), "f", "a", "change"), (3, at(900), "f", "b", "add")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, folder string, path string, type string")
    batch = sorted(tuple(r.changes) for r in E.debounced(df).collect())
    assert batch == [("a=change",), ("b=add",)]
    df.unionByName(df.limit(1).withColumn("ts", F.lit(at(600_000))).withColumn("folder", F.lit("z"))).write.parquet(str(tmp_path / "in"))
    stream = E.timed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "1 second")
    q = E.debounced(stream).writeStream.format("memory").queryName("deb").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r.changes) for r in spark.table("deb").where("folder = 'f'").collect()) == batch
    parts = spark.createDataFrame([(1, 0, "x<outp"), (1, 1, "ut>hello wor"), (1, 2, "ld</out"), (1, 3, "put>tail")], "key string, seq long, part string")
    parts.coalesce(1).write.parquet(str(tmp_path / "p"))
    s = spark.readStream.schema(parts.schema).parquet(str(tmp_path / "p"))
    q = E.safe_output(s).writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert "".join(r.piece for r in spark.table("out").collect()) == "hello world"
    assert E.watched(spark.createDataFrame([("a/b.PDF",), ("node_modules/x.md",), ("a.exe",)], "path string")).count() == 1


def test_chunks_are_put_in_order_once(spark):
    """Headings come by one window: whole contents are not sorted a second time."""
    say = "plain words and numbers 12 " * 5
    given = [("paragraph_title", "A"), ("figure_title", say), ("text", "1" + say), ("text", "2" + say), ("paragraph_title", "B"), ("paragraph_title", None), ("text", "3" + say), ("paragraph_title", "C"), ("paragraph_title", ""), ("text", "4" + say), ("text", None)]
    rows = [(1, 0, n, label, content) for n, (label, content) in enumerate(given)]
    out = D.chunks(spark.createDataFrame(rows, "k long, page int, nth int, label string, content string"), "k")
    got = [(r.nth, r.section_type, r.chunk_index, r.content) for r in out.orderBy("nth").collect()]
    text = "paragraph_title"
    assert got == [(1, "figure_title", 0, say), (2, text, 0, "A\n1" + say), (3, text, 0, "2" + say), (6, text, 0, "B\n3" + say), (9, text, 0, "4" + say)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Window [" in line for line in plan.splitlines()) == 1
