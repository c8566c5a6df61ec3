"""Figures, chunks, nested blocks, lines of a stream and ingest, each on small cases."""

import json
import random

from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.functions import values as V
from folioflow.operators import documents as D
from folioflow.operators import references as R
from folioflow.sources import ocr
from folioflow.streaming import events as E

BLOCK = "doc string, page int, height double, width double, nth int, label string, content string, block_order int, x0 double, y0 double, x1 double, y1 double"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def pages(spark, rows):
    return spark.createDataFrame([(d, p, 1000.0, 600.0, n, label, text, None, *map(float, box)) for d, p, n, label, text, box in rows], BLOCK)


def test_figures_that_stand_together(spark):
    rows = [
        ("a", 0, 0, "image", "", (50, 100, 250, 300)),
        ("a", 0, 1, "image", "", (270, 100, 500, 300)),  # grown boxes meet
        ("a", 0, 2, "chart", "", (60, 330, 240, 450)),  # stands under the first
        ("a", 0, 3, "image", "", (50, 700, 60, 705)),  # too small for a region
        ("a", 0, 4, "figure_title", "Figure 2. Late", (50, 460, 500, 480)),
        ("a", 0, 5, "figure_title", "Fig. 1 | First", (50, 720, 500, 740)),
    ]
    found = D.figure_regions(pages(spark, rows), "doc").collect()
    assert [(r.x0, r.y0, r.x1, r.y1, r.caption, r.doc_order) for r in found] == [(50, 100, 500, 450, "Figure 2. Late", 100)]
    clusters = {r.cluster: r.covered for r in D.figure_clusters(pages(spark, rows), "doc").collect()}
    assert clusters == {0: 200 * 200 + 230 * 200 + 180 * 120, 3: 50}


def test_first_figures(spark):
    image = lambda d, p, n, *box: (d, p, n, "image", "", box)
    title = lambda d, p, n, text, y: (d, p, n, "figure_title", text, (50, y, 500, y + 20))
    rows = [
        # Above its caption, down from the caption before.
        title("above", 0, 0, "Figure 3. Other", 100), image("above", 0, 1, 50, 0, 500, 90), image("above", 0, 2, 50, 200, 500, 400), title("above", 0, 3, "Figure 1: The one", 420),
        # Nothing above: below.
        title("below", 0, 0, "Fig. 1. Here", 50), image("below", 0, 1, 50, 100, 500, 300), image("below", 0, 2, 50, 600, 200, 650),
        # Nothing on the page: the page before; without a Figure 1 the first caption counts.
        image("before", 0, 0, 10, 10, 300, 300), title("before", 1, 0, "Figure 2. Next page", 20), title("before", 2, 0, "Figure 4. Later", 20),
        # No caption, and a caption without images.
        image("none", 0, 0, 10, 10, 300, 300), title("alone", 0, 0, "Figure 1. No image", 20),
        # Two groups of one size: the earlier.
        image("tie", 0, 0, 50, 100, 150, 200), image("tie", 0, 1, 400, 100, 500, 200), title("tie", 0, 2, "Figure 1", 300),
    ]
    got = {r.doc: (r.page, r.x0, r.y0, r.x1, r.y1) for r in D.first_figures(pages(spark, rows), "doc").collect()}
    assert got == {"above": (0, 50, 200, 500, 400), "below": (0, 50, 100, 500, 300), "before": (1, 10, 10, 300, 300), "tie": (0, 50, 100, 150, 200)}


def test_all_outputs(spark):
    rows = [("a", 0, 0, "text", "Main.", (0, 200, 9, 210)), ("b", 0, 0, "paragraph_title", "References", (0, 200, 9, 210))]
    refs = spark.createDataFrame([("a", 0, "1. A first reference of the list"), ("a", 1, "2. Second one. With more")], "doc string, nth int, content string")
    got = {r.doc: r for r in D.all_sections(pages(spark, rows), "doc", refs).collect()}
    assert got["a"].main_text == "\nMain.\n" and got["a"].references == "1. A first reference of the list\n2. Second one. With more"
    assert (got["b"].main_text, got["b"].methods, got["b"].references, got["b"].figures) == ("", None, "", [])


def test_text_chunks(spark):
    rng = random.Random(3)
    text = "".join(rng.choice(["word ", "word. ", "word\n", "word\n\n", "longerword "]) for _ in range(4000))
    rows = [("a", text), ("b", ""), ("c", None), ("d", "x" * 9000), ("e", "short")]
    got = D.text_chunks(spark.createDataFrame(rows, "doc string, text string"), "doc", tokens=100, overlap=10).orderBy("doc", "nth").collect()
    of = {d: [r for r in got if r.doc == d] for d in "abcde"}
    assert not of["b"] and not of["c"] and [r.content for r in of["e"]] == ["short"]
    for d in "ad":
        whole = dict(rows)[d]
        assert of[d][0].start == 0 and of[d][-1].end == len(whole)
        for a, b in zip(of[d], of[d][1:]):
            assert a.start < b.start <= a.end and b.end > a.end
        assert all(r.content == whole[r.start : r.end] and r.tokens == -(-len(r.content) // 4) <= 100 for r in of[d])
    assert all(whole[r.end - 1].isspace() for r in of["a"][:-1] for whole in [text])


def test_nested_blocks(spark):
    data = {
        "parsing_res_list": [{"block_label": "text", "block_content": "one", "block_bbox": [1, 2, 3, 4], "block_order": 7}],
        "children": [{"blocks": {"parsing_res_list": [{"label": "reference", "rec_text": "four", "bbox": [1]}]}}],
        "res": {"result": [{"parsing_res_list": [{"label": "text", "text": "two"}, "no block"]}], "parsing_result": {"parsing_res_list": [{"content": "three"}]}},
    }
    rows = [("a", json.dumps(data)), ("b", "not {json"), ("c", None), ("d", "[]")]
    df = spark.createDataFrame(rows, "doc string, raw string").withColumns({"page": F.lit(0), "width": F.lit(1.0), "height": F.lit(1.0)})
    got = [(r.doc, r.nth, r.label, r.content, r.block_order, r.x0, r.y1) for r in ocr.blocks_of_pages(df, "doc").orderBy("nth").collect()]
    assert got == [("a", 0, "text", "one", 7, 1, 4), ("a", 1, "text", "two", None, None, None), ("a", 2, "", "three", None, None, None), ("a", 3, "reference", "four", None, None, None)]


def test_lines_of_a_stream(spark, tmp_path):
    rng = random.Random(5)
    lines = {k: [json.dumps({"n": n, "t": "x" * rng.randint(0, 20)}) for n in range(30)] for k in "ab"}
    parts = []
    for k, own in lines.items():
        whole, at, seq = "\n".join(own) + "\n\n", 0, 0
        while at < len(whole):
            n = rng.randint(1, 40)
            parts.append((k, seq, whole[at : at + n]))
            at, seq = at + n, seq + 1
    df = spark.createDataFrame(parts, "key string, seq int, part string")
    batch = sorted((r.key, r.nth, r.line) for r in E.lines_of(df, "key", "part", "seq").collect())
    assert batch == sorted((k, n, x) for k, own in lines.items() for n, x in enumerate(own))
    for half in (0, 1):  # two files: lines go over the batches
        df.where(F.col("seq") % 1000 < 15 if half == 0 else F.col("seq") % 1000 >= 15).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema("key string, seq int, part string").json(str(tmp_path / "in"))
        q = E.complete_lines(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted((r.key, r.nth, r.line) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == batch


def test_polled(spark):
    local = spark.createDataFrame([(-1, "temp"), (1, "old"), (2, "gone")], "id int, s string")
    fresh = spark.createDataFrame([(1, "new"), (3, "come"), (-1, "never")], "id int, s string")
    assert sorted(map(tuple, E.polled(local, fresh, "id", F.col("id") < 0).collect())) == [(-1, "temp"), (1, "new"), (3, "come")]


def test_ingest(spark):
    papers = spark.createDataFrame([(1, 10, "10.1/A", "The first known title"), (2, 20, None, "Another known title")], "paper_id int, folder_id int, doi string, title string")
    links = spark.createDataFrame([(2, 30)], "paper_id int, folder_id int")
    rows = [
        (1, 10, "THE first, known title!", None, None, None, None), (2, 10, "short", None, "10.1/a", "x", None), (3, 30, None, "another known title", None, None, "10.1/a"),
        (4, 10, None, None, None, "Another known title", None), (5, 10, None, None, None, "Quite a new title", "10.9/z"), (6, 10, None, None, None, None, None),
    ]
    uploads = spark.createDataFrame(rows, "new_id int, folder_id int, metadata_title string, first_title string, first_doi string, title string, doi string")
    got = {r.new_id: (r.stage, r.outcome, r.paper_id) for r in R.ingested(papers, links, uploads).collect()}
    same, other, new = "duplicate_same_folder", "duplicate", ("full", "new", None)
    assert got == {1: ("metadata", same, 1), 2: ("first_page", same, 1), 3: ("first_page", same, 2), 4: ("full", other, 2), 5: new, 6: new}


def test_hot_title_makes_no_pairs(spark):
    n = 3000
    rows = spark.range(n).select(F.col("id").alias("paper_id"), F.lit(None).cast("string").alias("doi"), F.lit("One title for all of them").alias("title"))
    got = R.duplicates(rows, rows.withColumnRenamed("paper_id", "new_id")).agg(F.count("*"), F.sum(F.when(F.col("new_id") == 0, F.col("paper_id")).otherwise(F.col("paper_id") * 1000))).first()
    assert tuple(got) == (n, 1)


def test_rounding_and_answers(spark):
    for n, want in ((358650, "358.6K"), (405950, "405.9K"), (1250, "1.3K"), (2250, "2.3K"), (999950, "1000.0K"), (1500000, "1.5M"), (999, "999")):
        assert one(spark, V.count_text(F.lit(n))) == want
    rng = random.Random(1)
    values = [rng.randrange(1, 10**9) / rng.choice([7, 10, 100, 1000, 64]) for _ in range(2000)] + [0.05, 0.15, 0.25, 0.95, 8.45, 1e9 + 0.05]
    from decimal import ROUND_HALF_UP, Decimal

    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(V.one_digit(F.col("v")).alias("x")).collect()]
    assert got == [str(Decimal(v).quantize(Decimal("0.1"), ROUND_HALF_UP)) for v in values]
    assert one(spark, X.math_tags(F.lit("$$a\nb$$ and $x$ but \\$5"))) == '<mathblock data-latex="YQpi">.</mathblock> and <mathinline data-latex="eA==">.</mathinline> but \\$5'
    assert one(spark, X.json_list(F.lit("```JSON\n[3, 1]```"))) == [3, 1] and one(spark, X.json_list(F.lit('{"a": 1}'))) is None
    assert one(spark, X.settings_key(F.lit(3).alias("topN"), F.lit(None).cast("int").alias("x"))) == '{"topN":3}'
    assert tuple(one(spark, X.capabilities(F.lit("PaddleOCR-vl"), F.array(F.lit(None).cast("string"))))) == (False, False, True)


def test_linked_citations(spark):
    """Against the rule in plain Python, on random answers."""
    import re

    from folioflow.operators.fusion import linked_citations

    rng = random.Random(8)
    some = ["[1]", "[2, 3]", "![4]", "[x]", "[0]", "[9]", "[1,x, 2]", "word", " ", "[", "]", "[2a]", "[-1]"]
    rows = [(i, "".join(rng.choices(some, k=rng.randint(0, 8))), [f"u{k}" for k in range(rng.randint(0, 4))]) for i in range(300)]

    def plain(answer, urls):
        def one(part):
            m = re.match(r"[+-]?\d+", part)
            n = int(m[0]) if m else 0
            if n <= 0:
                return f"[{part}]"
            return f'<citation href="{urls[n - 1]}">{part}</citation>' if n <= len(urls) else ""

        return re.sub(r"(?<!!)\[([^\]]+)\]", lambda m: "".join(one(p.strip()) for p in m[1].split(",")), answer)

    got = {r.i: r.linked for r in linked_citations(spark.createDataFrame(rows, "i int, answer string, urls array<string>")).collect()}
    assert got == {i: plain(a, u) for i, a, u in rows}


def test_sidecars_lines_and_sizes(spark, tmp_path):
    pdfs = spark.createDataFrame([("/a/x.pdf",), ("/a/Y.PDF",), ("/a/z.pdf",)], "path string")
    sides = spark.createDataFrame([("/a/x.ocr.json",), ("/a/Y.ocr.json",)], "path string")
    assert sorted(r.path for r in ocr.with_sidecar(pdfs, sides).collect()) == ["/a/Y.PDF", "/a/x.pdf"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"a": 1, "b": "x"}\n{"a": 2}\n')
    stream = spark.readStream.schema("a int, b string").json(str(tmp_path / "in"))
    E.to_ndjson(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"a":1,"b":"x"}', '{"a":2}']
    for n, want in ((7_250_000_000, "7.3B"), (350_500_000, "351M"), (1234, "1,234"), (0, None)):
        assert one(spark, V.parameter_text(F.lit(n))) == want
    for gb, want in ((4.65, "4.7 GB"), (1.05, "1.1 GB"), (0.25, "256 MB"), (0.0, None)):
        assert one(spark, V.size_text(F.lit(gb))) == want


def test_folders_thresholds_and_seeds(spark):
    from folioflow.operators import graph, search

    rows = spark.createDataFrame([(i, i % 3, [float(i), 1.0]) for i in range(12)], "id int, folder int, vector array<double>")
    query = spark.createDataFrame([([3.0, 1.0],)], "query_vector array<double>")
    assert [r.id for r in search.nearest_in(rows, query, 3).collect()] == [3, 2, 4]
    assert [r.id for r in search.nearest_in(rows, query, 3, [0]).collect()] == [3, 0, 6]
    scored = spark.createDataFrame([(1, 0.5, 0.1, 0.3), (2, 0.2, 0.4, 0.3), (3, 0.5, 0.4, 0.4)], "id int, bc double, cc double, score double")
    assert [r.id for r in graph.ranked(scored, 10, 0.3, 0.2).collect()] == [3] and [r.id for r in graph.ranked(scored, 10).collect()] == [3, 1, 2]
    papers = spark.createDataFrame([(1, None, "A title"), (2, "10.1/x", "Other"), (3, None, "a TITLE")], "id int, doi string, title string")
    found = [[r.id for r in graph.resolve_seed(papers, d, t).collect()] for d, t in (("10.1/X", "a title"), (None, "a title"), ("10.9/z", "A Title"), ("", ""), ("10.9/z", None))]
    assert found == [[2], [1], [1], [], []]
    edges = spark.createDataFrame([(1, 2), (1, 3), (4, 1), (2, 5)], "src int, dst int")
    steps = [tuple(r) for r in graph.progress_rows(edges, graph.layers(edges, 1, 2), 1, 2).orderBy("phase", "current").collect()]
    assert steps == [(2, "Found 2 references.", None, None), (3, "Found 1 citations.", None, None), (4, "Processing, (3 papers)...", 2, 1), (4, "Processing, (1 papers)...", 2, 2)]


def test_formats_as_their_sql_has_them(spark):
    """Halves go to the even digit, and contexts stay in thousands."""
    for n, up, even in ((1250.0, "1.3K", "1.2K"), (1750.0, "1.8K", "1.8K"), (2_250_000.0, "2.3M", "2.2M"), (358_650.0, "358.6K", "358.6K"), (1999.99, "2.0K", "2.0K")):
        assert (one(spark, V.count_text(F.lit(n))), one(spark, V.count_text(F.lit(n), to_even=True))) == (up, even)
    assert one(spark, V.context_text(F.lit(1_250_499))) == "1.3M" and one(spark, V.context_text(F.lit(1_250_499), millions=False)) == "1250K"
