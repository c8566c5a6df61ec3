"""Queries of the research plan take whole inputs, on small tables of their own."""

import math
import random

import pytest

from folioflow.operators import documents as D
from folioflow.operators import graph, search
from folioflow.plans import research
from folioflow.plans.registry import QUERIES


@pytest.fixture
def run(spark, tmp_path):
    def run(name, **tables):
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"{table}.parquet"))
        return QUERIES[name](spark, str(tmp_path)).collect()

    return run


def test_whole_texts(run):
    assert research
    lines = ["word " * 40 + f"end{i}" for i in range(20)]
    docs = [(1, "\n".join(lines), "x")], "doc_id long, text string, source string"
    got = {r.block: r.doi for r in run("f6_doi_in_all_lines", documents=docs)}
    assert got == {i: None if i % 2 else f"10.1000/d1.{i}" for i in range(20)}
    text = " ".join(r.text for r in run("d7_references", documents=docs))
    assert all(f"end{i}" in text for i in range(20)) and "10.1000/d1.18" in text
    html = "<p>" + "long " * 30 + "</p>"
    pages = [(1, "https://www.a.org/a/very/long/path/to/one", html), (2, "https://a.org/x", "b")]
    got = {r.site: r.prompt for r in run("f17_whole_prompt", pages=(pages, "page_id long, url string, html string"))}
    assert got == {"a.org": f"Source [1]:\nTitle: 1\nURL: {pages[0][1]}\nContent: {html}\n\nSource [2]:\nTitle: 2\nURL: https://a.org/x\nContent: b"}


def test_context_and_seed(spark, run):
    sections = spark.createDataFrame([(1, "main one", "m", "cap"), (2, "", "m", "cap"), (3, "main three", None, ""), (4, "not asked for", None, "")], "k long, main_text string, methods string, figure_captions string")
    wanted = spark.createDataFrame([(7, 3, "T3"), (7, 1, "T1"), (7, 2, "T2"), (8, 2, "T2"), (9, 3, None)], "request long, k long, title string")
    got = {r.request: r.context for r in D.context_of(sections, "k", wanted).collect()}
    assert got == {7: "## [Paper 1] T1\n\nmain one\n\n### Figure Captions\n\ncap\n\n---\n\n## [Paper 3] T3\n\nmain three", 9: "## [Paper 3] \n\nmain three"}
    docs = [(i, f"Title {i}\nbody of {i}", "src") for i in range(25)]
    got = {r.request: r.context for r in run("d8_context_text", documents=(docs, "doc_id long, text string, source string"))}
    assert set(got) == {0, 1, 2} and all(f"body of {i}" in got[i // 10] for i in range(25))
    known = spark.createDataFrame([(1, "", "A"), (2, "10.1/X", "B"), (3, None, "b"), (4, "10.1/y", "")], "id long, doi string, title string")
    found = lambda *a: [r.id for r in graph.resolve_seed(known, *a).collect()]
    assert (found("10.1/x", "A"), found(None, "b"), found("", "a"), found("none", "B"), found(None, None)) == ([2], [2], [1], [2], [])


@pytest.mark.parametrize("score", ["cosine", "distance"])
def test_nearest_to_each(spark, score, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_NUMBERS", 12)  # in the driver: several blocks
    rng = random.Random(4)
    rows = [(i, f"n{i}", [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(120)]  # many ties
    rows += [(500, "other size", [1.0] * 3), (501, "null", None), (502, "null inside", [1.0, None, 1.0, 1.0]), (503, "zero", [0.0] * 4)]
    asked = [(i, v) for i, _, v in rows if i % 10 == 0 and i < 120] + [(900, [1.0, 0.0, 0.0]), (901, None), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "id long, name string, vector array<float>").repartition(3)
    got = search.nearest_each(df, spark.createDataFrame(asked, "query_id long, query_vector array<float>"), 7, score)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r.id, r.name, r.score))

    def value(v, q):
        if score == "distance":
            return math.exp(-sum((x - y) * (x - y) for x, y in zip(v, q)))
        both = math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in q))
        return sum(x * y for x, y in zip(v, q)) / both if both else 0.0

    for i, q in asked:
        if i is None or q is None:
            continue
        all_ = [(r[0], r[1], value(r[2], q)) for r in rows if r[2] and None not in r[2] and len(r[2]) == len(q)]
        want = sorted(all_, key=lambda r: (-r[2], r[0]))[:7]
        mine = sorted(found.pop(i), key=lambda r: (-r[2], r[0]))
        assert [r[:2] for r in mine] == [r[:2] for r in want], i
        assert [r[2] for r in mine] == pytest.approx([r[2] for r in want])
    assert not found


def test_all_queries_are_asked(run):
    rows = [(i, i % 5, [math.sin(i), math.cos(i), 1.0]) for i in range(250)], "vec_id long, label int, embedding array<float>"
    for name, n in (("v5_vector_topk_each", 10), ("v5_distance_scores_each", 20), ("v9_library_search_each", 50)):
        got = [r.query_id for r in run(name, embeddings=rows)]
        assert {q: got.count(q) for q in got} == {0: n, 100: n, 200: n}
    assert {r.query_id for r in run("v7_in_folders_each", embeddings=rows)} == {0, 100, 200}
