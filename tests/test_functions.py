"""Golden cases of text, value and vector functions."""

import math
import time

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.functions import values as V
from folioflow.functions.vectors import cosine, distance_score, squared_distance, strict_cosine
from folioflow.operators import references as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [
        ("https://doi.org/10.1038/nature01234.", "10.1038/nature01234"),
        ("https://www.pnas.org/doi/10.1073/pnas.2400677121#supplemental", "10.1073/pnas.2400677121"),
        ("DOI: 10.1000/xyz123),", "10.1000/xyz123"),
        ("no identifier here", None),
        ("10.1000/longer-one and https://doi.org/10.1000/a", "10.1000/a"),
    ],
)
def test_doi(spark, text, want):
    assert one(spark, R.doi(F.lit(text))) == want


def test_entries(spark):
    assert one(spark, R.starter_number(F.lit("12. Smith, J. Foo"))) == 12
    assert one(spark, R.starter_rest(F.lit("12. Smith, J. Foo"))) == "Smith, J. Foo"
    for a, b, want in (("inter-", "national", "international"), ("see doi:", "10.1/x", "see doi:10.1/x"), ("foo", "bar", "foo bar")):
        assert one(spark, R.joined(F.lit(a), F.lit(b))) == want
    assert R.title_of("Lee, A., & Kim, B. (2001). A study of small things. Nature 421, 3") == "A study of small things"
    assert R.title_of('Lee, A. "The title of the work" Nature') == "The title of the work"
    blocks = [("d", 0, "orphan one"), ("d", 1, "orphan two"), ("d", 2, "1. First entry of the list inter-\nnational\n2. Second entry, long enough"), ("d", 3, "goes on"), ("d", 4, "Citation: x")]
    got = R.entries(spark.createDataFrame(blocks, "k string, block int, content string"), "k").orderBy("nth").collect()
    assert [(r.ref_number, r.text) for r in got] == [(1, "orphan two orphan one First entry of the list inter-\nnational"), (2, "Second entry, long enough goes on")]


def test_text(spark):
    assert one(spark, X.loose_title(F.lit("Deep  Learning: A Review"))) == "deeplearningareview"
    assert one(spark, X.same_title(F.lit("Abc-1"), F.lit("abc 1"))) is False
    assert one(spark, X.author_line(F.array(*map(F.lit, "ABCD")))) == "A, B, C et al."
    t = F.lit("x [3] y [1, 3] z [9]")
    assert one(spark, X.cited_numbers(t, F.lit(4))) == [1, 3]
    assert one(spark, X.renumbering(X.cited_numbers(t, F.lit(4)))) == {1: 1, 3: 2}
    assert one(spark, X.renumbered(t, X.renumbering(X.cited_numbers(t, F.lit(4))))) == "x [2] y [1,2] z [9]"
    assert one(spark, X.is_methods_heading(F.lit("Materials and Methods"))) and not one(spark, X.is_methods_heading(F.lit("Results")))
    assert one(spark, X.is_caption(F.lit("Fig. 1 | Overview"))) and one(spark, X.is_panel(F.lit("(C and D) text")))
    assert one(spark, X.is_uninformative(F.lit("a" * 99))) and one(spark, X.is_uninformative(F.lit("Data availability " + "a" * 99)))
    assert not one(spark, X.is_uninformative(F.lit("plain words " * 20)))
    assert one(spark, X.encoded(F.lit("10.1/a (b)~!"))) == "10.1%2Fa%20(b)~!"
    assert one(spark, X.paper_url(F.lit(""), F.lit("10.1/x"), F.lit(None).cast("string"), F.lit("u"))) == "https://doi.org/10.1%2Fx"
    assert one(spark, X.output_of(F.lit("a<output>b\nc</output>d"))) == "b\nc"
    assert one(spark, X.json_object(F.lit('so {"a": [1]} it is'))) == '{"a": [1]}'
    assert one(spark, X.suggestions(F.lit("- a\n1. b\nc\n\nd\ne\nf"))) == ["c", "d", "e"]
    assert one(spark, X.closed_thinking(F.lit("<think>a"))).endswith("</think> <a> </a>")
    c = one(spark, X.change_counts(F.lit(" 5 files changed, 120 insertions(+)"), F.lit("A\tx\nD\ty\nA\tz")))
    assert tuple(c) == (5, 120, 0, 2, 1)
    assert one(spark, X.sidecar_path(F.lit("/a/b.PDF"))) == "/a/b.ocr.json"
    assert one(spark, X.model_family(F.lit("GPT-OSS 20b"))) == "GPT-OSS" and one(spark, X.model_family(F.lit("Qwen3"))) == "Qwen"


def test_values(spark):
    a, b = F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:01:01").cast("timestamp")
    assert one(spark, V.time_difference(a, b)) == "1 minute"
    assert tuple(one(spark, V.badge(F.lit(0.15), 40, 15))) == (15, "amber")
    assert one(spark, V.js_round(F.lit(-2.5))) == -2
    assert one(spark, V.count_text(F.lit(1500))) == "1.5K" and one(spark, V.size_text(F.lit(0.5))) == "512 MB"
    assert one(spark, V.version_number(F.lit("9.3"))) == 93 and one(spark, V.version_number(F.lit("x"))) is None
    assert one(spark, V.line_chunks(F.lit("a\nb\nc"), 2)) == ["a\nb", "c"]
    assert one(spark, V.rgb(F.lit("#ff0000"))) == [1.0, 0.0, 0.0]


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x)).cast("array<float>")
    assert one(spark, cosine(v(1.0, 0.0), v(0.0, 1.0))) == 0
    assert one(spark, cosine(v(1.0, 0.0), v(1.0, 0.0, 0.0))) == 0
    assert one(spark, cosine(v(0.0, 0.0), v(1.0, 0.0))) == 0
    assert one(spark, distance_score(squared_distance(v(1.0), v(1.0)))) == 1
    assert math.isclose(one(spark, strict_cosine(v(1.0, 2.0), v(2.0, 4.0))), 1)
    with pytest.raises(Exception, match="can't be compared"):
        one(spark, strict_cosine(v(0.0), v(1.0)))


def test_the_chunk_filter_reads_long_texts_once(spark):
    """Names without marks after them: each one looked on to the end of the text."""
    begun = time.time()
    assert one(spark, X.is_uninformative(F.repeat(F.lit("Smith and so on "), 20_000))) is False
    assert time.time() - begun < 10
    for text, want in (
        ("  " + "b" * 99 + "\n", True), ("  " + "b" * 98 + " c\n", False), (" \n10.1234/" + "A" * 100 + " ", True), ("10.1234/" + "A" * 100 + " b", False), ("." * 200, True), (None, None),
        ("Smith^{1}, Jones^{2} " + "and more " * 20, True), ("Smith^{1} " + "and more " * 20, False), ("One ², Two ³ " + "and more " * 20, True), ("x" * 100 + " OPEN Access", True), ("x" * 100 + " published: 1 May 2020", True),
    ):
        assert one(spark, X.is_uninformative(F.lit(text).cast("string"))) is want, text


def test_segments_of_a_block_need_no_shuffle(spark):
    rows = spark.createDataFrame([("d", 0, "one line"), ("d", 1, "before\n1. First\nof it\n2. Second \n"), ("d", 2, "a\n3. only one\nb"), ("d", 3, "1. a\n2. b")], "k string, block int, content string")
    got = R.segments(rows, "k")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [
        ("d", 0, 0, "one line"), ("d", 1, 0, "before\n1. First\nof it"), ("d", 1, 1, "2. Second"), ("d", 2, 0, "a\n3. only one\nb"), ("d", 3, 0, "1. a"), ("d", 3, 1, "2. b"),
    ]
