import random

import pytest

pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    import corpus_pipeline
    from folioflow.llm.tasks import keep

    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lm", "rt", "n")]
    rows = [(i, " ".join(rng.choices(words, k=60)), "en", f"s{i % 3}", 0) for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "s0", 0) for i in range(10)]  # exact copies
    rows += [(300 + i, rows[i][1] + " end", "en", "s1", 0) for i in range(10)]  # near copies
    rows += [(400 + i, " ".join(rng.choices(words, k=30)) + " grumpol", "en", "s2", 0) for i in range(40)]
    rows += [(500, None, None, None, None), (501, "", "en", "s1", 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = [(i, 0) for i in range(0, 120)] + [(i, 1) for i in range(400, 432)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, ids = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = keep(stage(spark, docs, d), name)
        if name != "bpe":
            assert out.columns == docs.columns
        ids[name], docs = [r.doc_id for r in out.select("doc_id").collect()], out
    clean = set(range(120)) | set(range(200, 210)) | set(range(300, 310)) | {500, 501}
    assert set(ids["toxicity"]) == clean
    assert set(ids["exact_dedup"]) == clean - set(range(200, 210)) - {501}
    assert set(ids["near_dedup"]) == set(range(120)) | {500}
    assert set(ids["source_mix"]) <= set(range(120)) and sorted(ids["bpe"]) == sorted(ids["source_mix"])
    a = corpus_pipeline.run(spark, d).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in a) == sorted((r.doc_id, r.ids_sha256) for r in docs.collect())


def test_empty(spark, tmp_path):
    import corpus_pipeline

    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, d).collect() == []


def test_missing_and_repeated_ids_and_clashing_columns(spark, tmp_path):
    """Every row is judged by itself; columns of any name go through all stages."""
    import collections

    import corpus_pipeline
    from folioflow.llm.tasks import keep

    rng = random.Random(21)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lm", "rt", "n")]
    say = lambda n: " ".join(rng.choices(words, k=n))
    a, b, c = say(60), say(60), say(60)
    rows = [(i, say(60), f"s{i % 2}") for i in range(100, 220)]
    rows += [(1, a, "s0"), (1, a, "s0"), (1, b, "s0"), (2, b, "s1"), (None, c, "s1"), (None, c, "s1"), (3, say(30) + " grumpol", "s0"), (3, c + " x y", "s0"), (None, say(30) + " grumpol", None), (None, None, None)]
    rows += [(400 + i, say(30) + " grumpol", "s0") for i in range(40)]
    extra = "ids string, score double, kept int, component_id string, id int, n long, taken int, rep string"
    # Names that the stages' own columns have.
    helpers = ["__key", "__nth", "__row", "__words", "__first", "__stays", "__stays_", "__doc", "__id", "__of", "__size", "__shares", "__taken", "__won", "__salt", "__t", "__marks"]
    extra += "".join(f", {h} string" for h in helpers)
    data = [(i, t, "en", s, 0, f"x{k}", 0.5, 1, "c", k, 7, 2, None, *(f"{h}{k}" for h in helpers)) for k, (i, t, s) in enumerate(rows)]
    d = str(tmp_path)
    spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 0) for i in range(100, 220)] + [(i, 1) for i in range(400, 432)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = keep(stage(spark, docs, d), name)
        assert docs.columns == [c.split(" ")[0] for c in f"doc_id, text, lang, source, n_chars, {extra}".split(", ")]
        for r in docs.collect():
            assert all(r[h] == f"{h}{r['id']}" for h in helpers) and r.ids == f"x{r['id']}"
        seen[name] = sorted((str(r.doc_id), r.text or "", r.ids) for r in docs.collect())
    clean = [x for x in rows if "grumpol" not in (x[1] or "")]
    assert [x[:2] for x in seen["toxicity"]] == sorted((str(i), t or "") for i, t, _ in clean)
    # One row of (1, a); b stays with id 1, the smaller; one of the rows without an id.
    first = [(1, a), (1, b), (None, c), (3, c + " x y"), (None, None), *((i, t) for i, t, _ in rows[:120])]
    assert [x[:2] for x in seen["exact_dedup"]] == sorted((str(i), t or "") for i, t in first)
    # What has no id stays; 3 is a near copy of c, which names no smaller id.
    assert [x[:2] for x in seen["near_dedup"]] == sorted((str(i), t or "") for i, t in first)
    out = docs.collect()
    words_of = collections.Counter()
    for r in out:
        words_of[r.source] += len((r.text or "").split())
    assert abs(words_of["s0"] + words_of["s1"] - 1.5 * sum(len((t or "").split()) for _, t in first)) <= 64
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == len(out)


def test_very_long_texts_go_through_whole(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lm", "rt", "n")]
    say = lambda n: " ".join(rng.choices(words, k=n))
    long = say(150_000)
    rows = [(0, long), (1, long + " end"), (2, long), (3, say(150_000) + " grumpol" * 900), *((k, say(40)) for k in range(10, 60)), *((k, say(30) + " grumpol") for k in range(100, 140))]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows if i >= 10], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    got = corpus_pipeline.run(spark, d).select("doc_id", "n_tokens").collect()
    assert {r.doc_id for r in got} <= {0, *range(10, 60)} and max(r.n_tokens for r in got if r.doc_id == 0) > 100_000
