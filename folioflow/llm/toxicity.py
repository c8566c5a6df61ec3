"""Toxicity by a weighted lexicon that Aho-Corasick matches in folded texts.

Folding undoes disguises: compatibility forms, accents, look-alike letters of
other scripts, and digits or signs that stand for letters inside a word. The
lexicon, its weights and the exception phrases are learned from labelled rows. A
term is a word or the start of a word; it enters if toxic rows have it more often
than chance allows over all terms tried. A match inside an exception phrase does
not count. The score is a logistic function of the heaviest match and of the sum
of matches for the text's length.
"""

from __future__ import annotations

import bisect
import itertools
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .tasks import keep, text_or_empty, tidy, unused

#: Most labelled rows of either label that fitting looks at, and most terms and
#: exception phrases that a lexicon holds: all that is broadcast or collected.
MOST_LABELLED = 10_000
MOST_TERMS = 20_000
MOST_EXCEPTIONS = 20_000
STARTS = (4, 5, 6)
SLICE_ROWS = 500

# Pairs of a look-alike letter and its Latin one (Cyrillic, then
# Greek, then Latin letters that no decomposition reaches).
_ALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ґ": "r",
    "п": "n", "г": "r", "з": "z", "д": "d", "л": "l", "б": "b", "и": "u", "α": "a", "β": "b",
    "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "γ": "y", "η": "n", "ω": "w", "σ": "o", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h",
    "ɡ": "g", "ſ": "s",
}
# Digits and signs that stand for letters inside words.
_SIGNS = str.maketrans("0134578@$", "oieastbas")
_ALIKE = {ord(k): v for k, v in _ALIKE.items()}
_MARKS = re.compile("[̀-ͯ​-‍⁠﻿­]+")
_MIXED = re.compile(r"[^\W\d_]+[0134578@$][\w@$]*|[0134578@$]+[^\W\d_][\w@$]*")
_REST = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Words in folded letters with one space before, between and after them."""
    t = text.lower()
    if not t.isascii():
        t = _MARKS.sub("", unicodedata.normalize("NFKD", t)).lower().translate(_ALIKE)
    # Words of letters alone, most of them, need no look at signs.
    words = (w if w.isalpha() else _REST.sub(" ", _MIXED.sub(lambda m: m[0].translate(_SIGNS), w)).strip() for w in t.split())
    return f" {' '.join(filter(None, words))} "


def _terms(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STARTS if len(w) > k}


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = -30.0
    heaviest: float = 0.0
    density: float = 0.0

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for t, w in self.weights.items():
            a.add_word(t, (t, w))
        for t in self.exceptions:
            a.add_word(t, (t, None))
        if len(a):
            a.make_automaton()
        return a


def matches(automaton, folded: str) -> list[tuple[str, float, int, int]]:
    """(term, weight, start, end) of each match outside the exception phrases."""
    if not len(automaton):
        return []
    found, spans = [], []
    for last, (term, weight) in automaton.iter(folded):
        (spans if weight is None else found).append((term, weight, last + 1 - len(term), last + 1))
    if spans:
        # Of the spans that start no later than a match, the one that reaches furthest tells.
        spans.sort(key=lambda s: s[2])
        starts, furthest = [s[2] for s in spans], list(itertools.accumulate((s[3] for s in spans), max))
        found = [m for m in found if not (k := bisect.bisect_right(starts, m[2])) or furthest[k - 1] < m[3]]
    return found


def features(automaton, text: str) -> tuple[float, float]:
    folded = fold(text)
    found = matches(automaton, folded)
    if not found:
        return 0.0, 0.0
    # A word counts once at each place, with the heaviest of its terms there.
    at: dict[int, float] = {}
    for _, w, a, _ in found:
        at[a] = max(w, at.get(a, 0.0))
    return max(at.values()), sum(at.values()) / (folded.count(" ") ** 0.5)


def _count_terms(batches):
    n = Counter()
    for batch in batches:
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            for t in _terms(fold(text)):
                n[t, toxic] += 1
            if len(n) > 1_000_000:
                yield _rows(n)
                n = Counter()
    yield _rows(n)


def _rows(n: Counter):
    return pa.RecordBatch.from_arrays(
        [pa.array([t for t, _ in n], pa.string()), pa.array([x for _, x in n], pa.int32()), pa.array(list(n.values()), pa.int64())],
        ["term", "toxic", "rows"],
    )


def _count_contexts(lexicon: Lexicon):
    def run(batches):
        automaton, n = lexicon.automaton(), Counter()
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                folded, seen = fold(text), set()
                for _, _, a, _ in matches(automaton, folded):
                    end = folded.index(" ", a + 1)
                    before, after = folded.rfind(" ", 0, a), folded.find(" ", end + 1)
                    if before >= 0:
                        seen.add(folded[before : end + 1])
                    if after >= 0:
                        seen.add(folded[a : after + 1])
                for phrase in seen:
                    n[phrase, toxic] += 1
        yield _rows(n)

    return run


def _feature_rows(lexicon: Lexicon):
    def run(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            rows = [features(automaton, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("toxic"), *(pa.array([r[i] for r in rows], pa.float64()) for i in (0, 1))],
                ["id", "toxic", "heaviest", "density"],
            )

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """A lexicon learned from ``labels`` (id, label 0 or 1) that join ``docs``.

    At most MOST_LABELLED rows of either label are used, those first by a hash of
    the id. Null ids and labels are left out, of repeated ids the largest label
    counts. Without rows of both labels the lexicon is empty and scores 0.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id"))
    known = known.agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    some = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("id"), "id").limit(MOST_LABELLED) for v in (0, 1)]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    # At most 2 * MOST_LABELLED pairs of numbers are broadcast.
    sample = keep(texts.join(F.broadcast(some[0].unionByName(some[1])), "id").select("id", "toxic", "text"), "tox-sample")
    rows = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(rows) < 2:
        return Lexicon()
    bad, good = rows[1], rows[0]
    counts = sample.select("toxic", "text").mapInArrow(tidy(_count_terms), "term string, toxic int, rows long")
    counts = keep(
        counts.groupBy("term").agg(F.sum(F.expr("rows * toxic")).alias("p"), F.sum(F.expr("rows * (1 - toxic)")).alias("n")), "tox-terms"
    )
    lexicon = Lexicon()
    share = bad / (bad + good)
    tried = counts.count()
    p, n = F.col("p"), F.col("n")
    # Log likelihood ratio against the overall share of toxic rows, at a level
    # divided by the number of terms that were tried: about one false term in all.
    gain = p * F.log(p / ((p + n) * share)) + F.when(n > 0, n * F.log(n / ((p + n) * (1 - share)))).otherwise(0.0)
    weight = F.log((p + 0.5) / (bad + 1)) - F.log((n + 0.5) / (good + 1))
    found = (
        counts.where(p > 0).withColumn("gain", gain).withColumn("weight", weight)
        .where((F.col("gain") >= float(np.log(max(tried, 2)))) & (F.col("weight") >= 1.5))
        .orderBy(F.desc("gain"), "term").limit(MOST_TERMS).collect()
    )
    lexicon.weights = {r["term"]: r["weight"] for r in found}
    if any(r["n"] for r in found):
        contexts = sample.select("toxic", "text").mapInArrow(tidy(_count_contexts(lexicon)), "term string, toxic int, rows long")
        contexts = contexts.groupBy("term").agg(F.sum(F.expr("rows * toxic")).alias("p"), F.sum(F.expr("rows * (1 - toxic)")).alias("n"))
        lexicon.exceptions = [
            r["term"]
            for r in contexts.where("p = 0 and n >= 5").orderBy(F.desc("n"), "term").limit(MOST_EXCEPTIONS).collect()
        ]
    got = sample.mapInArrow(tidy(_feature_rows(lexicon)), "id long, toxic int, heaviest double, density double").orderBy("id", "heaviest").collect()
    x = np.array([[1.0, r["heaviest"], r["density"]] for r in got])
    y = np.array([float(r["toxic"]) for r in got])
    w = np.zeros(3)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (q * (1 - q))) @ x + np.diag([1e-3, 1e-2, 1e-2]), x.T @ (y - q) - np.array([1e-3, 1e-2, 1e-2]) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    lexicon.bias, lexicon.heaviest, lexicon.density = map(float, w)
    return lexicon


def _scores(lexicon: Lexicon, rows: list[tuple[float, float]]) -> np.ndarray:
    z = [lexicon.bias + lexicon.heaviest * a + lexicon.density * b for a, b in rows]
    return 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -40, 40)))


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) and predicted of each row of ``docs``. Null and empty texts match nothing. Only the text is looked at;
    the lexicon, of bounded size, goes to each task."""

    def run(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            rows = [features(automaton, t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_scores(lexicon, rows))], ["id", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    scored = texts.mapInArrow(tidy(run), "id long, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document; labels of held-out
    rows are not learned from. A row without an id has a null held_out. Texts of any
    length are scored whole."""
    lexicon = fit(docs, labels.where(~held_out()))
    return score(docs, lexicon).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic, all columns as they were. Each row is
    judged by its own text, whatever its id; rows never move. Texts of any length are scored whole."""
    lexicon = fit(docs, labels.where(~held_out()))
    names = [f.name for f in docs.schema.fields]
    stays = unused("__stays", names)

    def run(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(a, SLICE_ROWS)
                s = _scores(lexicon, [features(automaton, t.as_py() or "") for t in part.column("text")])
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(s < 0.5)], [*names, stays])

    kept = docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, StructField(stays, BooleanType())]))
    return kept.where(F.col(stays)).drop(stays)
