"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words of documents are streamed through the automaton, which tracks how long a passage
ending at each word stands in an item. Passages of a window's length or more are hits;
``decontaminated`` removes them and drops documents of which they cover too much.

Items are cut into pieces of PIECE_WORDS words that overlap by a window less one word,
so each window is in a piece, and pieces are dealt to shards by hash. Tasks build one
automaton a shard; up to SHARDS_AT_ONCE of them, of some SHARD_WORDS words each, go to
the tasks that read documents. Larger benchmarks take several passes, each of which
carries a document's spans along in its row, so rows never move.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .suffix_automaton import SuffixAutomaton
from .tasks import keep, text_slices, unused

WINDOW = 10
PIECE_WORDS = 2000
#: Words of items in an automaton (some 100 bytes each), and automata in a task.
SHARD_WORDS = 50_000
SHARDS_AT_ONCE = 4
SLICE_BYTES = 1 << 20

#: To lower case, and all that no word has to a space.
_LETTERS = bytes(c if chr(c).isdigit() or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and other characters than ASCII ones."""
    return text.translate(_LETTERS).split()


def _automata(items: DataFrame, id_col: str, text_col: str, length: int) -> tuple[DataFrame, int]:
    """(shard, automaton binary) of the items, and the number of shards."""
    texts = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def pieces(batches):
        for batch in batches:
            rows = {"id": [], "n": [], "words": []}
            for name, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text or b"")
                # The last piece starts where a window still fits, or holds the whole item.
                for a in range(0, max(1, len(words) - length + 1), PIECE_WORDS) if words else ():
                    piece = words[a : a + PIECE_WORDS + length - 1]
                    for column, value in zip(rows.values(), (name, len(piece), b" ".join(piece))):
                        column.append(value)
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("id", pa.string()), ("n", pa.int64()), ("words", pa.binary())]))

    cut = keep(texts.mapInArrow(pieces, "id string, n long, words binary").dropDuplicates(["id", "words"]), "decon-pieces")
    total = cut.agg(F.sum("n")).first()[0] or 0

    def build(key, table):
        names = sorted(set(table.column("id").to_pylist()))
        number = {name: i for i, name in enumerate(names)}
        rows = sorted((number[i], w.split()) for i, w in zip(table.column("id").to_pylist(), table.column("words").to_pylist()))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "automaton": pa.array([pickle.dumps((names, SuffixAutomaton(rows, length)))], pa.binary())})

    shards = max(1, -(-int(total) // SHARD_WORDS))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("id", "words"), F.lit(shards)))
    return keep(dealt.groupBy("shard").applyInArrow(build, "shard long, automaton binary"), "decon-automata"), shards


class _Marks:
    """Spans of one document (first word, end), and ids of the items that they hit."""

    def __init__(self, packed: bytes | None = None):
        self.spans, self.items = pickle.loads(packed) if packed else ([], set())

    def add(self, start: int, end: int) -> None:
        """Ends come in order; a longer window may swallow earlier spans."""
        while self.spans and self.spans[-1][1] >= start:
            start, end = min(start, self.spans[-1][0]), max(end, self.spans[-1][1])
            self.spans.pop()
        self.spans.append((start, end))

    def merged(self, others: list) -> None:
        for start, end in sorted(others):
            if self.spans and self.spans[-1][1] >= start:
                self.spans[-1] = (self.spans[-1][0], max(end, self.spans[-1][1]))
            else:
                self.spans.append((start, end))

    def packed(self) -> bytes | None:
        return pickle.dumps((self.spans, self.items)) if self.spans else None


def _numbered(texts: list[bytes], get) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, -1 for ones in no item and after each text, and the texts'
    numbers of words. Long texts are split slice by slice."""
    parts, counts = [], []
    for text in texts:
        plain, at, n = text.translate(_LETTERS), 0, 0
        while at < len(plain):
            end = plain.find(b" ", at + SLICE_BYTES) if len(plain) - at > SLICE_BYTES else -1
            end = len(plain) if end < 0 else end
            words = plain[at:end].split()
            parts.append(np.fromiter(map(get, words, itertools.repeat(-1)), np.int32, len(words)))
            n, at = n + len(words), end
        parts.append(np.array([-1], np.int32))
        counts.append(n)
    return np.concatenate(parts), np.array(counts, np.int64)


def _streamed(texts: list[bytes], automata: list, marks: list[_Marks]) -> np.ndarray:
    """Adds the hits of ``texts`` to ``marks``; gives each text's number of words."""
    for names, automaton in automata or [([], SuffixAutomaton([], WINDOW))]:
        ids, counts = _numbered(texts, automaton.vocabulary.get)
        starts = np.cumsum(counts + 1) - counts - 1
        runs = automaton.runs(ids)
        at = np.searchsorted(starts, [a for a, _ in runs], side="right") - 1
        for doc, group in itertools.groupby(zip(at.tolist(), runs), key=lambda x: x[0]):
            own, found, base = _Marks(), set(), int(starts[doc])
            for _, (a, b) in group:
                for start, end, states in automaton.matches(ids[a:b].tolist(), a - base):
                    own.add(start, end)
                    found.update(states)
            earlier, marks[doc].spans = marks[doc].spans, []
            marks[doc].merged([*earlier, *own.spans])
            marks[doc].items |= {names[i] for i in automaton.named(found)}
    return counts


def _marked(docs: DataFrame, items: DataFrame, text_col: str, columns: list[StructField], make, length: int, item_id: str, item_text: str) -> DataFrame:
    """``docs`` with the columns that ``make`` gives for (texts, numbers of words, marks)
    of some rows in place of a column of marks that none else has."""
    marks_col = unused("__marks", docs.columns)
    rows = docs.withColumn(marks_col, F.lit(None).cast("binary"))
    automata_of, count = _automata(items, item_id, item_text, length)
    text_at = docs.columns.index(text_col)
    names = [f.name for f in docs.schema.fields]
    for first in range(0, count, SHARDS_AT_ONCE):
        # At most SHARDS_AT_ONCE automata of bounded size come to the driver at a time.
        part = automata_of.where((F.col("shard") >= first) & (F.col("shard") < first + SHARDS_AT_ONCE))
        automata = rows.sparkSession.sparkContext.broadcast([bytes(r["automaton"]) for r in part.select("automaton").collect()])
        last = first + SHARDS_AT_ONCE >= count

        def run(batches, automata=automata, last=last):
            known = [pickle.loads(a) for a in automata.value]
            for batch in batches:
                place = 0
                for at, texts in text_slices(range(batch.num_rows), batch.column(text_at), SLICE_BYTES):
                    part = batch.slice(place, len(at))
                    place += len(at)
                    marks = [_Marks(m.as_py()) for m in part.column(len(names))]
                    counts = _streamed(texts, known, marks)
                    more = make(texts, counts, marks) if last else [pa.array([m.packed() for m in marks], pa.binary())]
                    fields = [f.name for f in columns] if last else [marks_col]
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *more], [*names, *fields])

        rows = rows.mapInArrow(run, StructType([*docs.schema.fields, *(columns if last else [StructField(marks_col, BinaryType())])]))
        if not last:
            rows = keep(rows, "decon-marks")
    return rows


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", length: int = WINDOW) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of ``docs``.

    A word is hit inside a passage that is a window of an item: ``length`` of its words
    in a row, or all of them where it has fewer. items_sha256 is the digest of the ids of
    the items that hit, sorted as strings and joined by commas. Null and empty texts have
    no words and nothing hits them; items without words hit nothing. Items of one id are
    one item, and a null id is written as an empty one. Rows whose id repeats are each
    judged by their own text; an empty table gives none, an empty benchmark no hits.
    Other columns are not looked at. Texts of any length are streamed whole.
    """

    def make(texts, counts, marks):
        listed = [",".join(sorted(m.items)) for m in marks]
        hits = [sum(b - a for a, b in m.spans) for m in marks]
        return [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(m.items) for m in marks], pa.int64()),
                pa.array([hashlib.sha256(s.encode()).hexdigest() for s in listed]), pa.array([n > 0 for n in hits])]

    kinds = StructType.fromDDL("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean").fields
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = _marked(texts, items, "text", kinds, make, length, item_id, item_text)
    return out.select(F.col("id").alias(id_col), *[f.name for f in kinds])


def _without(text: bytes, spans: list) -> bytes:
    """``text`` without the words of ``spans`` and what stands between them."""
    plain = text.translate(_LETTERS)
    out, done, nth, at = [], 0, 0, 0
    for first, end in spans:
        for target, ends in ((first, False), (end, True)):
            # On to the start of word ``target``, or the end of the one before it.
            while nth < target:
                at = _next_word(plain, at)
                space = plain.find(b" ", at)
                at, nth = len(plain) if space < 0 else space, nth + 1
            if not ends:
                out.append(text[done : _next_word(plain, at)])
        done = at
    return b"".join([*out, text[done:]])


def _next_word(plain: bytes, at: int) -> int:
    while at < len(plain) and plain[at] == 32:
        at += 1
    return at


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", length: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """``docs`` without passages of items: hit words go, and what stands between them;
    documents of which more than ``coverage`` of the words are hit go whole. Columns, of
    any name, are as they were, but for the text."""
    names = docs.columns
    text_at = names.index(text_col)
    marks = [StructField(unused("text", names), BinaryType()), *StructType.fromDDL(f"{unused('stays', names)} boolean").fields]

    def make(texts, counts, found):
        return [pa.array([_without(t, m.spans) if m.spans else None for t, m in zip(texts, found)], pa.binary()),
                pa.array([sum(b - a for a, b in m.spans) <= coverage * n for n, m in zip(counts.tolist(), found)])]

    out = _marked(docs, items, text_col, marks, make, length, item_id, item_text).where(F.col(marks[1].name))
    left = F.coalesce(F.col(marks[0].name).cast("string"), F.col(text_col)).alias(text_col)
    return out.select(*names[:text_at], left, *names[text_at + 1 :])
