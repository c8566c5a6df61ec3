"""A training corpus from ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns
of documents.

- toxicity: documents that the lexicon, learned from labels, predicts toxic go.
- exact_dedup: of equal texts the one with the smallest doc_id stays.
- near_dedup: of each group of near copies the one with the smallest doc_id stays.
- source_mix: documents as often, or as far, as their source's target weight says;
  a document that is taken twice has two rows.
- bpe: one row for each row of the mix, with its token ids and digests of these and
  of the text that they decode to.

Null and empty texts are not toxic, equal to each other, and not in the mix, as they
hold no words. Rows without an id go through all stages, and rows of one id each by its
own text; of rows of one id and one text exact_dedup keeps one. Empty tables go through
all stages; extra columns of any name are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.bpe import encode_and_decode
from folioflow.llm.exact_dedup import drop_duplicates
from folioflow.llm.mixing import mixed_documents
from folioflow.llm.ngram_join import one_of_each
from folioflow.llm.queries import tokenizer_path
from folioflow.llm.tasks import keep
from folioflow.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_and_decode(docs, tokenizer_path()).select(
        "doc_id",
        "ids",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("bpe", bpe),
]

#: The learned lexicon and byte-pair encoding are not SQL; tests compare the stages
#: with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
