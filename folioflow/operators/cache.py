"""Results of searches, kept for as long as what they were made of stays as it is.

The key of a result is a digest of what was asked (query, sorted folders, scope, model,
settings) and of the contents of the tables it was made of, so a changed library
misses, and a library changed back hits again. Results are Parquet tables in a shared
folder, renamed to their key once whole: a job that fails leaves no result.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def contents(table: DataFrame) -> str:
    """A digest of a table's columns and rows, whatever their order and files: the number
    of rows and two sums of 64-bit digests, added up in one pass."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(table.columns)]), {"ignoreNullFields": "false"})
    sums = [F.coalesce(F.sum(F.xxhash64("row", F.lit(k)).cast("decimal(38,0)")), F.lit(0)).alias(f"s{k}") for k in (0, 1)]
    found = table.select(row.alias("row")).agg(F.count("row").alias("n"), *sums).first()
    kinds = sorted((f.name, f.dataType.simpleString()) for f in table.schema)
    return hashlib.sha256(json.dumps([kinds, found["n"], *(str(found[f"s{k}"]) for k in (0, 1))]).encode()).hexdigest()


def files(table: DataFrame) -> str:
    """A digest of the files that a table is read from, with their sizes and times: cheap,
    but a table that is written again counts as changed."""
    meta = table.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return contents(meta)


class ResultCache:
    """Kept results in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, digest: Callable[[DataFrame], str] = contents):
        self.spark, self.folder, self.digest = spark, folder.rstrip("/"), digest
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = lambda name: hadoop.Path(f"{self.folder}/{name}" if name else self.folder)
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def key(self, asked: dict, inputs: dict[str, DataFrame]) -> str:
        """asked: what the result depends on besides tables. Queries are trimmed and
        lower-cased, as asking again in other letters finds the same; lists under
        ``folders`` are sorted; what is None doesn't count."""
        asked = {k: v for k, v in asked.items() if v is not None}
        if isinstance(asked.get("query"), str):
            asked["query"] = asked["query"].strip().lower()
        if asked.get("folders") is not None:
            asked["folders"] = sorted(asked["folders"])
        said = [sorted(asked.items()), sorted((name, self.digest(table)) for name, table in inputs.items())]
        return hashlib.sha256(json.dumps(said, default=str).encode()).hexdigest()

    def get(self, asked: dict, inputs: dict[str, DataFrame], make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
        """The result, and whether it was kept already. ``make`` is called on a miss only."""
        key = self.key(asked, inputs)
        hit = self._files.exists(self._path(f"{key}/_SUCCESS"))
        if not hit:
            part = f"part-{uuid.uuid4().hex}"
            make().write.parquet(f"{self.folder}/{part}")
            if not self._files.rename(self._path(part), self._path(key)):
                self._files.delete(self._path(part), True)  # another job has kept it meanwhile
        return self.spark.read.parquet(f"{self.folder}/{key}"), hit

    def clear(self) -> None:
        if self._files.exists(self._path("")):
            self._files.delete(self._path(""), True)
