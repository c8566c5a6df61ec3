"""Trees of scanned pages as a batch source.

    spark.dataSource.register(PageTree)
    spark.read.format("page_tree").option("path", tree).load()

A document is a folder of page_<n>.json files, or a file <name>.ocr.json beside a PDF.
Folders are listed once; slices of files, by number and bytes, are the partitions. Pages
are numbered from 0 in the order of n; text that is no JSON is kept, without a parse.
The tree must be in a folder that the driver and all executors mount.
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SLICE_FILES = 1000
SLICE_BYTES = 32 << 20
_PAGE = re.compile(r"page_(\d+)\.json")
_SIDECAR = ".ocr.json"


class _Files(InputPartition):
    def __init__(self, files: list[tuple]):
        self.files = files


def _found(root: str):
    """(document, page, path, size, has_pdf) of the tree: page is None for a sidecar."""
    for folder, names, files in os.walk(root):
        names.sort()
        pages = sorted((int(m[1]), f) for f in files if (m := _PAGE.fullmatch(f)))
        for nth, (_, f) in enumerate(pages):
            path = os.path.join(folder, f)
            yield os.path.relpath(folder, root), nth, path, os.path.getsize(path), False
        there = set(files)
        for f in sorted(files):
            if f.endswith(_SIDECAR):
                path, name = os.path.join(folder, f), f.removesuffix(_SIDECAR)
                yield os.path.relpath(os.path.join(folder, name), root), None, path, os.path.getsize(path), f"{name}.pdf" in there


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


class _Reader(DataSourceReader):
    def __init__(self, root: str, most_files: int):
        self.root, self.most_files = os.path.abspath(root), most_files

    def partitions(self):
        out, size = [[]], 0
        for found in _found(self.root):
            if out[-1] and (len(out[-1]) >= self.most_files or size + found[3] > SLICE_BYTES):
                out.append([])
                size = 0
            out[-1].append(found)
            size += found[3]
        return [_Files(files) for files in out if files] or [_Files([])]

    def read(self, part: _Files):
        for document, page, path, _, has_pdf in part.files:
            with open(path, encoding="utf-8", errors="replace") as f:
                raw = f.read()
            yield document, "sidecar" if page is None else "page", page, os.path.basename(path), raw, _is_json(raw), has_pdf


class PageTree(DataSource):
    """Options: path, and files (most files in a partition)."""

    @classmethod
    def name(cls) -> str:
        return "page_tree"

    def schema(self) -> str:
        return "document string, kind string, page int, file string, raw string, is_json boolean, has_pdf boolean"

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("files", SLICE_FILES)))
