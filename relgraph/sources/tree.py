"""A source tree as a table: a Python data source, one partition for each top-level entry.

Spark's own file sources hide names that begin with ``_`` or ``.``; this one keeps hidden
files of known languages and prunes only hidden, vendored and build directories.
Options: ``path``; ``content`` (default true; false reads sizes and times, and a first KB where binary files are told by it);
``docs`` (default false; documents are left out).
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from relgraph import schemas
from relgraph.functions.text import LANGUAGES

PARSE_BYTES, SNIFF_BYTES = 1_500_000, 1024
PRUNED = frozenset("__pycache__ alembic bower_components build coverage dist dist-packages env env.d logs migrations node_modules out site-packages target temp tmp vendor vendors venv virtualenv".split())
EXCLUDED = re.compile(r"\.min\.(?:js|css)$|\.map$|\.lock$|^(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock)$|\.(?:pyc|pyo|so|o|a|dll|dylib)$|\.d\.ts$|_pb2(?:_grpc)?\.py$|\.generated\.(?:ts|js)$")
SNIFFED = frozenset(["python", "javascript", "typescript"])


def language_of(name: str, docs: bool) -> str | None:
    stem, dot, ext = name.rpartition(".")
    found = LANGUAGES.get(ext.lower()) if dot and stem else None
    return None if found == "doc" and not docs else found


def pruned(folder: str) -> bool:
    name = os.path.basename(folder)
    return name in PRUNED or name.startswith(".") or os.path.exists(os.path.join(folder, "pyvenv.cfg"))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.content = str(options.get("content", "true")).lower() != "false"
        self.docs = str(options.get("docs", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(name) for name in sorted(os.listdir(self.root))]

    def _row(self, path: str) -> tuple | None:
        name = os.path.basename(path)
        language = language_of(name, self.docs)
        if language is None or EXCLUDED.search(name) or os.path.islink(path):
            return None
        digest, size, mtime, body = "", 0, 0.0, b""
        try:
            stat = os.stat(path)
            size, mtime = stat.st_size, stat.st_mtime
            if self.content or language in SNIFFED:
                with open(path, "rb") as f:
                    body = f.read() if self.content else f.read(SNIFF_BYTES)
                digest = hashlib.sha256(body).hexdigest() if self.content else ""
        except OSError:
            digest, size, mtime, body = "", 0, 0.0, b""
        if language in SNIFFED and b"\0" in body[:SNIFF_BYTES]:
            return None
        return os.path.relpath(path, self.root).replace(os.sep, "/"), language, size, mtime, digest, body if self.content and size <= PARSE_BYTES else b""

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        top = os.path.join(self.root, partition.value)
        if os.path.isfile(top):
            row = self._row(top)
            if row:
                yield row
            return
        if os.path.islink(top) or pruned(top):
            return
        for folder, inner, names in os.walk(top):
            inner[:] = sorted(d for d in inner if not pruned(os.path.join(folder, d)))
            for name in sorted(names):
                row = self._row(os.path.join(folder, name))
                if row:
                    yield row


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return schemas.FILES

    def reader(self, schema) -> TreeReader:  # noqa: ANN001
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, content: bool = True, docs: bool = False) -> DataFrame:
    """``path, language, size, mtime, sha256, text``; text is empty beyond 1.5 MB, malformed bytes are replaced."""
    spark.dataSource.register(TreeSource)
    files = spark.read.format("source_tree").option("content", str(content).lower()).option("docs", str(docs).lower()).option("path", root).load()
    decode = F.udf(lambda b: bytes(b).decode("utf-8", "replace") if b else "", "string")
    return files.select("path", "language", "size", "mtime", "sha256", (decode("content") if content else F.lit("")).alias("text"))
