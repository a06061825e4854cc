"""Facts of source files: imports, symbols, usage, routes. One function a language, in a registry.

To add a language, write ``text -> Facts`` and put it into ``EXTRACTORS``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph import schemas
from relgraph.extract import braces, python
from relgraph.extract.facts import Facts

EXTRACTORS: dict[str, Callable[[str], Facts]] = {"python": python.extract, "javascript": braces.javascript, "typescript": braces.javascript, "go": braces.go, "rust": braces.rust, "java": braces.java, "c": braces.c, "cpp": braces.c}


def extract(language: str | None, text: str | None) -> Facts:
    """Facts of one file; none for blank text and for languages without an extractor."""
    if not (text or "").strip() or language not in EXTRACTORS:
        return Facts()
    return EXTRACTORS[language](text)


def extracts(files: DataFrame) -> DataFrame:
    """One row (see schemas) for each of ``files(path, language, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [extract(r["language"], r["text"]).row(r["path"]) for r in batch.to_pylist()]
            names = list(Facts().row(""))
            string, strings = pa.string(), pa.list_(pa.string())
            one = pa.struct([("module", string), ("level", pa.int32()), ("symbols", strings), ("local_names", strings), ("is_relative", pa.bool_()), ("base_classes", strings), ("is_reexport", pa.bool_())])
            types = [string, pa.list_(one), strings, pa.map_(string, pa.int32()), string, pa.bool_(), string, strings, strings]
            yield pa.RecordBatch.from_arrays([pa.array([list(r[k].items()) if isinstance(r[k], dict) else r[k] for r in rows], t) for k, t in zip(names, types, strict=True)], names)

    return files.select("path", "language", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schemas.EXTRACTS)
