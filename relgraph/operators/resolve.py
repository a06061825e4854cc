"""Resolution of imports and links to nodes: candidates with priorities, joined with indexes.

Every way in which a language may mean a file becomes a candidate row ``(kind, key)``; indexes
of the same kinds are made from the node table; one equi-join meets them, and the
candidates of least priority that exist win.
"""

from __future__ import annotations

import posixpath
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relgraph.functions import text as tx
from relgraph.storage import cut

DIRECTORY_FILES = 12
ALL = 1 << 30
JS_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
CANDIDATE_SCHEMA = "path string, import_seq int, slot int, priority int, kind string, key string, exact boolean, skip_self boolean, take int"
Candidate = tuple[int, int, str, str, bool, bool, int]  # slot, priority, kind, key, exact, skip_self, take


# Generic pieces


def suffixes(paths: DataFrame) -> DataFrame:
    """``(path, suffix)``: every suffix, by whole segments, of each path without its extension."""
    parts = F.split(tx.without_extension(F.col("path")), "/")
    return paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))


def first_match(asked: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Of ``asked.candidates`` the first that ``known(key, target)`` has and that isn't ``asked.own``."""
    rows = asked.select(*keys, "own", F.posexplode("candidates").alias("at", "key"))
    found = rows.join(known, "key").where(F.col("target") != F.col("own")).withColumn("priority", F.col("at") + 1)
    order = Window.partitionBy(*keys).orderBy("priority", "target")
    return found.withColumn("n", F.row_number().over(order)).where("n = 1")


def directory_files(links: DataFrame, paths: DataFrame, most: int = DIRECTORY_FILES) -> DataFrame:
    """``(page_id, href, path)``: the first files of the directory that ``links(page_id, own, href)`` name.

    Of a directory only the first ``most + 1`` files meet its links, since no more than one of them is a link's own."""
    first = Window.partitionBy("href").orderBy("path")
    held = paths.select(tx.dirname(F.col("path")).alias("href"), "path").distinct()
    held = held.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most + 1).select("href", "path")
    found = links.join(held, "href").where(F.col("path") != F.col("own"))
    order = Window.partitionBy("page_id", "href").orderBy("path")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("page_id", "href", "path")


def matching_routes(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """``calls(page_id, call)`` with each of ``routes(route)`` that they begin with.

    Routes have few shapes (which segments are ``*``). A call is cut to each shape that routes of its first segment have,
    and what comes out is the route that it meets: rows follow the calls and the matches, not calls times routes."""
    served = routes.select("route", tx.route_head(F.col("route")).alias("head"), tx.route_shape(F.col("route")).alias("shape")).where(F.size("shape") >= 2)
    shapes = cut(served.select("head", "shape").distinct())
    called = calls.select("page_id", "call", tx.route_head(F.col("call")).alias("head"))
    plain = called.join(shapes.where("head <> '*'"), "head").select("page_id", "call", "shape")
    any_ = called.drop("head").join(shapes.where("head = '*'").select("shape")).select("page_id", "call", "shape")
    fits = plain.unionByName(any_).where(F.size(F.split("call", "/")) >= F.size("shape"))
    return fits.withColumn("route", tx.in_shape(F.col("call"), F.col("shape"))).join(served.select("route", "shape"), ["route", "shape"]).select("page_id", "call", "route")


# Candidates by language


def _python(path: str, module: str, level: int, symbols: list[str], relative: bool) -> Iterator[Candidate]:
    folder = path.split("/")[:-1]
    if relative or level > 0:
        base = folder[: len(folder) - level + 1] if level else folder
        if module:
            target = "/".join(base + module.split("."))
            yield 0, 1, "noext", target, True, False, 1
            yield 0, 2, "noext", f"{target}/__init__", True, False, 1
            for s in symbols:
                yield 0, 3, "noext", f"{target}/{s}", True, False, ALL
        else:
            for slot, s in enumerate(symbols):
                yield slot, 1, "noext", "/".join([*base, s]), True, False, 1
                yield slot, 2, "noext", "/".join([*base, s, "__init__"]), True, False, 1
    elif module.split(".")[0] not in sys.stdlib_module_names:
        yield 0, 1, "dotted", module, True, False, 1
        yield 0, 2, "noext", f"{module.replace('.', '/')}/__init__", True, False, 1
        for s in symbols:
            yield 0, 3, "dotted", f"{module}.{s}", True, False, ALL


def _js(path: str, module: str, level: int, symbols: list[str], relative: bool) -> Iterator[Candidate]:
    exact = module.startswith(".")
    base: list[str] = []
    if exact:
        base, rest = path.split("/")[:-1], module
        ups = 0
        while rest.startswith("../"):
            ups, rest = ups + 1, rest[3:]
        base = base[: len(base) - ups] if ups else base
        module = rest.removeprefix("./")
    elif "/" not in module:
        return
    target = "/".join(base + [p for p in module.split("/") if p and (p != "." or not exact)])
    ways = [("path", target), ("noext", target), *(("path", f"{target}.{e}") for e in JS_EXTENSIONS), *(("path", f"{target}/index.{e}") for e in JS_EXTENSIONS)]
    for priority, (kind, key) in enumerate(ways):
        yield 0, priority, kind, key, exact, False, 1


def _go(path: str, module: str, level: int, symbols: list[str], relative: bool) -> Iterator[Candidate]:
    rest, i = module, 0
    while rest and ("/" in rest or i == 0):
        yield 0, i, "godir", rest, i == 0, True, DIRECTORY_FILES
        rest, i = rest.partition("/")[2], i + 1


def _java(path: str, module: str, level: int, symbols: list[str], relative: bool) -> Iterator[Candidate]:
    if module.endswith(".*"):
        yield 0, 0, "javadir", module.removesuffix(".*").replace(".", "/"), True, True, ALL
    else:
        yield 0, 0, "suffix", module.replace(".", "/"), True, False, 1


def _rust(path: str, module: str, level: int, symbols: list[str], relative: bool) -> Iterator[Candidate]:
    if "::" not in module:
        beside = posixpath.join(posixpath.dirname(path), module)
        yield 0, 0, "noext", beside, True, True, 1
        yield 0, 1, "noext", f"{beside}/mod", True, True, 1
        return
    _, *rest = module.split("::")
    whole = "/".join(p for p in rest if p != "super" and p != "self")
    for priority, key in enumerate((whole, posixpath.dirname(whole))):
        if key:
            yield 0, priority, "suffix", key, False, True, 1


def _c(path: str, module: str, level: int, symbols: list[str], relative: bool) -> Iterator[Candidate]:
    stem, dot, _ = module.rpartition(".")
    name = (stem if dot and stem else module).replace("\\", "/")
    yield 0, 0, "noext", posixpath.normpath(posixpath.join(posixpath.dirname(path), name)), True, True, 1
    yield 0, 1, "suffix", name.lstrip("./"), True, True, 1
    yield 0, 2, "base", name.rsplit("/", 1)[-1], False, True, 1


#: language: candidates of one import. Add a language here.
RESOLVERS: dict[str, Callable[..., Iterator[Candidate]]] = {"python": _python, "javascript": _js, "typescript": _js, "go": _go, "java": _java, "rust": _rust, "c": _c, "cpp": _c}


def candidates(imports: DataFrame) -> DataFrame:
    """Candidate rows of ``imports(path, language, import_seq, module, level, symbols, is_relative)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "import_seq", "slot", "priority", "kind", "key", "exact", "skip_self", "take"]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32()]
        for batch in batches:
            rows = [
                (r["path"], r["import_seq"], *c)
                for r in batch.to_pylist()
                for c in RESOLVERS.get(r["language"], _js)(r["path"], r["module"] or "", r["level"] or 0, r["symbols"] or [], bool(r["is_relative"]))
            ]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return imports.select("path", "language", "import_seq", "module", "level", "symbols", "is_relative").mapInArrow(run, CANDIDATE_SCHEMA)


def index(nodes: DataFrame) -> DataFrame:
    """``(kind, key, target)`` of ``nodes(path, language)``; where one key means one file, the first or last by path."""
    n = nodes.select("path", "language", tx.without_extension(F.col("path")).alias("noext"), tx.dirname(F.col("path")).alias("dir"))
    parts = F.split("noext", "/")
    ends = lambda x, sep: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.array_join(F.slice(x, i, F.size(x)), sep))
    kind = lambda name: F.lit(name).alias("kind")
    paths = n.select(kind("path"), F.col("path").alias("key"), F.col("path").alias("target"))
    noext = n.groupBy(F.col("noext").alias("key")).agg(F.max("path").alias("target")).select(kind("noext"), "key", "target")
    dotted = n.where("language = 'python'").select(F.explode(ends(parts, ".")).alias("key"), "path").groupBy("key").agg(F.min("path").alias("target")).select(kind("dotted"), "key", "target")
    suffix = n.where("language IN ('java', 'rust', 'c', 'cpp')").select(kind("suffix"), F.explode(ends(parts, "/")).alias("key"), F.col("path").alias("target"))
    base = n.select(kind("base"), F.element_at(parts, -1).alias("key"), F.col("path").alias("target"))
    out = paths.unionByName(noext).unionByName(dotted).unionByName(suffix).unionByName(base)
    for language, name, keep in (("go", "godir", F.col("path").endswith(".go")), ("java", "javadir", F.lit(True))):
        own = n.where((F.col("language") == language) & (F.col("dir") != ""))
        chosen = own.select(F.explode(ends(F.split("dir", "/"), "/")).alias("key"), "dir", "path").groupBy("key").agg(F.min_by("dir", "path").alias("dir"))
        out = out.unionByName(chosen.join(n.where(keep).select("dir", F.col("path").alias("target")), "dir").select(kind(name), "key", "target"))
    return out


def resolve(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(path, import_seq, target, exact)``: the files that each import means."""
    hits = candidates(imports).join(index(nodes), ["kind", "key"]).where("NOT skip_self OR target <> path")
    best = Window.partitionBy("path", "import_seq", "slot").orderBy("priority")
    hits = hits.withColumn("turn", F.dense_rank().over(best)).where("turn = 1")
    nth = Window.partitionBy("path", "import_seq", "slot").orderBy("target")
    return hits.withColumn("n", F.row_number().over(nth)).where("n <= take").select("path", "import_seq", "target", "exact").distinct()


def links(extracts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links for ``graph.relationships`` of ``extracts`` (see schemas), one for each import and file it means."""
    n = nodes.select("path", "language", "always_include")
    imports = extracts.select("path", "usage_counts", F.posexplode("imports").alias("import_seq", "i")).join(n.select("path", "language"), "path").select("path", "language", "import_seq", "usage_counts", "i.*")
    used = F.aggregate(F.transform("local_names", lambda x: F.coalesce(F.col("usage_counts")[x], F.lit(0))), F.lit(0), lambda a, x: a + x)
    facts = imports.select("path", "import_seq", F.size("symbols").alias("symbols"), used.alias("usage"), (F.size("base_classes") > 0).alias("inherits"), F.col("is_reexport").alias("reexports"))
    found = resolve(imports, n).join(facts, ["path", "import_seq"])
    return found.join(n.select(F.col("path").alias("target"), F.col("always_include").alias("to_config")), "target").select(F.col("path").alias("src"), F.col("target").alias("dst"), "symbols", "usage", "inherits", "reexports", "to_config", "exact")
