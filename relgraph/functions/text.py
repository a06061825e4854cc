"""Text functions as column expressions: terms, sentences, paths, routes, roles and token estimates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about which node is meant; shortest first.
STOPWORDS = sorted(
    "you will would with why who which where when what were was we us to those this they there then them their the that than so should she "
    "shall please our or on of not no my must might may me its it is into in if i how his him here her he have has had from for find explain "
    "does do did could can by but being been be at as are and an about a your yes these tell show".split(),
    key=lambda w: (len(w), w),
)
BROAD = "all flow full every trace across entire global system overview pipeline structure everywhere framework end-to-end throughout architecture".split()
FIELD_WEIGHTS = {"type": 1.0, "description": 1.0, "symbols": 2.0, "filename": 3.0}
CAMEL_PIECES = "|".join(("[A-Z]?[0-9a-z]+", "[A-Z]+(?=[^a-z]|$)"))
_RUN, _PIECE, _HAS_PIECES = re.compile("[A-Za-z0-9]+"), re.compile(CAMEL_PIECES), re.compile("[A-Za-z0-9][A-Z]")
DESCRIPTION_CHARS, LARGE_TOKENS = 140, 800
#: ``role=markers`` in the order in which they are tried.
MARKERS = [
    x.split("=")
    for x in "controller=controller;route=route,router,endpoint;model=model,entity;schema=schema;middleware=middleware;service=service;repository=repository,dao;component=component;view=view,page;hook=hook;util=util,helper,lib;auth=auth;database=db,database,migration;api=api;client=client;types=type,interface;state=store,reducer,context".split(";")
]
CONFIG_EXTENSIONS = "json yaml yml toml ini cfg env conf".split()
DOC_EXTENSIONS = "md rst txt".split()
LANGUAGES = {e: k for k, v in {"python": "py", "javascript": "cjs js jsx mjs", "typescript": "ts tsx", "go": "go", "rust": "rs", "java": "java", "c": "c h", "cpp": "c++ cc cpp cxx h++ hh hpp hxx", "config": " ".join(CONFIG_EXTENSIONS), "doc": " ".join(DOC_EXTENSIONS)}.items() for e in v.split()}
ENTRYPOINTS = [f"{n}.py" for n in ("__main__", "app", "cli", "main", "manage", "server")] + [f"{n}.{e}" for n in ("index", "server") for e in ("js", "ts")]
ROLE_PHRASES = dict(
    x.split("=")
    for x in "api=API integration;auth=Authentication logic;client=Client wrapper;component=UI component;config=Configuration / constants;controller=Request controller;database=Database access;entrypoint=Application entry point;hook=Reusable hook;middleware=Middleware;model=Data model;repository=Data-access repository;route=Route / endpoint definitions;schema=Schema definitions;service=Service-layer logic;state=State management;test=Test suite;types=Type / interface definitions;util=Utility helpers;view=View / page".split(";")
)


def terms(text: Column) -> Column:
    """Each run of letters and digits in lower case, then its camel-case pieces (so a plain word comes twice)."""
    runs = F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), 1)
    pieces = lambda r: F.transform(F.regexp_extract_all(r, F.lit(f"({CAMEL_PIECES})"), 1), F.lower)
    return F.flatten(F.transform(runs, lambda r: F.concat(F.array(F.lower(r)), pieces(r))))


def _cut(text: str, once: bool) -> list[str]:
    """``terms`` of one text in another order: all runs, then all pieces. Pieces never reach beyond a run, so they are cut all at once."""
    runs = _RUN.findall(text)
    runs = list(dict.fromkeys(runs)) if once else runs
    whole = " ".join(runs)
    low = whole.lower().split()
    return low + (" ".join(_PIECE.findall(whole)).lower().split() if _HAS_PIECES.search(whole) else low)


def _lists(texts: pa.Array, of: Callable[[str], Iterable], values: Callable[[list], pa.Array]) -> pa.Array:
    """Lists of what ``of`` makes of each text, null of null; ``values`` makes an array of all their elements, of some texts at a time."""
    parts = []
    for at in range(0, max(1, len(texts)), 256):
        offsets, flat = [0], []
        for t in texts.slice(at, 256).to_pylist():
            flat += of(t or "")
            offsets.append(len(flat))
        parts.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values(flat), mask=texts.slice(at, 256).is_null()))
    return pa.concat_arrays(parts)


def _strings(flat: list) -> pa.Array:
    return pa.array(flat, pa.string())


def term_counts(text: Column) -> Column:
    """Distinct ``terms`` with their numbers, ``term`` and ``tf``."""

    @F.arrow_udf("array<struct<term string, tf bigint>>")
    def counted(texts: pa.Array) -> pa.Array:
        pairs = lambda flat: pa.StructArray.from_arrays([_strings([k for k, _ in flat]), pa.array([n for _, n in flat], pa.int64())], ["term", "tf"])
        return _lists(texts, lambda t: Counter(_cut(t, False)).items(), pairs)

    return counted(text)


def term_set(text: Column) -> Column:
    """Distinct ``terms``."""

    @F.arrow_udf("array<string>")
    def distinct(texts: pa.Array) -> pa.Array:
        return _lists(texts, lambda t: dict.fromkeys(_cut(t, True)), _strings)

    return distinct(text)


def query_terms(query: Column) -> Column:
    """Distinct terms without stopwords; all of them where nothing else is left."""

    @F.arrow_udf("array<string>")
    def telling(texts: pa.Array) -> pa.Array:
        silent = frozenset(STOPWORDS)

        def of(text: str) -> list[str]:
            every = list(dict.fromkeys(_cut(text, True)))
            return [t for t in every if t not in silent] or every

        return _lists(texts, of, _strings)

    return telling(query)


def first_sentence(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    found = F.regexp_extract(flat, "^(.+?[.!?])(\\s|$)", 1)
    sentence = F.when(found == "", flat).otherwise(found)
    short = F.concat(F.rtrim(F.substring(sentence, 1, DESCRIPTION_CHARS - 1)), F.lit("…"))
    return F.when(F.length(sentence) > DESCRIPTION_CHARS, short).otherwise(sentence)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def without_extension(path: Column) -> Column:
    """Up to the last dot; all of it where nothing comes before that."""
    return F.regexp_replace(path, "(?s)^(.+)\\.[^.]*$", "$1")


def language(path: Column) -> Column:
    """By the file name's extension; null where it is unknown."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return table[F.lower(F.regexp_extract(basename(path), "\\.([^.]*)$", 1))]


def role(path: Column, with_doc_rule: bool = True) -> tuple[Column, Column]:
    """``(file_type, always_include)``: the first rule that fires."""
    low = F.lower(path)
    name, rooted = basename(low), F.concat(F.lit("/"), low)
    config = name.startswith(".env") | F.regexp_extract(name, "\\.([^.]*)$", 1).isin(CONFIG_EXTENSIONS)
    named = reduce(lambda a, b: a | b, (name.contains(w) for w in "constants settings credentials secrets config env".split()))
    test = name.startswith("test_") | name.endswith("_test.py") | name.contains(".test.") | name.contains(".spec.") | rooted.contains("/tests/") | rooted.contains("/__tests__/")
    kind = F.when(config | named, "config").when(test, "test")
    for label, markers in MARKERS:
        fires = [name.contains(m) | rooted.contains(f"/{m}") | rooted.contains(f"{m}s/") for m in markers.split(",")]
        kind = kind.when(reduce(lambda a, b: a | b, fires), label)
    kind = kind.when(name.isin(ENTRYPOINTS), "entrypoint")
    if with_doc_rule:
        kind = kind.when(F.regexp_extract(name, "\\.([^.]*)$", 1).isin(DOC_EXTENSIONS), "doc")
    return kind.otherwise("other"), config


def describe(docstring: Column, file_type: Column, language_: Column, symbols: Column) -> Column:
    """First sentence of the docstring, else a phrase for the role and up to three symbols, else one for the language."""
    sentence = first_sentence(F.coalesce(docstring, F.lit("")))
    shown = F.concat(F.lit(" defining "), F.array_join(F.slice(symbols, 1, 3), ", "), F.when(F.size(symbols) > 3, F.concat(F.lit(" (+"), (F.size(symbols) - 3).cast("string"), F.lit(" more)"))).otherwise(""))
    part = F.when(F.size(symbols) > 0, shown).otherwise("")
    phrase = F.create_map(*(F.lit(x) for pair in ROLE_PHRASES.items() for x in pair))[file_type]
    plain = F.when(F.size(symbols) > 0, F.concat(F.initcap(language_), F.lit(" module"), part, F.lit("."))).otherwise(F.concat(F.initcap(language_), F.lit(" file ("), file_type, F.lit(").")))
    return F.when(sentence != "", sentence).when(phrase.isNotNull(), F.concat(phrase, part, F.lit("."))).otherwise(plain)


def normal_route(path: Column) -> Column:
    """Path parameters become ``*``, final slashes go."""
    marked = F.regexp_replace(path, "/\\{[^}]+\\}|/:[a-zA-Z_]\\w*|/\\d+(?=/|$)", "/*")
    return F.coalesce(F.nullif(F.rtrim(marked, F.lit("/")), F.lit("")), F.lit("/"))


def route_matches(server: Column, client: Column) -> Column:
    """Whether the client's path begins with the server's segments, ``*`` standing for any."""
    s, c = F.split(server, "/"), F.split(client, "/")
    agree = F.forall(F.zip_with(s, F.slice(c, 1, F.size(s)), lambda a, b: (a == "*") | (a == b)), lambda x: F.coalesce(x, F.lit(False)))
    return (F.size(s) >= 2) & (F.size(c) >= F.size(s)) & agree


def route_head(route: Column) -> Column:
    """The first segment."""
    return F.get(F.split(route, "/"), 1)


def route_shape(route: Column) -> Column:
    """For each segment whether it stands for any."""
    return F.transform(F.split(route, "/"), lambda s: s == "*")


def in_shape(path: Column, shape: Column) -> Column:
    """As many segments of a path as the shape has, those that it leaves open as ``*``."""
    return F.array_join(F.zip_with(F.slice(F.split(path, "/"), 1, F.size(shape)), shape, lambda s, open_: F.when(open_, "*").otherwise(s)), "/")


def byte_tokens(size: Column) -> Column:
    """Estimate from bytes, for nodes."""
    return F.greatest(F.lit(1), F.floor(size / 4)).cast("bigint")


def char_tokens(text: Column) -> Column:
    """Estimate from characters, for slices."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def adaptive_cutoff(nodes: Column) -> Column:
    grown = F.least(F.lit(0.28), F.lit(0.12) + F.lit(0.035) * F.log2(nodes / 200.0))
    return F.when(nodes <= 200, F.lit(0.12)).otherwise(grown)
