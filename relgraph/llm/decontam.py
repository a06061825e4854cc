"""Benchmark decontamination: documents that hold a benchmark item, or nearly so.

Candidates are found by SimHash. For each item there is a window of words of about its
size; the fingerprints of all of the item's windows are indexed, and those of every
document at a stride such that a verbatim copy, wherever it begins, has a window that
is one of the item's. The index is multi-index Hamming: a fingerprint is cut into
four blocks (``BLOCKS``), and every value within a quarter of ``RADIUS`` bits of an item's block leads to
it, so every fingerprint within ``RADIUS`` is found; it takes about 2 KB for each of an item's fingerprints. An edited copy can be further away than that, so
each item is also indexed by its short runs of words, of the length (``run_of``) of which every copy at
``SIMILARITY`` must have one unbroken, wherever single words were replaced, and those are looked
up at every word of a document. Candidates are then verified by the
weighted share of the item's word bigrams (rarer in the benchmark: heavier) that the
document has where the window was, with the item's length to each side as slack.

Documents are read once; nothing is shuffled. The benchmark goes to all executors
while it is below ``ITEMS_AT_ONCE`` items and ``CHARS_AT_ONCE`` characters, which is checked by a count; a larger one is
searched in parts of that size, with a pass over the documents for each. A worker builds a part's index once. Rarity is counted over the whole
benchmark before it is split, so an item's similarity is the same however it is searched for.

Defined results: a null or empty text holds nothing; an item with a null id or text, or of
fewer than two words, is not searched for. An item found in several places of a document
is reported once, at its most similar place (of equals that whose fingerprint is nearest, then the first). Repeated documents and
items are each reported; an empty benchmark or corpus gives an empty result. Other
columns are left out of ``find`` and kept by ``clean``. Ids may be of any type; a very long text or item is
searched whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from relgraph.llm import textops as tx
from relgraph.llm.shared import cut

SIMILARITY = 0.7
RADIUS, BLOCKS, BITS = 11, (16, 16, 16, 16), 64
ITEMS_AT_ONCE, CHARS_AT_ONCE = 5_000, 2_000_000
_QUERIES = 1 << 14  # fingerprints looked up at once
_built: WeakKeyDictionary[Broadcast, Benchmark] = WeakKeyDictionary()
_ROWS = 256  # texts of a batch that are strings at once
_PART = 1 << 13  # words fingerprinted at once, for the cache


def sizes(longest: int) -> list[int]:
    """Window sizes: every size up to 8, then each about a sixth larger than the one before."""
    out = [*range(1, 9)]
    while out[-1] < longest:
        out.append(out[-1] + max(1, out[-1] // 6))
    return out


def stride(size: int) -> int:
    return max(1, size // 8)


def window_of(item_words: int) -> int:
    """The largest size of which an item has as many windows as the stride is long."""
    return max(s for s in sizes(item_words) if s + stride(s) - 1 <= item_words)


def run_of(item_words: int, threshold: float = SIMILARITY) -> int:
    """Words of the longest run that every copy has unbroken which keeps ``threshold`` of the item's bigrams:
    a replaced word breaks two of them (words at the ends, or side by side, fewer, which leaves longer runs)."""
    held = item_words - 1
    broken = int((1 - threshold) * held + 1e-9)
    return 1 + min(-(-(held - b) // (b // 2 + 1)) for b in range(broken + 1))


def _running(grams: np.ndarray) -> np.ndarray:
    """Sums of each bit over the first 0, 1, 2, ... grams, by blocks of rows."""
    rows, kind = -(-len(grams) // 128), np.int16 if len(grams) < 1 << 15 else np.int32
    bits = np.zeros((rows * 128, BITS), kind)
    bits[: len(grams)] = np.unpackbits(grams.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    x = bits.reshape(rows, 128, BITS)
    for i in range(1, 128):
        x[:, i] += x[:, i - 1]
    x[1:] += np.cumsum(x[:-1, -1], axis=0, dtype=kind)[:, None]
    sums = np.zeros((len(grams) + 1, BITS), kind)
    sums[1:] = bits[: len(grams)]
    return sums


def simhashes(grams: np.ndarray, steps: dict[int, int]) -> dict[int, np.ndarray]:
    """64-bit SimHashes of the grams of windows: for each size in words, of the windows at every so many words."""
    held = {size: max(1, size - 1) for size in steps}  # grams of a window
    counts = {size: (len(grams) - held[size]) // step + 1 if len(grams) >= held[size] else 0 for size, step in steps.items()}
    out = {size: np.zeros(n, np.uint64) for size, n in counts.items()}
    part = max(_PART, *held.values()) if held else _PART
    for at in range(0, len(grams), part):
        sums = _running(grams[at : at + part + max(held.values())])
        for size, step in steps.items():
            first, stop = -(-at // step), min(-(-(at + part) // step), counts[size])
            if first < stop:
                low = first * step - at
                n = stop - first
                over = sums[low + held[size] :: step][:n] - sums[low::step][:n] > held[size] // 2
                out[size][first:stop] = np.packbits(over.ravel(), bitorder="little").view(np.uint64)
    return out


def _near(bits: int, radius: int) -> np.ndarray:
    """All masks of ``bits`` bits with at most ``radius`` set."""
    masks = level = np.zeros(1, np.uint64)
    for _ in range(radius):
        level = np.unique((level[:, None] ^ (np.uint64(1) << np.arange(bits, dtype=np.uint64))[None, :]).ravel())
        masks = np.union1d(masks, level)
    return masks


class Blocks:
    """Multi-index over fingerprints: all within ``RADIUS`` of a query are found."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.blocks, shift = prints, [], 0
        for bits in BLOCKS:
            near = _near(bits, RADIUS // len(BLOCKS))
            own = (prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
            values = (own[:, None] ^ near[None, :]).astype(np.uint16).ravel()
            owners = (np.argsort(values, kind="stable") // len(near)).astype(np.int32)
            first = np.zeros((1 << bits) + 1, np.int64)  # where a value's owners begin
            np.cumsum(np.bincount(values, minlength=1 << bits), out=first[1:])
            self.blocks.append((np.uint64(shift), np.uint64((1 << bits) - 1), first, owners))
            shift += bits

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, fingerprint) within the radius, each once."""
        found = [np.zeros(0, np.int64)]
        for at in range(0, len(queries), _QUERIES):
            part = queries[at : at + _QUERIES]
            for shift, mask, first, owners in self.blocks:
                own = ((part >> shift) & mask).astype(np.int64)
                low = first[own]
                many = first[own + 1] - low
                hit = np.flatnonzero(many)
                low, many = low[hit], many[hit]
                query = np.repeat(hit, many)
                target = owners[np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)]
                close = np.bitwise_count(part[query] ^ self.prints[target]) <= RADIUS
                found.append((query[close] + at) * len(self.prints) + target[close])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))


class Benchmark:
    """Items ready to be searched for."""

    def __init__(self, rows: list[tuple], rarity: tuple[int, dict[int, int]] | None = None, threshold: float = SIMILARITY):
        """``rarity``: how many items the whole benchmark has, and in how many each bigram is (1 where
        it isn't said), if ``rows`` are a part of it."""
        rows = sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1]))
        hashes, begins = tx.words([r[1] for r in rows])
        words = [hashes[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)]
        keep = [i for i, w in enumerate(words) if len(w) > 1]
        self.ids, self.words = [rows[i][0] for i in keep], [words[i] for i in keep]
        self.grams = [tx.grams(w, 2) for w in self.words]
        total, seen = rarity or (len(keep), Counter(g for grams in self.grams for g in set(grams.tolist())))
        self.weights = []
        for grams in self.grams:
            distinct, counts = np.unique(grams, return_counts=True)
            rarity = 1 + np.log(max(1, total) / np.fromiter((seen.get(g, 1) for g in distinct.tolist()), float, len(distinct)))
            self.weights.append((distinct, counts, rarity))
        self.index: dict[int, tuple[Blocks, np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            by_size.setdefault(window_of(len(w)), []).append(i)
        for size, items in by_size.items():
            prints = [simhashes(self.grams[i], {size: 1})[size] for i in items]
            places = np.concatenate([np.arange(len(p)) for p in prints])
            self.index[size] = (Blocks(np.concatenate(prints)), np.repeat(items, [len(p) for p in prints]), places)
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}  # known low bits, hashes ascending, items, places
        by_run: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            by_run.setdefault(run_of(len(w), threshold), []).append(i)
        for size, items in by_run.items():
            own = [tx.grams(self.words[i], size) for i in items]
            marks = np.concatenate(own)
            order = np.argsort(marks, kind="stable")
            known = np.zeros(1 << min(22, max(16, (64 * len(marks)).bit_length())), bool)
            known[marks & np.uint64(len(known) - 1)] = True
            self.runs[size] = (known, marks[order], np.repeat(items, [len(m) for m in own])[order], np.concatenate([np.arange(len(m)) for m in own])[order])

    def similarity(self, item: int, grams: np.ndarray) -> float:
        """Weighted share of the item's bigrams, with their numbers, that are in ``grams``."""
        distinct, counts, rarity = self.weights[item]
        own = np.sort(grams)
        have = np.searchsorted(own, distinct, "right") - np.searchsorted(own, distinct, "left")
        return float((np.minimum(have, counts) * rarity).sum() / (counts * rarity).sum())

    def find(self, hashes: np.ndarray, begins: np.ndarray, threshold: float) -> list[tuple[int, int, float, int, int]]:
        """``(document, item, similarity, first word, last word + 1)`` over documents whose words are ``hashes``."""
        if not self.ids or len(hashes) < 2:
            return []
        grams = tx.grams(hashes, 2)
        lengths = np.diff(begins)
        best: dict[tuple[int, int], tuple[float, int, int, int]] = {}  # similarity, bits apart (negative), place
        marks = simhashes(grams, {size: stride(size) for size in self.index})
        tried: set[tuple[int, int, int]] = set()  # document, item, place of its first word

        def verify(d: int, i: int, begin: int, bits: int) -> None:
            n, base = len(self.words[i]), int(begins[d])
            low, high = max(base, begin - n // 4), min(base + int(lengths[d]), begin + n + n // 4)
            if high - low < 2:
                return
            value = self.similarity(i, grams[low : high - 1])
            if value >= threshold and (value, -bits) > best.get((d, i), (0.0, -BITS - 2))[:2]:
                best[d, i] = (value, -bits, max(0, begin - base), min(int(lengths[d]), begin + n - base))

        for size, (blocks, items, places) in self.index.items():
            query, target = blocks.search(marks[size])
            start = query * stride(size)
            document = np.searchsorted(begins, start, "right") - 1
            apart = np.bitwise_count(marks[size][query] ^ blocks.prints[target]).tolist()
            for d, s, bits, i, p in sorted(set(zip(document.tolist(), start.tolist(), apart, items[target].tolist(), places[target].tolist(), strict=True))):
                tried.add((d, i, s - p))
                verify(d, i, s - p, bits)
        for size, (known, runs, items, places) in self.runs.items():
            if len(hashes) < size:
                continue
            own = tx.grams(hashes, size)
            hit = np.flatnonzero(known[own & np.uint64(len(known) - 1)])
            low, high = np.searchsorted(runs, own[hit], "left"), np.searchsorted(runs, own[hit], "right")
            many = high - low
            start = np.repeat(hit, many)
            target = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
            document = np.searchsorted(begins, start, "right") - 1
            inside = start + size <= begins[document + 1]
            found = set(zip(document[inside].tolist(), items[target][inside].tolist(), (start - places[target])[inside].tolist(), strict=True))
            for d, i, begin in sorted(found - tried):
                verify(d, i, begin, BITS + 1)  # after any that a fingerprint led to
        return [(d, i, value, a, b) for (d, i), (value, _, a, b) in sorted(best.items())]


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(part, gram, items)`` of an item's distinct bigrams; ``items`` is 1 with the first of each item."""
    for batch in batches:
        parts, grams, items = [], [], []
        texts, numbers = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for at in tx.chunks(texts):
            hashes, begins = tx.words(texts[at])
            for part, a, b in zip(numbers[at], begins[:-1], begins[1:], strict=True):
                if b - a > 1:
                    own = np.unique(tx.grams(hashes[a:b], 2))
                    parts.append(np.full(len(own), part, np.int32))
                    grams.append(own.view(np.int64))
                    items.append(np.arange(len(own)) == 0)
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(np.concatenate(grams)), pa.array(np.concatenate(items).astype(np.int32))], ["part", "gram", "items"])


def _parts(benchmark: DataFrame, items_at_once: int) -> Iterator[tuple[list[Row], tuple[int, dict[int, int]] | None]]:
    """Rows of each part, and what ``Benchmark`` needs to know of the others."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    count, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    parts = max(-(-count // items_at_once), -(-chars // CHARS_AT_ONCE))
    if parts <= 1:
        yield items.collect(), None
        return
    placed = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * parts)).cast("int"))
    grams = cut(placed.mapInArrow(tx.lean(_bigrams), "part int, gram bigint, items int"))
    total = grams.agg(F.sum("items")).first()[0] or 0
    shared = cut(grams.groupBy("gram").agg(F.count("*").alias("seen")).where("seen > 1"))
    for part in range(2 * parts):
        own = grams.where(F.col("part") == part).select("gram").distinct().join(shared, "gram").collect()
        yield placed.where(F.col("part") == part).drop("part").collect(), (total, {r["gram"] & (1 << 64) - 1: r["seen"] for r in own})


def _ready(shared: Broadcast, threshold: float) -> Benchmark:
    """The index of a part, built once by a worker; it goes when the part's broadcast does."""
    if shared not in _built:
        _built[shared] = Benchmark(*shared.value, threshold)
    return _built[shared]


def _findings(bench: Benchmark, column: pa.Array, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """``find`` over a batch's texts, of which few are strings at a time."""
    for at in range(0, len(column), _ROWS):
        texts = column.slice(at, _ROWS).to_pylist()
        for part in tx.chunks(texts, 1 << 17):
            for d, *rest in bench.find(*tx.words(texts[part]), threshold):
                yield at + part.start + d, *rest


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """``(doc_id, item_id, similarity, first_word, end_word)`` for each item that a document holds."""
    schema = T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"]]).add("similarity", T.DoubleType()).add("first_word", T.IntegerType()).add("end_word", T.IntegerType())
    source, out, item_type = docs.select("doc_id", F.col("text").cast("string")), None, to_arrow_type(benchmark.schema["item_id"].dataType)
    for rows, rarity in _parts(benchmark, items_at_once):
        shared = docs.sparkSession.sparkContext.broadcast(([tuple(r) for r in rows], rarity))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = _ready(shared, threshold)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = [(ids[d], bench.ids[i], value, a, b) for d, i, value, a, b in _findings(bench, batch.column(1), threshold)]
                columns = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], item_type), pa.array(columns[2], pa.float64()), *(pa.array(c, pa.int32()) for c in columns[3:])], schema.names)

        part = source.mapInArrow(tx.lean(run), schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """``docs`` without the rows that hold an item; columns are kept."""
    place, searched = docs.columns.index("text"), None
    for rows, rarity in _parts(benchmark, items_at_once):
        docs = docs if searched is None else cut(searched)  # one index at a time in a worker
        shared = docs.sparkSession.sparkContext.broadcast(([tuple(r) for r in rows], rarity))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = _ready(shared, threshold)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, *_ in _findings(bench, batch.column(place), threshold)]] = False
                yield batch.filter(pa.array(keep))

        searched = docs.mapInArrow(tx.lean(run), docs.schema)
    return docs if searched is None else searched
