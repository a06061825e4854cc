"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins, and the model is a lookup table for each feature, and
for each of a few pairs of features, that are learnt by boosting shallow trees in turns:
each round takes one feature after the other and adds a small step of a tree of at most
``LEAVES`` leaves fitted to the present gradient. A score is the sum of the tables' entries.

A labelled document is good if its quality is 1 and it isn't toxic. Which words are toxic is learnt too: a hashed
word weighs the logarithm of how much commoner it is in documents labelled toxic than in the others, and a text's
greatest weight and mean weight are two more features. For the documents it is trained on, the weights
come from the other half of them.

It is trained on at most ``SAMPLE`` labelled documents, those with the smallest hash of
the id (of rows that repeat an id one label counts; ids with conflicting labels are left
out). Every document is then scored where it is read: no shuffle, one pass.

Defined results: a null text counts as empty and gets the score of an empty one; a null
id is scored like any. Without labels of both classes every score is the share of
good ones (1.0 without any label), so that nothing is rejected without evidence. Repeated rows get equal
scores; an empty table gives an empty result. ``score`` leaves other columns out; ``accept`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relgraph.llm import textops as tx

SAMPLE, REJECT_BELOW = 20_000, 0.5
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, LEAVES, RATE = 32, 8, 150, 60, 8, 4, 0.15
FEATURES = ["chars", "letters", "digits", "signs", "upper", "word_length", "distinct_words", "repeated_words", "commonest_word", "signs_after_words", "exclamations", "bars", "words_per_line", "repeated_lines"]
WORD_BITS, WORD_DOCS = 18, 5  # places of the word weights, and toxic documents that a word must be in to have one
_upper: list[np.ndarray] = []


def features(texts: list[str | None]) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    if not _upper:
        _upper.append(np.fromiter((chr(i).isupper() for i in range(0x110000)), bool, 0x110000))
    texts = [t or "" for t in texts]
    out = np.zeros((len(texts), len(FEATURES)))
    for part in tx.chunks(texts):
        own = texts[part]
        points = tx.code_points("\n".join(own))
        begins = np.cumsum([0, *(len(t) + 1 for t in own)])
        kind = tx.classes()[points]
        inside = np.zeros(len(points) + 2, np.int8)
        inside[1:-1] = (kind != tx.OTHER) & (kind != tx.SPACE)
        step = np.diff(inside)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        hashes = tx.span_hashes(points, starts, ends)
        first = np.searchsorted(starts, begins)

        def per_text(flags: np.ndarray, at: np.ndarray = begins) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flags)])
            stops = np.minimum(at, len(flags))
            return (sums[stops[1:]] - sums[stops[:-1]]).astype(float)

        chars = np.fromiter(map(len, own), float, len(own))
        safe, words = np.maximum(chars, 1), np.diff(first).astype(float)
        many = np.maximum(words, 1)
        letters = per_text(kind == tx.LETTER)
        following = np.append(kind, tx.SPACE)
        thrice = np.zeros(len(points), bool)
        thrice[: max(0, len(points) - 2)] = (points[:-2] == points[1:-1]) & (points[1:-1] == points[2:]) & (kind[:-2] == tx.OTHER)
        signed = np.append(thrice, False)[ends] & (following[ends] == tx.OTHER)
        same = np.zeros(len(hashes), bool)
        same[1:] = hashes[1:] == hashes[:-1]
        same[first[:-1][first[:-1] < len(hashes)]] = False
        distinct, commonest, lines, again = (np.zeros(len(own)) for _ in range(4))
        for i, text in enumerate(own):
            ordered = np.sort(hashes[first[i] : first[i + 1]])
            if len(ordered):
                heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
                distinct[i], commonest[i] = len(heads), np.diff(np.append(heads, len(ordered))).max()
            rows = [x for x in text.split("\n") if x.strip()]
            lines[i], again[i] = len(rows), len(rows) - len(set(rows))
        columns = [np.log1p(chars), letters / safe, per_text(kind == tx.NUMBER) / safe, per_text(kind == tx.OTHER) / safe, per_text(_upper[0][points]) / np.maximum(letters, 1), per_text(ends - starts, first) / many]
        columns += [distinct / many, per_text(same, first) / many, commonest / many, per_text(signed, first) / many, per_text(points == 33) / many, per_text(points == 124) / many, np.log1p(words / np.maximum(lines, 1)), again / np.maximum(lines, 1)]
        out[part] = np.column_stack(columns)
    return out


def _places(hashes: np.ndarray) -> np.ndarray:
    return np.unique((hashes >> np.uint64(64 - WORD_BITS)).astype(np.int32))


def word_weights(places: list, toxic: np.ndarray) -> np.ndarray:
    """Weight of each hashed word, from the distinct ones of each document."""
    counts = np.zeros((2, 1 << WORD_BITS))
    for own, y in zip(places, toxic.tolist(), strict=True):
        counts[int(y), own] += 1
    many = max(1, int(toxic.sum()))
    weights = np.log((counts[1] + 0.5) / many) - np.log((counts[0] + 0.5) / max(1, len(toxic) - many))
    return np.where(counts[1] >= WORD_DOCS, np.maximum(0, weights), 0).astype(np.float32)


def _toxicity(places: list, weights: np.ndarray) -> np.ndarray:
    """Greatest and mean weight of each document's distinct words."""
    return np.array([(weights[own].max(), weights[own].mean()) if len(own) else (0, 0) for own in places], float).reshape(-1, 2)


def _text_places(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for part in tx.chunks(texts):
        hashes, begins = tx.words(texts[part])
        out += [_places(hashes[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)]
    return out


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Values by bin of a tree grown best split first over ordered bins."""
    parts = [(0, len(gradient))]
    g, w = np.append(0, np.cumsum(gradient)), np.append(0, np.cumsum(weight))

    def best(low: int, high: int) -> tuple[float, int]:
        if high - low < 2:
            return 0.0, low
        at = np.arange(low + 1, high)
        total = (g[high] - g[low]) ** 2 / (w[high] - w[low] + 1)
        gain = (g[at] - g[low]) ** 2 / (w[at] - w[low] + 1) + (g[high] - g[at]) ** 2 / (w[high] - w[at] + 1) - total
        return float(gain.max()), int(at[gain.argmax()])

    while len(parts) < leaves:
        (gain, at), (low, high) = max((best(*p), p) for p in parts)
        if gain <= 1e-9:
            break
        parts.remove((low, high))
        parts += [(low, at), (at, high)]
    values = np.zeros(len(gradient))
    for low, high in parts:
        values[low:high] = (g[high] - g[low]) / (w[high] - w[low] + 1)
    return values


class Additive:
    """The fitted model: cuts of the features, a table for each, and for each chosen pair."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        y = np.asarray(y, float)
        share = float(y.mean()) if len(y) else 1.0
        self.constant = share if share in (0.0, 1.0) else None
        self.cuts, self.coarse, self.tables, self.pairs = [], [], [], []
        if self.constant is not None:
            self.constant = 1.0 if not len(y) else share
            return
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.coarse = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for c in x.T]
        bins, wide = self._bins(x, self.cuts), self._bins(x, self.coarse)
        self.intercept = np.log(share / (1 - share))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        f = np.full(len(y), self.intercept)
        for _ in range(ROUNDS):
            for k, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-f))
                step = RATE * _tree(np.bincount(bins[k], y - p, len(table)), np.bincount(bins[k], p * (1 - p), len(table)), LEAVES)
                table += step
                f += step[bins[k]]
        p = 1 / (1 + np.exp(-f))
        cells = lambda a, b: wide[a] * (len(self.coarse[b]) + 1) + wide[b]
        shape = lambda a, b: (len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)

        def worth(a: int, b: int) -> float:
            n = int(np.prod(shape(a, b)))
            g, w = np.bincount(cells(a, b), y - p, n), np.bincount(cells(a, b), p * (1 - p), n)
            return float((g**2 / (w + 1)).sum())

        chosen = sorted(combinations(range(x.shape[1]), 2), key=lambda ab: (-worth(*ab), ab))[:PAIRS]
        self.pairs = [(a, b, np.zeros(shape(a, b))) for a, b in chosen]
        for _ in range(PAIR_ROUNDS):
            for a, b, table in self.pairs:
                p = 1 / (1 + np.exp(-f))
                at = cells(a, b)
                g, w = (np.bincount(at, v, table.size).reshape(table.shape) for v in (y - p, p * (1 - p)))
                rows = _tree(g.sum(1), w.sum(1), 2)  # cut one feature, then the other within each part
                edge = np.flatnonzero(np.diff(rows))
                step = np.zeros_like(table)
                for low, high in zip([0, *(edge + 1)], [*(edge + 1), len(rows)], strict=True):
                    step[low:high] = _tree(g[low:high].sum(0), w[low:high].sum(0), 2)
                table += RATE * step
                f += RATE * step.ravel()[at]

    @staticmethod
    def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)]

    weights: np.ndarray | None = None

    def of(self, texts: list[str | None]) -> np.ndarray:
        """Probability of good quality for each text."""
        x = features(texts)
        return self.score(x if self.weights is None else np.column_stack([x, _toxicity(_text_places(texts), self.weights)]))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        f = np.full(len(x), self.intercept)
        for table, bins in zip(self.tables, self._bins(x, self.cuts), strict=True):
            f += table[bins]
        wide = self._bins(x, self.coarse)
        for a, b, table in self.pairs:
            f += table[wide[a], wide[b]]
        return 1 / (1 + np.exp(-f))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    toxic = F.coalesce(F.col("toxic"), F.lit(0)).cast("int")
    state = F.col("quality").cast("int") * 2 + toxic  # 2 is good
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min(state).alias("low"), F.max(state).alias("high")).where("low = high")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("known_id"), F.col("low").alias("state"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("known_id")).select("doc_id", "text", "state")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(features(texts)), pa.list_(pa.float64())), pa.array([p.tobytes() for p in _text_places(texts)], pa.binary())], ["doc_id", "state", "x", "words"])

    schema = T.StructType([docs.schema["doc_id"]]).add("state", T.IntegerType()).add("x", T.ArrayType(T.DoubleType())).add("words", T.BinaryType())
    found = sorted((r["doc_id"], r["state"], tuple(r["x"]), bytes(r["words"])) for r in rows.mapInArrow(tx.lean(run), schema).collect())
    x, states = np.array([r[2] for r in found]).reshape(-1, len(FEATURES)), np.array([r[1] for r in found], int)
    places, is_toxic = [np.frombuffer(r[3], np.int32) for r in found], states % 2 == 1
    if not is_toxic.any():
        return Additive(x, states == 2)
    own = np.zeros((len(found), 2))
    for half in (0, 1):
        other = np.arange(len(found)) % 2 != half
        own[~other] = _toxicity(places[half::2], word_weights(places[1 - half :: 2], is_toxic[other]))
    model = Additive(np.column_stack([x, own]), states == 2)
    model.weights = word_weights(places, is_toxic)
    return model


def score(docs: DataFrame, model: Additive, reject_below: float = REJECT_BELOW) -> DataFrame:
    """``(doc_id, score, accepted)`` for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.of(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= reject_below)], ["doc_id", "score", "accepted"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(tx.lean(run), T.StructType([docs.schema["doc_id"]]).add("score", T.DoubleType()).add("accepted", T.BooleanType()))


def accept(docs: DataFrame, model: Additive, reject_below: float = REJECT_BELOW) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject; columns are kept."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.of(batch.column(place).to_pylist()) >= reject_below))

    return docs.mapInArrow(tx.lean(run), docs.schema)
