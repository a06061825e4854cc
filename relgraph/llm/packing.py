"""Packing of documents into windows of a fixed number of tokens, by best-fit decreasing.

Documents longer than a window are first cut into full windows and a rest. Pieces are
then taken from the longest to the shortest, and each goes into the window with the
least room that still holds it; a segment tree indexed by remaining capacity finds it.

Pieces of one length are interchangeable, so the exact packing of the whole corpus
needs only how many pieces there are of each length: at most ``capacity`` numbers,
however large the corpus. The driver packs these numbers (runs of equal pieces into
runs of equally full windows); executors rank their pieces within each length and
read their place from the runs. Ranks come from counts by (length, hash bucket), so no
task sorts all pieces of one length.

Defined results: a document without tokens (null or empty text) needs no place and is
not in the result. Ties: pieces of one length are taken by hash bucket, id and piece
number; windows with equal room by number. Repeated rows are packed as often as they
come. An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relgraph.llm.shared import cut
from relgraph.llm.token_counts import RANKS_FILE, token_lengths

CAPACITY, BUCKETS = 2048, 64
RUN_TYPES = {"length": pa.int32(), "low": pa.int64(), "high": pa.int64(), "per_window": pa.int32(), "first_window": pa.int64(), "first_offset": pa.int32()}


class RoomTree:
    """Segment tree over remaining capacities 0..capacity: the least that is at least some length and has open windows."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, room: int, value: bool) -> None:
        at = room + self.size
        self.any[at] = value
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        at = length + self.size
        while not self.any[at]:
            while at & 1:  # a right child: up
                at //= 2
                if at <= 1:
                    return None
            if at == 0:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.size


def plan(counts: Iterable[tuple[int, int]], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, low, high, per_window, first_window, first_offset)`` that place pieces ``low..high-1``
    of a length, ``per_window`` to each window from ``first_window`` on, the first at ``first_offset``."""
    tree, open_ = RoomTree(capacity), [[] for _ in range(capacity + 1)]
    runs, windows = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            heapq.heappush(open_[room], (first, n))
            tree.set(room, True)

    for length, n in sorted(counts, reverse=True):
        low = 0
        while low < n:
            room = tree.tightest(length)
            if room is None:
                room, first, many = capacity, windows, -(-(n - low) // (capacity // length))
                windows += many
            else:
                first, many = heapq.heappop(open_[room])
                if not open_[room]:
                    tree.set(room, False)
            per = room // length
            full = min(many, (n - low) // per)
            if full:
                runs.append((length, low, low + full * per, per, first, capacity - room))
                low += full * per
                put(room - per * length, first, full)
            rest = n - low
            if full < many:
                if rest:  # fewer than ``per``: the last window takes them all
                    runs.append((length, low, n, per, first + full, capacity - room))
                    put(room - rest * length, first + full, 1)
                    low, full = n, full + 1
                put(room, first + full, many - full)
    return runs


def _table(spark: SparkSession, runs: list[tuple]) -> DataFrame:
    """``runs`` by Arrow: a list of rows would start Python workers of another kind beside those of the operators, which stay."""
    columns = [list(c) for c in zip(*runs, strict=True)] or [[] for _ in RUN_TYPES]
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, RUN_TYPES.values(), strict=True)], names=[*RUN_TYPES]))


def pack(lengths: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", length_col: str = "n_tokens") -> DataFrame:
    """``(doc_id, piece, piece_start, piece_tokens, window_id, window_offset)``; ``lengths`` is read twice."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = lengths.sparkSession
    d = lengths.select(F.col(id_col).alias("doc_id"), F.col(length_col).cast("int").alias("n")).where("n > 0")
    pieces = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {capacity}").cast("int"))).alias("piece"))
    pieces = pieces.withColumn("length", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity)).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
    cells = cut(pieces.groupBy("length", "bucket").count())  # at most capacity * BUCKETS rows
    runs = plan([(r["length"], r["n"]) for r in cells.groupBy("length").agg(F.sum("count").alias("n")).collect()], capacity)
    before = cells.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(F.broadcast(before), ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(_table(spark, runs)), "length").where("rank >= low AND rank < high")
    nth = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id",
        "piece",
        (F.col("piece") * capacity).alias("piece_start"),
        F.col("length").alias("piece_tokens"),
        (F.col("first_window") + F.expr("(rank - low) div per_window")).alias("window_id"),
        (F.col("first_offset") + (nth % F.col("per_window")) * F.col("length")).cast("int").alias("window_offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, ranks_file: str = RANKS_FILE) -> DataFrame:
    """``pack`` of ``docs(doc_id, text)`` by their exact token counts, which are counted once."""
    return pack(cut(token_lengths(docs.select("doc_id", "text"), ranks_file=ranks_file)), capacity)
