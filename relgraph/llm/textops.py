"""Vectorised text primitives: words and their hashes by numpy, many documents at once."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE, MARK = range(5)
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BASE = 0x9E3779B97F4A7C55
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def classes() -> np.ndarray:
    """Class of each code point, by Unicode category; built once a process."""
    if "classes" not in _tables:
        kinds = {"L": LETTER, "N": NUMBER, "M": MARK}
        table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        table[_WHITE] = SPACE
        _tables["classes"] = table
    return _tables["classes"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("powers", ())) < n:
        size = max(n, 1 << 18)
        for name, base in (("powers", _BASE), ("inverses", _BASE_INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _tables[name] = np.multiply.accumulate(row)
    return _tables["powers"], _tables["inverses"]


def release() -> None:
    """Gives free memory back to the system: workers live on between tasks of different operators."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, with ``release`` when its task ends."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def lean_group(run: Callable) -> Callable:
    """``run`` of two arguments over a group, with ``release`` when it has returned."""

    def whole(one: object, two: object) -> pa.Table:
        try:
            return run(one, two)
        finally:
            release()

    return whole


def mix(h: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def running_sums(points: np.ndarray) -> np.ndarray:
    powers, _ = _powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    letters = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    letters ^= letters >> np.uint64(29)
    np.cumsum(letters * powers[: len(points)], out=sums[1:])
    return sums


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each span of ``points``, by one rolling sum over all of them (``sums``, where there is one already)."""
    sums = running_sums(points) if sums is None else sums
    _, inverses = _powers(len(points) + 1)
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def chunks(texts: list, limit: int = 1 << 19) -> Iterator[slice]:
    """Slices of ``texts`` of about ``limit`` characters; a longer text is a slice by itself."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > begin and size + n > limit:
            yield slice(begin, i)
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield slice(begin, len(texts))


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all ``texts`` in order, and where each
    text's begin. A word is a run of letters, marks and numbers; null counts as empty."""
    lowered = [(t or "").lower() for t in texts]
    points = code_points("\n".join(lowered))
    kind = classes()[points]
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = (kind != OTHER) & (kind != SPACE)
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    begins = np.cumsum([0, *(len(t) + 1 for t in lowered)])
    return span_hashes(points, starts, ends), np.searchsorted(starts, begins)


class StaticMap:
    """Look-ups of 64-bit keys by arrays: a hash table whose collisions go to a smaller one, and so on."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 3)
        while len(keys):
            slots = self._slots(keys, bits)
            _, first = np.unique(slots, return_index=True)
            table, held, used = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64), np.zeros(1 << bits, bool)
            table[slots[first]], held[slots[first]], used[slots[first]] = keys[first], values[first], True
            self.levels.append((bits, table, held, used))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, bits = keys[rest], values[rest], max(4, bits - 3) if len(self.levels) < 8 else bits + 2

    @staticmethod
    def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * bits)) >> np.uint64(64 - bits)).astype(np.int64)

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        out = np.full(len(keys), default, np.int64)
        if not self.levels:
            return out
        bits, table, held, used = self.levels[0]
        slots = self._slots(keys, bits)
        some = np.flatnonzero(used[slots])  # a key of a later level collided with one of the first
        keys, slots = keys[some], slots[some]
        for i, (bits, table, held, used) in enumerate(self.levels):
            if i:
                slots = self._slots(keys, bits)
            hit = (table[slots] == keys) & used[slots]
            out[some[hit]] = held[slots[hit]]
            some, keys = some[~hit], keys[~hit]
        return out


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words of one text; of all of them where there are fewer."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = hashes[: len(hashes) - n + 1].copy()
    for i in range(1, n):
        out = mix(out * np.uint64(0xFF51AFD7ED558CCD) + hashes[i : len(hashes) - n + 1 + i])
    return out if n > 1 else mix(out)
