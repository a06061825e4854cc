"""Exact token counts at every prefix of every document.

Byte-pair encoding is solved by a dynamic programme over prefixes: of all tokens
that end a prefix, exactly one is compatible with the last token of what is
before it, and the prefix has one token more than that. One pass over a text
thus gives the count of each of its prefixes, and questions of truncation and
budget become array look-ups (``tokens_at``, ``chars_within``), without encoding again.

Texts are cut into pretokens with numpy, many documents at once; the programme
runs once for each distinct pretoken of a worker, and counts are gathered from
its table. Where only whole texts count, they are cut at blanks, and pretokens not met before are merged, many at once. Prefixes are measured in characters (code points). A prefix's count is
that of encoding the prefix by itself, so it can fall when a character is added.

Defined results: a null text gives null counts; an empty text one prefix (of
length 0) with 0 tokens. Very long texts are handled by themselves. Repeated rows
give repeated results, an empty table an empty one. Other columns are left out.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, compress, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relgraph.llm import textops as tx

RANKS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BUDGET = 2048
_CACHE_WORDS, _CACHE_COUNTS, _CACHE_WHOLE, _CACHE_CHARS = 200_000, 4_000_000, 300_000, 4_000_000
_SHORT, _FEW, _LONG, _MANY = 32, 1 << 16, 1 << 20, 1 << 21
_WIDTHS = 8, 12, 16, _SHORT  # bytes of pretokens that are merged together
_NOTHING, _NEVER, _WRONG = (1 << 20) - 1, 1 << 24, 1 << 32  # no token, no merge, no count


class Encoder:
    """Counts by prefix for the vocabulary in a ranks file (base64 token and rank on each line)."""

    def __init__(self, ranks_file: str = RANKS_FILE):
        with open(ranks_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.longest = max(map(len, self.ranks))
        self._halves()
        self.pairs: dict[int, bool] = {}  # whether a token may follow another
        self.reach: dict[bytes, int] = {}  # the longest token that begins with two bytes
        for token in self.ranks:
            self.reach[token[:2]] = max(len(token), self.reach.get(token[:2], 1))
        self.whole = Whole(self.counts)
        self.lefts, self.rights = np.array(self.left), np.array(self.right)
        self.joined = tx.StaticMap(np.fromiter(self.joins, np.int64, len(self.joins)), np.fromiter(self.joins.values(), np.int64, len(self.joins)))
        bytes_ = [bytes([i]) for i in range(256)]
        self.of_byte = np.array([self.ranks[b] for b in bytes_], np.int32)
        self.of_two = self.joined.get((self.of_byte[:, None].astype(np.int64) << 20 | self.of_byte).ravel(), _NEVER).astype(np.int32)
        short = [t for t in self.ranks if len(t) <= _SHORT]
        sizes = np.fromiter(map(len, short), np.int64, len(short))
        stops = np.cumsum(sizes)
        hashes = tx.span_hashes(np.frombuffer(b"".join(short), np.uint8).astype(np.uint32), stops - sizes, stops)
        self.by_hash = tx.StaticMap(hashes.view(np.int64), np.array([self.ranks[t] for t in short]))
        self.forget()

    def forget(self) -> None:
        self.where: dict[str, int] = {}
        self.table = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _halves(self) -> None:
        """The two tokens that each token's last merge joins; single bytes are their own halves."""
        self.left, self.right = list(range(len(self.ranks))), list(range(len(self.ranks)))
        self.joins: dict[int, int] = {}
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i], rank), self.ranks.get(token[i:], rank)
                if a < rank and b < rank and self._compatible(a, b):
                    self.left[rank], self.right[rank] = a, b
                    self.joins[a << 20 | b] = rank
                    break

    def _compatible(self, a: int, b: int) -> bool:
        """Follows the merges back along the joint: no earlier merge may cross it."""
        limit = 1 << 40
        joins, left, right = self.joins, self.left, self.right
        while True:
            if joins.get(a << 20 | b, 1 << 40) < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def _compatible_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_compatible`` for arrays of tokens."""
        out = np.zeros(len(a), bool)
        at = np.arange(len(a))
        limit = np.full(len(a), 1 << 40)
        while len(at):
            going = self.joined.get(a << 20 | b, 1 << 40) >= limit
            at, a, b, limit = at[going], a[going], b[going], limit[going]
            first = a > b  # undo the left token's last merge, else the right one's; where it has none, the other's
            limit = np.where(first, a, b + 1)
            a, b = np.where(first, self.rights[a], a), np.where(first, b, self.lefts[b])
            stuck = np.where(first, a == limit, b + 1 == limit)
            limit = np.where(stuck, np.where(first, b + 1, a), limit)
            a, b = np.where(stuck & ~first, self.rights[a], a), np.where(stuck & first, self.lefts[b], b)
            done = stuck & np.where(first, b + 1 == limit, a == limit)
            out[at[done]] = True
            at, a, b, limit = at[~done], a[~done], b[~done], limit[~done]
        return out

    def byte_counts(self, piece: bytes) -> list[int]:
        """Tokens of each prefix of one pretoken, in bytes."""
        ranks, last, count = self.ranks, [-1] * (len(piece) + 1), [0] * (len(piece) + 1)
        for end in range(1, len(piece) + 1):
            for begin in range(max(0, end - self.longest), end):
                token = ranks.get(piece[begin:end])
                if token is not None and (begin == 0 or self._compatible(last[begin], token)):
                    last[end], count[end] = token, count[begin] + 1
                    break
        return count

    def _learn(self, words: list[str]) -> None:
        """Puts the counts of new pretokens into the table: their prefixes of 1 character, 2, ..."""
        coded = [w.encode("utf-8", "replace") for w in words]
        short = [i for i, c in enumerate(coded) if len(c) <= _SHORT]
        if short:
            pieces = [coded[i] for i in short]
            joined = np.frombuffer(b"".join(pieces), np.uint8)
            closes = np.append((joined[1:] & 0xC0) != 0x80, True)  # the last byte of a character
            sizes = np.fromiter((len(words[i]) for i in short), np.int64, len(short))
            places = self._append(self._short_counts(pieces)[closes]) + np.cumsum(sizes) - sizes
            self.where.update(zip((words[i] for i in short), places.tolist(), strict=True))
        for word, piece in zip(words, coded, strict=True):
            if len(piece) > _SHORT:
                counts = np.array(self.byte_counts(piece)[1:], np.int32)
                self.where[word] = self._append(counts[np.append((np.frombuffer(piece, np.uint8)[1:] & 0xC0) != 0x80, True)])

    def _append(self, counts: np.ndarray) -> int:
        at = self.used
        while at + len(counts) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at : at + len(counts)] = counts
        self.used += len(counts)
        return at

    def _short_counts(self, pieces: list[bytes]) -> np.ndarray:
        """``byte_counts`` of many pieces, one after the other, without the leading 0s."""
        joined = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint32)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begins = np.cumsum(sizes) - sizes
        own = np.repeat(begins, sizes)  # where the piece of each byte begins
        at = np.arange(len(joined))
        sums = tx.running_sums(joined)
        ends, froms, tokens = [], [], []
        for size in range(1, min(_SHORT, self.longest) + 1):
            at = at[at - own[at] + 1 >= size]  # last bytes of the candidates
            if not len(at):
                break
            token = self.by_hash.get(tx.span_hashes(joined, at - size + 1, at + 1, sums).view(np.int64), -1)
            found = token >= 0
            ends.append(at[found])
            froms.append(at[found] - size)
            tokens.append(token[found])
        end, before, token = map(np.concatenate, (ends, froms, tokens))
        place = end - own[end]
        order = np.argsort(place, kind="stable")
        end, before, token = end[order], before[order], token[order]
        edges = np.searchsorted(place[order], np.arange(_SHORT + 1))
        last, count = np.zeros(len(joined), np.int64), np.zeros(len(joined), np.int32)
        for j in range(_SHORT):
            e, f, t = (x[edges[j] : edges[j + 1]] for x in (end, before, token))
            if not len(e):
                break
            whole = f < own[e]
            fits = whole.copy()
            fits[~whole] = self._compatible_all(last[f[~whole]], t[~whole])
            last[e[fits]] = t[fits]
            count[e[fits]] = np.where(whole[fits], 0, count[np.maximum(f[fits], 0)]) + 1
        return count

    def _look_up(self, words: list[str]) -> np.ndarray:
        missing = [w for w in dict.fromkeys(words) if w not in self.where]
        if missing:
            self._learn(missing)
        return np.fromiter(map(self.where.__getitem__, words), np.int64, len(words))

    def _places(self, joined: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Table positions of the spans; spans are grouped by hash, then compared with their group's first."""
        hashes = tx.span_hashes(points, starts, ends)
        _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
        lengths = ends - starts
        offsets = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        model = first[group]
        same = (lengths[model] == lengths).all() and (points[np.repeat(starts[model], lengths) + offsets] == points[np.repeat(starts, lengths) + offsets]).all()
        if not same:  # two pretokens share a hash: look each up by itself
            return self._look_up([joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        return self._look_up([joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])[group]

    def prefix_counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts after each character of all texts, joined by a line end, and where each text begins."""
        if len(self.where) > _CACHE_WORDS or self.used > _CACHE_COUNTS:
            self.forget()
        joined = "\n".join(texts)
        points = tx.code_points(joined)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        n = len(points)
        if not n:
            return np.zeros(1, np.int32), begins
        starts, contracted = pretokens(points, begins)
        ends = np.append(starts[1:], n)
        breaks = begins[1:-1] - 1  # the joints: pretokens of their own, and of no tokens
        at = self._places(joined, points, starts, ends)
        lengths = ends - starts
        total = self.table[at + lengths - 1].astype(np.int64)
        total[np.searchsorted(starts, breaks)] = 0
        before = np.cumsum(total) - total
        document = np.searchsorted(begins, starts, "right") - 1
        first = np.minimum(np.searchsorted(starts, begins[:-1]), len(starts) - 1)
        before -= before[first][document]
        counts = np.repeat(before, lengths) + self.table[np.arange(n) + np.repeat(at - starts, lengths)]
        # A prefix that ends in white space has all of that run as one pretoken.
        space = np.zeros(n + 2, np.int8)
        space[1:-1] = tx.classes()[points] == tx.SPACE
        space[breaks + 1] = 0
        edge = np.diff(space)
        run, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(run):
            size = stop - run
            inside = np.arange(size.sum()) + np.repeat(run - (np.cumsum(size) - size), size)
            base = before[np.searchsorted(starts, run)]
            spot = self._places(joined, points, run, stop)  # may make the table anew
            counts[inside] = np.repeat(base, size) + self.table[inside + np.repeat(spot - run, size)]
        counts[contracted + 1] = before[np.searchsorted(starts, contracted)] + 2  # "'l" of "'ll": the letter is a pretoken yet
        return counts.astype(np.int32), begins

    def totals(self, texts: list[str | None]) -> list[int | None]:
        """Tokens of each whole text; null for null. Counts of what stands between blanks are added up, without those of prefixes."""
        out: list[int | None] = []
        for part in tx.chunks(texts, _MANY):
            own = texts[part]
            if len(own[0] or "") > _MANY:
                out.append(sum(map(self.whole.total, stretches(own[0]))))
            else:
                out += [None if t is None else n for t, n in zip(own, self.whole.totals([t or "" for t in own]).tolist(), strict=True)]
        return out

    def counts(self, words: list[str]) -> np.ndarray:
        """``count`` of many pretokens."""
        pieces = [w.encode("utf-8", "replace") for w in words]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        more = ~np.fromiter(map(self.ranks.__contains__, pieces), bool, len(pieces))
        out = np.ones(len(pieces), np.int64)
        for i in np.flatnonzero(more & (sizes > _SHORT)).tolist():
            out[i] = self.count(pieces[i])
        joined = np.frombuffer(b"".join([*pieces, bytes(_SHORT)]), np.uint8)
        begins = np.cumsum(sizes) - sizes
        for low, high in zip((0, *_WIDTHS), _WIDTHS, strict=False):
            some = np.flatnonzero(more & (sizes > low) & (sizes <= high))
            if len(some):
                out[some] = self._merge(joined[begins[some] + np.arange(high)[:, None]], sizes[some])
        return out

    def _merge(self, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of short pieces, a column of bytes for each, all merged at once: in each round every piece
        makes its first merge, the leftmost of those. ``keys`` has merge and place of each pair of tokens."""
        place = np.arange(len(letters), dtype=np.int32)[:, None]
        tokens = np.where(place < sizes, self.of_byte[letters], _NOTHING)
        keys = np.where(place[1:] < sizes, self.of_two[letters[:-1].astype(np.int32) << 8 | letters[1:]], _NEVER) << 5 | place[:-1]
        out, at, left = sizes.copy(), np.arange(len(sizes)), sizes.copy()
        while len(keys):
            best = keys.min(axis=0)
            going = best < _NEVER << 4
            if not going.all():
                out[at[~going]] = left[~going]
                at, left, best, tokens, keys = at[going], left[going], best[going], tokens[:, going], keys[:, going]
            if not len(at):
                return out
            spot, columns = best & 31, np.arange(len(at))
            for j in range(1, len(keys)):
                later = spot < j
                np.copyto(tokens[j], tokens[j + 1], where=later)
                if j + 1 < len(keys):
                    np.copyto(keys[j], keys[j + 1] - 1, where=later)
            tokens, keys, left = tokens[:-1], keys[:-1], left - 1
            tokens[spot, columns] = best >> 5
            for first, some in ((spot, spot < len(keys)), (spot - 1, spot > 0)):
                first, column = first[some], columns[some]
                pair = tokens[first, column].astype(np.int64) << 20 | tokens[first + 1, column]
                keys[first, column] = self.joined.get(pair, _NEVER).astype(np.int32) << 5 | first
        out[at] = left
        return out

    def count(self, piece: bytes) -> int:
        """Tokens of one pretoken: the longest that is compatible with the one before, taken back where nothing can follow."""
        ranks, pairs, reach = self.ranks, self.pairs, self.reach
        if piece in ranks:
            return 1
        n, at, before = len(piece), 0, []
        dead, size = set(), min(n - 1, reach.get(piece[:2], 1))
        while at < n:
            while size:
                token = ranks.get(piece[at : at + size])
                if token is not None and at + size not in dead:
                    if not before:
                        break
                    key = before[-1][0] << 20 | token
                    if (fits := pairs.get(key)) is None:
                        fits = pairs[key] = self._compatible(before[-1][0], token)
                    if fits:
                        break
                size -= 1
            if size:
                before.append((token, size))
                at += size
                size = min(n - at, reach.get(piece[at : at + 2], 1))
            else:
                dead.add(at)
                size = before.pop()[1]
                at -= size
        if len(pairs) > _CACHE_WORDS:
            pairs.clear()
        return len(before)


class Whole(defaultdict):
    """Counts of what stands between blanks, with the blank before it; when there are many, those met only once go.

    The last blank before anything but white space begins a pretoken in any text, so the parts of a text that is cut
    there have the pretokens of the whole. Each part has a number here, by which its count and its uses are found."""

    def __init__(self, count_all: Callable[[list[str]], np.ndarray]):
        super().__init__()
        self.count_all = count_all
        self.forget()

    def forget(self) -> None:
        self._keep([], np.zeros(0, np.int64))

    def _keep(self, parts: list[str], counts: np.ndarray) -> None:
        """Only these; the next new part gets the number after theirs."""
        self.clear()
        self.update(zip(parts, range(len(parts)), strict=True))
        self.default_factory = count(len(parts)).__next__
        self.counts, self.uses, self.held = counts, np.zeros(len(parts), np.int64), sum(map(len, parts))

    def totals(self, texts: list[str]) -> np.ndarray:
        out = self._cut_totals(texts, lambda text: _blank().split(text) if "  " in text else text.split(" "))
        again = np.flatnonzero(out >= _WRONG)
        if len(again):
            out[again] = self._cut_totals([texts[i] for i in again.tolist()], _blank().split)
        return out

    def total(self, text: str) -> int:
        return int((self.totals([text]) if len(text) <= 2 * _MANY else self._plain([text]))[0])

    def _cut_totals(self, texts: list[str], cut: Callable[[str], list[str]]) -> np.ndarray:
        """Tokens of texts by their parts, of which the first has no blank before it; few texts are in parts at once."""
        if len(self) > _CACHE_WHOLE or self.held > _CACHE_CHARS:
            self._prune()
        heads, sizes, numbers = [], [], []
        for some in tx.chunks(texts, _FEW):
            cuts = [cut(text) for text in texts[some]]
            heads += [parts.pop(0) for parts in cuts]
            own = [len(parts) for parts in cuts]
            sizes += own
            numbers.append(np.fromiter(map(self.__getitem__, chain.from_iterable(cuts)), np.int64, sum(own)))
        if n := len(self) - len(self.counts):
            new = list(islice(reversed(self), n))[::-1]
            self.counts = np.concatenate([self.counts, self._after_blank(new)])
            self.uses = np.concatenate([self.uses, np.zeros(n, np.int64)])
            self.held += sum(map(len, new))
        every = np.concatenate([np.zeros(0, np.int64), *numbers])
        self.uses += np.bincount(every, minlength=len(self.uses))
        return self._plain(heads) + _sums(self.counts[every], np.array(sizes, np.int64))

    def _prune(self) -> None:
        some = self.uses > 1
        parts = list(compress(self, some))
        if len(parts) <= _CACHE_WHOLE // 2 and sum(map(len, parts)) <= _CACHE_CHARS // 2:
            self._keep(parts, self.counts[some])
        else:
            self.forget()

    def _after_blank(self, parts: list[str]) -> np.ndarray:
        """Tokens of each part and the blank before it; ``_WRONG`` where white space follows that, or nothing."""
        out, white = np.full(len(parts), _WRONG), _white()
        letters = np.fromiter(map(str.isalpha, parts), bool, len(parts))  # one pretoken
        other = [i for i in np.flatnonzero(~letters).tolist() if parts[i][:1] not in white]
        words = [" " + part for part in compress(parts, letters)]
        ones, own = np.ones(len(words), np.int64), [" " + parts[i] for i in other]
        more = list(chain.from_iterable(split("".join(own))))
        ends = np.searchsorted(np.cumsum(np.fromiter(map(len, more), np.int64, len(more))), np.cumsum(np.fromiter(map(len, own), np.int64, len(own))))
        sums = self._added(words + more, np.concatenate([ones, np.diff(ends + 1, prepend=0)]))
        out[letters], out[other] = sums[: len(words)], sums[len(words) :]
        return out

    def _plain(self, texts: list[str]) -> np.ndarray:
        """Tokens of texts that aren't cut at blanks."""
        out, sizes, words = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), []
        for i, text in enumerate(texts):
            found = split(text)
            first = next(found, [])
            words += first
            sizes[i] = len(first)
            for more in found:
                out[i] += self.count_all(more).sum()
        return out + self._added(words, sizes)

    def _added(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        """Tokens of runs of ``sizes`` pretokens."""
        every = list(dict.fromkeys(words))
        counts = dict(zip(every, self.count_all(every).tolist(), strict=True))
        return _sums(np.fromiter(map(counts.__getitem__, words), np.int64, len(words)), sizes)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each run of ``sizes`` values."""
    sums, ends = np.concatenate([[0], np.cumsum(values)]), np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


@lru_cache(maxsize=1)
def _white() -> frozenset[str]:
    """White space, and nothing at all."""
    return frozenset(["", *map(chr, np.flatnonzero(tx.classes() == tx.SPACE))])


@lru_cache(maxsize=1)
def _blank() -> re.Pattern:
    """A blank before anything but white space."""
    return re.compile(f" (?=[^{''.join(_white())}])")


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """Pretokens of any text, and of one in ASCII: as ``pretokens`` cuts them."""
    kind, ranges = tx.classes(), {}
    for k in (tx.LETTER, tx.NUMBER, tx.SPACE):
        edge = np.diff(np.concatenate([[0], (kind == k).astype(np.int8), [0]]))
        ranges[k] = "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
    whole = lambda letter, number, space: f"'(?:[sdmt]|ll|ve|re)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    return re.compile(whole(ranges[tx.LETTER], ranges[tx.NUMBER], ranges[tx.SPACE])), re.compile(whole("A-Za-z", "0-9", " \\t\\n\\r\\f\\v"), re.A)


def split(text: str) -> Iterator[list[str]]:
    """Pretokens of a text, in lists; those of a very long one in several."""
    pattern = _patterns()[text.isascii()]
    if len(text) <= _LONG:
        yield pattern.findall(text)
        return
    found = pattern.finditer(text)
    while words := [m[0] for m in islice(found, _LONG // 8)]:
        yield words


def stretches(text: str) -> Iterator[str]:
    """A very long text in pieces that begin with a blank before something, and so with a pretoken."""
    begin = 0
    while begin < len(text):
        found = _blank().search(text, begin + _MANY)
        end = found.start() if found else len(text)
        yield text[begin:end]
        begin = end


def pretokens(points: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pretokens start, and those that are a two-letter contraction (``'ll 've 're``).

    Runs of letters, numbers, other signs or white space, one blank going with what
    follows it; the characters between texts are pretokens of their own."""
    n = len(points)
    kind = tx.classes()[points].copy()
    kind[kind == tx.MARK] = tx.OTHER
    breaks = begins[1:-1] - 1
    kind[breaks] = 9
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start[breaks] = start[breaks + 1] = True
    space = kind == tx.SPACE
    solid = np.append(~space & (kind != 9), False)
    last = np.flatnonzero(space & solid[1:])  # white space just before something else
    start[last] = True
    blank = last[points[last] == 32]
    start[blank + 1] = False
    runs = np.flatnonzero(start[:n])
    quote = runs[(points[runs] == 39) & (np.append(runs[1:], n) - runs == 1)]
    quote = quote[quote + 1 < n]
    letter = points[quote + 1]
    after = np.append(points, 0)[quote + 2]
    plain = np.append(kind, 9)
    two = ((letter == 108) & (after == 108) | (letter == 118) & (after == 101) | (letter == 114) & (after == 101)) & (plain[quote + 2] == tx.LETTER)
    one = np.isin(letter, [ord(c) for c in "sdmt"])
    for quotes, size in ((quote[one], 2), (quote[two], 3)):
        start[quotes + 1] = False
        stop = quotes + size
        start[stop[plain[stop] == tx.LETTER]] = True
    return np.flatnonzero(start[:n]), quote[two]


@lru_cache(maxsize=4)
def encoder(ranks_file: str) -> Encoder:
    return Encoder(ranks_file)


def prefix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_file: str = RANKS_FILE) -> DataFrame:
    """``(doc_id, n_tokens, prefix_tokens)``; ``prefix_tokens[i]`` has the tokens of the first ``i`` characters."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_file)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in tx.chunks(texts, 1 << 19):
                own = texts[part]
                counts, begins = enc.prefix_counts([t or "" for t in own])
                values = np.zeros(len(counts) + 1, np.int32)  # each joint becomes the next text's prefix of length 0
                values[1 : len(counts) + 1] = counts
                values[begins[:-1]] = 0
                sizes = np.fromiter((0 if t is None else len(t) + 1 for t in own), np.int64, len(own))
                null = np.fromiter((t is None for t in own), bool, len(own))
                if null.any():
                    values = np.delete(values, begins[:-1][null])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(null, False))
                lists = pa.ListArray.from_arrays(offsets, pa.array(values[: sizes.sum()]))
                ends = np.cumsum(sizes) - 1
                totals = pa.array(values[np.maximum(ends, 0)], mask=null)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), totals, lists], ["doc_id", "n_tokens", "prefix_tokens"])
        enc.forget()

    return source.mapInArrow(tx.lean(run), f"doc_id {kind}, n_tokens int, prefix_tokens array<int>")


def token_lengths(docs: DataFrame, text_col: str = "text", ranks_file: str = RANKS_FILE) -> DataFrame:
    """``docs`` without its text and with ``n_tokens`` in its place: counts only."""
    kept = [c for c in docs.columns if c != text_col]
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).cast("string"))
    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).schema.add("n_tokens", T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_file)
        for batch in batches:
            arrays, texts = [batch.column(i) for i in range(len(kept))], batch.column(len(kept))
            step = 1 + 2 * _MANY * len(texts) // max(1, texts.nbytes)  # rows that are strings at once
            totals = [n for i in range(0, len(texts), step) for n in enc.totals(texts.slice(i, step).to_pylist())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(totals, pa.int32())], [*kept, "n_tokens"])
        enc.forget()
        enc.whole.forget()

    return source.mapInArrow(tx.lean(run), schema)


def tokens_at(prefix_tokens: Column, n_chars: Column) -> Column:
    """Tokens of the first ``n_chars`` characters."""
    return F.get(prefix_tokens, n_chars)


def chars_within(prefix_tokens: Column, budget: Column | int) -> Column:
    """Length of the longest prefix of at most ``budget`` tokens."""
    fits = F.transform(prefix_tokens, lambda x: x <= F.lit(budget))
    return F.size(prefix_tokens) - F.array_position(F.reverse(fits), True).cast("int")
