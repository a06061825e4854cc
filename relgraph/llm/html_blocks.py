"""HTML extraction: a recurrent network labels the blocks of a page as content or not.

A page is cut into leaf blocks: runs of text between block-level tags. Each block is a
vector of its tag path (signed hashes of tags, their classes and pairs of tags), of its words (signed
hashes) and of a few plain figures. A bidirectional LSTM, in numpy, reads the blocks of the
whole page in order and gives each a probability; the text of those at 0.5 or more is the page's.

The network is trained here, on at most ``SAMPLE`` pages (distinct ones, with the smallest hash of id,
URL and page), under a teacher that reads only unmistakable markers: what is in ``article`` or ``main`` is
content; what is in ``nav``, ``footer``, ``aside``, ``header`` outside of them, in the title or
an element classed as an advertisement is not; other blocks teach nothing. In half of
the pages these markers are hidden from the network, so it learns the context around them.
Pages are labelled where they are read: one pass, no shuffle.

Defined results: a null page gives null text and labels; one without text an empty text
and no labels. Broken HTML is read as far as it goes; script, style and comments are never text. A quoted
attribute may hold ``<``; but where ``TRIES`` tags of a page had quotes that never close, its later ones end before
the next ``<``, so that a very long or hostile page takes linear time. Paths are read to any depth.
Without a page to learn from, every block counts as content. Repeated rows get equal results,
an empty table gives an empty one. Other columns are left out.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relgraph.llm import textops as tx

SAMPLE, HIDDEN, EPOCHS, RATE, SEED = 300, 16, 6, 0.01, 7
PATH_DIMS, WORD_DIMS, FIGURES = 32, 32, 7
WIDTH = PATH_DIMS + WORD_DIMS + FIGURES
TRIES = 16
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][A-Za-z0-9-]*+)((?:[^<>\"']|\"[^\"<]*+\"|'[^'<]*+')*+)>|<[!?/][^<>]*+>|[^<]+", re.S | re.I)
_QUOTED = re.compile(r"<()(/?)([A-Za-z][A-Za-z0-9-]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
_CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*[\"']?([^\"'>]+)", re.I)
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SIBLINGS = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_CONTENT, _OTHER = frozenset(["article", "main"]), frozenset(["nav", "footer", "aside", "header", "title"])
_AD = re.compile(r"^(?:ads?|advert\w*|sponsor\w*|banner)$", re.I)


class Block:
    __slots__ = ("linked", "parts", "path", "text")

    def __init__(self, path: tuple[str, ...]):
        self.path, self.parts, self.linked, self.text = path, [], 0, ""


def _tokens(page: str) -> Iterator[re.Match]:
    """Tags, comments and texts in order; a ``<`` that begins none of them is left out."""
    at, tries, end = 0, TRIES, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        if m is None and tries and page[at + 1 : at + 2].isalpha():
            m = _QUOTED.match(page, at)
            tries -= m is None
        if m is not None:
            yield m
        at = m.end() if m is not None else at + 1


def blocks(page: str) -> list[Block]:
    """Leaf blocks in order; a path has tags and, after a dot, their classes."""
    out: list[Block] = []
    stack: list[str] = []
    names: list[str] = []
    links = 0
    block: Block | None = None
    for m in _tokens(page):
        close, name, rest = m.group(2), m.group(3), m.group(4)
        if name is None:
            if m.group(1) is None and not (text := m.group()).startswith("<") and (block or not text.isspace()):
                if block is None:
                    block = Block(tuple(stack))
                    out.append(block)
                block.parts.append(text)
                if links:
                    block.linked += len(text)
            continue
        name = name.lower()
        if name in _INLINE:
            if name == "a":
                links = 0 if close else 1
            continue
        block, links = None, 0
        if name in _VOID:
            continue
        if close:
            if name in names:
                at = len(names) - 1 - names[::-1].index(name)
                del names[at:], stack[at:]
            continue
        if (like := _SIBLINGS.get(name)) and (open_ := [i for i, t in enumerate(names) if t in like]):
            inner = max((i for i, t in enumerate(names) if t in ("table", "ul", "ol", "dl")), default=-1)
            if open_[-1] > inner:
                del names[open_[-1] :], stack[open_[-1] :]
        names.append(name)
        kinds = " ".join(_CLASS.findall(rest)).lower().split() if rest and "=" in rest else []
        stack.append(".".join([name, *kinds]))
    for b in out:
        b.text = " ".join(entities.unescape("".join(b.parts)).split())
    return [b for b in out if b.text]


def teacher(path: tuple[str, ...]) -> int:
    """1 content, 0 not, -1 unknown; the innermost marker decides."""
    for step in reversed(path):
        name, *kinds = step.split(".")
        if any(_AD.match(k) for k in kinds):
            return 0
        if name in _CONTENT:
            return 1
        if name in _OTHER:
            return 0
    return -1


def hidden(path: tuple[str, ...]) -> tuple[str, ...]:
    """The path without the teacher's markers."""
    return tuple("div" if s.split(".")[0] in _CONTENT | _OTHER or any(_AD.match(k) for k in s.split(".")[1:]) else s for s in path)


@lru_cache(maxsize=200_000)
def _slot(token: str, dims: int) -> tuple[int, float]:
    h = zlib.crc32(token.encode("utf-8", "replace"))
    return h % dims, 1.0 if h >> 31 else -1.0


@lru_cache(maxsize=50_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH_DIMS, np.float32)
    for i, step in enumerate(path):
        for token in {step, step.split(".")[0], f"{path[i - 1] if i else ''}>{step}"}:
            at, sign = _slot(token, PATH_DIMS)
            v[at] += sign
    return v / np.float32(np.sqrt(1 + len(path)))


def vectors(pages: list[list[Block]], paths: list[list[tuple[str, ...]]] | None = None) -> list[np.ndarray]:
    """A row for each block of each page; ``paths`` instead of the blocks' own."""
    found = [b for page in pages for b in page]
    if not found:
        return [np.zeros((0, WIDTH), np.float32) for _ in pages]
    hashes, begins = tx.words([b.text for b in found])
    own = np.repeat(np.arange(len(found)), np.diff(begins))
    cells = own * WORD_DIMS + (hashes % np.uint64(WORD_DIMS)).astype(np.int64)
    words = np.bincount(cells, np.where(hashes >> np.uint64(63), 1.0, -1.0), len(found) * WORD_DIMS).reshape(-1, WORD_DIMS)
    many = np.maximum(np.diff(begins), 1)
    out = np.zeros((len(found), WIDTH), np.float32)
    out[:, :PATH_DIMS] = [_path_vector(p) for p in ([b.path for b in found] if paths is None else [p for page in paths for p in page])]
    out[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = words / np.sqrt(many)[:, None]
    size = np.fromiter((len(b.text) for b in found), float, len(found))
    ends = np.fromiter((b.text.count(".") + b.text.count("!") + b.text.count("?") for b in found), float, len(found))
    linked = np.fromiter((b.linked for b in found), float, len(found))
    depth = np.fromiter((len(b.path) for b in found), float, len(found))
    place = np.concatenate([np.arange(len(p)) / max(1, len(p)) for p in pages])
    out[:, -FIGURES:] = np.column_stack([np.ones(len(found)), np.log1p(size) / 4, np.log1p(many) / 3, np.minimum(1, linked / size), ends / many, depth / 8, place])
    return np.split(out, np.cumsum([len(p) for p in pages])[:-1])


class Labeller:
    """A bidirectional LSTM over padded batches; weights of both directions are stacked."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        scale = 1 / np.sqrt(WIDTH + HIDDEN)
        self.w = {f"{d}{k}": (rng.standard_normal(s) * scale).astype(np.float32) for d in "fb" for k, s in (("x", (WIDTH, 4 * HIDDEN)), ("h", (HIDDEN, 4 * HIDDEN)))}
        self.w |= {f"{d}c": np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN) for d in "fb"}
        self.w |= {"out": (rng.standard_normal(2 * HIDDEN) * scale).astype(np.float32), "bias": np.zeros(1, np.float32)}
        self.trained = False

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states by step (steps, pages, HIDDEN), in the order of ``x``; and what going back needs."""
        steps, pages, _ = x.shape
        gates = x.reshape(-1, WIDTH) @ self.w[f"{d}x"] + self.w[f"{d}c"]
        gates = gates.reshape(steps, pages, -1)
        h, c, out, past = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32), np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ self.w[f"{d}h"]
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            cn = (f * c + i * g) * m
            tc = np.tanh(cn)
            hn = o * tc * m
            if keep:
                past.append((t, h, c, i, f, o, g, tc))
            h, c = hn, cn
            out[t] = h
        return out, past

    def _back(self, x: np.ndarray, mask: np.ndarray, d: str, past: list, grad: np.ndarray, into: dict) -> None:
        steps, pages, _ = x.shape
        dz_all = np.zeros((steps, pages, 4 * HIDDEN), np.float32)
        dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        for t, h, c, i, f, o, g, tc in reversed(past):
            m = mask[t][:, None]
            dh = (dh + grad[t]) * m
            dc = (dc + dh * o * (1 - tc * tc)) * m
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            dz_all[t] = dz
            into[f"{d}h"] += h.T @ dz
            dh, dc = dz @ self.w[f"{d}h"].T, dc * f
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        into[f"{d}x"] += x.reshape(-1, WIDTH).T @ flat
        into[f"{d}c"] += flat.sum(0)

    @staticmethod
    def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(map(len, pages))
        x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k], mask[: len(p), k] = p, 1
        return x, mask

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, size: int = 16) -> None:
        """Adam on the cross entropy of blocks with a label (0 or 1)."""
        known = [k for k, y in enumerate(labels) if (y >= 0).any()]
        if not known:
            return
        self.trained = True
        rng = np.random.default_rng(SEED)
        m, v, n = {k: np.zeros_like(w) for k, w in self.w.items()}, {k: np.zeros_like(w) for k, w in self.w.items()}, 0
        for _ in range(epochs):
            order = sorted(known, key=lambda k: (len(pages[k]), k))
            batches = [order[i : i + size] for i in range(0, len(order), size)]
            rng.shuffle(batches)
            for batch in batches:
                x, mask = self._padded([pages[k] for k in batch])
                y = np.full(mask.shape, -1.0, np.float32)
                for j, k in enumerate(batch):
                    y[: len(labels[k]), j] = labels[k]
                (hf, pf), (hb, pb) = self._run(x, mask, "f", True), self._run(x, mask, "b", True)
                h = np.concatenate([hf, hb], 2)
                p = 1 / (1 + np.exp(-np.clip(h @ self.w["out"] + self.w["bias"], -30, 30)))
                dz = np.where(y >= 0, p - y, 0).astype(np.float32) / np.float32(max(1, (y >= 0).sum()))
                grads = {k: np.zeros_like(w) for k, w in self.w.items()}
                grads["out"], grads["bias"] = np.einsum("tp,tph->h", dz, h), np.array([dz.sum()], np.float32)
                dh = dz[:, :, None] * self.w["out"]
                self._back(x, mask, "f", pf, dh[:, :, :HIDDEN], grads)
                self._back(x, mask, "b", pb, dh[:, :, HIDDEN:], grads)
                n += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g / max(1.0, norm)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = (self.w[k] - RATE * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)

    def probabilities(self, pages: list[np.ndarray], most: int = 1 << 14) -> list[np.ndarray]:
        """For each page those of its blocks; pages of like length go together, at most ``most`` padded blocks."""
        out: list[np.ndarray] = [np.ones(len(p), np.float32) for p in pages]
        if not self.trained:
            return out
        batch: list[int] = []
        for k in [*sorted((k for k, p in enumerate(pages) if len(p)), key=lambda k: len(pages[k])), None]:
            if batch and (k is None or len(pages[k]) * (len(batch) + 1) > most):
                x, mask = self._padded([pages[j] for j in batch])
                h = np.concatenate([self._run(x, mask, "f", False)[0], self._run(x, mask, "b", False)[0]], 2)
                p = 1 / (1 + np.exp(-np.clip(h @ self.w["out"] + self.w["bias"], -30, 30)))
                for j, at in enumerate(batch):
                    out[at] = p[: len(pages[at]), j]
                batch = []
            if k is not None:
                batch.append(k)
        return out


def train(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    rows = pages.where("html IS NOT NULL").select("page_id", "url", F.col("html").cast("string").alias("html"))
    marked = rows.withColumn("h", F.xxhash64("page_id", "url", "html"))
    chosen = marked.select("h").distinct().orderBy("h").limit(sample).withColumnRenamed("h", "least")
    own = marked.join(F.broadcast(chosen), F.col("h") == F.col("least"), "left_semi").groupBy("h").agg(F.min(F.struct("page_id", "url", "html")).alias("r")).select("r.*")
    found = sorted((str(r["page_id"]), r["url"] or "", r["html"]) for r in own.collect())
    cut = [blocks(page) for _, _, page in found]
    paths = [[hidden(b.path) if k % 2 else b.path for b in page] for k, page in enumerate(cut)]
    model = Labeller()
    model.fit(vectors(cut, paths), [np.array([teacher(b.path) for b in page], np.float32) for page in cut])
    return model


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """``(page_id, text, labels)`` for each row: the content blocks by lines, and whether each block is content."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                pages_ = part.column(1).to_pylist()
                found = [blocks(p or "") for p in pages_]
                labels = [p >= 0.5 for p in shared.value.probabilities(vectors(found))]
                texts = [None if p is None else "\n".join(x.text for x, keep in zip(b, y, strict=True) if keep) for p, b, y in zip(pages_, found, labels, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([None if p is None else y.tolist() for p, y in zip(pages_, labels, strict=True)], pa.list_(pa.bool_()))], ["page_id", "text", "labels"])

    return pages.select("page_id", F.col("html").cast("string")).mapInArrow(tx.lean(run), T.StructType([pages.schema["page_id"]]).add("text", T.StringType()).add("labels", T.ArrayType(T.BooleanType())))
