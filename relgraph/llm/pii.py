"""Personal data: offset-preserving deobfuscation, detection and redaction.

A text is rewritten by transducers into plain form, and each character of the result
keeps the span of source characters that it came from:

1. signs: homoglyphs (Cyrillic, Greek, full-width, mathematical letters and digits) become
   the ASCII sign they look like; invisible characters vanish;
2. spelled digits: three or more number words in a row become digits;
3. disguises: ``(at)``, ``[at]``, ``{at}``, `` at `` before a name with a dot, ``(dot)``, `` dot ``
   and the like become ``@`` and ``.``.

Identifiers are found in the rewritten text and their spans mapped back to the source,
which is all that redaction touches. Numbers that only look like one are left: a card must pass the Luhn check (and not be
of equal digits), an IBAN that of ISO 7064 and its country's length where known. Rewriting runs only around places that can matter:
texts without digits, ``@``, number words or disguises pass after one search.

Defined results: a null text gives null and no spans; an empty one itself. Spans never
overlap: of two that do, the earlier begins, then the longer one stays, then the kind first in
``KINDS``. Offsets count characters (code points), the end is exclusive. Very long texts
take linear time. Repeated rows and empty tables give as many rows. ``find`` leaves other
columns out; ``redact`` keeps them.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relgraph.llm import textops as tx

KINDS = ("secret", "email", "iban", "card", "ssn", "ip", "phone")
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹫": "@", "∕": "/", "：": ":",
}
_INVISIBLE = "­​‌‍⁠﻿᠎"
_DIGITS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_NUMBER = "|".join(sorted(_DIGITS, key=len, reverse=True))
_SPELLED = re.compile(rf"\b(?:{_NUMBER})(?:[ \t,.\-]{{1,3}}(?:{_NUMBER}|\d+)\b){{2,}}", re.I)
_SPELLED_PART = re.compile(rf"({_NUMBER})|(\d+)|([ \t,.\-]+)", re.I)
_AT = re.compile(r"[ \t]*[\(\[\{<][ \t]*(?:at|arroba|@)[ \t]*[\)\]\}>][ \t]*|(?<=[a-z0-9])[ \t]+at[ \t]+(?=[a-z0-9-]+(?:[ \t]*[\(\[\{<][ \t]*(?:dot|punkt|point|punto|\.)|[ \t]+dot[ \t]))|(?<=[0-9])[ \t]+at[ \t]+(?=[a-z0-9-]+\.[a-z0-9])|(?<=[a-z0-9])[ \t]+@[ \t]*(?=[a-z0-9])|(?<=[a-z0-9])@[ \t]+(?=[a-z0-9])", re.I)
_DOT = re.compile(r"[ \t]*[\(\[\{<][ \t]*(?:dot|punkt|point|punto|\.)[ \t]*[\)\]\}>][ \t]*|(?<=[a-z0-9])[ \t]+dot[ \t]+(?=[a-z0-9])", re.I)
#: Where a text may need the transducers, and where each kind may be: looser than the patterns, for a search of whole batches.
_REWRITE = rf"(?i)[\(\[\{{<][ \t]*(?:at|arroba|@|dot|punkt|point|punto|\.)[ \t]*[\)\]\}}>]|[ \t]dot[ \t]|[0-9][ \t]+at[ \t]|[a-z0-9]([ \t]+@[ \t]*|@[ \t]+)[a-z0-9]|(?:{_NUMBER})[ \t,.\-]{{1,3}}(?:{_NUMBER}|[0-9]+)[ \t,.\-]{{1,3}}(?:{_NUMBER}|[0-9])"
_MAYBE = {
    "secret": r"(?i)AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|eyJ|-----BEGIN|(?:key|token|secret|passw(?:or)?d|pwd)[\"']?[ \t]*[:=]|[0-9a-f]{32}",
    "email": "@",
    "iban": "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}",
    "card": r"[0-9](?:[ \-]?[0-9]){12}",
    "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "ip": r"[0-9]\.[0-9]{1,3}\.[0-9]|(?:[0-9a-fA-F]{1,4}:){7}",
    "phone": r"\+[0-9]|\([0-9]{2,4}\)|[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4}|[0-9]{10}",
}
_PATTERNS = {
    "secret": re.compile(
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:.*?-----END [A-Z ]*PRIVATE KEY-----|[A-Za-z0-9+/=\s]*)|\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}|\bsk-[A-Za-z0-9_-]{20,}|\bxox[abprs]-[A-Za-z0-9-]{10,}|\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"
        r"|(?i:(?:api[_-]?key|access[_-]?key|key|token|secret|passw(?:or)?d|pwd)[\"']?[ \t]*[:=][ \t]*)(?:\"(?P<a>[^\"\s]{6,})\"|'(?P<b>[^'\s]{6,})'|(?P<c>[A-Za-z0-9_\-+/=.]*\d[A-Za-z0-9_\-+/=.]{5,}))|\b(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,}\b", re.S
    ),
    "email": re.compile(r"[A-Za-z0-9_%+\-]+(?:\.[A-Za-z0-9_%+\-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"),
    "iban": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "card": re.compile(r"(?<![\d.])\d(?:[ \-]?\d){12,18}(?![\d]|\.\d)"),
    "ssn": re.compile(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    "ip": re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)|(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])"),
    "phone": re.compile(r"(?<![\d.\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d(?:[ .\-]?\d){5,12}|\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}|\d{3}[ .\-]\d{3}[ .\-]\d{4}|0\d{9,10}|\d{10}(?!\d))(?![\d])"),
}


@lru_cache(maxsize=1)
def sign_table() -> dict[int, str]:
    """Each homoglyph's ASCII sign. Accented letters of ordinary words stay as they are."""
    table = {ord(k): v for k, v in _LOOKALIKES.items()}
    for point in range(128, sys.maxunicode + 1):
        c = chr(point)
        if unicodedata.decomposition(c).startswith(("<wide>", "<font>", "<circle>")):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain.isascii():
                table[point] = plain
        elif unicodedata.category(c) == "Nd":
            table[point] = str(unicodedata.digit(c))
    return table


@lru_cache(maxsize=1)
def _foreign() -> re.Pattern:
    """Any sign that the first transducer changes."""
    return re.compile("[" + "".join(sorted({*map(chr, sign_table()), *_INVISIBLE})) + "]")


class Aligned:
    """A rewritten text; ``low[i]`` and ``high[i]`` are the source span of its character ``i``. Without any, it is the source."""

    def __init__(self, text: str):
        self.text, self.low, self.high = text, None, None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces spans of the present text, given in order. Each new character stands for the whole span replaced."""
        if not edits:
            return
        if self.low is None:
            self.low, self.high = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        parts, low, high, at = [], [], [], 0
        for start, end, new in edits:
            parts += [self.text[at:start], new]
            low += self.low[at:start]
            high += self.high[at:start]
            if end > start:
                low += [self.low[start]] * len(new)
                high += [self.high[end - 1]] * len(new)
            at = end
        self.text = "".join([*parts, self.text[at:]])
        self.low, self.high = low + self.low[at:], high + self.high[at:]

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.low is None else (min(self.low[start:end]), max(self.high[start:end]))


def normalise(text: str) -> Aligned:
    out = Aligned(text)
    if not text.isascii() and _foreign().search(text):
        if any(c in text for c in _INVISIBLE):
            out.rewrite([(m.start(), m.end(), "") for m in re.finditer(f"[{_INVISIBLE}]+", text)])
        out.text = out.text.translate(sign_table())  # one sign for one: spans stay
    spelled = []
    for m in _SPELLED.finditer(out.text):
        for part in _SPELLED_PART.finditer(out.text, m.start(), m.end()):
            word, _, gap = part.groups()
            if word or gap:
                spelled.append((part.start(), part.end(), str(_DIGITS[word.lower()]) if word else ""))
    out.rewrite(spelled)
    out.rewrite([(m.start(), m.end(), ".") for m in _DOT.finditer(out.text)])
    out.rewrite([(m.start(), m.end(), "@") for m in _AT.finditer(out.text)])
    return out


_IBAN_LENGTHS = {c: int(n) for c, n in (x.split(":") for x in "AD:24 AE:23 AT:20 BE:16 BG:22 CH:21 CY:28 CZ:24 DE:22 DK:18 EE:20 ES:24 FI:18 FR:27 GB:22 GR:27 HR:21 HU:28 IE:22 IL:23 IS:26 IT:27 LI:21 LT:20 LU:20 LV:21 MC:27 MT:31 NL:18 NO:15 PL:28 PT:25 RO:24 SA:24 SE:24 SI:19 SK:24 TR:26".split())}


def luhn(number: str) -> bool:
    """Whether the last digit is the check digit of a card's number."""
    digits = [int(c) for c in number if c.isdigit()]
    return len(set(digits)) > 1 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def iban_length(text: str) -> int:
    """How many characters from the start of ``text`` are a valid account number, by remainder 97; 0 if none are."""
    ends = [k + 1 for k, c in enumerate(text) if c != " "]
    known = _IBAN_LENGTHS.get(text[:2])
    for size in [known] if known else range(len(ends), 14, -1):
        if size and size <= len(ends):
            plain = "".join(text[: ends[size - 1]].split())
            if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                return ends[size - 1]
    return 0


def spans(text: str | None, kinds: tuple[str, ...] = KINDS, rewrite: bool = True) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of each identifier, in source characters, in order."""
    if not text or not kinds:
        return []
    aligned, found = normalise(text) if rewrite else Aligned(text), []
    for kind in kinds:
        for m in _PATTERNS[kind].finditer(aligned.text):
            group = next((g for g in ("a", "b", "c") if kind == "secret" and m.group(g)), 0)
            low, high = m.span(group)
            if kind == "card" and not luhn(m.group()):
                continue
            if kind == "iban" and (high := low + iban_length(m.group())) == low:
                continue
            start, end = aligned.source(low, high)
            found.append((start, -end, KINDS.index(kind), kind))
    out, reached = [], 0
    for start, end, _, kind in sorted(found):
        if start >= reached:
            out.append((kind, start, -end))
            reached = -end
    return out


def batch_spans(texts: pa.Array) -> list[list[tuple[str, int, int]]]:
    """``spans`` of each text: whole-batch searches first tell which texts need which patterns."""
    texts = texts.cast(pa.string())
    hit = lambda pattern: pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_pylist()
    rewrite = [a or b for a, b in zip(hit(_REWRITE), hit(_foreign().pattern), strict=True)]
    maybe = {kind: hit(pattern) for kind, pattern in _MAYBE.items()}
    out = []
    for i, again in enumerate(rewrite):
        kinds = KINDS if again else tuple(k for k in KINDS if maybe[k][i])
        out.append(spans(texts[i].as_py(), kinds, again) if kinds else [])
    return out


def redacted(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    if not found:
        return text
    parts, at = [], 0
    for kind, start, end in found:
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, text[at:]])


def replaced(texts: pa.Array, found: list) -> pa.Array:
    """``texts`` redacted; those without findings are not touched."""
    if not any(found):
        return texts
    changed = pa.array([redacted(texts[i].as_py(), f) for i, f in enumerate(found) if f], texts.type)
    return pc.replace_with_mask(texts, pa.array([bool(f) for f in found]), changed)


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, spans)``: the text with its identifiers replaced, and where they were in the source."""
    source = docs.select("doc_id", F.col("text").cast("string"))
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch_spans(batch.column(1))
            out = replaced(batch.column(1), found)
            yield pa.RecordBatch.from_arrays([batch.column(0), out, pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f] for f in found], kinds)], ["doc_id", "text", "spans"])

    return source.mapInArrow(tx.lean(run), T.StructType([docs.schema["doc_id"], T.StructField("text", T.StringType())]).add("spans", SPANS))


SPANS = T.ArrayType(T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType()))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with identifiers replaced in ``text``, and ``n_chars`` (where there is one) made to agree; columns are kept."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(place, "text", replaced(batch.column(place), batch_spans(batch.column(place))))

    out = docs.mapInArrow(tx.lean(run), docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
