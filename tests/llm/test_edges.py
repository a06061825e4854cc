"""Deep, long, hostile and odd inputs of the operators, against plain versions."""

import gzip
import html
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from relgraph.llm import decontam, fingerprints, html_blocks, pii, url_rules, warc
from relgraph.llm import textops as tx


def test_blocks_equal_brute_force():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 63, 300, np.uint64)
    queries = np.concatenate([prints[:200], rng.integers(0, 1 << 63, 40_000, np.uint64)])
    for k in range(200):
        for bit in rng.choice(64, k % 14, replace=False):
            queries[k] ^= np.uint64(1) << np.uint64(bit)
    near = np.bitwise_count(queries[:, None] ^ prints[None, :]) <= decontam.RADIUS
    assert set(zip(*map(np.ndarray.tolist, decontam.Blocks(prints).search(queries)), strict=True)) == set(map(tuple, np.argwhere(near).tolist()))
    assert near.any(axis=1)[:200].sum() > 150


def test_long_items_have_exact_fingerprints():
    grams = np.random.default_rng(6).integers(0, 1 << 63, 70_000, np.uint64)
    grams |= np.uint64(1 << 5)  # a bit that all have, counted beyond 16 bits
    size = 60_001
    bits = np.unpackbits(grams[: size - 1].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    want = np.packbits(bits > (size - 1) // 2, bitorder="little").view(np.uint64)[0]
    assert decontam.simhashes(grams, {size: 1})[size][0] == want


@pytest.mark.parametrize("kind", ["int", "bigint", "string"])
def test_item_ids_of_any_type(spark, kind):
    rng = random.Random(1)
    item = " ".join(f"w{rng.randint(0, 999)}" for _ in range(30))
    docs = spark.createDataFrame([("a", f"x y {item} z", "q"), ("b", "other words", "q"), ("c", None, "q"), ("d", "", "q"), ("e", "long " * 60_000, "q")], "doc_id string, text string, item_id string")
    bench = spark.createDataFrame([(7, item), (8, None), (None, item)], "item_id int, text string").withColumn("item_id", F.col("item_id").cast(kind))
    assert [(r["doc_id"], str(r["item_id"])) for r in decontam.find(docs, bench).collect()] == [("a", "7")]
    assert {r["doc_id"] for r in decontam.clean(docs, bench, items_at_once=1).collect()} == set("bcde")
    assert decontam.clean(docs, bench.limit(0)).count() == 5


def test_hostile_pages_take_linear_time():
    begun = time.process_time()
    for piece in ('<a "x ', "<!x", '<a "<a" ', "<a '", "<p ", "<", "<!--"):
        html_blocks.blocks(piece * (1_000_000 // len(piece)))
    assert time.process_time() - begun < 20


def test_paths_of_any_depth_and_quoted_signs():
    found = html_blocks.blocks("<article>" + "<div>" * 20 + '<p title="a<b">x &copy; y</p>')
    assert [b.text for b in found] == ["x © y"] and len(found[0].path) == 22 and html_blocks.teacher(found[0].path) == 1


def test_training_pages_do_not_depend_on_order(spark):
    rows = [(1, "u", f"<article><p>{w} text here</article><nav>n</nav>") for w in "abcdef"] * 2
    models = [html_blocks.train(spark.createDataFrame(r, "page_id int, url string, html string").repartition(n), sample=4) for r, n in ((rows, 1), (rows[::-1], 3))]
    assert all(np.array_equal(models[0].w[k], models[1].w[k]) for k in models[0].w)


REFERENCES = "a&copy;b &#xE9; &#233; &mdash; &amp;lt; &unknown; &#0; &#xD800; & &copy &NotEqualTilde; &#x1F600;"


def test_references_are_decoded_once(spark):
    got = spark.createDataFrame([(f"<p>{REFERENCES}</p>",)], "h string").select(warc.plain_text(F.col("h")).alias("t")).first()["t"]
    want = REFERENCES
    for r in ("&copy;", "&#xE9;", "&#233;", "&mdash;", "&NotEqualTilde;", "&#x1F600;"):
        want = want.replace(r, html.unescape(r))
    assert got == want.replace("&amp;", "&")


def test_plain_text_of_odd_pages(spark):
    rng = random.Random(2)
    bits = ["<", ">", "&", ";", " ", "  ", "\n", "\t", "\r", "\f", "\v", "\u00a0", "\u3000", "a", "Z", "é", "😀", "<p>", "</P >", "<br/>", "<b x='y'>", "</b>", "<a <p> b>", "<!-- ", "-->", "<script>", "<SCRIPT a=1>", "</script >", "<scripts>", "<style>", "</style", "<noscript>", "</noscript>", "<template>", "</template>", "&amp;", "&nbsp;", "&Tab;", "&NewLine;", "&#32;", "&#10;", "&#xe9;", "&lt;p&gt;", "&copy", "&nosuch;", "<pre", "\\", "$1"]
    pages = ["", "\n", " ", "&", *("".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(3000))]

    def plain(page):
        t = re.sub(warc._TAG, "", re.sub(warc._BLOCK, "\n", re.sub(warc._HIDDEN, "", page, flags=re.A), flags=re.A))
        first, *rest = t.split("&")
        for x in rest:
            name = re.match(warc._REFERENCE, x)
            sign = None if name is None else html.unescape(f"&{name[1]};") if name[1][0] == "#" else warc._NAMED.get(name[1])
            first += "&" + x if sign is None else sign + x[name.end() :]
        return re.sub(" ?\n[ \n]*", "\n", re.sub("[ \t\f\r\u00a0]+", " ", first)).strip(" \n")

    got = spark.createDataFrame(list(enumerate(pages)), "i int, h string").select("i", warc.plain_text(F.col("h")).alias("t")).collect()
    assert [r["t"] for r in sorted(got)] == list(map(plain, pages))


def test_links_in_three_quotings(spark):
    page = "<a href=\"x y\">1</a><a class=k href='y'>2</a><A HREF=z>3</a><a data-href=no>4</a>"
    pages = spark.createDataFrame([(1, "u", page)], "page_id int, url string, html string")
    envelope = warc.derive(warc.responses(pages)).where("warc_type = 'metadata'").first()["payload"]
    assert '"links":["x y","y","z"]' in envelope


def test_warc_members_chunks_and_charsets(spark, tmp_path):
    def record(k, head, body):
        block = b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body
        return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: r%d\r\nContent-Length: %d\r\n\r\n" % (k, len(block)) + block + b"\r\n\r\n"

    text = "é" * 3000
    chunked = b"".join(b"%x\r\n" % len(c) + c + b"\r\n" for c in (text.encode()[:100], text.encode()[100:])) + b"0\r\n\r\n"
    kinds = [(b"Content-Type: text/html; charset=latin-1", text.encode("latin-1")), (b"Transfer-Encoding: chunked", chunked), (b"Content-Encoding: gzip", gzip.compress(text.encode())), (b"Content-Encoding: deflate", zlib.compress(text.encode())), (b"Content-Type: text/html; charset=nonsense", text.encode())]
    (tmp_path / "a b.warc.gz").write_bytes(b"".join(gzip.compress(record(k, *kinds[k % 5]), 1) for k in range(5000)))
    begun = time.time()
    rows = warc.read_warc(spark, str(tmp_path)).select("record_id", "body").collect()
    assert len(rows) == 5000 and {r["body"] for r in rows} == {text} and time.time() - begun < 60


def test_url_rules_of_any_depth(spark):
    pages = spark.createDataFrame([(1, "https://example.com/a/b/c/d/e.html"), (2, "http://x.b.c.d.e.f.com/"), (3, "http://example.com/" + "y/" * 30_000)], "page_id int, url string")
    rules = spark.createDataFrame([(1, "example.com/a/b/c/d/", "block", 1), (2, "b.c.d.e.f.com/", "block", 1)], url_rules.RULE_SCHEMA)
    assert {(r["page_id"], r["rule_id"]) for r in url_rules.decide(pages, rules).collect()} == {(1, 1), (2, 2), (3, None)}


@pytest.mark.parametrize("text", ["4111111111111112", "at 1700000000000 ms", "AB12 CDEF 1234 GH", "DE89 3704 0044 0532 0130 01", "0000 0000 0000 0000"])
def test_numbers_without_their_check_digits_stay(text):
    assert not [k for k, _, _ in pii.spans(text) if k in ("card", "iban")]


def test_rewriting_keeps_source_spans():
    """Each rewritten character's span holds the source characters it stands for, in order and without a gap in what stays."""
    rng = random.Random(3)
    pieces = ["bob", " (at) ", "mаil", " [dot] ", "com", " one two three four ", "​", "０１７", " x ", "é", "@"]
    for _ in range(300):
        text = "".join(rng.choice(pieces) for _ in range(12))
        out = pii.normalise(text)
        spans = [out.source(i, i + 1) for i in range(len(out.text))]
        assert all(0 <= a < b <= len(text) for a, b in spans) and spans == sorted(spans)
        for c, (a, b) in zip(out.text, spans, strict=True):
            assert b - a > 1 or text[a] == c or pii.sign_table().get(ord(text[a])) == c or c in "@."


def test_memory_is_given_back_when_a_task_stops_early(monkeypatch):
    called = []
    monkeypatch.setattr(tx, "release", lambda: called.append(1))
    rows = tx.lean(lambda batches: (b for b in batches))(iter([1, 2]))
    assert next(rows) == 1
    rows.close()
    assert called == [1]


@pytest.mark.parametrize("words", [20, 60, 250])
def test_short_documents_are_found_in_long_ones(spark, words):
    rng = random.Random(words)
    long = [f"w{rng.randint(0, 10**6)}" for _ in range(4000)]
    rows = [(i, " ".join(long[40 * i : 40 * i + words])) for i in range(90)] + [(99, " ".join(long))]
    found = fingerprints.sketches(spark.createDataFrame(rows, "doc_id int, text string"))
    whole = found.where("doc_id = 99").select(F.col("sketch").alias("whole"))
    shares = [r["c"] for r in found.where("doc_id < 90").crossJoin(whole).select(fingerprints.containment(F.col("sketch"), F.col("whole")).alias("c")).collect()]
    assert set(shares) <= {1.0, None} and shares.count(None) <= (5 if words == 20 else 0)
