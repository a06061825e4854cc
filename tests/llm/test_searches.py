"""Operators that search or read pages, and the pipeline, against brute force."""

import gzip
import json
import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from relgraph.llm import decontam, html_blocks, ngram_join, packing, pii, quality, shared, url_rules, warc
from relgraph.llm import textops as tx
from relgraph.llm.queries import ORACLES, QUERIES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCABULARY = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("a", "ena", "iro", "ostu", "u")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(rng, text, share):
    return " ".join(rng.choice(VOCABULARY) if rng.random() < share else w for w in text.split())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCS)


def corpus(rng):
    rows = [(i, prose(rng, rng.choice([1, 2, 5, 12, 30, 80, 200]))) for i in range(120)]
    base = prose(rng, 90)
    rows += [(200 + i, edited(rng, base, 0.04)) for i in range(70)]  # copies enough to make their words frequent
    for i in range(60):
        rows.append((300 + i, edited(rng, rows[i][1], rng.choice([0, 0.03, 0.1, 0.2, 0.3]))))
    shared = prose(rng, 60)
    rows += [(400 + i, f"{prose(rng, 50)} {shared} {prose(rng, 10)}") for i in range(40)]
    return [*rows, (500, rows[3][1].upper()), (501, None), (502, ""), (503, " .. "), (None, base), (1, rows[1][1])]


def gram_set(text, n):
    w = re.findall(r"[^\W_]+", text.lower())
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_pairs(rows, n, threshold):
    sets = {}
    for i, t in rows:
        if i is not None and t and gram_set(t, n):
            sets.setdefault(gram_set(t, n), []).append(i)
    least = {s: min(i) for s, i in sets.items()}
    out = {(least[s], j): 1.0 for s, i in sets.items() for j in set(i) if j != least[s]}
    every = sorted(least.items(), key=lambda x: x[1])
    for k, (a, i) in enumerate(every):
        for b, j in every[k + 1 :]:
            value = len(a & b) / len(a | b)
            if value >= threshold - 1e-12:
                out[i, j] = value
    return out


@pytest.mark.parametrize(("n", "threshold"), [(3, 0.5), (2, 0.6), (1, 0.8)])
def test_join_is_exact(spark, n, threshold):
    rows = corpus(random.Random(n))
    docs = frame(spark, rows).withColumn("jaccard", F.lit("clash")).withColumn("bucket", F.lit("clash"))
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in ngram_join.pairs(docs, n, threshold).collect()}
    assert got == pytest.approx(brute_pairs(rows, n, threshold))


def test_join_finds_scattered_edits(spark):
    rng = random.Random(13)
    rows = []
    for i in range(12):
        words = [rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(200)]
        rows.append((i, " ".join(words)))
        for at in range(3, 195, 8):  # 12 %: bigram Jaccard above 0.6, trigram below 0.5
            words[at] = rng.choice(VOCABULARY) + "x"
        rows.append((100 + i, " ".join(words)))
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in ngram_join.pairs(frame(spark, rows)).collect()}
    assert {(i, 100 + i) for i in range(12)} <= set(got) and got == pytest.approx(brute_pairs(rows, 2, 0.6))
    assert not {(i, 100 + i) for i in range(12)} & set(brute_pairs(rows, 3, 0.5))


def test_signatures_share_enough():
    rng = np.random.default_rng(4)
    places = 1 << ngram_join.TABLE_BITS
    for classes in (np.zeros(places, np.uint8), np.full(places, 200, np.uint8), rng.integers(0, 60, places).astype(np.uint8), rng.integers(20, 30, places).astype(np.uint8)):
        for _ in range(600):
            n, t = int(rng.integers(1, 160)), float(rng.choice([0.5, 0.6, 0.8]))
            common = np.unique(rng.integers(0, 1 << 56, n).astype(np.uint64))
            add = lambda: np.unique(np.concatenate([common, rng.integers(0, 1 << 56, int(rng.integers(0, n + 1))).astype(np.uint64)]))  # noqa: E731, B023
            a, b = add(), add()
            if len(common) / (len(a) + len(b) - len(common)) < t:
                continue
            both = np.intersect1d(*(np.concatenate(ngram_join.signatures(x, classes, t)) for x in (a, b)))
            assert (both & np.uint64(1)).any() or len(both) >= ngram_join.shared(min(len(a), len(b)))


def test_common_tokens_and_forest():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 9000, int(rng.integers(1, 6000))).astype(np.uint64)) for _ in range(30)]
    assert (ngram_join.common(sets[:11], sets[11:]) == [[len(np.intersect1d(a, b)) for b in sets[11:]] for a in sets[:11]]).all()
    for _ in range(60):
        links = rng.random((int(rng.integers(1, 12)), int(rng.integers(1, 12)))) < 0.15
        rows, columns = links.shape

        def roots(edges, rows=rows, columns=columns):
            root = list(range(rows + columns))
            for i, j in edges:
                x, y = root[i], root[rows + j]
                root = [min(x, y) if r in (x, y) else r for r in root]
            return root

        forest = ngram_join._forest(links)
        assert roots(forest) == roots(np.argwhere(links).tolist()) and all(links[i, j] for i, j in forest) and len(forest) < rows + columns


def brute_classes(rows, n, threshold):
    """doc_id, class_id, links of each distinct row, from all pairs."""
    sets = {(i, gram_set(t or "", n)) for i, t in rows if i is not None}
    near = {x: {y for y in sets if y != x and x[1] and y[1] and len(x[1] & y[1]) / len(x[1] | y[1]) >= threshold - 1e-12} for x in sets}
    out = []
    for x in sets:
        seen, ahead = {x}, [x]
        while ahead:
            fresh = near[ahead.pop()] - seen
            seen |= fresh
            ahead += fresh
        out.append((x[0], min(i for i, _ in seen), len(near[x])))
    return sorted(out)


@pytest.mark.parametrize("block", [1024, 16])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = [*corpus(random.Random(6)), (7, "another text of seven"), (1, None), (600, "x " * 30_000 + "end")]
    docs = frame(spark, rows).withColumn("class_id", F.lit("clash")).withColumn("node", F.lit("clash"))
    got = sorted(map(tuple, ngram_join.near_duplicates(docs).collect()))
    assert got == brute_classes(rows, 2, 0.6) and max(r[2] for r in got) > 60
    named = docs.withColumn("doc_id", F.format_string("d%03d", "doc_id")).where("doc_id <> 'dnull'")
    again = sorted(map(tuple, ngram_join.near_duplicates(named).collect()))
    assert again == [(f"d{a:03d}", f"d{b:03d}", c) for a, b, c in got]
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_sketches_are_never_further_apart_than_sets():
    rng = np.random.default_rng(3)
    for n, m, both in ((5, 300, 3), (300, 280, 250), (40, 41, 40), (9000, 7000, 6000), (1, 1, 0)):
        every = rng.integers(0, 1 << 56, n + m - both, dtype=np.uint64)
        one, two = every[:n], every[n - both :]
        bits = ngram_join.apart([ngram_join.sketch(one)], [ngram_join.sketch(two)])[0]
        assert bits <= n + m - 2 * both
    one, two = (rng.integers(0, 1 << 56, 300, dtype=np.uint64) for _ in "ab")
    assert ngram_join.apart([ngram_join.sketch(one)], [ngram_join.sketch(two)])[0] > ngram_join._bearable(600, 0.6)


def test_rounds_strips_and_spent_tables(spark, monkeypatch):
    rng = random.Random(8)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") for _ in range(60)] for _ in range(40)]
    texts = [" ".join(w if rng.random() > 0.04 else "x" for w in rng.choice(base)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    folder = shared.shared_dir(spark).removeprefix("file:")
    want = {tuple(r) for r in ngram_join.near_duplicates(docs).collect()}
    for name, value in (("_BUCKET", 1000), ("_PER_TOKEN", 1), ("BLOCK", 8), ("CROWD", 4)):
        monkeypatch.setattr(ngram_join, name, value)
    before = set(os.listdir(folder))
    met, rounds = ngram_join._met, []
    monkeypatch.setattr(ngram_join, "_met", lambda *a: rounds.append(1) or met(*a))
    assert {tuple(r) for r in ngram_join.near_duplicates(docs).collect()} == want and len(rounds) > 1
    kept = [spark.read.parquet(f"{folder}/{x}").columns for x in set(os.listdir(folder)) - before]
    assert not any({"marks", "grams", "sketch", "places"} & set(c) - ({"marks"} if "node" in c or "label" in c else set()) for c in kept)


def test_cut_frees_its_shuffle(spark):
    files = lambda: {x for x in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(" ").split() if "/shuffle_" in x}
    before = files()
    assert shared.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    deadline = time.time() + 10
    while (left := {x for x in files() - before if x.endswith(".data")}) and time.time() < deadline:
        time.sleep(0.2)
    assert len(left) <= 4  # those of the count that followed


def test_sets_are_sifted_and_collected_in_one_pass(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a text of number {i} with words") for i in range(300)], "doc_id bigint, text string")
    plans = []
    monkeypatch.setattr(ngram_join, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or shared.cut(df))
    asked = docs.where("doc_id < 100")
    found = {r["node"]: ngram_join._unpacked(pa.scalar(bytes(r["grams"]))) for r in ngram_join._grams(docs, asked, 2).collect()}
    assert [p.count("MapInArrow") for p in plans] == [1]  # each pass takes a Python worker
    rows = pa.RecordBatch.from_pylist([r.asDict() for r in asked.collect()])
    for _, grams in ngram_join._sets(rows, 2):
        assert len(found[ngram_join.node(grams)]) == len(grams)
    assert len(found) < 150


def test_packing_starts_no_other_workers(spark, monkeypatch):
    lengths = spark.range(1000).selectExpr("id AS doc_id", "CAST(id * 7 % 5000 AS INT) AS n_tokens")

    def refuse(*_, **__):
        raise AssertionError("rows of a Python list need Python workers without an operator")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    assert packing.pack(lengths).agg(F.sum("piece_tokens")).first()[0] == sum(i * 7 % 5000 for i in range(1000))
    assert packing.pack(lengths.where("n_tokens < 0")).count() == 0


def test_one_of_each(spark):
    rows = corpus(random.Random(3))
    docs = frame(spark, rows)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    left = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.select("doc_id").collect())
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute_pairs(rows, ngram_join.WORDS, ngram_join.THRESHOLD):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert left == sorted([(False, i) for i in parent if root(i) == i] + [(True, 0)])
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0 and ngram_join.pairs(docs.limit(0)).count() == 0


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randint(8, 70))) for i in range(40)]
    rows, planted = [(i, prose(rng, 400)) for i in range(60)], set()
    for i, t in items:
        rows.append((100 + i, f"{prose(rng, rng.randint(0, 90))} {t.capitalize()}, {prose(rng, rng.randint(0, 90))}"))
        rows.append((200 + i, f"{prose(rng, 40)} {edited(rng, t, 0.05)} {prose(rng, 30)}"))
        planted.add((100 + i, i))
    docs, bench = frame(spark, [*rows, (900, None), (901, ""), (902, items[0][1])]), spark.createDataFrame([*items, (77, None), (78, "word"), (None, "a b c d")], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontam.find(docs.withColumn("similarity", F.lit("clash")), bench).collect()}
    whole = decontam.Benchmark(items)
    brute = set()
    for i, t in rows:
        h, _ = tx.words([t])
        for k, _ in items:
            n = len(whole.words[k])
            grams = tx.grams(h, 2)
            if any(whole.similarity(k, grams[s : s + n - 1]) >= decontam.SIMILARITY for s in range(max(1, len(h) - n + 1))):
                brute.add((i, k))
    assert planted <= set(found) and len(brute & set(found)) >= 0.9 * len(brute)
    assert not {k for k in found if k[0] < 100} and found[902, 0]["similarity"] == 1.0 and found[902, 0]["first_word"] == 0
    cleaned = decontam.clean(docs, bench)
    assert cleaned.columns == docs.columns and {r["doc_id"] for r in cleaned.collect()} == {i for i, _ in [*rows, (900, 0), (901, 0)]} - {d for d, _ in found}
    parts = {(r["doc_id"], r["item_id"]) for r in decontam.find(docs, bench.limit(12), items_at_once=5).collect()}
    assert parts == {k for k in found if k[1] in {r["item_id"] for r in bench.limit(12).collect()}}
    assert decontam.find(docs, bench.limit(0)).count() == 0 and decontam.find(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("share", [0.05, 0.1, 0.13])
def test_decontamination_finds_edited_copies(share):
    rng = random.Random(11)
    items = [(i, prose(rng, n)) for i, n in enumerate([8, 10, 12, 15, 20, 30, 50, 70] * 5)]
    bench, brute, found = decontam.Benchmark(items), set(), set()
    for k, (_, t) in enumerate(items):
        for _ in range(4):
            words = t.split()
            for at in rng.sample(range(len(words)), max(1, round(share * len(words)))):
                words[at] = rng.choice(VOCABULARY)
            h, begins = tx.words([f"{prose(rng, 40)} {' '.join(words)} {prose(rng, 30)}"])
            n, grams = len(words), tx.grams(h, 2)
            copy = (len(brute), k)
            if max(bench.similarity(k, grams[s : s + n - 1]) for s in range(len(h) - n + 1)) >= decontam.SIMILARITY:
                if any(i == k for _, i, *_ in bench.find(h, begins, decontam.SIMILARITY)):
                    found.add(copy)
                brute.add(copy)
    assert len(brute) > 60 and len(found) >= 0.9 * len(brute)


def test_decontamination_parts_count_rarity_of_all(spark):
    rng = random.Random(12)
    common = prose(rng, 12)
    items = [(i, f"{common} {prose(rng, 12)}") for i in range(30)]
    docs = frame(spark, [(i, f"{prose(rng, 20)} {edited(rng, t, 0.05)} {prose(rng, 20)}") for i, t in items])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole, parts = ({(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.find(docs, bench, items_at_once=n).collect()} for n in (100, 8))
    assert whole and parts == pytest.approx(whole)


def test_decontamination_holds_few_texts_at_once():
    seen = []

    class Bench:
        def find(self, hashes, begins, threshold):
            seen.append(len(hashes))
            return [(len(begins) - 2, 0, 1.0, 0, 1)]

    found = list(decontam._findings(Bench(), pa.array(["word " * 200] * 3000), 0.7))
    assert max(seen) <= 40_000 and sum(seen) == 600_000 and found[-1][0] == 2999


def test_references_are_looked_for_once(spark):
    assert warc.plain_text(F.col("x"))._jc.toString().count("regexp_extract") == 1


def test_tags_are_taken_out_once(spark):
    assert warc.plain_text(F.col("x"))._jc.toString().count("!--.*?-->") == 1


def test_blocks_find_all_within_radius():
    rng = np.random.default_rng(6)
    prints = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    queries = prints[rng.integers(0, 50, 400)].copy()
    for i in range(400):
        for bit in rng.choice(64, int(rng.integers(0, decontam.RADIUS + 3)), replace=False):
            queries[i] ^= np.uint64(1) << np.uint64(bit)
    got = set(zip(*(x.tolist() for x in decontam.Blocks(prints).search(queries)), strict=True))
    assert got == {(i, j) for i in range(400) for j in range(50) if bin(int(queries[i] ^ prints[j])).count("1") <= decontam.RADIUS}


PAGE = "<html><head><title>T &amp; t</title><style>p{}</style></head><body><nav><ul><li><a href='/x'>Home</a><li>More</ul></nav><!-- no <p> --><article><p>First <b>bold</b> text, here.<p>Second &#233; text.</article><script>var t='</p>';</script><footer>&copy; us</footer></body></html>"


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.b/c", PAGE, "x"), (1, "http://a.b/c", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x")], "page_id bigint, url string, html string, payload string")
    rows = warc.derive(warc.responses(pages)).collect()
    assert len(rows) == 8
    text = next(r for r in rows if r["page_id"] == 1 and r["warc_type"] == "conversion")
    meta = next(r for r in rows if r["page_id"] == 1 and r["warc_type"] == "metadata")
    assert text["payload"] == "T & t\nHome\nMore\nFirst bold text, here.\nSecond é text.\n© us" and text["warc_refers_to"] == meta["warc_refers_to"]
    envelope = json.loads(meta["payload"])
    assert envelope["record_id"] == meta["warc_refers_to"] and envelope["payload_digest"] == meta["source_payload_digest"] and "WARC-Type: response" in envelope["warc_headers"]
    response = warc.responses(pages).first()
    block = (response["http_headers"] + PAGE).encode()
    record = b"WARC/1.1\r\n" + response["warc_headers"].encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record + b"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: 1\r\n\r\nx\r\n\r\n" + record[:90])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    read = warc.read_warc(spark, str(tmp_path)).collect()
    assert len(read) == 3 and all(r["body"] == PAGE and r["warc_headers"] == response["warc_headers"] and r["payload_digest"] == response["payload_digest"] for r in read)
    again = warc.derive(warc.read_warc(spark, str(tmp_path))).where("warc_type = 'conversion'").first()
    assert again["payload"] == text["payload"] and again["warc_refers_to"] == text["warc_refers_to"]
    (headers, _, body) = next(warc.parse(warc.serialise(text.asDict())))
    assert body.decode() == text["payload"] and headers["warc-refers-to"] == text["warc_refers_to"]
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_url_rules(spark):
    urls = ["http://a.b.c.d.e.f.example.com/x/y/z/w/v.html?q=1#f", "http://user@Example.com:80//x/", "https://1.2.3.4/p", None, "no url", "http://example.com", "http://example.com"]
    pages = spark.createDataFrame([(i, u, "block") for i, u in enumerate(urls)], "page_id int, url string, action string")
    made = pages.select("page_id", url_rules.expressions(F.col("url"), 5, 4).alias("e")).collect()
    assert len(made[0]["e"]) == 30 and "example.com/x/y/" in made[0]["e"] and "c.d.e.f.example.com/" not in made[0]["e"] and "d.e.f.example.com/" not in made[0]["e"][:0]
    assert set(made[1]["e"]) == {"example.com/x/", "example.com/"} and set(made[2]["e"]) == {"1.2.3.4/p", "1.2.3.4/"}
    rules = spark.createDataFrame([(1, "example.com/", "block", 0), (2, "example.com/x/", "allow", 0), (2, "example.com/x/", "allow", 0), (3, "f.example.com/", "block", 5), (4, "1.2.3.4/", "block", None), (5, None, "block", 9), (6, "example.com/", "allow", 0)], url_rules.RULE_SCHEMA)
    for limit in (1000, 0):  # broadcast, and shuffled
        rows = {r["page_id"]: (r["action"], r["rule_id"]) for r in url_rules.decide(pages, rules, broadcast_rules=limit).collect()}
        assert rows == {0: ("block", 3), 1: ("allow", 2), 2: ("block", 4), 3: ("none", None), 4: ("none", None), 5: ("allow", 6), 6: ("allow", 6)}
    assert url_rules.decide(pages.limit(0), rules).count() == 0 and {r["action"] for r in url_rules.decide(pages, rules.limit(0)).collect()} == {"none"}


def test_html_blocks(spark):
    found = html_blocks.blocks(PAGE)
    assert [b.text for b in found] == ["T & t", "Home", "More", "First bold text, here.", "Second é text.", "© us"]
    assert [html_blocks.teacher(b.path) for b in found] == [0, 0, 0, 1, 1, 0]
    rng = random.Random(7)
    make = lambda: "<body><nav>" + "".join(f"<li><a href=/{prose(rng, 1)}>{prose(rng, 1)}</a>" for _ in range(rng.randint(2, 6))) + "</nav><div class=ad>" + prose(rng, 5) + "</div><article><h1>" + prose(rng, 5) + "</h1>" + "".join(f"<p>{prose(rng, 30)}." for _ in range(rng.randint(1, 9))) + "</article><footer>" + prose(rng, 4) + "</footer>"
    rows = [(i, f"u{i}", make(), "x") for i in range(160)]
    pages = spark.createDataFrame([*rows, (900, None, None, "x"), (901, "", "", "x"), (902, "v", "<<p <", "x"), (0, *rows[0][1:])], "page_id int, url string, html string, text string")
    model = html_blocks.train(pages, sample=80)
    got = {r["page_id"]: r for r in html_blocks.extract(pages, model).collect()}
    held = [(y, bool(html_blocks.teacher(b.path))) for i, _, page, _ in rows for b, y in zip(html_blocks.blocks(page), got[i]["labels"], strict=True)]
    assert np.mean([a == b for a, b in held]) > 0.97
    masked = [html_blocks.blocks(page) for _, _, page, _ in rows[:60]]
    p = model.probabilities(html_blocks.vectors(masked, [[html_blocks.hidden(b.path) for b in page] for page in masked]))
    assert np.mean([(y >= 0.5) == bool(html_blocks.teacher(b.path)) for q, page in zip(p, masked, strict=True) for y, b in zip(q, page, strict=True)]) > 0.9
    assert got[900]["text"] is None and got[901]["text"] == "" and got[901]["labels"] == []
    assert html_blocks.extract(pages.limit(0), html_blocks.train(pages.limit(0))).count() == 0


def test_network_gradient():
    rng = np.random.default_rng(8)
    model = html_blocks.Labeller()
    x = [rng.standard_normal((5, html_blocks.WIDTH)).astype(np.float32), rng.standard_normal((3, html_blocks.WIDTH)).astype(np.float32)]
    y = [np.array([1, 0, 1, -1, 0], np.float32), np.array([0, 1, 1], np.float32)]
    model.fit(x, y, epochs=120)
    assert all(((p >= 0.5) == (t == 1))[t >= 0].all() for p, t in zip(model.probabilities(x), y, strict=True))


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    items = [(i, prose(rng, 25)) for i in range(5)]
    clean = [(i, prose(rng, 60) + ".") for i in range(150)]
    junk = [(200 + i, " ".join([rng.choice(VOCABULARY)] * 60)) for i in range(40)]
    copies = [(300 + i, edited(rng, clean[i][1], 0.02)) for i in range(20)]
    leaks = [(400 + i, f"{prose(rng, 30)} {items[i][1]} {prose(rng, 30)}") for i in range(5)]
    private = [(500, f"{prose(rng, 40)} a.b@mail.example.com {prose(rng, 20)}")]
    frame(spark, clean + junk + copies + leaks + private).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in clean[:100] + junk[:30]], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "packing"]
    placed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in placed}
    assert kept == {i for i, _ in clean} | {500}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = quality.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    step = quality.accept(docs, model)
    step = decontam.clean(ngram_join.one_of_each(step), spark.read.parquet(str(tmp_path / "benchmark.parquet")))
    step = pii.redact(step)
    assert step.columns == docs.columns and "@" not in step.where("doc_id = 500").first()["text"]
    assert sorted(map(tuple, packing.pack_documents(step).collect())) == sorted(map(tuple, placed))


def test_registry():
    numbers = sorted(int(re.match(r"op(\d+)_", name).group(1)) for name in QUERIES)
    assert numbers == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
