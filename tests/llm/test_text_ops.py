"""Operators over texts: token counts, fingerprints, quality, packing, personal data."""

import random
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relgraph.llm import fingerprints, packing, pii, quality, token_counts
from relgraph.llm import textops as tx

tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ODD = "doc_id bigint, text string, sketch int, n_tokens string, score string, words string"


@pytest.fixture(scope="module")
def encoder():
    return token_counts.Encoder()


def odd_docs(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one two three four five six seven"), (4, "one two three four five six seven"), (None, "one two"), (5, "word " * 30000)]
    return spark.createDataFrame([(i, t, 1, "x", None, "y") for i, t in rows], ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab'slvretdm 12\n\t.!é日ß²😀 ", max_size=25), max_size=6))
def test_prefix_counts_are_encodings(encoder, texts):
    true = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    counts, begins = encoder.prefix_counts(texts)
    for text, begin in zip(texts, begins.tolist(), strict=False):
        assert [int(counts[begin + i]) for i in range(len(text))] == [len(true.encode_ordinary(text[: i + 1])) for i in range(len(text))]
    assert encoder.totals(texts) == [len(true.encode_ordinary(t)) for t in texts]


def test_long_pieces(encoder):
    true = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    text = "".join(random.Random(1).choice("abcé") for _ in range(300)) + " " * 50 + "x"
    counts, _ = encoder.prefix_counts([text])
    assert all(counts[i] == len(true.encode_ordinary(text[: i + 1])) for i in range(0, len(text), 7))


def test_token_rows(spark):
    rows = token_counts.prefix_counts(odd_docs(spark)).withColumn("c", token_counts.chars_within(F.col("prefix_tokens"), 3)).withColumn("at", token_counts.tokens_at(F.col("prefix_tokens"), F.lit(3)))
    got = rows.collect()
    assert got[0]["n_tokens"] is None and got[0]["prefix_tokens"] is None
    assert got[1]["n_tokens"] == 0 and got[1]["prefix_tokens"] == [0]
    assert got[3]["n_tokens"] == 7 and got[3]["c"] == len("one two three") and got[3]["at"] == 1 and got[3] == got[4]
    assert len(got[6]["prefix_tokens"]) == 150001
    assert token_counts.prefix_counts(odd_docs(spark).limit(0)).count() == 0


def test_sketches(spark):
    every = {r["doc_id"]: r for r in fingerprints.sketches(odd_docs(spark), scale=1).collect()}
    assert every[1]["sketch"] is None and every[1]["n_shingles"] is None and every[2]["sketch"] == [] and every[3]["n_shingles"] == 0
    assert every[4]["n_shingles"] == 3 and len(every[4]["sketch"]) == 3 and every[None]["n_shingles"] == 1
    words = [f"w{i}" for i in range(4000)]
    docs = spark.createDataFrame([(1, " ".join(words[:1000])), (2, " ".join(words)), (3, " ".join(words[1000:]))], "doc_id int, text string")
    s = fingerprints.sketches(docs, scale=8)
    one, two = s.where("doc_id = 1").select(F.col("sketch").alias("a")), s.where("doc_id = 2").select(F.col("sketch").alias("b"))
    assert one.join(two).select(fingerprints.containment(F.col("a"), F.col("b")).alias("c")).first()["c"] == 1.0
    share = two.join(one).select(fingerprints.containment(F.col("b"), F.col("a")).alias("c")).first()["c"]
    assert abs(share - 0.25) < 0.08
    merged = fingerprints.merge(s.where("doc_id <> 2").withColumn("k", F.lit(1)), "k").first()["sketch"]
    assert set(merged) <= set(two.first()["b"]) and len(merged) > 0.95 * len(two.first()["b"])


def brute_pack(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(room, i) for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40), st.data())
def test_plan_is_best_fit_decreasing(capacity, data):
    lengths = data.draw(st.lists(st.integers(1, capacity), max_size=60))
    runs = packing.plan([(n, lengths.count(n)) for n in set(lengths)], capacity)
    used, taken = {}, []
    for length, low, high, per, first, offset in runs:
        for k in range(high - low):
            used.setdefault(first + k // per, []).append((offset + k % per * length, length))
        taken += [length] * (high - low)
    assert sorted(taken) == sorted(lengths)
    for spans in used.values():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in s) for s in used.values()) == brute_pack(lengths, capacity)


def test_pack_rows(spark):
    rng = random.Random(2)
    lengths = [rng.choice([1, 5, 9, 16, 40]) for _ in range(300)]
    docs = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)] + [(7, lengths[7], "x"), (900, 0, "x"), (901, None, "x")], "doc_id bigint, n_tokens int, window_id string")
    rows = packing.pack(docs, 16).collect()
    pieces = [n for n in [*lengths, lengths[7]] for n in [16] * (n // 16) + [n % 16] if n]
    assert sorted(r["piece_tokens"] for r in rows) == sorted(pieces)
    rooms = {}
    for r in sorted(rows, key=lambda r: (r["window_id"], r["window_offset"])):
        assert r["window_offset"] == rooms.get(r["window_id"], 0)
        rooms[r["window_id"]] = r["window_offset"] + r["piece_tokens"]
    assert sorted(16 - v for v in rooms.values()) == brute_pack(pieces, 16)
    assert packing.pack(docs.limit(0), 16).count() == 0
    assert {r["doc_id"] for r in packing.pack_documents(odd_docs(spark), 64).collect()} == {3, 4, 5, None}


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail bob (at) example (dot) com now", "email", "bob (at) example (dot) com"),
        ("b​ob@exаmple.com", "email", "b​ob@exаmple.com"),
        ("jane [at] mail [dot] example [dot] org", "email", "jane [at] mail [dot] example [dot] org"),
        ("call five five five one two three four five six seven now", "phone", "five five five one two three four five six seven"),
        ("ring ０１７０１２３４５６７.", "phone", "０１７０１２３４５６７"),
        ("card 4111 1111 1111 1111 ok", "card", "4111 1111 1111 1111"),
        ("at 10.0.0.1.", "ip", "10.0.0.1"),
        ('token = "abcdef123456"', "secret", "abcdef123456"),
        ("my ssn 123-45-6789", "ssn", "123-45-6789"),
        ("DE89 3704 0044 0532 0130 00 end", "iban", "DE89 3704 0044 0532 0130 00"),
    ],
)
def test_pii_maps_back(text, kind, found):
    import pyarrow as pa

    spans = pii.spans(text)
    assert [(k, text[a:b]) for k, a, b in spans] == [(kind, found)]
    assert pii.batch_spans(pa.array([None, "", text, "we met at example.com, one two and three of 1234 at 1.2.3.4.5"])) == [[], [], spans, []]


def test_pii_rows(spark):
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(9, "x a@b.de y", 1, "x", None, "y")], ODD)).withColumn("n_chars", F.length("text"))
    rows = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert rows[1]["text"] is None and rows[9]["text"] == "x [EMAIL] y" and tuple(rows[9]["spans"][0]) == ("email", 2, 8)
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.where("doc_id = 9").first()["n_chars"] == 11 and out.count() == docs.count()
    assert pii.find(docs.limit(0)).count() == 0


def test_quality_learns(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    good = [" ".join(word() for _ in range(rng.randint(20, 90))) + "." for _ in range(300)]
    bad = [" ".join([word()] * 20 + [word() for _ in range(20)]) if i % 2 else " ".join(word().upper() + "!!" for _ in range(40)) for i in range(150)]
    rows = [(i, t, 1 if i < 300 else 0) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows if i % 3] + [(None, 1, 0), (2, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels)
    scored = {r["doc_id"]: r["accepted"] for r in quality.score(docs, model).collect()}
    held = [(scored[i], y) for i, _, y in rows if i % 3 == 0]
    assert np.mean([a == bool(y) for a, y in held]) > 0.97
    odd = odd_docs(spark)
    assert quality.score(odd, model).count() == odd.count() and quality.accept(odd, model).columns == odd.columns
    none = quality.train(docs, labels.limit(0))
    assert quality.accept(odd, none).count() == odd.count() and quality.score(odd.limit(0), model).count() == 0


def test_quality_rejects_toxic(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(600):
        words = [word() for _ in range(60)]
        if i % 5 == 0:
            for at in rng.sample(range(60), 3):
                words[at] = rng.choice(["vile", "foul", "nasty"])
        rows.append((i, " ".join(words) + ".", int(i % 5 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i % 3], "doc_id bigint, quality int, toxic int")
    accepted = {r["doc_id"]: r["accepted"] for r in quality.score(docs, quality.train(docs, labels)).collect()}
    held = [(accepted[i], y) for i, _, y in rows if i % 3 == 0]
    assert np.mean([not a for a, y in held if y]) > 0.9 and np.mean([a for a, y in held if not y]) > 0.95


def test_features_handle_edges():
    x = quality.features([None, "", "a", "!!! ###", "x" * 5000, "a\n" * 3])
    assert np.isfinite(x).all()


def test_words_and_grams():
    hashes, begins = tx.words(["One two", None, "", "two ONE!"])
    assert begins.tolist() == [0, 2, 2, 2, 4] and hashes[0] == hashes[3] and hashes[1] == hashes[2]
    assert len(tx.grams(hashes[:2], 5)) == 1 and len(tx.grams(hashes[:0], 2)) == 0


def test_totals_are_those_of_the_prefix_programme():
    enc, rng = token_counts.encoder(token_counts.RANKS_FILE), random.Random(4)
    letters = "ab'' ''sdmtlrve\n\t    é字5٣½!?.,-_́ः😀\x1c\x85\r\u200bßǅ𝒜𝟘Ⅷ²the"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(3000)] + ["a" * 3000]
    counts, begins = enc.prefix_counts(texts)
    assert enc.totals([*texts, None, ""]) == [*counts[begins[1:] - 2].tolist(), None, 0]
    assert all(enc.count(w.encode()) == enc.byte_counts(w.encode())[-1] for text in texts[:300] for words in token_counts.split(text) for w in words)


def test_new_pretokens_are_merged_together():
    enc, rng, calls = token_counts.Encoder(), random.Random(6), []
    words = ["".join(rng.choice("aeinrstzé") for _ in range(rng.randint(6, 14))) for _ in range(4000)]
    each = [enc.count(w.encode()) for w in words]
    enc.totals(["tables made once"])
    sys.setprofile(lambda frame, event, _: calls.append(frame.f_code.co_name) if event == "call" else None)
    try:
        totals = enc.totals([" " + " ".join(words[i : i + 100]) for i in range(0, 4000, 100)])
    finally:
        sys.setprofile(None)
    assert totals == [sum(enc.count((" " + w).encode()) for w in words[i : i + 100]) for i in range(0, 4000, 100)]
    assert len(calls) < len(words)  # none for each
    odd = ["".join(rng.choice("aaeinrst' .é日😀\n") for _ in range(rng.randint(1, 14))) for _ in range(4000)] + ["a" * n for n in range(1, 60)]
    assert enc.counts(words).tolist() == each and enc.counts(odd).tolist() == [enc.count(w.encode()) for w in odd] and enc.counts([]).tolist() == []


@pytest.mark.parametrize(("whole", "chars", "few", "long"), [(300_000, 4_000_000, 1 << 16, 1 << 20), (20, 4_000_000, 9, 64), (300_000, 30, 9, 16)])
def test_totals_by_parts_between_blanks(monkeypatch, whole, chars, few, long):
    for name, value in (("_CACHE_WHOLE", whole), ("_CACHE_CHARS", chars), ("_FEW", few), ("_LONG", long), ("_MANY", 2 * long)):
        monkeypatch.setattr(token_counts, name, value)
    enc, rng = token_counts.Encoder(), random.Random(7)
    true = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    pieces = [" ", " ", "  ", "\n", " \n", "\t", "\xa0", "　", "'s", "'ll", "'", "the", "of,", "Word", "zqx", "日本語", "12", "½", "!?", "é", "(a)"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [" ", "  ", "a ", " a", "\n a", "a \n", " \n" * 50, "x" * 200, " x" * 200, "日" * 100]
    assert enc.totals([*texts, None]) == [*(len(true.encode_ordinary(t)) for t in texts), None]
    assert all(enc.totals([t]) == [len(true.encode_ordinary(t))] for t in texts[::25])
