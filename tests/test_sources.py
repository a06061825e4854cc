"""The tree's two modes agree, the stream carries state from batch to batch, and a cluster needs a shared folder."""

from types import SimpleNamespace

import pytest

from relgraph import storage
from relgraph.operators import propagate
from relgraph.sources.tree import read_tree
from relgraph.streaming import sync


def test_both_modes_leave_binaries_out(spark, tmp_path):
    (tmp_path / "bin.py").write_bytes(b"x = 1\0\n")
    (tmp_path / "a.py").write_text("x = 1\n")
    for content in (True, False):
        assert [r["path"] for r in read_tree(spark, str(tmp_path), content).collect()] == ["a.py"]


def test_stream_batches(spark, tmp_path):
    state = lambda *rows: spark.createDataFrame(rows, sync.SCHEMA)
    first = state(("a", 1, 1.0, "h", False), ("b", 2, 1.0, "h", None), ("b", 3, 2.0, "i", None), (None, 1, 1.0, "h", False))
    second = state(("a", 1, 2.0, "h", True), ("c", 5, 2.0, "k", False), ("d", 6, 2.0, "k", False), ("d", 6, 2.0, "k", True))
    for batch, k in ((first, 0), (second, 1), (second, 1)):
        sync.apply_batch(batch, k, str(tmp_path))
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/v1").select("path", "size").collect()} == {("b", 3), ("c", 5)}


def test_a_cluster_needs_a_shared_folder(spark):
    other = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        storage.cut(SimpleNamespace(sparkSession=other))


@pytest.mark.parametrize("merge", [1, 8])
def test_spread_is_the_fixpoint(spark, monkeypatch, merge):
    monkeypatch.setattr(propagate, "MERGE", merge)
    edges = [(f"n{i}", f"n{i + 1}", 9) for i in range(12)] + [("n0", "n6", 5), ("n12", "n0", 1)]
    rows = propagate.spread(spark.createDataFrame(edges, "src string, dst string, weight int"), spark.createDataFrame([(1, "n0", 1.0), (1, "n9", 0.5)], "query_id int, path string, relevance double"), spark.createDataFrame([(1, 0.2)], "query_id int, cutoff double"))
    want = {"n0": 1.0, "n9": 0.5}
    while True:
        more = dict(want)
        for a, b, w in [*edges, *((b, a, w) for a, b, w in edges)]:
            if a in more and (v := more[a] * min(0.95, w / 10)) >= 0.2 and v > more.get(b, 0) + 1e-9:
                more[b] = v
        if more == want:
            break
        want = more
    got = {r["path"]: r["relevance"] for r in rows.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
