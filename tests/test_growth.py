"""Rows that no step may exceed: what joins give follows the input and the result, not their product."""

from collections import Counter

from pyspark.sql import functions as F

from relgraph.functions import text as tx
from relgraph.operators import graph, propagate, resolve, retrieve, scoring, slicing
from relgraph.plans import catalog


def most_rows(spark, run):
    """The result of ``run``, and the most rows that a step of its queries (those that it writes, too) gave."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    ids = lambda: [(x := every.apply(k)).executionId() for every in [store.executionsList()] for k in range(every.size())]
    before = max(ids(), default=-1)
    out = run()
    bus.waitUntilEmpty(30_000)
    most = 0
    for i in (i for i in ids() if i > before):
        metrics, values = store.execution(i).get().metrics(), store.executionMetrics(i).iterator()
        told = {}
        while values.hasNext():
            pair = values.next()
            told[pair._1()] = pair._2()
        for m in (metrics.apply(k) for k in range(metrics.size())):
            if m.name() == "number of output rows" and m.accumulatorId() in told:
                most = max(most, int(told[m.accumulatorId()].replace(",", "")))
    return out, most


def tried(df):
    """Whether a join tries pairs by a condition on their segments, instead of meeting them by equality."""
    return "forall(" in df._jdf.queryExecution().optimizedPlan().toString()


def test_routes_of_one_segment(spark):
    n = 1000
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("/en/"), "id", F.lit(".html")).alias("call"))
    routes = pages.select(F.col("call").alias("route")).union(spark.createDataFrame([("/en/*",), ("/*/7.html",), ("/*",)], "route string"))
    rows, most = most_rows(spark, lambda: resolve.matching_routes(pages, routes).collect())
    assert len(rows) == 3 * n + 1 and {r["route"] for r in rows if r["page_id"] == 7} == {"/en/7.html", "/en/*", "/*/7.html", "/*"}
    assert most < 10 * n and not tried(resolve.matching_routes(pages, routes))  # calls had been tried with all routes of their first segment


def test_route_links_of_one_segment(spark):
    n = 600
    nodes = spark.range(n).select(F.concat(F.lit("n"), "id").alias("path"), F.array(F.concat(F.lit("/en/r"), "id")).alias("http_routes"), F.array(F.concat(F.lit("/en/r"), F.col("id") + 1, F.lit("/x"))).alias("http_calls"))
    rows, most = most_rows(spark, lambda: graph.route_links(nodes).collect())
    assert len(rows) == n - 1 and most < 10 * n and not tried(graph.route_links(nodes))


def test_literal_stars_in_calls(spark):
    calls = spark.createDataFrame([(1, "/*/x"), (2, "/a/*"), (3, "/")], "page_id int, call string")
    routes = spark.createDataFrame([("/*/x",), ("/a/b",), ("/a/*",), ("/",), ("*",)], "route string")
    assert sorted((r["page_id"], r["route"]) for r in resolve.matching_routes(calls, routes).collect()) == [(1, "/*/x"), (2, "/a/*"), (3, "/")]


def test_large_directory(spark):
    n = 600
    paths = spark.range(n).select(F.format_string("/en/%04d", "id").alias("path"))
    links = paths.select(F.col("path").alias("page_id"), F.col("path").alias("own"), F.lit("/en").alias("href"))
    rows, most = most_rows(spark, lambda: resolve.directory_files(links, paths).collect())
    of = lambda p: sorted(r["path"] for r in rows if r["page_id"] == p)
    assert len(rows) == 12 * n and of("/en/0003") == [f"/en/{k:04d}" for k in range(13) if k != 3] and of("/en/0500") == [f"/en/{k:04d}" for k in range(12)]
    assert most < 20 * n  # n * n, when a link met all files of its directory


def test_small_file_of_many_rows(spark, tmp_path):
    spark.range(120_000).select(F.col("id").alias("p_partkey"), F.lit("blue gear").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("t").alias("p_type"), F.lit(1).alias("p_size")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert catalog.QUERIES["python_extract"](spark, str(tmp_path)).rdd.getNumPartitions() == 3  # one task had all of them


def test_terms_of_whole_texts(spark):
    texts = ["HTTPServer snake_case X1", "AB1 aBC1 ABc1D", "KKiss İX straße", "", None, "plain words, plain"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.terms(F.col("t")).alias("terms"), tx.term_counts(F.col("t")).alias("counts"), tx.term_set(F.col("t")).alias("set")).collect()
    for r in rows:
        assert (r["terms"] is None) == (r["counts"] is None) == (r["set"] is None)
        if r["terms"] is not None:
            assert {c["term"]: c["tf"] for c in r["counts"]} == Counter(r["terms"]) and sorted(r["set"]) == sorted(set(r["terms"]))


def test_parts_of_filenames(spark):
    n = 400
    nodes = spark.range(n).select(F.concat(F.lit("gears/BlueGear_"), "id").alias("path"))
    asked = spark.createDataFrame([(1, "gear"), (1, "lue"), (2, "zebra")], "query_id int, term string")
    rows, most = most_rows(spark, lambda: scoring.partial_terms(nodes, asked).collect())
    assert len(rows) == n and {(r["query_id"], r["term"]) for r in rows} == {(1, "lue")}
    assert most <= n  # names met their nodes again: eight rows for each


def test_contents_are_not_broadcast(spark, tmp_path):
    spark.range(3000).select(F.format_string("f%d.py", "id").alias("path")).write.parquet(str(tmp_path / "f"))
    contents = spark.read.parquet(str(tmp_path / "f")).withColumn("text", F.repeat(F.lit("x = 1\n"), 100))  # a small file, from which much is made
    asked = spark.createDataFrame([(1, "x")], "query_id int, query string")
    top = contents.where("path = 'f7.py'").select(F.lit(1).alias("query_id"), F.lit(1).alias("position"), "path")
    packed = slicing.pack(top, contents, asked)
    assert [r["path"] for r in packed.collect()] == ["f7.py"]
    assert "repeat(" not in packed._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[-1]


def test_knees_by_steps(spark):
    values = {1: [1.0, 0.9, 0.61, 0.36, 0.2, 0.1], 2: [1.0, 0.59, 0.1], 3: [1.0] * 5 + [0.601] * 4, 4: [0.3], 5: [1.0, 0.8, 0.8**2, 0.8**3, 0.8**5, 0.8**7, 0.8**10]}
    rows = spark.createDataFrame([(q, f"p{k}", v) for q, own in values.items() for k, v in enumerate(own)], "query_id int, path string, relevance double")
    for r in retrieve.knees(rows).collect():
        own = values[r["query_id"]]
        assert (r["knee"], r["qualified"], r["reached"]) == (next((k for k in range(1, len(own)) if own[k] < own[k - 1] * 0.6), len(own)), sum(v >= 0.15 for v in own), len(own))
    many = spark.range(20_000).select((F.col("id") % 2).alias("query_id"), F.col("id").cast("string").alias("path"), (1 / (1 + F.col("id") / 2000)).alias("relevance"))
    found = retrieve.knees(many)
    assert [r["knee"] for r in found.collect()] == [10_000, 10_000]
    assert "lag(low" in found._jdf.queryExecution().optimizedPlan().toString()  # of steps; a window had all rows of a query


def test_reasons_of_the_asked(spark):
    n = 1000
    edges = spark.range(n).select(F.lit("hub").alias("src"), F.concat(F.lit("n"), "id").alias("dst"), F.lit(5).alias("weight"), F.array(F.lit("calls")).alias("relations"))
    best = edges.select(F.lit(1).alias("query_id"), F.col("dst").alias("path"), F.lit(0.5).alias("relevance")).union(spark.createDataFrame([(1, "hub", 1.0)], "query_id int, path string, relevance double"))
    seeds = best.where("path = 'hub'").withColumn("seed_rank", F.lit(1))
    whole = {r["path"]: r["reason"] for r in propagate.reasons(edges, best, seeds).collect()}
    some = propagate.reasons(edges, best, seeds, best.where("path IN ('hub', 'n7')").select("query_id", "path"))
    assert len(whole) == n + 1 and {r["path"]: r["reason"] for r in some.collect()} == {k: whole[k] for k in ("hub", "n7")} == {"hub": "direct metadata match", "n7": "linked → hub (w=5, calls)"}
