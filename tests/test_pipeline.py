import json

from pyspark.sql import functions as F

from textgrove.operators import evaluate, graph, search, tree, vectors
from textgrove.plans.build import build
from textgrove.sources import corpus

TEXT = "Preamble here. agree as follows:\nARTICLE I Things\nSection 1.1 First. Alpha beta gamma. Delta.\nSection 1.2 Second. Epsilon zeta.\nARTICLE II More\nSection 2.1 Third. Eta theta iota.\n"


def test_build(spark, tmp_path):
    (tmp_path / "c/x").mkdir(parents=True)
    (tmp_path / "c/x/a b.txt").write_bytes(TEXT.replace("\n", "\r\n").encode())
    (tmp_path / "c/x/none.txt").write_text(" ")
    (tmp_path / "b.json").write_text(json.dumps({"tests": [{"query": "q", "snippets": [{"file_path": "x/a b.txt", "span": [0, 4], "answer": "Prea"}], "tags": ["t"]}]}))
    tests, snippets = corpus.read_benchmark(spark, str(tmp_path / "b.json"), "named")
    assert tests.first()["tags"] == ["named"] and snippets.first()["span"] == (0, 4)
    raw = corpus.read_corpus(spark, str(tmp_path / "c"), snippets)
    assert [r["file_path"] for r in raw.collect()] == ["x/a b.txt"]
    everything = corpus.read_corpus(spark, str(tmp_path / "c")).withColumn("doc_id", F.md5("file_path"))
    docs, chunks, nodes, edges = build(everything)
    rows = chunks.collect()
    assert {r["name"] for r in rows if r["is_leaf"]} >= {"Section 1.1 First. Alpha beta gamma. Delta.", "Section 2.1 Third. Eta theta iota."}
    text = TEXT
    for r in rows:
        if r["is_leaf"]:
            assert text[r["span_abs"]["start"] : r["span_abs"]["end"]] == r["content"]
        assert r["summary"] is not None
    assert graph.repeated_ids(nodes).isEmpty() and docs.count() == 2
    e = {tuple(r) for r in edges.collect()}
    assert all((d, s, "PREV") in e for s, d, t in e if t == "NEXT")
    graph.write_graph(nodes, edges, str(tmp_path / "g"))
    graph.write_graph(nodes, edges, str(tmp_path / "g"))
    n2, _ = graph.read_graph(spark, str(tmp_path / "g"))
    assert n2.count() == nodes.count()
    new = nodes.limit(1).withColumn("name", F.lit("changed"))
    assert graph.upsert_nodes(nodes, new).where("name = 'changed'").count() == 1
    name = corpus.fingerprint(everything, "file_path", "content")
    made = corpus.cached(spark, str(tmp_path / name), lambda: everything)
    assert made.count() == 2 and corpus.cached(spark, str(tmp_path / name), lambda: 1 / 0).count() == 2


def test_metric(spark):
    s = "test_id long, pos int, file_path string, span struct<start:int,end:int>"
    truth = spark.createDataFrame([(1, 0, "f", (0, 10)), (2, 0, "f", (0, 5)), (2, 1, "f", (5, 9)), (2, 1, "f", (5, 9)), (3, 0, None, None)], s)
    found = spark.createDataFrame([(1, 1, "f", (5, 15)), (1, 2, "f", (30, 20)), (4, 1, "f", (0, 3))], s.replace("pos", "rank"))
    got = {r[0]: (r[1], r[2]) for r in evaluate.precision_recall(truth, found).collect()}
    assert got == {1: (0.25, 0.5), 2: (0.0, 0.0), 4: (0.0, 0.0)}
    assert [(r["test_id"], r["s"]) for r in evaluate.disjointness(truth).collect()] == [(2, 5)]
    assert [r["score"] for r in evaluate.rank_scores(found).where("test_id = 1").orderBy("place").collect()] == [1.0, 0.5]
    mean = evaluate.weighted_mean(evaluate.precision_recall(truth, found)).first()
    assert abs(mean[0] - 0.25 / 3) < 1e-9
    assert evaluate.weighted_mean(evaluate.precision_recall(truth.limit(0), found.limit(0))).first()[0] is None


def test_results(spark, tmp_path):
    s = "test_id long, rank int, file_path string, span struct<start:int,end:int>"
    found = spark.createDataFrame([(1, 1, "f", (5, 15))], s)
    truth = found.withColumnRenamed("rank", "pos")
    scores = evaluate.precision_recall(truth, found)
    corpus.write_results(scores, evaluate.rank_scores(found), evaluate.weighted_mean(scores), str(tmp_path))
    assert spark.read.json(f"{tmp_path}/summary.json").first()["average_recall"] == 1.0
    assert spark.read.json(f"{tmp_path}/results.json").first()["retrieved"][0]["file_path"] == "f"


def test_locate(spark):
    contracts = spark.createDataFrame([("d", "p/f.txt", "abcabc", 10), ("n", None, None, None)], "doc_id string, file_path string, content string, file_offset int")
    chunks = spark.createDataFrame([("1", "d", "x", "bc"), ("2", "d", "x", ""), ("3", "d", "x", "zz"), ("4", "d", "x", None), ("5", "n", "x", "a")], "chunk_id string, doc_id string, name string, content string")
    got = {r["chunk_id"]: (r["span_start"], r["span_end"]) for r in search.locate_spans(chunks, contracts).collect()}
    assert got == {"1": (11, 13), "2": (10, 10)}


def test_components_and_children(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (9, 8), (7, 7)], "a long, b long")
    assert {tuple(r) for r in vectors.components(edges).collect()} == {(i, 1) for i in range(1, 7)} | {(8, 8), (9, 8)}
    v = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate([(1, 0), (1, 0.1), (0, 1), (0, 0)])] + [(9, None), (None, [1.0, 0.0]), (1, [1.0, 0.1])], "id long, v array<double>")
    for block in (1, 2_048):
        assert {tuple(r) for r in vectors.single_linkage(v, 0.25, block).collect()} == {(0, 0), (1, 0), (2, 2), (3, 3), (9, 9)}
    rows = v.select(F.lit("p").alias("parent"), "id", "v").where("id is not null").distinct()
    q = spark.createDataFrame([(7, "p", [1.0, 0.0])], "query_id int, parent string, q array<double>")
    assert [(r["id"], r["rank"]) for r in vectors.child_topk(rows, q, 2).orderBy("rank").collect()] == [(0, 1), (1, 2)]


def test_query_set(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.9, 0.1]), (4, [0.0, 0.0]), (5, None), (6, [1.0]), (7, [-1.0, 0.0])], "id long, v array<double>")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (9, None), (8, [3.0])], "query_id long, q array<double>")
    got = {(r["query_id"], r["id"], r["rank"]) for r in vectors.query_topk(rows, asked, 1).collect()}
    assert got == {(1, 2, 1), (8, 6, 1)}
    assert vectors.query_topk(rows, asked.limit(0)).count() == vectors.query_topk(rows.limit(0), asked).count() == 0


def test_tree_rollups(spark):
    c = spark.createDataFrame(
        [("a", None, 0, 1, (0, 9), None, ""), ("b", "a", 1, 2, (9, 5), "B", " s "), ("c", "a", 0, 2, (2, 4), "C", None), ("d", "a", 0, 2, None, None, None)],
        "chunk_id string, parent_id string, ord int, depth int, span struct<start:int,end:int>, content string, summary string",
    ).withColumn("doc_id", F.lit("x"))
    assert tuple(tree.envelopes(c).first()) == ("a", 2, 9, 3)
    assert tree.content_roll_up(c).first()["text"] == "CB"
    assert tree.summary_roll_up(c).first()["text"] == "C\n\n\n\ns"
    assert {tuple(r) for r in tree.descendants(c).collect()} == {("a", x, 1) for x in "bcd"}
    pairs = graph.sibling_edges(c).where("type = 'NEXT'").collect()
    assert [(r["src"], r["dst"]) for r in sorted(pairs, key=lambda r: r["src"])] == [("c", "d"), ("d", "b")]
    assert tree.levels(c.limit(0)).count() == 0
