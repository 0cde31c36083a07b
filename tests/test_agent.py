import json
import logging

import pytest
from pyspark.sql import functions as F

from textgrove.functions import prompts
from textgrove.operators import agent, evaluate, graph, search
from textgrove.plans.build import BuildConfig, build
from textgrove.sources import records

CALLS = "test_id long, pos int, name string, args string"


def fixed(spark, script):
    """A policy that makes script[round] for every running question."""
    rounds = iter(script)

    def policy(log):
        calls = next(rounds)
        ids = log.select("test_id").distinct()
        return ids.crossJoin(spark.createDataFrame([(i, n, "{}") for i, n in enumerate(calls)], "pos int, name string, args string")).select("test_id", "pos", "name", "args")

    return policy


def echo(calls):
    return calls.select("test_id", "pos", F.lit('[{"file_path": "f", "span": [1, 2], "name": "n", "content": "c"}]').alias("content"))


TOOLS = {"ResponseTool": echo, "Other": echo}


def kinds(log, test_id):
    rows = log.where(F.col("test_id") == test_id).orderBy("seq", "pos").collect()
    return [(r["kind"], r["name"]) if r["kind"] != "ai" else ("ai", r["content"]) for r in rows]


def questions(spark, n=2):
    return spark.createDataFrame([(i, f"q{i}", "x") for i in range(n)], "test_id long, query string, name string")


def test_budget(spark):
    log = agent.run_rounds(questions(spark), TOOLS, fixed(spark, [["Other"]] * 3), budget=2)
    assert kinds(log, 1) == [("user", None), ("call", "Other"), ("tool", "Other"), ("call", "Other"), ("tool", "Other"), ("ai", agent.OVER_BUDGET)]


def test_end_rule(spark):
    log = agent.run_rounds(questions(spark), TOOLS, fixed(spark, [["ResponseTool", "Other"], ["Other", "ResponseTool"], ["Other"]]))
    assert [k for k, _ in kinds(log, 0)] == ["user", "call", "call", "tool", "tool", "call", "call", "tool", "tool"]
    got = agent.responses(log).where("test_id = 0").orderBy("place").collect()  # those of the mixed round count too
    assert [(r["place"], r["file_path"], r["span_start"], r["span_end"], r["score"]) for r in got] == [(1, "f", 1, 2, 1.0), (2, "f", 1, 2, 0.5)]


def test_no_calls_and_unknown_tools(spark):
    log = agent.run_rounds(questions(spark), TOOLS, lambda log: spark.createDataFrame([], CALLS))
    assert kinds(log, 0) == [("user", None), ("ai", "")]
    assert agent.run_rounds(questions(spark, 0), TOOLS, lambda log: spark.createDataFrame([], CALLS)).count() == 0
    with pytest.raises(KeyError):
        agent.run_rounds(questions(spark), TOOLS, fixed(spark, [["Nothing"]]))


def small_graph(spark):
    contracts = spark.createDataFrame([("d1", "x/Red_Deed.txt", "aaa bbb ccc", None, 0, "odd")], "doc_id string, file_path string, content string, toc_json string, file_offset int, name string")
    rows = [("p", "d1", None, None, 0, 1, "part", None, "", None), ("l1", "d1", "f1", "p", 0, 2, "one", "aaa", None, (0, 3)), ("l2", "d1", None, "p", 1, 2, "two", "bbb", " ", (7, 4)), ("l3", "d1", None, "p", 2, 2, "three", None, None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, file_path string, parent_id string, ord int, depth int, name string, content string, summary string, span struct<start: int, end: int>")
    return contracts, chunks


def test_nodes_and_search(spark):
    contracts, chunks = small_graph(spark)
    nodes = graph.with_vectors(graph.nodes(contracts, chunks), lambda texts: [[float(t.count(c)) for c in "abc"] for t in texts])
    assert nodes.dtypes == spark.createDataFrame([], graph.NODE).dtypes
    held = {r["id"]: r for r in nodes.collect()}
    assert held["d1"]["name"] == "Red_Deed.txt" and held["d1"]["vector"] == [3.0, 3.0, 3.0] and held["p"]["vector"] is None and not held["p"]["leaf"]
    assert held["l2"]["span"] == [4, 7] and held["l2"]["file_path"] == "x/Red_Deed.txt" and held["l1"]["file_path"] == "f1" and held["l2"]["vector"] == [0.0, 3.0, 0.0]
    edges = graph.child_edges(chunks)
    asked = spark.createDataFrame([(1, "p", "abb"), (2, "none", "a"), (3, "p", None)], "query_id int, id string, query string")
    got = search.search_children(asked, nodes, edges, lambda texts: [[float(t.count(c)) for c in "abc"] for t in texts]).orderBy("pos").collect()
    assert [(r["query_id"], r["component_id"], r["component_leaf"], r["component_summary"]) for r in got] == [(1, "l2", True, " "), (1, "l1", True, "aaa")]
    ids = spark.createDataFrame([(1, ["l2", "l1", "l2", "unknown", None, "l3"])], "query_id int, ids array<string>")
    got = search.response_by_ids(ids, chunks.select("chunk_id", "doc_id", "name", "content"), contracts).orderBy("place").collect()
    assert [(r["place"], r["chunk_id"], r["span_start"], r["span_end"]) for r in got] == [(1, "l2", 4, 7), (2, "l1", 0, 3)]


def test_violations_raise(spark):
    rows = [(1, 0, "f", (0, 5)), (1, 1, "f", (5, 9))]
    schema = "test_id long, pos int, file_path string, span struct<start: int, end: int>"
    with pytest.raises(ValueError):
        evaluate.require_disjoint(spark.createDataFrame(rows, schema))
    assert evaluate.require_disjoint(spark.createDataFrame(rows[:1], schema)).count() == 1


def test_prompts(spark):
    def broken(name):
        raise OSError

    assert prompts.prompt("toc", broken) == prompts.prompt("toc") and prompts.prompt("toc", lambda n: "own") == "own"
    df = spark.createDataFrame([("a{b}", None)], "x string, y string")
    assert df.select(prompts.filled("<{x}|{y}|{z}>", x="x", y="y")).first()[0] == "<a{b}||{z}>"


def test_records(spark, tmp_path):
    log = records.logger(str(tmp_path), "records-test")
    records.logger(str(tmp_path), "records-test").info("said")
    assert len(log.handlers) == 2 and log.level == logging.INFO and "said" in next(tmp_path.glob("*.log")).read_text()
    seen = []
    with records.progress(spark, lambda done, all_: seen.append((done, all_)), 0.05):
        spark.range(100).count()
    assert seen and len(records.stamp()) == 15


def test_build_reads_its_cache(spark, tmp_path):
    text = "Preamble follows: ARTICLE I One\nfirst sentence here.\nARTICLE II Two\nsecond sentence there."
    raw = spark.createDataFrame([("d", "x/a.txt", text)], "doc_id string, file_path string, content string")
    asked = tmp_path / "asked"

    def outline(texts):
        with asked.open("a") as f:
            f.write("x")
        return [json.dumps({"A": {"b": {"start_sentence": "first sentence", "end_sentence": "here."}, "c": {"start_sentence": "second sentence", "end_sentence": "there."}}}) for _ in texts]

    config = BuildConfig(boundary_model=outline, cache=str(tmp_path / "cache"), summary_concurrency=2)
    first = [sorted(map(str, df.collect())) for df in build(raw, config)]
    n = len(asked.read_text())
    again = [sorted(map(str, df.collect())) for df in build(raw, config)]
    assert first == again and len(asked.read_text()) == n
    inner = build(raw, config)[1].where("not is_leaf").first()
    assert inner["content"].startswith("first sentence here.") and "second sentence" in inner["content"]
    vectors = {r["label"]: r["vector"] for r in build(raw, config)[2].collect()}
    assert vectors["Corpus"] is not None and len(vectors["Corpus"]) == 26
