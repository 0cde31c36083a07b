"""The tool loop for many questions at once: a round of all questions is a few joins, whatever their number.

The log is a table of messages (test_id, seq, pos, kind, name, content): `user` the question, `call` a tool call with its
arguments in JSON, `tool` a tool's result, a JSON list, and `ai` a final message. A policy reads the log of the running
questions and returns their next calls; a question without calls has ended. Tools take calls and return results.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.models import Embedder, letter_counts
from ..session import cut
from .search import response_by_ids, search_children

LOG = "test_id bigint, seq int, pos int, kind string, name string, content string"
Policy = Callable[[DataFrame], DataFrame]
Tool = Callable[[DataFrame], DataFrame]
OVER_BUDGET = "The budget of tool rounds is used up."
RESPONSE = "ResponseTool"


def appended(log: DataFrame, update: DataFrame) -> DataFrame:
    """The log with the messages of update after those that are there."""
    return log.unionByName(update)


def run_rounds(questions: DataFrame, tools: dict[str, Tool], policy: Policy, budget: int = 5) -> DataFrame:
    """The log of all questions (test_id, query) when each has ended.

    A round asks the policy for the next calls (test_id, pos, name, args) of the running questions. Without calls a
    question ends with an empty message. With calls, it ends with a fixed message once `budget` rounds of tools have run,
    else all its calls are run; it ends after a round whose last call is the response tool. A call of an unknown tool
    raises. Null queries are asked as they are. One job a round and table; no rows end at once.
    """
    spark = questions.sparkSession
    message = lambda df, seq, kind, name, content, pos=F.lit(0): df.select(F.col("test_id").cast("bigint").alias("test_id"), F.lit(seq).alias("seq"), pos.cast("int").alias("pos"), F.lit(kind).alias("kind"), name.cast("string").alias("name"), content.cast("string").alias("content"))
    none = F.lit(None)
    log = cut(message(questions, 0, "user", none, F.col("query")), "log")
    running = cut(questions.select(F.col("test_id").cast("bigint").alias("test_id")).distinct(), "running")
    seq = 0
    for done in range(budget + 1):
        calls = cut(policy(log.join(running, "test_id", "left_semi")).select("test_id", F.col("pos").cast("int").alias("pos"), "name", "args"), "calls")
        ended = running.join(calls.select("test_id").distinct(), "test_id", "left_anti")
        seq += 1
        if done == budget:
            over = running.join(calls.select("test_id").distinct(), "test_id", "left_semi")
            return appended(appended(log, message(ended, seq, "ai", none, F.lit(""))), message(over, seq, "ai", none, F.lit(OVER_BUDGET)))
        named = {r[0] for r in calls.select("name").distinct().limit(len(tools) + 1).collect()}
        if named - set(tools):
            raise KeyError(f"no such tool: {sorted(map(str, named - set(tools)))}")
        results = [tools[n](calls.where(F.col("name") == n)).select("test_id", "pos", F.lit(n).alias("name"), "content") for n in sorted(named)]
        update = appended(message(ended, seq, "ai", none, F.lit("")), message(calls, seq, "call", F.col("name"), F.col("args"), F.col("pos")))
        if results:
            got = calls.select("test_id", "pos", "name").join(reduce(DataFrame.unionByName, results), ["test_id", "pos", "name"], "left")
            update = appended(update, message(got, seq + 1, "tool", F.col("name"), F.coalesce("content", F.lit("[]")), F.col("pos")))
        seq += 1
        log = appended(log, cut(update, "log"))
        last = calls.groupBy("test_id").agg(F.max_by("name", "pos").alias("last"))
        running = cut(last.where(F.col("last") != RESPONSE).select("test_id"), "running")
        if running.isEmpty():
            return log
    return log


def responses(log: DataFrame) -> DataFrame:
    """(test_id, place, file_path, name, span_start, span_end, score): the results of all response calls in the order of the messages, scored 1 / place."""
    rows = log.where((F.col("kind") == "tool") & (F.col("name") == RESPONSE))
    kind = "array<struct<file_path: string, span: array<bigint>, name: string, content: string>>"
    flat = rows.select("test_id", "seq", F.col("pos").alias("call"), F.posexplode(F.from_json("content", kind)).alias("at", "r"))
    place = F.row_number().over(Window.partitionBy("test_id").orderBy("seq", "call", "at"))
    return flat.withColumn("place", place).select("test_id", "place", "r.file_path", "r.name", F.get("r.span", F.lit(0)).alias("span_start"), F.get("r.span", F.lit(1)).alias("span_end"), (F.lit(1.0) / F.col("place")).alias("score"))


def _listed(rows: DataFrame, order: str, *fields: str) -> DataFrame:
    """(test_id, pos, content): the rows of each call in order, as a JSON list of fields."""
    item = F.struct(order, F.struct(*fields).alias("z"))
    held = rows.groupBy("test_id", "pos").agg(F.sort_array(F.collect_list(item)).alias("l"))
    return held.select("test_id", "pos", F.to_json(F.transform("l", lambda x: x["z"])).alias("content"))


def graph_tools(nodes: DataFrame, edges: DataFrame, contracts: DataFrame, embedder: Embedder = letter_counts, k: int = 5, threshold: float = 0.0) -> dict[str, Tool]:
    """The tools over a written graph: corpora by name, components and sub-components by similarity, spans by ids.

    The corpus tool takes a phrase and lists the corpora whose name, without its ending and with blanks for underscores,
    is that phrase: a list of all would be sent to every question.
    """
    corpora = nodes.where("label = 'Corpus'").select(F.col("id").alias("contract_id"), F.col("name").alias("contract_name"), F.regexp_replace(F.regexp_replace("name", r"\.txt$", ""), "_", " ").alias("phrase"))
    chunks = nodes.where("label = 'Chunk'").select(F.col("id").alias("chunk_id"), "name", "content", "file_path")

    def corpus(calls: DataFrame) -> DataFrame:
        asked = calls.select("test_id", "pos", F.get_json_object("args", "$.phrase").alias("phrase")).where("phrase <> ''")
        return _listed(asked.join(corpora, "phrase"), "contract_id", "contract_id", "contract_name")

    def search(prefix: str, leaf: bool) -> Tool:
        def tool(calls: DataFrame) -> DataFrame:
            asked = calls.select(F.struct("test_id", F.col("pos").alias("call")).alias("query_id"), F.get_json_object("args", "$.id").alias("id"), F.get_json_object("args", "$.query").alias("query"))
            found = search_children(asked, nodes, edges, embedder, k, threshold)
            names = {f"{prefix}{n}": F.col(f"component_{n}") for n in ("id", "name", "summary", *(["leaf"] if leaf else []))}
            rows = found.select("query_id.test_id", F.col("query_id.call").alias("pos"), F.col("pos").alias("rank"), *[c.alias(n) for n, c in names.items()])
            return _listed(rows, "rank", *names)

        return tool

    def respond(calls: DataFrame) -> DataFrame:
        asked = calls.select(F.struct("test_id", F.col("pos").alias("call")).alias("query_id"), F.from_json(F.get_json_object("args", "$.sub_component_ids"), "array<string>").alias("ids"))
        found = response_by_ids(asked, chunks, contracts.select("doc_id", "file_path", "content", "file_offset"))
        rows = found.select("query_id.test_id", F.col("query_id.call").alias("pos"), "place", "file_path", F.array("span_start", "span_end").alias("span"), "name", "content")
        return _listed(rows, "place", "file_path", "span", "name", "content")

    return {"SearchCorpusTool": corpus, "SearchComponentTool": search("component_", False), "SearchSubComponentTool": search("sub_component_", True), RESPONSE: respond}


def stepwise_policy(leaves: int = 2, pattern: str = "^Consider (.*?);") -> Policy:
    """Contract by the name in the question, its best component, that one's best leaves, their spans; deeper where the best sub-component has children of its own. It ends where a tool finds nothing."""

    def step(log: DataFrame) -> DataFrame:
        query = log.where("kind = 'user'").groupBy("test_id").agg(F.first("content").alias("query"))
        last = log.where("kind = 'tool'").groupBy("test_id").agg(F.max_by(F.struct("name", "content"), F.struct("seq", -F.col("pos"))).alias("m"))
        rows = query.join(last, "test_id", "left").select("test_id", "query", "m.name", "m.content")
        field = lambda path: F.get_json_object("content", path)
        ids = F.from_json("content", "array<struct<sub_component_id: string, sub_component_leaf: boolean>>")
        chosen = F.slice(F.transform(F.filter(ids, lambda x: x["sub_component_leaf"]), lambda x: x["sub_component_id"]), 1, leaves)
        down = lambda c: F.to_json(F.struct(c.alias("id"), "query"))
        first_leaf = F.get(ids, F.lit(0))["sub_component_leaf"]
        call = (
            F.when(F.col("name").isNull(), F.struct(F.lit("SearchCorpusTool").alias("name"), F.to_json(F.struct(F.regexp_extract("query", pattern, 1).alias("phrase"))).alias("args")))
            .when((F.col("name") == "SearchCorpusTool") & field("$[0].contract_id").isNotNull(), F.struct(F.lit("SearchComponentTool").alias("name"), down(field("$[0].contract_id")).alias("args")))
            .when((F.col("name") == "SearchComponentTool") & field("$[0].component_id").isNotNull(), F.struct(F.lit("SearchSubComponentTool").alias("name"), down(field("$[0].component_id")).alias("args")))
            .when((F.col("name") == "SearchSubComponentTool") & first_leaf, F.struct(F.lit(RESPONSE).alias("name"), F.to_json(F.struct(chosen.alias("sub_component_ids"))).alias("args")))
            .when((F.col("name") == "SearchSubComponentTool") & ~first_leaf, F.struct(F.lit("SearchSubComponentTool").alias("name"), down(field("$[0].sub_component_id")).alias("args")))
        )
        return rows.where("query is not null").select("test_id", F.lit(0).alias("pos"), call.alias("c")).where("c is not null").select("test_id", "pos", "c.name", "c.args")

    return step
