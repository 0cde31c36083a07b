"""Queries of the retrieval pipeline, each with the SQL that defines its result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import found_at, model_json, newlines, split_at_marker
from ..functions.windows import find_range, letters
from ..functions.models import letter_counts
from ..operators import agent, evaluate, graph, search, tree, vectors
from ..session import cut, shared_dir
from ..sources.tables import leaf_rows, table

_K = 'k AS (SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY summary IS NOT NULL DESC, ingested_at DESC) = 1)'
_C = "c AS (SELECT * FROM contracts WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC) = 1)"
_SPAN = 'least(span."start", span."end") AS s, greatest(span."start", span."end") AS e'
_B = r"[ \t\n\r\f\x0b]"
_TRIM = "regexp_replace({0}, '^" + _B + "+|" + _B + "+$', '', 'g')"
_TRUTH = f'SELECT DISTINCT test_id, file_path, {_SPAN} FROM snippets WHERE file_path IS NOT NULL AND span."start" IS NOT NULL AND span."end" IS NOT NULL'
_FOUND = f'SELECT DISTINCT test_id, file_path, {_SPAN} FROM retrieved WHERE file_path IS NOT NULL AND span."start" IS NOT NULL AND span."end" IS NOT NULL'
_EDGES = "rows_ AS (SELECT chunk_id, ord, coalesce(parent_id, doc_id) AS above FROM k), lagged AS (SELECT chunk_id, lag(chunk_id) OVER (PARTITION BY above ORDER BY ord NULLS LAST, chunk_id) AS before FROM rows_ WHERE above IS NOT NULL), e AS (SELECT before AS src, chunk_id AS dst, 'NEXT' AS type FROM lagged WHERE before IS NOT NULL UNION ALL SELECT chunk_id, before, 'PREV' FROM lagged WHERE before IS NOT NULL)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _chunks(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return tree.latest(table(spark, root, "chunks"), "chunk_id", *columns, prefer="summary")


def _contracts(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return tree.latest(table(spark, root, "contracts"), "doc_id", *columns)


# vectors


@query(
    "WITH q AS (SELECT label, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT c.label AS parent, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings c, q), r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY round(score, 9) DESC, id) AS rank FROM s WHERE score > 0) SELECT parent, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5"
)
def child_topk(spark: SparkSession, root: str) -> DataFrame:
    """The five children of each parent that are most similar to one query vector."""
    rows = table(spark, root, "embeddings").select(F.col("label").alias("parent"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = rows.where("id = 0").select(F.lit(0).alias("query_id"), F.col("v").alias("q"))
    asked = rows.select("parent").distinct().crossJoin(F.broadcast(q))  # one query row
    return vectors.child_topk(rows, asked).select("parent", "id", F.round("score", 6).alias("score"), "rank")


@query(
    "WITH q AS (SELECT vec_id AS query_id, label AS parent, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings JOIN q ON label = parent), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s WHERE score > 0) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5"
)
def child_topk_batched(spark: SparkSession, root: str) -> DataFrame:
    """Every hundredth vector as a query among the children of its own parent."""
    rows = table(spark, root, "embeddings").select(F.col("label").alias("parent"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "parent", F.col("v").alias("q"))
    return vectors.child_topk(rows, asked).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _letters_sql(c: str) -> str:
    return f"list_transform(range(97, 123), lambda i: (length(lower({c})) - length(replace(lower({c}), chr(i::INT), '')))::DOUBLE)"


@query(
    f"WITH d AS (SELECT doc_id AS id, {_letters_sql('text')} AS v FROM documents WHERE text IS NOT NULL), q AS (SELECT id AS query_id, v AS q FROM d WHERE id % 100 = 0), s AS (SELECT query_id, id, list_cosine_similarity(v, q) AS score FROM d, q WHERE id <> query_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s WHERE score > 0 AND NOT isnan(score)) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5"
)
def semantic_documents_topk(spark: SparkSession, root: str) -> DataFrame:
    """Every hundredth document as a query against all others, by letter counts."""
    rows = table(spark, root, "documents").where("text is not null").select(F.col("doc_id").alias("id"), letters("text").alias("v"))
    asked = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return vectors.query_topk(rows, asked).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH d AS (SELECT doc_id, unnest(range(0, 26)) AS i, {_letters_sql('text')} AS v FROM documents WHERE text IS NOT NULL) SELECT doc_id, chr((97 + i)::INT) AS letter, v[i + 1]::BIGINT AS n FROM d")
def letter_embedding(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").where("text is not null").select("doc_id", F.posexplode(letters("text")).alias("i", "n"))
    return rows.select("doc_id", F.chr(F.col("i") + 97).alias("letter"), F.col("n").cast("bigint").alias("n"))


@query(
    "WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.4 AND a.vec_id <> b.vec_id), r(v, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.seen FROM r JOIN p ON p.a = r.v) SELECT v AS id, min(seen) AS part FROM r GROUP BY v"
)
def clusters(spark: SparkSession, root: str) -> DataFrame:
    """Single linkage over all vectors, cut at a cosine distance of 0.6."""
    return vectors.single_linkage(table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 0.6)


# text and trees


@query("SELECT doc_id AS contract_id, string_split(file_path, '/')[-1] AS contract_name FROM (WITH " + _C + " SELECT * FROM c)")
def list_corpora(spark: SparkSession, root: str) -> DataFrame:
    return search.list_corpora(_contracts(spark, root, "file_path"))


def _split_sql(table_: str, id_: str, text: str, marker: str) -> str:
    n = len(marker)
    return f"WITH d AS (SELECT {id_}, {text} AS t, strpos(lower({text}), '{marker}') AS p FROM {table_}) SELECT {id_}, CASE WHEN p > 0 THEN left(t, p - 1) WHEN p = 0 THEN '' END AS intro, CASE WHEN p > 0 THEN substr(t, p + {n}) ELSE t END AS body, CASE WHEN p > 0 THEN p - 1 + {n} WHEN p = 0 THEN 0 END AS body_start, length(t) AS body_end FROM d"


@query(_split_sql("contracts", "doc_id", "content", "follows:"))
def split_intro_body(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "contracts").select("doc_id", *[c.alias(n) for n, c in split_at_marker("content").items()])


@query(_split_sql("documents", "doc_id", "text", " the "))
def split_intro_body_marker(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", *[c.alias(n) for n, c in split_at_marker("text", " the ").items()])


@query(
    "WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, unnest(range(len(l))) AS ord, unnest(l) AS line FROM d) SELECT doc_id, ord, length(line) AS n, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS span_start FROM x"
)
def chunk_lines(spark: SparkSession, root: str) -> DataFrame:
    return tree.text_lines(table(spark, root, "documents")).select("doc_id", "ord", F.length("line").alias("n"), "span_start")


@query("WITH " + _K + " SELECT doc_id, depth, count(*) AS chunks, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM k p WHERE p.parent_id = k.chunk_id)) AS leaves FROM k GROUP BY doc_id, depth")
def chunk_tree_levels(spark: SparkSession, root: str) -> DataFrame:
    return tree.levels(_chunks(spark, root, "doc_id", "parent_id", "depth"))


@query("WITH " + _K + f', x AS (SELECT parent_id, CASE WHEN span."start" IS NOT NULL AND span."end" IS NOT NULL THEN 1 END AS ok, {_SPAN} FROM k) SELECT parent_id, min(s) FILTER (ok = 1) AS span_start, max(e) FILTER (ok = 1) AS span_end, count(*) AS children FROM x WHERE parent_id IS NOT NULL GROUP BY parent_id')
def span_envelope(spark: SparkSession, root: str) -> DataFrame:
    return tree.envelopes(_chunks(spark, root, "parent_id", "span"))


@query("WITH " + _K + " SELECT parent_id, md5(string_agg(coalesce(content, ''), '' ORDER BY ord NULLS LAST, chunk_id)) AS text FROM k WHERE parent_id IS NOT NULL GROUP BY parent_id")
def content_rollup(spark: SparkSession, root: str) -> DataFrame:
    return tree.content_roll_up(_chunks(spark, root, "parent_id", "ord", "content")).select("parent_id", F.md5("text").alias("text"))


@query("WITH " + _K + ", x AS (SELECT *, " + _TRIM.format("coalesce(nullif(summary, ''), nullif(content, ''), '')") + " AS t FROM k) SELECT parent_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY ord NULLS LAST, chunk_id)) AS text FROM x WHERE parent_id IS NOT NULL GROUP BY parent_id")
def summary_rollup(spark: SparkSession, root: str) -> DataFrame:
    return tree.summary_roll_up(_chunks(spark, root, "parent_id", "ord", "content", "summary")).select("parent_id", F.md5("text").alias("text"))


@query("SELECT DISTINCT chunk_id FROM chunks k WHERE NOT EXISTS (SELECT 1 FROM chunks p WHERE p.parent_id = k.chunk_id)")
def leaf_nodes(spark: SparkSession, root: str) -> DataFrame:
    return leaf_rows(table(spark, root, "chunks")).distinct()


@query("WITH " + _K + " SELECT doc_id, path[1] AS head, string_agg(chunk_id, ',' ORDER BY depth, ord, chunk_id) AS chunk_ids FROM k GROUP BY doc_id, path[1]")
def key_paths(spark: SparkSession, root: str) -> DataFrame:
    """Chunks gathered under the first key of their path, in order."""
    rows = _chunks(spark, root, "doc_id", "path", "depth", "ord").groupBy("doc_id", F.get("path", F.lit(0)).alias("head"))
    item = F.struct(F.col("depth").isNull(), "depth", F.col("ord").isNull(), "ord", "chunk_id")
    return rows.agg(F.sort_array(F.collect_list(item)).alias("l")).select("doc_id", "head", F.array_join(F.transform("l", lambda z: z["chunk_id"]), ",").alias("chunk_ids"))


@query("WITH RECURSIVE " + _K + ", r AS (SELECT parent_id AS ancestor, chunk_id, 1 AS distance FROM k WHERE parent_id IS NOT NULL UNION ALL SELECT k.parent_id, r.chunk_id, r.distance + 1 FROM r JOIN k ON k.chunk_id = r.ancestor WHERE k.parent_id IS NOT NULL) SELECT ancestor, chunk_id, distance FROM r")
def subtree(spark: SparkSession, root: str) -> DataFrame:
    return tree.descendants(_chunks(spark, root, "parent_id", "depth"))


# graph


_NODE = ["file_path", "toc_json", "content", "summary"]
_ALL = ["doc_id", "file_path", "parent_id", "name", "ord", "depth", "content", "summary", "span"]


@query(
    "WITH " + _K + ", " + _C + """ SELECT doc_id AS id, 'Corpus' AS label, string_split(file_path, '/')[-1] AS name, md5(file_path) AS file_path, md5(toc_json) AS toc_json, md5(content) AS content, NULL::VARCHAR AS summary, NULL::INT AS span_start, NULL::INT AS span_end, NULL::INT AS ord, 0 AS depth, false AS leaf FROM c
UNION ALL SELECT chunk_id, 'Chunk', k.name, md5(coalesce(k.file_path, c.file_path)), NULL, md5(k.content), md5(k.summary), CASE WHEN span."end" IS NOT NULL THEN least(span."start", span."end") END, CASE WHEN span."start" IS NOT NULL THEN greatest(span."start", span."end") END, ord, depth, NOT EXISTS (SELECT 1 FROM k p WHERE p.parent_id = k.chunk_id) FROM k LEFT JOIN c USING (doc_id)"""
)
def graph_nodes(spark: SparkSession, root: str) -> DataFrame:
    """All columns of the nodes but the vector, long texts as hashes."""
    rows = graph.nodes(_contracts(spark, root, "file_path", "toc_json", "content"), _chunks(spark, root, *_ALL))
    span = [F.get("span", F.lit(i)).alias(n) for i, n in enumerate(("span_start", "span_end"))]
    return rows.select("id", "label", "name", *[F.md5(c).alias(c) for c in _NODE], *span, "ord", "depth", "leaf")


@query("WITH " + _K + " SELECT coalesce(parent_id, doc_id) AS src, chunk_id AS dst, 'CHILD' AS type FROM k WHERE coalesce(parent_id, doc_id) IS NOT NULL")
def child_edges(spark: SparkSession, root: str) -> DataFrame:
    return graph.child_edges(_chunks(spark, root, "parent_id", "doc_id"))


@query("WITH " + _K + ", " + _EDGES + " SELECT * FROM e")
def sibling_edges(spark: SparkSession, root: str) -> DataFrame:
    return graph.sibling_edges(_chunks(spark, root, "parent_id", "doc_id", "ord"))


@query("WITH " + _K + ", " + _EDGES + ", p AS (SELECT src AS chunk_id, dst AS section_id FROM e WHERE type = 'NEXT' UNION SELECT dst, src FROM e WHERE type = 'NEXT') SELECT p.chunk_id, section_id, name AS section_name, coalesce(nullif(summary, ''), content) AS summary FROM p JOIN k ON k.chunk_id = section_id")
def neighbors(spark: SparkSession, root: str) -> DataFrame:
    chunks = _chunks(spark, root, "parent_id", "doc_id", "ord", "name", "summary", "content")
    return graph.neighbours(chunks, graph.sibling_edges(chunks))


@query("SELECT 'Chunk' AS label, chunk_id AS id, count(*) AS n FROM chunks GROUP BY chunk_id HAVING count(*) > 1 UNION ALL SELECT 'Corpus', doc_id, count(*) FROM contracts GROUP BY doc_id HAVING count(*) > 1")
def unique_ids(spark: SparkSession, root: str) -> DataFrame:
    """Ids that break uniqueness in the tables as delivered."""
    raw = table(spark, root, "chunks").select(F.lit("Chunk").alias("label"), F.col("chunk_id").alias("id")).unionByName(table(spark, root, "contracts").select(F.lit("Corpus").alias("label"), F.col("doc_id").alias("id")))
    return graph.repeated_ids(raw)


@query("WITH " + _K + ", x AS (SELECT chunk_id, CASE WHEN coalesce(" + _TRIM.format("summary") + ", '') <> '' THEN " + _TRIM.format("summary") + " ELSE content END AS text FROM k) SELECT chunk_id, md5(text) AS text FROM x WHERE coalesce(" + _TRIM.format("text") + ", '') <> ''")
def embed_text_choice(spark: SparkSession, root: str) -> DataFrame:
    return graph.embed_text(_chunks(spark, root, "summary", "content")).select("chunk_id", F.md5("text").alias("text"))


@query("WITH " + _K + ", " + _EDGES + " SELECT 'node' AS kind, 'Corpus' AS label, count(DISTINCT doc_id) AS n FROM contracts WHERE doc_id IS NOT NULL UNION ALL SELECT 'node', 'Chunk', count(*) FROM k UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY type UNION ALL SELECT 'edge', 'CHILD', count(*) FROM k WHERE coalesce(parent_id, doc_id) IS NOT NULL")
def graph_written(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the graph's tables, read back after writing."""
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    chunks = _chunks(spark, root, "parent_id", "doc_id", "ord", "name", "depth")
    graph.write_graph(graph.nodes(_contracts(spark, root, "file_path"), chunks), graph.child_edges(chunks).unionByName(graph.sibling_edges(chunks)), path)
    nodes, edges = graph.read_graph(spark, path)
    return nodes.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "label", "n").unionByName(edges.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "label", "n"))


# spans


@query("WITH " + _K + ", " + _C + " SELECT chunk_id, c.file_path, k.name, (strpos(c.content, k.content) - 1 + coalesce(file_offset, 0))::BIGINT AS span_start, (strpos(c.content, k.content) - 1 + coalesce(file_offset, 0) + length(k.content))::BIGINT AS span_end FROM k JOIN c USING (doc_id) WHERE k.content IS NOT NULL AND strpos(c.content, k.content) > 0")
def locate_spans(spark: SparkSession, root: str) -> DataFrame:
    return search.locate_spans(_chunks(spark, root, "doc_id", "name", "content"), _contracts(spark, root, "file_path", "content", "file_offset"))


@query("WITH " + _K + ", " + _C + " SELECT chunk_id FROM k JOIN c USING (doc_id) WHERE strpos(c.content, upper(k.content)) = 0")
def locate_spans_missing(spark: SparkSession, root: str) -> DataFrame:
    """Chunks whose upper-cased content its contract does not hold."""
    texts = _contracts(spark, root, "content").withColumnRenamed("content", "hay")
    return _chunks(spark, root, "doc_id", "content").join(texts, "doc_id").where(found_at(F.col("hay"), F.upper("content")) == -1).select("chunk_id")


@query('WITH ' + _C + ' SELECT test_id, pos, doc_id, md5(substr(content, span."start" - coalesce(file_offset, 0) + 1, span."end" - span."start")) AS answer FROM (SELECT DISTINCT * FROM snippets) s JOIN c USING (file_path) WHERE span."start" >= coalesce(file_offset, 0) AND span."end" <= coalesce(file_offset, 0) + length(content) AND span."start" <= span."end"')
def answer_slice(spark: SparkSession, root: str) -> DataFrame:
    found = search.answers(table(spark, root, "snippets"), _contracts(spark, root, "file_path", "content", "file_offset"))
    return found.select("test_id", "pos", "doc_id", F.md5("answer").alias("answer"))


@query(f'WITH x AS (SELECT DISTINCT test_id, pos, file_path, {_SPAN} FROM snippets WHERE file_path IS NOT NULL AND span."start" IS NOT NULL AND span."end" IS NOT NULL), y AS (SELECT *, lag(e) OVER (PARTITION BY test_id, file_path ORDER BY s, e, pos) AS before FROM x) SELECT test_id, pos, file_path, s, e, before FROM y WHERE before >= s')
def disjoint_violations(spark: SparkSession, root: str) -> DataFrame:
    return evaluate.disjointness(table(spark, root, "snippets"))


@query("SELECT DISTINCT file_path FROM snippets WHERE file_path IN (SELECT file_path FROM contracts) ORDER BY file_path")
def used_paths(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "snippets").select("file_path").distinct().join(table(spark, root, "contracts").select("file_path"), "file_path", "left_semi").orderBy("file_path")


@query(f'WITH x AS (SELECT DISTINCT test_id, rank, file_path, {_SPAN} FROM retrieved WHERE file_path IS NOT NULL AND span."start" IS NOT NULL AND span."end" IS NOT NULL), y AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY rank NULLS FIRST, file_path, s, e) AS place FROM x) SELECT test_id, place, file_path, s, e, 1.0::DOUBLE / place AS score FROM y')
def rank_scores(spark: SparkSession, root: str) -> DataFrame:
    return evaluate.rank_scores(table(spark, root, "retrieved"))


@query(f"WITH t AS ({_TRUTH}), f AS ({_FOUND}) SELECT test_id, file_path, t.s, t.e, f.s AS fs, f.e AS fe, least(t.e, f.e) - greatest(t.s, f.s) AS shared FROM t JOIN f USING (test_id, file_path) WHERE least(t.e, f.e) > greatest(t.s, f.s)")
def span_overlap(spark: SparkSession, root: str) -> DataFrame:
    return evaluate.overlaps(table(spark, root, "snippets"), table(spark, root, "retrieved"))


_PR = f"t AS ({_TRUTH}), f AS ({_FOUND}), o AS (SELECT test_id, sum(least(t.e, f.e) - greatest(t.s, f.s)) AS shared FROM t JOIN f USING (test_id, file_path) WHERE least(t.e, f.e) > greatest(t.s, f.s) GROUP BY test_id), tl AS (SELECT test_id, sum(e - s) AS n FROM t GROUP BY test_id), fl AS (SELECT test_id, sum(e - s) AS m FROM f GROUP BY test_id), pr AS (SELECT coalesce(tl.test_id, fl.test_id) AS test_id, CASE WHEN m > 0 THEN coalesce(shared, 0)::DOUBLE / m ELSE 0 END AS precision, CASE WHEN n > 0 THEN coalesce(shared, 0)::DOUBLE / n ELSE 0 END AS recall FROM tl FULL JOIN fl ON tl.test_id = fl.test_id LEFT JOIN o ON o.test_id = coalesce(tl.test_id, fl.test_id))"


@query(f"WITH {_PR} SELECT test_id, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr")
def precision_recall(spark: SparkSession, root: str) -> DataFrame:
    scores = evaluate.precision_recall(table(spark, root, "snippets"), table(spark, root, "retrieved"))
    return scores.select("test_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"WITH {_PR} SELECT round(avg(precision), 6) AS average_precision, round(avg(recall), 6) AS average_recall FROM pr")
def weighted_average(spark: SparkSession, root: str) -> DataFrame:
    mean = evaluate.weighted_mean(evaluate.precision_recall(table(spark, root, "snippets"), table(spark, root, "retrieved")))
    return mean.select(F.round("average_precision", 6).alias("average_precision"), F.round("average_recall", 6).alias("average_recall"))


@query()
def seeded_cap(spark: SparkSession, root: str) -> DataFrame:
    """The draw is that of Python's generator, which SQL lacks."""
    return evaluate.seeded_cap(table(spark, root, "tests"), table(spark, root, "snippets")).select("test_id", "path", F.round("draw", 9).alias("draw"))


@query("SELECT test_id, 'contracts' AS tag, query FROM tests")
def tag_overwrite(spark: SparkSession, root: str) -> DataFrame:
    named = table(spark, root, "tests").withColumn("tags", F.array(F.lit("contracts")))
    return named.select("test_id", F.explode("tags").alias("tag"), "query")


# JSON and model answers


@query("SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events")
def json_props(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT doc_id, md5(toc_json) AS said FROM contracts WHERE toc_json IS NOT NULL")
def fence_extract(spark: SparkSession, root: str) -> DataFrame:
    """Answers that wrap the table of contents in reasoning and a fence give it back unchanged."""
    said = F.concat(F.lit("a</think> b</think>\nhere:\n```json\n"), F.col("toc_json"), F.lit("\n```\nend"))
    return table(spark, root, "contracts").where("toc_json is not null").select("doc_id", F.md5(model_json(said)).alias("said"))


@query(
    "WITH " + _C + """, j AS (SELECT doc_id, toc_json FROM c WHERE json_valid(toc_json) AND json_type(toc_json) = 'OBJECT'),
x AS (SELECT doc_id, toc_json, unnest(json_keys(toc_json)) AS key, unnest(range(len(json_keys(toc_json)))) AS ord FROM j),
y AS (SELECT *, json_extract(toc_json, '$."' || key || '".sections') AS inner_ FROM x),
z AS (SELECT doc_id, ord, key, json_extract_string(toc_json, '$."' || key || '".name') AS description, unnest(coalesce(json_keys(inner_), [NULL])) AS child, unnest(CASE WHEN inner_ IS NULL OR len(json_keys(inner_)) = 0 THEN [0] ELSE range(len(json_keys(inner_))) END) AS child_ord, inner_ FROM y)
SELECT doc_id AS contract_id, ord, key AS component_name, description AS component_description, child_ord, child AS child_name, CASE WHEN json_type(inner_, '$."' || child || '"') = 'VARCHAR' THEN json_extract_string(inner_, '$."' || child || '"') END AS child_description FROM z"""
)
def toc_components(spark: SparkSession, root: str) -> DataFrame:
    """A row for each child of each component; a component without children has one with nulls."""
    toc = search.corpus_toc(_contracts(spark, root, "toc_json"))
    flat = toc.select("contract_id", "ord", "component_name", "component_description", F.posexplode_outer("childs").alias("child_ord", "c"))
    return flat.select("contract_id", "ord", "component_name", "component_description", F.coalesce("child_ord", F.lit(0)).alias("child_ord"), F.col("c.component_name").alias("child_name"), F.col("c.component_description").alias("child_description"))


@query()
def fuzzy_window(spark: SparkSession, root: str) -> DataFrame:
    """Where each leaf stands in its contract, from the window of its first sentence to that of its last, with their scores.

    Of every 16th leaf, by the hash of its id, both sentences are altered (each e written as a), so that the windows of
    the whole contract are compared and scored. The window similarity has no SQL form.
    """
    leaves = leaf_rows(table(spark, root, "chunks"), "doc_id", "content").where("content is not null").dropDuplicates(["chunk_id"])
    said = F.split(F.regexp_replace(newlines("content"), r"^\s+|\s+$", ""), r"(?<=\.)\s+")
    wanted = leaves.select("chunk_id", "doc_id", (F.pmod(F.xxhash64("chunk_id"), F.lit(16)) == 0).alias("altered"), F.element_at(said, 1).alias("first"), F.element_at(said, -1).alias("last"))
    target = {c: F.when(F.col("altered"), F.translate(c, "eE", "aA")).otherwise(F.col(c)) for c in ("first", "last")}
    # rows, not contracts, are the unit of work: a long contract is searched by many tasks
    pairs = wanted.withColumns(target).join(_contracts(spark, root, "content"), "doc_id").repartition(F.col("chunk_id"))
    found = pairs.select("chunk_id", "altered", find_range(newlines("content"), "first", "last").alias("w"))
    return found.select("chunk_id", "altered", "w.start", "w.end", F.round("w.score", 6).alias("score"), F.round("w.last_score", 6).alias("last_score"))


# messages


@query("WITH x AS (SELECT event_id, user_id, event_type, sum((event_type = 'purchase')::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS round FROM events) SELECT event_id, user_id, event_type, round::BIGINT AS round FROM x WHERE round <= 5")
def message_log(spark: SparkSession, root: str) -> DataFrame:
    """Messages per key with their round, up to a budget of five tool rounds."""
    return search.round_log(table(spark, root, "events"), "user_id", "ts", "event_id", "event_type = 'purchase'", 5).select("event_id", "user_id", "event_type", "round")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_entry FROM events")
def carry_last_entry(spark: SparkSession, root: str) -> DataFrame:
    return search.carried(table(spark, root, "events"), "user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", F.col("value"))).select("event_id", "last_entry")


_V = _letters_sql("coalesce(nullif(summary, ''), content, '')")


@query(
    "WITH " + _K + ", " + _C + f""", named AS (SELECT doc_id AS parent, replace(regexp_replace(string_split(file_path, '/')[-1], '\\.txt$', ''), '_', ' ') AS phrase FROM c),
asked AS (SELECT test_id, regexp_extract(query, '^Consider (.*?);', 1) AS phrase, {_letters_sql('query')} AS q FROM tests WHERE query IS NOT NULL),
rows_ AS (SELECT coalesce(parent_id, doc_id) AS parent, chunk_id AS id, {_V} AS v FROM k),
s1 AS (SELECT test_id, q, id, list_cosine_similarity(v, q) AS score FROM asked JOIN named USING (phrase) JOIN rows_ USING (parent) WHERE phrase <> ''),
b1 AS (SELECT test_id, q, id AS parent FROM s1 WHERE score > 0 AND NOT isnan(score) QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY round(score, 9) DESC, id) = 1),
s2 AS (SELECT test_id, id, list_cosine_similarity(v, q) AS score FROM b1 JOIN rows_ USING (parent)),
b2 AS (SELECT test_id, id AS chunk_id, row_number() OVER (PARTITION BY test_id ORDER BY round(score, 9) DESC, id) AS r FROM s2 WHERE score > 0 AND NOT isnan(score)),
hit AS (SELECT test_id, chunk_id, r, c.file_path, strpos(c.content, k.content) - 1 + coalesce(file_offset, 0) AS s, length(k.content) AS n FROM b2 JOIN k USING (chunk_id) JOIN c USING (doc_id) WHERE r <= 2 AND k.content IS NOT NULL AND strpos(c.content, k.content) > 0)
SELECT test_id, row_number() OVER (PARTITION BY test_id ORDER BY r) AS place, chunk_id, file_path, s::BIGINT AS span_start, (s + n)::BIGINT AS span_end, 1.0::DOUBLE / row_number() OVER (PARTITION BY test_id ORDER BY r) AS score FROM hit"""
)
def agent_end_to_end(spark: SparkSession, root: str) -> DataFrame:
    return search.answer_questions(table(spark, root, "tests").select("test_id", "query"), _contracts(spark, root, "file_path", "content", "file_offset"), _chunks(spark, root, "parent_id", "doc_id", "name", "summary", "content"))


_SAID = "CASE WHEN coalesce(" + _TRIM.format("summary") + ", '') <> '' THEN summary ELSE content END"
_NV = "CASE WHEN " + _TRIM.format(_SAID) + " <> '' THEN " + _letters_sql(f"coalesce({_SAID}, '')") + " END"
_TOLD = "coalesce(nullif(summary, ''), content)"
_QUERIED = f"asked AS (SELECT test_id, query, regexp_extract(query, '^Consider (.*?);', 1) AS phrase, {_letters_sql('query')} AS q FROM tests WHERE query IS NOT NULL), named AS (SELECT replace(regexp_replace(string_split(file_path, '/')[-1], '\\.txt$', ''), '_', ' ') AS phrase, min(doc_id) AS doc_id FROM c GROUP BY 1), rows0 AS MATERIALIZED (SELECT coalesce(parent_id, doc_id) AS parent, chunk_id AS id, name, {_TOLD} AS told, NOT EXISTS (SELECT 1 FROM k p WHERE p.parent_id = k.chunk_id) AS leaf, {_NV} AS v FROM k), rows_ AS MATERIALIZED (SELECT * FROM rows0 WHERE v IS NOT NULL), s1 AS (SELECT test_id, query, q, doc_id, id, name, told, list_cosine_similarity(v, q) AS score FROM asked JOIN named USING (phrase) JOIN rows_ ON parent = doc_id WHERE phrase <> ''), b1 AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY round(score, 9) DESC, id) AS pos FROM s1 WHERE score > 0 AND NOT isnan(score)), s2 AS (SELECT test_id, q, r.id, r.name, r.told, r.leaf, list_cosine_similarity(v, q) AS score FROM b1 JOIN rows_ r ON r.parent = b1.id WHERE pos = 1), b2 AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY round(score, 9) DESC, id) AS pos FROM s2 WHERE score > 0 AND NOT isnan(score))"


def _graph(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The graph of the chunks with the default embedder's vectors, written and read back."""
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    chunks = _chunks(spark, root, *_ALL)
    nodes = graph.with_vectors(graph.nodes(_contracts(spark, root, "file_path", "toc_json", "content"), chunks), letter_counts, 1_000)
    graph.write_graph(nodes, graph.child_edges(chunks).unionByName(graph.sibling_edges(chunks)), path)
    return graph.read_graph(spark, path)


def _first_components(spark: SparkSession, root: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every question about a contract, asked of the contract's components."""
    names = nodes.where("label = 'Corpus'").select("id", F.regexp_replace(F.regexp_replace("name", r"\.txt$", ""), "_", " ").alias("phrase")).groupBy("phrase").agg(F.min("id").alias("id"))
    asked = table(spark, root, "tests").where("query is not null").withColumn("phrase", F.regexp_extract("query", "^Consider (.*?);", 1)).where("phrase <> ''")
    return search.search_children(asked.join(names, "phrase").select(F.col("test_id").alias("query_id"), "id", "query"), nodes, edges)


@query("WITH " + _K + ", " + _C + ", " + _QUERIED + " SELECT test_id, pos, id AS component_id, name AS component_name, md5(told) AS component_summary FROM b1 WHERE pos <= 5")
def search_component(spark: SparkSession, root: str) -> DataFrame:
    found = _first_components(spark, root, *_graph(spark, root))
    return found.select(F.col("query_id").alias("test_id"), "pos", "component_id", "component_name", F.md5("component_summary").alias("component_summary"))


@query("WITH " + _K + ", " + _C + ", " + _QUERIED + " SELECT test_id, pos, id AS sub_component_id, name AS sub_component_name, md5(told) AS sub_component_summary, leaf AS sub_component_leaf FROM b2 WHERE pos <= 5")
def search_sub_component(spark: SparkSession, root: str) -> DataFrame:
    """The same questions, asked of the best component's children."""
    nodes, edges = _graph(spark, root)
    first = cut(_first_components(spark, root, nodes, edges).where("pos = 1").select("query_id", F.col("component_id").alias("id")), "asked")
    asked = first.join(table(spark, root, "tests").select(F.col("test_id").alias("query_id"), "query"), "query_id")
    found = search.search_children(asked, nodes, edges)
    return found.select(F.col("query_id").alias("test_id"), "pos", *[F.col(f"component_{n}").alias(f"sub_component_{n}") for n in ("id", "name")], F.md5("component_summary").alias("sub_component_summary"), F.col("component_leaf").alias("sub_component_leaf"))


@query(
    "WITH " + _K + ", " + _C + ", a AS (SELECT coalesce(parent_id, doc_id) AS query_id, chunk_id, row_number() OVER (PARTITION BY coalesce(parent_id, doc_id) ORDER BY chunk_id DESC) AS nth FROM k), h AS (SELECT query_id, nth, chunk_id, c.file_path, k.name, k.content, strpos(c.content, k.content) - 1 + coalesce(file_offset, 0) AS s FROM a JOIN k USING (chunk_id) JOIN c USING (doc_id) WHERE query_id IS NOT NULL AND k.content IS NOT NULL AND strpos(c.content, k.content) > 0) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY nth) AS place, chunk_id, file_path, name, md5(content) AS content, s::BIGINT AS span_start, (s + length(content))::BIGINT AS span_end FROM h"
)
def response_by_ids(spark: SparkSession, root: str) -> DataFrame:
    """Each parent asks for its children, the last id first, each twice, and for an unknown one."""
    chunks = _chunks(spark, root, "parent_id", "doc_id", "name", "content")
    ids = F.sort_array(F.collect_list("chunk_id"), asc=False)
    asked = chunks.groupBy(F.coalesce("parent_id", "doc_id").alias("query_id")).agg(F.concat(ids, F.array(F.lit("unknown")), ids).alias("ids")).where("query_id is not null")
    found = search.response_by_ids(asked, chunks.select("chunk_id", "doc_id", "name", "content"), _contracts(spark, root, "file_path", "content", "file_offset"))
    return found.withColumn("content", F.md5("content"))


@query(
    "WITH " + _K + ", " + _C + ", " + _QUERIED + """, pick AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY pos) AS nth FROM b2 WHERE pos <= 5 AND leaf AND test_id IN (SELECT test_id FROM b2 WHERE pos = 1 AND leaf)),
vol AS (SELECT k.chunk_id, k.name, k.content, coalesce(k.file_path, c.file_path) AS file_path FROM k LEFT JOIN c USING (doc_id)),
hit AS (SELECT test_id, nth, p.id AS chunk_id, v.file_path, v.name, min(strpos(c.content, v.content) - 1 + coalesce(file_offset, 0)) AS s, any_value(length(v.content)) AS n FROM pick p JOIN vol v ON v.chunk_id = p.id JOIN c USING (file_path) WHERE nth <= 2 AND v.content IS NOT NULL AND strpos(c.content, v.content) > 0 GROUP BY ALL)
SELECT test_id, row_number() OVER (PARTITION BY test_id ORDER BY nth) AS place, file_path, name, s::BIGINT AS span_start, (s + n)::BIGINT AS span_end, 1.0::DOUBLE / row_number() OVER (PARTITION BY test_id ORDER BY nth) AS score FROM hit"""
)
def agent_rounds(spark: SparkSession, root: str) -> DataFrame:
    """The tool loop with the stepwise policy over the written graph: the spans that its response calls gave."""
    nodes, edges = _graph(spark, root)
    tools = agent.graph_tools(nodes, edges, _contracts(spark, root, "file_path", "content", "file_offset"))
    log = agent.run_rounds(table(spark, root, "tests").select("test_id", "query"), tools, agent.stepwise_policy(), budget=5)
    return agent.responses(log)

