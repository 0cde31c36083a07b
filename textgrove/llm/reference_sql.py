"""What the problems' results are, in SQL: for small tables, as it compares everything with everything."""

from __future__ import annotations

_SPAN = 'least(span."start", span."end")::BIGINT AS s, greatest(span."start", span."end")::BIGINT AS e'

# problem 1: items, their gaps by strength, and the pieces one after another
_ITEMS = f"""leaf AS (SELECT chunk_id, doc_id, ingested_at, {_SPAN} FROM chunks k WHERE NOT EXISTS (SELECT 1 FROM chunks p WHERE p.parent_id = k.chunk_id)),
kept AS (SELECT * FROM leaf WHERE e - s > 1200 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST, s DESC, e DESC, doc_id DESC) = 1),
text_of AS (SELECT doc_id, coalesce(file_offset, 0)::BIGINT AS o, coalesce(content, '') AS t FROM contracts WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC NULLS LAST, coalesce(file_offset, 0) DESC, coalesce(content, '') DESC) = 1),
item AS (SELECT chunk_id AS item_id, substr(t, greatest(s - o, 0) + 1, e - greatest(s, o)) AS t, greatest(s, o) AS o FROM kept JOIN text_of USING (doc_id)
  UNION ALL SELECT doc_id, t, o FROM text_of WHERE doc_id NOT IN (SELECT doc_id FROM chunks WHERE doc_id IS NOT NULL)),
long_item AS (SELECT * FROM item WHERE length(t) > 1200)"""

P1_FOUND = f"""WITH RECURSIVE {_ITEMS},
token AS (SELECT item_id, unnest(l) AS w, generate_subscripts(l, 1) AS k FROM (SELECT item_id, regexp_extract_all(t, '[ \\t\\r\\n]+|[^ \\t\\r\\n]+') AS l FROM long_item)),
placed AS (SELECT *, sum(length(w)) OVER (PARTITION BY item_id ORDER BY k) AS e, lag(w) OVER (PARTITION BY item_id ORDER BY k) AS before FROM token),
gap AS (SELECT item_id, e, CASE WHEN length(w) - length(replace(w, chr(10), '')) > 1 THEN 1 ELSE 0 END AS strong, CASE WHEN right(before, 1) IN ('.', '!', '?', ';') THEN 1 ELSE 0 END AS middle FROM placed WHERE left(w, 1) IN (' ', chr(9), chr(10), chr(13))),
ends AS (SELECT item_id, list(e) FILTER (strong = 1) AS g1, list(e) FILTER (middle = 1) AS g2, list(e) AS g3 FROM gap GROUP BY item_id),
start AS (SELECT i.item_id, i.o, length(t)::BIGINT AS n, coalesce(g1, []) AS g1, coalesce(g2, []) AS g2, coalesce(g3, []) AS g3 FROM long_item i LEFT JOIN ends USING (item_id)),
piece AS (SELECT item_id, o, n, g1, g2, g3, 0::BIGINT AS a, NULL::BIGINT AS b FROM start
  UNION ALL
  SELECT item_id, o, n, g1, g2, g3, b - 120, NULL FROM (SELECT *EXCLUDE b, CASE WHEN n - a > 1200 THEN coalesce(list_max(list_filter(g1, lambda x: x > a + 600 AND x <= a + 1200)), list_max(list_filter(g2, lambda x: x > a + 600 AND x <= a + 1200)), list_max(list_filter(g3, lambda x: x > a + 600 AND x <= a + 1200)), a + 1200)::BIGINT END AS b FROM piece) WHERE b IS NOT NULL)
SELECT item_id, (a + o)::BIGINT AS piece_start, (coalesce(lead(a) OVER (PARTITION BY item_id ORDER BY a) + 120, n) + o)::BIGINT AS piece_end FROM piece"""

P1_CHECKS = f"WITH {_ITEMS} SELECT 'items' AS what, count(*)::BIGINT AS n FROM long_item UNION ALL SELECT 'code points', coalesce(sum(length(t)), 0)::BIGINT FROM long_item UNION ALL SELECT unnest(['over the limit', 'wrong overlap', 'items short']), 0"

# problem 2: every window of 200
_SHARED = """text_of AS (SELECT DISTINCT doc_id, content AS t FROM contracts WHERE doc_id IS NOT NULL AND length(content) >= 200),
win AS (SELECT doc_id, a, md5(substr(t, a + 1, 200)) AS h FROM (SELECT doc_id, t, unnest(range(length(t) - 199)) AS a FROM text_of)),
more AS (SELECT h FROM win GROUP BY h HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT doc_id, a, coalesce(a > lag(a) OVER (PARTITION BY doc_id ORDER BY a) + 200, true) AS fresh FROM win SEMI JOIN more USING (h)),
run AS (SELECT doc_id, a, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY a) AS r FROM hit),
stretch AS (SELECT doc_id, min(a)::BIGINT AS span_start, (max(a) + 200)::BIGINT AS span_end FROM run GROUP BY doc_id, r)"""
P2_FOUND = f"WITH {_SHARED} SELECT * FROM stretch"
P2_AMOUNT = f"WITH {_SHARED} SELECT doc_id, count(*) AS stretches, sum(span_end - span_start)::BIGINT AS shared, (sum(span_end - span_start) / max(length(t)))::DOUBLE AS part FROM stretch JOIN text_of USING (doc_id) GROUP BY doc_id"

# problems 3 and 5: all pairs of vectors
_VECTORS = """v AS (SELECT chunk_id AS id, vector::DOUBLE[] AS v FROM chunks WHERE chunk_id IS NOT NULL AND len(vector) = 128 AND len(list_filter(vector, lambda x: isfinite(x))) = 128 AND len(list_filter(vector, lambda x: x <> 0)) > 0 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) = 1),
near AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN v b ON a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= {floor})"""
P3_FOUND = f"WITH {_VECTORS.format(floor=0.8)}, best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) <= 5) SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM best"
P5_FOUND = f"WITH RECURSIVE {_VECTORS.format(floor=0.75)}, reach(v, seen) AS (SELECT id, id FROM v UNION SELECT near.b, reach.seen FROM reach JOIN near ON near.a = reach.v), part AS (SELECT v AS chunk_id, min(seen) AS cluster_key FROM reach GROUP BY v) SELECT cluster_key, chunk_id FROM part WHERE cluster_key IN (SELECT cluster_key FROM part GROUP BY cluster_key HAVING count(*) >= 3)"


def _recall(floor: float) -> str:
    """On tables that one cell holds, the index meets every link."""
    links = f"{_VECTORS.format(floor=2)}, d AS (SELECT DISTINCT v FROM v), q AS (SELECT DISTINCT v FROM v WHERE ('0x' || substr(id, 2, 15))::UBIGINT % 100 = 0), n AS (SELECT q.v, count(*) AS c FROM q JOIN d ON q.v <> d.v AND list_cosine_similarity(q.v, d.v) >= {floor} GROUP BY q.v)"
    return f"WITH {links} SELECT (SELECT count(*) FROM q)::INT AS queries, coalesce(sum(least(c, 5)), 0)::BIGINT AS expected, coalesce(sum(least(c, 5)), 0)::BIGINT AS met, CASE WHEN count(*) > 0 THEN 1.0::DOUBLE END AS recall FROM n"


P3_RECALL, P5_RECALL = _recall(0.8), _recall(0.75)

P6_CHECKS = "SELECT 'documents' AS what, count(*)::BIGINT AS n FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'tokens', sum(strlen(text) + 1)::BIGINT FROM documents UNION ALL SELECT unnest(['over capacity', 'cut without need']), 0"

# problem 7: the words of both sides, and every run of 12
_L = r"[\p{L}\p{N}]"
_DISPLAYED = "|".join(rf"\\begin\s*\{{{n}\}}.*?\\end\s*\{{{n}\}}" for m in ("equation", "align", "alignat", "eqnarray", "gather", "multline", "flalign", "displaymath", "math") for n in (m, m + r"\*"))


def _words(table: str, key: str) -> str:
    steps = [
        (rf"(?s)\\\[.*?\\\]|\$\$.*?\$\$|{_DISPLAYED}", " \x01 "),
        (r"""\\[`'^"~=.](?:\{?\\?([A-Za-z])\}?)""", r"\1"),
        (r"(?s)\\(?:begin|end)\s*\{[^{}]*\}|\\(?:[Cc]ite[a-z]*|ref|eqref|pageref|autoref|label)\*?\s*(?:\[[^\]]*\]\s*)*\{[^{}]*\}|\\(?:[A-Za-z@]+\*?|[^-])", " "),
        (rf"({_L})-[ \t]*(?:\r\n|\n|\r)[ \t]*(?:%+[ \t]*)?({_L})", r"\1\2"),
        (r"[{}]+|\\-|\u00ad".replace(r"\u00ad", "\u00ad"), ""),
    ]
    text = "text"
    for pattern, to in steps:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return f"SELECT {key} AS id, regexp_extract_all(lower({text}), '{_L}+|\x01') AS w FROM (SELECT DISTINCT {key}, text FROM {table} WHERE text IS NOT NULL AND {key} IS NOT NULL)"


_LEAKS = f"""dw AS MATERIALIZED ({_words("documents", "doc_id")}), iw AS MATERIALIZED ({_words("eval_items", "item_id")}),
gram AS (SELECT id, i, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM iw) WHERE NOT contains(array_to_string(w[i : i + 11], ' '), '\x01')),
dgram AS (SELECT id, i, g FROM (SELECT id, i, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM dw)) WHERE g IN (SELECT g FROM gram)),
pair AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id, d.i AS nth, d.i - i.i AS shift FROM dgram d JOIN gram i USING (g))"""
P7_FOUND = f"WITH {_LEAKS} SELECT DISTINCT doc_id, item_id FROM pair"
P7_ITEMS = f"""WITH {_LEAKS}, run AS (SELECT doc_id, item_id, nth, shift, nth - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY nth) AS r FROM pair),
longest AS (SELECT doc_id, item_id, max(n) + 11 AS longest FROM (SELECT doc_id, item_id, count(*) AS n FROM run GROUP BY doc_id, item_id, shift, r) GROUP BY doc_id, item_id),
covered AS (SELECT doc_id, item_id, count(DISTINCT p) AS covered FROM (SELECT doc_id, item_id, unnest(range(nth, nth + 12)) AS p FROM pair) GROUP BY doc_id, item_id)
SELECT item_id, count(*) AS documents, count(*) FILTER (covered * 2 >= len(w)) AS half_or_more, max(longest)::BIGINT AS longest FROM longest JOIN covered USING (doc_id, item_id) JOIN iw ON iw.id = item_id GROUP BY item_id"""
