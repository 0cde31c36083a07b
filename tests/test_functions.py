from difflib import SequenceMatcher
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textgrove.functions import text as X
from textgrove.functions import windows
from textgrove.functions.models import boundaries_by_headings, toc_by_headings
from textgrove.functions.register import register
from textgrove.functions.windows import best_window, flat_tree, sentence_range, toc_components


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f("c").alias("r")).first()[0]


def test_split(spark):
    rows = [("Intro as FOLLOWS: Body",), ("a follows: b follows: c",), ("abc",), ("",), (None,), ("é😀 follows:ß",)]
    df = spark.createDataFrame(rows, "c string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in X.split_at_marker("c").items()]).collect()]
    assert got == [("Intro as ", " Body", 17, 22), ("a ", " b follows: c", 10, 23), ("", "abc", 0, 3), ("", "", 0, 0), (None, None, None, None), ("é😀 ", "ß", 11, 12)]


def test_model_json(spark):
    assert one(spark, 'x</think>y</think>{"a":1}', X.model_json) == '{"a":1}'
    assert one(spark, 'hi\n```json\n{"a":1}\n```\nbye\n```json\n{}\n```', X.model_json) == '{"a":1}'
    assert one(spark, "not json", X.model_json) == "not json"
    assert one(spark, None, X.model_json) is None


def test_scalars(spark):
    assert one(spark, "\n a b\t", X.trimmed) == "a b"
    assert one(spark, "a\r\nb\rc", X.newlines) == "a\nb\nc"
    assert one(spark, "x/y/z.txt", X.basename) == "z.txt"
    assert one(spark, "One. Two. Three", lambda c: X.sentences(c, 2)) == "One. Two"
    df = spark.createDataFrame([("abcabc", "bc", ""), ("abc", "zz", None)], "h string, n string, e string")
    assert [tuple(r) for r in df.select(X.found_at("h", "n"), X.found_at(F.col("h"), F.col("e")), X.first_of("e", "n")).collect()] == [(1, 0, "bc"), (-1, None, "zz")]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0])], "v array<float>, w array<float>")
    got = [r[0] for r in v.select(X.cosine("v", "w")).collect()]
    assert abs(got[0] - 0.70710678) < 1e-6 and got[1:] == [None, None, None]


def slow_window(content, target):
    words, low, goal = [m.span() for m in re.finditer(r"\S+", content)], content.lower(), target.lower()
    k, best, at = len(target.split()), -1.0, (0, 0)
    if not k or not content:
        return 0, 0, 0.0
    for i in range(len(words) - k + 1):
        s, e = words[i][0], words[i + k - 1][1]
        score = SequenceMatcher(None, goal, low[s:e]).ratio()
        if score > best:
            best, at = score, (s, e)
    return *at, best


def test_window():
    assert best_window("A b c d b c", "B C") == (2, 5, 1.0)
    assert best_window("x", "  ") == best_window("", "a") == best_window(None, None) == (0, 0, 0.0)
    assert best_window("one two", "a b c d") == (0, 0, -1.0)
    rnd = random.Random(5)
    for _ in range(150):
        content = " ".join("".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(0, 25)))
        target = " ".join("".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(0, 4)))
        assert best_window(content, target) == slow_window(content, target)
    assert sentence_range("aa bb cc dd", "cc dd", "aa bb") == (5, 6)


def test_toc():
    assert toc_components('{"ARTICLE_I":{"name":"N","sections":{"s1":"T","s2":3},"x":"dropped"}}') == [{"component_name": "ARTICLE_I", "component_description": "N", "childs": [("s1", "T"), ("s2", None)]}]
    assert toc_components('{"Exhibits":{"name":"E","A":"t","B":{"name":"b"},"C":1}}')[0]["childs"] == [("A", "t"), ("B", "b"), ("C", None)]
    assert toc_components('{"Annex":"t"}') == [{"component_name": "Annex", "component_description": "t", "childs": []}]
    assert toc_components('"raw"') == toc_components(None) == toc_components('{"cut') == []
    assert toc_components("[]") == []


def test_tree():
    rows = flat_tree('{"a": [1], "b": "x", "c": {"d": {"start_sentence": "cc", "end_sentence": "dd"}, "e": {}}}', "aa bb cc dd")
    assert [(r[0], r[3], r[4], r[5]) for r in rows] == [(["c"], False, 0, 11), (["c", "d"], True, 6, 11), (["c", "e"], False, 0, 0)]
    assert flat_tree("no", "x") == flat_tree(None, None) == []
    text = "ARTICLE I First\nSection 1.1 A. one two.\nmore.\nSection 1.2 B. three.\nExhibit A list"
    assert "Section 1.1" in toc_by_headings([text])[0] and "Exhibits" in toc_by_headings([text])[0]
    assert "Section 1.2" in boundaries_by_headings([text])[0]


def test_sql_names(spark):
    register(spark)
    assert spark.sql("SELECT find_window('A b c d b c', 'B C').end").first()[0] == 5
    assert abs(spark.sql("SELECT cosine(array(1D, 0D), array(1D, 1D))").first()[0] - 0.7071) < 1e-3
    tree = '{"a": {"start_sentence": "aa", "end_sentence": "bb"}}'
    assert spark.sql(f"SELECT path[0], start, end FROM chunk_tree('{tree}', 'aa bb')").first() == ("a", 0, 5)
    assert spark.sql("SELECT letter_embedding('Abba')[1], size(toc_components('{\"Annex\":\"t\"}'))").first() == (2.0, 1)


def test_fuzzy_window_of_leaves(spark, sf):
    from textgrove.plans.reference import fuzzy_window
    from textgrove.sources.tables import table

    rows = fuzzy_window(spark, sf).toPandas()
    text = {r["doc_id"]: re.sub("\r\n?", "\n", r["content"]) for r in table(spark, sf, "contracts").where("doc_id is not null and content is not null").collect()}
    leaf = {r["chunk_id"]: r for r in table(spark, sf, "chunks").where("content is not null").collect()}
    inexact = 0
    for r in rows.itertuples():
        if r.chunk_id not in leaf or leaf[r.chunk_id]["doc_id"] not in text:
            continue
        content, own = text[leaf[r.chunk_id]["doc_id"]], re.sub("\r\n?", "\n", leaf[r.chunk_id]["content"]).strip(" \t\n\r\f\v")
        said = re.split(r"(?<=\.)\s+", own, flags=re.ASCII)
        first, last = (t.translate(str.maketrans("eE", "aA")) if r.altered else t for t in (said[0], said[-1]))
        if r.altered:
            inexact += 0 < r.score < 1 or 0 < r.last_score < 1
        assert (r.score, r.last_score) == tuple(round(best_window(content, t)[2], 6) for t in (first, last))
        assert (r.start, r.end) == sentence_range(content, first, last)
    assert inexact > 3 and (rows["altered"].mean() < 0.2)


@settings(max_examples=200, deadline=None)
@given(st.text("abcdefgh ", max_size=60), st.text("abcdefgh ", max_size=40), st.integers(1, 12))
def test_matcher_is_that_of_the_library(a, b, times):
    from difflib import SequenceMatcher

    a, b = (a + "q") * times, (b + "xq") * times  # beyond 200 characters frequent ones do not count
    ours, theirs = windows._Matcher(None), SequenceMatcher(None)
    for m in (ours, theirs):
        m.set_seq1(a)
        m.set_seq2(b)
    assert ours.get_matching_blocks() == theirs.get_matching_blocks() and ours.ratio() == theirs.ratio()
