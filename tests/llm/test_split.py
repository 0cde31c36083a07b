import re

from hypothesis import given, settings
from hypothesis import strategies as st

from textgrove.llm.split import balanced_pieces, sequential_pieces, split_oversized
from textgrove.llm.split_queries import long_items, p1_found

TEXTS = st.lists(st.sampled_from(["ab", "c", ". ", "\n\n", " ", "longword", "; ", "\r\n", "😀", "\t", "!"]), max_size=500).map("".join)


def brute(text, limit, overlap):
    """The rule as stated, tried at every end."""
    gaps = [m.span() for m in re.finditer(r"[ \t\r\n]+", text)]
    s, out = 0, []
    while len(text) - s > limit:
        ends = [(a, b) for a, b in gaps if s + limit // 2 < b <= s + limit]
        best = [b for a, b in ends if text[a:b].count("\n") >= 2] or [b for a, b in ends if a and text[a - 1] in ".!?;"] or [b for _, b in ends] or [s + limit]
        out.append((s, best[-1]))
        s = best[-1] - overlap
    return [*out, (s, len(text))]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_sequential(text):
    assert sequential_pieces(text, 60, 6) == brute(text, 60, 6)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_balanced(text):
    p = balanced_pieces(text, 60, 6)
    assert p[0][0] == 0 and p[-1][1] == len(text)
    assert all(b - a <= 60 for a, b in p)
    assert all(c == b - 6 and d > b for (_, b), (c, d) in zip(p, p[1:]))
    assert "".join(text[a if i == 0 else a + 6 : b] for i, (a, b) in enumerate(p)) == text


def test_balanced_is_balanced():
    assert balanced_pieces("word. " * 500, 1_200, 120) == [(0, 1080), (960, 2040), (1920, 3000)]
    assert len(balanced_pieces("x" * 10_000, 1_200, 120)) == 10


def test_operator_cases(spark):
    rows = [("a", "x" * 130, 5, 1), ("b", None, 0, 1), ("c", "", 0, 1), ("d", "y" * 100, 0, 1), (None, "z" * 101, None, 1), ("a", "x" * 130, 5, 1)]
    df = spark.createDataFrame(rows, "item_id string, text string, offset long, piece_start int")
    got = sorted(map(tuple, split_oversized(df, limit=100, overlap=10, method="sequential").collect()), key=str)
    assert got == sorted([("a", 5, 105), ("a", 95, 135)] * 2 + [(None, 0, 100), (None, 90, 101)], key=str)
    assert split_oversized(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf):
    want = {(r["item_id"], s + r["offset"], e + r["offset"]) for r in long_items(spark, sf).collect() if len(r["text"]) > 1_200 for s, e in brute(r["text"], 1_200, 120)}
    got = [tuple(r) for r in p1_found(spark, sf).collect()]
    assert set(got) == want and len(got) == len(want) > 0
