import random

import numpy as np

from textgrove.llm import shared_spans as S
from textgrove.llm.shared_spans import shared_spans


def brute(rows, least):
    """Every window of `least` of every text."""
    texts = {}
    for i, t in rows:
        if i is not None and t is not None:
            texts[i] = t
    where = {}
    for i, t in texts.items():
        for a in range(len(t) - least + 1):
            where.setdefault(t[a : a + least], set()).add(i)
    out = set()
    for i, t in texts.items():
        spans = []
        for a in range(len(t) - least + 1):
            if len(where[t[a : a + least]]) > 1:
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = a + least
                else:
                    spans.append([a, a + least])
        out |= {(i, *s) for s in spans}
    return out


def prose(rnd, n):
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 9))) for _ in range(300)]
    out = ""
    while len(out) < n:
        out += rnd.choice(words) + rnd.choice([" ", " ", " ", ". ", "\n\n", ", ", "é ", "😀"])
    return out[:n]


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id string, content string, id int, cid int") if len(rows[0]) == 4 else spark.createDataFrame(rows, "doc_id string, content string")
    got = [tuple(r)[:3] for r in shared_spans(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute([r[:2] for r in rows], 200)
    return got


def test_against_all_windows(spark):
    rnd = random.Random(3)
    parts = [prose(rnd, n) for n in (199, 200, 201, 230, 500, 900, 350, 260)]
    rows = []
    for i in range(60):
        t = "".join(rnd.choice(parts) if rnd.random() < 0.4 else prose(rnd, rnd.randrange(1, 700)) for _ in range(4))
        rows.append((f"d{i}", t))
    rows += [("copy1", rows[0][1]), ("copy2", rows[0][1]), ("short", "x" * 199), ("empty", ""), ("null", None), (None, rows[1][1]), ("copy1", rows[0][1])]
    assert len(check(spark, rows)) > 60


def test_odd_texts(spark):
    rnd = random.Random(4)
    run = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(700))  # no gaps at all
    edits = prose(rnd, 3_000)
    rows = [("a", run[:400]), ("b", "!" + run[100:650]), ("c", run[300:])]
    rows += [(f"e{i}", edits[: i * 300] + "#" + edits[i * 300 + 1 :]) for i in range(1, 9)]  # nearly equal copies
    rows += [("twice", run[:0] + "q" * 50 + edits[:150] * 2)]
    check(spark, [(*r, 1, 2) for r in rows])  # names of the operator's own columns


def test_long_text_is_read_in_segments(spark):
    rnd = random.Random(5)
    common = prose(rnd, 1_500)
    rows = [("long", prose(rnd, 1_010_000) + common + prose(rnd, 3_000)), ("other", prose(rnd, 500) + common)]
    got = {tuple(r)[:3] for r in shared_spans(spark.createDataFrame(rows, "doc_id string, content string")).collect()}
    assert any(i == "long" and s <= 1_010_000 and e >= 1_011_500 for i, s, e in got) and any(i == "other" and s <= 500 and e >= 2_000 for i, s, e in got)


def test_empty_table(spark):
    assert shared_spans(spark.createDataFrame([], "doc_id string, content string")).count() == 0


def certain(text, left):
    codes = S._codes(text)
    p, low, high = S.parse(codes, S.Spelling(codes), np.zeros(len(codes), np.int64))
    return {(int(x) - left, int(lo) - left, int(hi) - left) for x, lo, hi in zip(p[1:], np.minimum(low[1:], low[:-1]), np.maximum(high[1:], high[:-1]), strict=True)}


def test_certain_boundaries_stand_in_every_context():
    rnd = random.Random(6)
    hexes = "".join(rnd.choice("0123456789abcdef") for _ in range(90))
    for core in (prose(rnd, 400), hexes * 2 + prose(rnd, 150), "-" * 70 + prose(rnd, 100) + "ab " * 60, "x" * 300, ("word " * 9 + hexes[:45]) * 5):
        seen = []
        for left, right in ((prose(rnd, 333), prose(rnd, 222)), ("", prose(rnd, 5)), (hexes, hexes), ("-" * 60, "ab ab"), (core, core)):
            seen.append({b for b in certain(left + core + right, len(left)) if b[1] >= 0 and b[2] <= len(core)})
        assert all(x == seen[0] for x in seen)


def test_texts_of_one_symbol_and_of_few(spark):
    rnd = random.Random(8)
    few = "".join(rnd.choice("ab ") for _ in range(900))
    rows = [("a", "=" * 450), ("b", "x" + "=" * 230 + "y"), ("c", "ab" * 300), ("d", "q" + "ab" * 120 + "r"), ("e", few), ("f", few[100:420] + "zz" + few[500:705])]
    check(spark, rows)
    got = {tuple(r)[:3] for r in shared_spans(spark.createDataFrame(rows, "doc_id string, content string"), most_sent=0).collect()}
    assert got == brute(rows, 200)


def test_texts_whose_numbers_collide(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(f"d{i}", prose(rnd, 400)) for i in range(6)]
    rows.append(("e", rows[0][1][100:]))
    hashed = S.F.xxhash64
    monkeypatch.setattr(S.F, "xxhash64", lambda *c: S.F.lit(7).cast("bigint") if str(c[0]) == str(S.F.lit(0)) else hashed(*c))
    check(spark, rows)
