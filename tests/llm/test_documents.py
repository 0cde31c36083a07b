import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textgrove.llm.leakage import Automaton, leaked_items, leaked_spans, placed_words, without_leaks, words
from textgrove.llm.packing import best_fit_decreasing, byte_tokens, lower_bound, pack
from textgrove.llm.subjects import _links, passages, subject_shares


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60))
def test_best_fit_and_bound(sizes):
    x = np.array(sizes, np.int64)
    bins = best_fit_decreasing(x, 100)
    used = np.bincount(bins, weights=x) if len(x) else np.zeros(0)
    assert (used <= 100).all() and lower_bound(x, 100) <= len(used)


def test_bound_is_tight_where_known():
    assert lower_bound(np.array([51] * 7), 100) == 7
    assert lower_bound(np.array([34] * 6), 100) == 3
    assert lower_bound(np.array([60, 60, 40, 40]), 100) == 2


def test_pack(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([rnd.randrange(1, 60), rnd.randrange(60, 250)]), 1) for i in range(3_000)] + [(90_000, None, 1), (90_001, -4, 1), (90_002, 0, 1), (7, 30, 1), (90_003, 1_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, size long, bin int")
    got = pack(df, "doc_id", "size", 100, per_part=500)
    p = got.toPandas()
    assert (p.groupby("container")["size"].sum() <= 100).all()
    assert p["size"].sum() == sum(max(r[1] or 0, 0) for r in rows)
    assert not set(p["id"]) & {90_000, 90_001} and (p["id"] == 7).sum() == 1 + -(-rows[7][1] // 100)
    whole = p[p.pieces == 1]
    assert (whole["size"] <= 100).all() and sorted(p[p["id"] == 90_003]["piece"]) == list(range(10))
    least = lower_bound(p["size"].to_numpy(), 100)
    assert p["container"].nunique() <= least * 1.02 + 1
    assert pack(df.limit(0), "doc_id", "size", 100).count() == 0
    sizes = spark.createDataFrame([("aé😀",), ("",), (None,)], "t string").select(byte_tokens("t")).collect()
    assert [r[0] for r in sizes] == [8, 1, None]


def test_words():
    text = "Each~\\emph{veldax} {\\it in} the \\textbf{Sur}vey, not-\nebooks\\cite{ref2} % com-\n% mented: Well---\\'Etat\\\\end"
    assert words(text) == "each veldax in the survey notebooks commented well etat end".split()
    assert words("a \\[ x = 1 \\] b $$y$$ \\begin{align*} z \\end{align*} c $n$ d") == ["a", "\x00", "b", "\x00", "\x00", "c", "n", "d"]
    assert words("") == words("\\ % {}") == []


def brute(tokens, items, least):
    grams = {}
    for i, w in items:
        for k in range(len(w) - least + 1):
            if "\x00" not in w[k : k + least]:
                grams.setdefault(tuple(w[k : k + least]), set()).add(i)
    return set().union(*[grams.get(tuple(tokens[k : k + least]), set()) for k in range(len(tokens) - least + 1)], set())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=6), st.lists(st.sampled_from(["a", "b", "c", "d", "\x00"]), max_size=40))
def test_automaton(items, tokens):
    items = list(enumerate(items))
    a = Automaton(items, 3)
    got = a.runs(tokens)
    assert set(got) == brute(tokens, items, 3)
    for i, spans in got.items():
        grams = {tuple(items[i][1][k : k + 3]) for k in range(len(items[i][1]) - 2)}
        inside = {k + d for k in range(len(tokens) - 2) if tuple(tokens[k : k + 3]) in grams for d in range(3)}
        assert {k for a, b, _ in spans for k in range(a, b)} == inside and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
        runs = [n for n in range(3, 41) if any(tokens[k : k + n] == items[i][1][j : j + n] for k in range(len(tokens) - n + 1) for j in range(len(items[i][1]) - n + 1))]
        assert max(n for _, _, n in spans) == max(runs)


def test_automaton_stays_small():
    rnd = random.Random(1)
    items = [(i, [str(rnd.randrange(3_000)) for _ in range(200)]) for i in range(60)]
    a = Automaton(items, 12)
    assert a.size() < 70 * 12_000 and set(a.runs(items[7][1])) == {7}


def test_placed_words(sf):
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist() if t]
    texts += ["caf\\'{e}-\n bar \\[ x \\] \\emph{do}ing na\u00adive stra\u00dfe \u0130x", "a-\r\n% b{c}d $$ y $$", "\x00a\x01b", ""]
    for t in texts:
        got, at = placed_words(t)
        assert got == words(t) and all(a < b for a, b in at) and at == sorted(at)
        for w, (a, b) in zip(got, at, strict=True):
            if w != "\x00" and t[a:b].isalnum() and t[a:b].isascii():
                assert t[a:b].lower() == w


def test_leaks(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, f"x {item.upper()} y", 0), (2, " ".join(item.split()[:11]), 0), (3, "\\emph{" + item.replace(" ", "}\n% \\emph{") + "}", 0), (4, None, 0), (5, "", 0), (6, "one two three four five six \\[ a \\] seven eight nine ten eleven twelve thirteen", 0), (None, item, 0)]
    items = [(10, item, 0), (11, "one two", 0), (12, None, 0), (13, "", 0), (14, "zero " + item, 0), (10, item, 0)]
    d, e = spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string, doc_id int")
    got = {tuple(r) for r in leaked_items(d, e).select("doc_id", "item_id", "longest").collect()}
    assert got == {(i, j, 13) for i in (1, 3, None) for j in (10, 14)}
    assert leaked_items(d.limit(0), e).count() == leaked_items(d, e.limit(0)).count() == 0
    parted = leaked_items(d, e, shard_bytes=40, most_sent=1).select("doc_id", "item_id", "longest")
    assert {tuple(r) for r in parted.collect()} == got and parted.count() == len(got)


def test_spans_and_removal(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, f"Before. {item.title()}, after"), (2, "keep red green blue white black grey end"), (3, "red green blue white"), (4, None), (5, ""), (1, "another text"), (None, f"{item} x"), (6, f"{item} {item}")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame([(10, item), (11, "red green blue white black grey"), (12, None)], "item_id long, text string")
    spans = {tuple(r)[:5] for r in leaked_spans(d, e, coverage=0.8).collect()}
    n = len(item)
    assert spans == {(1, 10, 8, 8 + n, 13), (2, 11, 5, 36, 6), (None, 10, 0, n, 13), (6, 10, 0, 2 * n + 1, 26)}
    for more in ({}, {"shard_bytes": 10, "most_sent": 1}):
        got = sorted(map(tuple, without_leaks(d, e, **more).collect()), key=repr)
        want = [(1, "Before.  , after", n), (2, "keep   end", 31), (3, "red green blue white", 0), (4, None, 0), (5, "", 0), (1, "another text", 0), (None, f"{item} x", 0), (6, " ", 2 * n + 1)]
        assert got == sorted(want, key=repr)
    assert without_leaks(d.limit(0), e).count() == 0 and without_leaks(d, e.limit(0)).count() == len(docs)


def test_passages():
    text = "\\newcommand{\\foo}{membrane}\n\\title{Cell}\\begin{document}\\keywords{gene}\nThe \\foo{} is \\emph{here}~\\cite{a}. % draft words\n\\iffalse hidden \\fi Mol\\'ecule café!\n\\begin{comment}no\\end{comment}\\begin{equation}x\\end{equation}\n\\item[1)] Last $n$ one.\n\\begin{thebibliography}{9}\\bibitem{a} Book"
    assert passages(text) == [["the", "membrane", "is", "here"], ["molecule", "cafe"], ["last", "one"]]
    assert passages("") == []


def test_subjects(spark):
    rnd = random.Random(7)
    words_ = {s: [f"{s}{''.join(rnd.choice('aeiou') for _ in range(4))}" for _ in range(12)] for s in ("law", "sport", "bio")}
    common = ["the", "result", "shows", "that", "method"]

    def sentence(s):
        return " ".join(rnd.sample(common, 3) + rnd.sample(words_[s], 3)) + ". "

    docs, truth, labels = [], {}, []
    for i in range(300):
        pick = rnd.sample(sorted(words_), rnd.choice([1, 1, 2]))
        text = "".join(sentence(s) for s in pick for _ in range(8)) + sentence(rnd.choice(sorted(words_)))
        docs.append((i, text, "x"))
        truth[i] = set(pick)
        if i % 4 == 0:
            labels += [(i, rnd.choice([s, s.upper() + " ", {"law": "Law title"}.get(s, s)])) for s in pick]
    labels += [(1, None), (2, "unknown"), (None, "law"), (4, rnd.choice(sorted(words_))), (8, "bio"), (999, "law")]
    docs += [(900, None, "x"), (901, "", "x"), (902, "the result", "x"), (None, sentence("law"), "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string")
    sub = spark.createDataFrame([("law", "Law title"), ("sport", None), ("bio", "Biology"), (None, "x")], "subject string, title string")
    for most in (200_000, 3):
        got = subject_shares(d, lab, sub, most_terms=most)
        found = {}
        for r in got.where("share >= 0.3").collect():
            found.setdefault(r["doc_id"], set()).add(r["subject"])
        assert sum(found.get(i) == t for i, t in truth.items()) >= 0.98 * len(truth)
        assert not set(found) - set(truth)
    assert subject_shares(d, lab.limit(0), sub).count() == subject_shares(d.limit(0), lab, sub).count() == subject_shares(d, lab, sub.limit(0)).count() == 0
    assert got.where(F.col("share").isNull()).count() == 0


def test_all_documents_of_a_term_meet(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1_500, 64)) + 0.8
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float16)
    x[700] = x[3]
    df = spark.createDataFrame([(i, [7], v.tobytes()) for i, v in enumerate(x)], "doc_id long, tops array<long>, sketch binary")
    s = x.astype(np.float32) @ x.astype(np.float32).T
    np.fill_diagonal(s, -1)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= 0.3}
    for more in ({}, {"block": 200}):
        got = _links(df, 5, 0.3, **more).select("doc_id", "other").collect()
        assert len(got) == len(want) and len({tuple(r) for r in got} & want) >= len(want) - 4  # but for ties in single precision


def test_exchange_saves_containers(spark):
    for seed in (1, 2):
        rnd = random.Random(seed)
        rows = [(i, rnd.choice([rnd.randrange(1, 400), rnd.randrange(300, 700)])) for i in range(2_000)]
        df = spark.createDataFrame(rows, "id long, n long")
        used = [pack(df, "id", "n", 1_000, per_part=100, rounds=r) for r in (0, 4)]
        before, after = (u.select("container").distinct().count() for u in used)
        assert -(-sum(n for _, n in rows) // 1_000) <= after < before
        assert used[1].groupBy("container").agg(F.sum("size").alias("n")).where("n > 1000").isEmpty() and used[1].count() == len(rows)
