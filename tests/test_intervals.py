import random

from hypothesis import given, settings
from hypothesis import strategies as st

from textgrove.operators.intervals import IntervalMap, covered_gaps, covered_periods
from textgrove.streaming.intervals import gap_changes

ROWS = "k string, s long, e long"


def brute(rows):
    out = {}
    for k, s, e in sorted((r for r in rows if None not in r and r[1] < r[2]), key=lambda r: (r[0], r[1])):
        p = out.setdefault(k, [])
        if p and s <= p[-1][1]:
            p[-1][1] = max(p[-1][1], e)
        else:
            p.append([s, e])
    periods = {(k, s, e) for k, p in out.items() for s, e in p}
    gaps = {(k, a[1], b[0]) for k, p in out.items() for a, b in zip(p, p[1:])}
    return periods, gaps


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60))))
def test_interval_map(spans):
    m = IntervalMap()
    for s, e in spans:
        m.insert(s, e)
    covered = {x for s, e in spans for x in range(s, e)}
    assert {x for s, e in zip(m.starts, m.ends) for x in range(s, e)} == covered
    assert all(a < b for a, b in m.gaps())


def test_periods_and_gaps(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), s := rnd.randrange(400), s + rnd.randrange(-3, 12)) for _ in range(120)]
    rows += [("hot", i * 3, i * 3 + 2) for i in range(200)] + [("hot", 0, 2)] * 50
    rows += [(None, 1, 2), ("a", None, 5), ("a", 5, None), ("a", 7, 7), ("far", -40, -20), ("far", -20, 5), ("far", 90, 300)]
    df = spark.createDataFrame(rows, ROWS)
    periods, gaps = brute(rows)
    for block in (16, 1 << 20):
        assert {tuple(r) for r in covered_periods(df, "k", "s", "e", block).collect()} == periods
        got = [tuple(r) for r in covered_gaps(df, "k", "s", "e", block).collect()]
        assert set(got) == gaps and len(got) == len(gaps)


def test_empty_and_clashing_names(spark):
    assert covered_gaps(spark.createDataFrame([], ROWS), "k", "s", "e").count() == 0
    df = spark.createDataFrame([("a", 0, 1, "x", 9), ("a", 4, 6, None, 9)], ROWS + ", __key string, __block long")
    assert [tuple(r) for r in covered_gaps(df, "k", "s", "e").collect()] == [("a", 1, 4)]


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 0, 5), ("a", 10, 12), ("b", 1, 2)], ROWS).write.parquet(src)
    q = gap_changes(spark.readStream.schema(ROWS).parquet(src), "k", "s", "e").writeStream.format("memory").queryName("gaps").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    spark.createDataFrame([("a", 4, 7)], ROWS).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    rows = [tuple(r) for r in spark.sql("SELECT key, gap_start, gap_end, open FROM gaps").collect()]
    assert rows == [("a", 5, 10, True), ("a", 5, 10, False), ("a", 7, 10, True)]


def test_stream_across_blocks(spark, tmp_path):
    src, n = str(tmp_path / "in"), 1 << 20
    rnd = random.Random(4)
    batches = [
        [("a", 5, 9), ("a", n + 3, n + 4), ("a", 4 * n + 1, 4 * n + 2), ("b", 0, n), ("b", n, n + 7), ("c", 0, n), ("c", n + 1, n + 2), ("d", -9, -3), ("d", 2, 3)],
        [("a", 2 * n, 2 * n + 5), ("a", 9, n + 3), ("c", n, n + 1), ("d", -3, 1)],
        [("r", s := rnd.randrange(-3 * n, 9 * n), s + rnd.randrange(1, n // 3)) for _ in range(25)],
        [("r", s := rnd.randrange(-3 * n, 9 * n), s + rnd.randrange(1, n)) for _ in range(12)],
    ]
    q = None
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ROWS).coalesce(2).write.mode("append").parquet(src)
        if q is None:
            q = gap_changes(spark.readStream.schema(ROWS).parquet(src), "k", "s", "e").writeStream.format("memory").queryName("gaps_across").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        net = {}
        for r in spark.sql("SELECT * FROM gaps_across").collect():
            gap = (r["key"], r["gap_start"], r["gap_end"])
            assert r["block"] == (r["gap_start"] - 1) // n
            net[gap] = net.get(gap, 0) + (1 if r["open"] else -1)
        assert {g for g, c in net.items() if c} == brute([r for b in batches[: i + 1] for r in b])[1] and set(net.values()) <= {0, 1}
    q.stop()


def test_one_interval_of_any_length(spark):
    rows = [("a", -5, 1 << 60), ("a", 7, 9), ("b", 0, 3), ("b", 1 << 50, (1 << 50) + 4)]
    df = spark.createDataFrame(rows, "k string, s long, e long")
    assert {tuple(r) for r in covered_periods(df, "k", "s", "e").collect()} == {("a", -5, 1 << 60), ("b", 0, 3), ("b", 1 << 50, (1 << 50) + 4)}
    assert {tuple(r) for r in covered_gaps(df, "k", "s", "e").collect()} == {("b", 3, 1 << 50)}
