"""Evaluation texts inside training texts, found with generalised suffix automata of the test items.

Both sides are read as words: runs of letters and digits, case folded. Markup commands with their braces, names of
environments, keys of citations and references, comment signs and line layout are passed over, words broken at a line's
end or by braces are joined, and a displayed formula interrupts. An automaton holds every run of words of its items; a
document's words are streamed through it, which gives at each word the length of the longest run that ends there and
stands in some item. Runs that exceed a length, or that cover a part of their item, are the spans that are reported, and
that are removed from the text.

Items are dealt into shards of bounded size; each shard's automaton is built in a task and written in arrays (about 50
bytes a word). As many automata as fit a bound are sent to all tasks at a time, and the documents are read once for each
such load; documents are not shuffled. So any number of items can be searched for.
"""

from __future__ import annotations

import pickle
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

_DISPLAYED = "equation|align|alignat|eqnarray|gather|multline|flalign|displaymath|math"
_FORMULA = re.compile(r"\\\[.*?\\\]|\$\$.*?\$\$|\\begin\s*\{(" + _DISPLAYED + r")(\*?)\}.*?\\end\s*\{\1\2\}", re.S)
_MARKUP = re.compile(r"\\(?:begin|end)\s*\{[^{}]*\}|\\(?:[Cc]ite[a-z]*|ref|eqref|pageref|autoref|label)\*?\s*(?:\[[^\]]*\]\s*)*\{[^{}]*\}|\\(?!-)(?:[A-Za-z@]+\*?|.)", re.S)
_JOINED = re.compile(r"[{}]+|\\-|\u00ad|(?<=[^\W_]|\x01)-[ \t]*(?:\r\n|\n|\r)[ \t]*(?:%+[ \t]*)?(?=[^\W_])")
_WORD = re.compile(r"[^\W_]+|\x00")
_ACCENT = re.compile(r"\\[`'^\"~=.](?:\{?\\?([A-Za-z])\}?)")
BREAK = "\x00"
_SAME = re.compile(r"[^\W_](?:\x01*[^\W_])*|\x00")


def words(text: str) -> list[str]:
    """The compared words of a text in order; BREAK stands for a displayed formula."""
    text = text.replace("\x00", " ").replace("\x01", " ")
    if "\\" in text or "$$" in text:
        text = _FORMULA.sub(" \x00 ", text)
        text = _MARKUP.sub(" ", _ACCENT.sub(r"\1", text))
    return _WORD.findall(_JOINED.sub("", text).casefold())


def placed_words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """words(text) with the place of each in text: what is passed over is replaced at equal length, by blanks or, inside words, by a sign that joins."""
    text = text.replace("\x00", " ").replace("\x01", " ")
    if "\\" in text or "$$" in text:
        text = _FORMULA.sub(lambda m: " \x00".ljust(len(m[0])), text)
        text = _ACCENT.sub(lambda m: m[1].ljust(len(m[0]), "\x01"), text)
        text = _MARKUP.sub(lambda m: " " * len(m[0]), text)
    out, at = [], []
    for m in _SAME.finditer(_JOINED.sub(lambda m: "\x01" * len(m[0]), text)):
        for w in _WORD.findall(m[0].replace("\x01", "").casefold()):
            out.append(w)
            at.append(m.span())
    return out, at


class Automaton:
    """Generalised suffix automaton over word numbers, in arrays; runs of at least `least` words are of interest.

    Most states have one way on: `letter` and `target` hold the first of each state, `more` and `more_to` all others,
    sorted by state and letter. item_from and item_of list the items that hold the run of each state of `least` words or more.
    """

    def __init__(self, items: list[tuple[int, list[str]]], least: int):
        self.least, vocabulary = least, {}
        nxt: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        ends: list[tuple[int, int]] = []

        def clone(p: int, c: int, q: int) -> int:
            twin = len(nxt)
            nxt.append(dict(nxt[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = twin
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = twin
                p = link[p]
            return twin

        def extend(last: int, c: int) -> int:
            if c in nxt[last]:
                q = nxt[last][c]
                return q if length[last] + 1 == length[q] else clone(last, c, q)
            new, p = len(nxt), last
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[p] + 1 == length[q] else clone(p, c, q)
            return new

        self.words = {}
        for item, tokens in items:
            last, self.words[item] = 0, len(tokens)
            for w in tokens:
                if w == BREAK:
                    last = 0
                    continue
                last = extend(last, vocabulary.setdefault(w, len(vocabulary)))
                ends.append((last, item))
        found: dict[int, set[int]] = {}
        for state, item in ends:
            while state > 0 and length[state] >= least:
                known = found.setdefault(state, set())
                if item in known:
                    break
                known.add(item)
                state = link[state]
        self.terms = list(vocabulary)
        self.link, self.length = array("i", link), array("i", length)
        firsts = [next(iter(n.items()), (-1, 0)) for n in nxt]
        self.letter, self.target = array("i", [c for c, _ in firsts]), array("i", [t for _, t in firsts])
        rest = sorted((state * len(vocabulary) + c, t) for state, n in enumerate(nxt) for c, t in list(n.items())[1:])
        self.more, self.more_to = array("q", [k for k, _ in rest]), array("i", [t for _, t in rest])
        per = [sorted(found.get(state, ())) for state in range(len(nxt))]
        self.item_from = array("i", np.concatenate([[0], np.cumsum([len(x) for x in per])]).astype(np.int32).tobytes())
        self.item_of = array("q", [i for x in per for i in x])

    def size(self) -> int:
        """Bytes of the arrays."""
        return sum(len(x) * x.itemsize for x in (self.link, self.length, self.letter, self.target, self.more, self.more_to, self.item_from, self.item_of))

    def runs(self, tokens: list[str]) -> dict[int, list[list[int]]]:
        """{item: [[first word, after the last, longest run]]}: the words of tokens that lie in runs of at least `least` words that they share with the item; runs that overlap or touch are one."""
        if len(tokens) < self.least:
            return {}
        if not hasattr(self, "number"):
            self.number = {w: i for i, w in enumerate(self.terms)}
        ids = np.fromiter(map(self.number.get, tokens, repeat(-1)), np.int32, len(tokens))
        known = np.concatenate([[False], ids >= 0, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= self.least
        link, lengths, letter, target, more, more_to, least, terms = self.link, self.length, self.letter, self.target, self.more, self.more_to, self.least, len(self.terms)
        out: dict[int, list[list[int]]] = {}
        for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            state = length = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while True:
                    if letter[state] == c:
                        state, length = target[state], length + 1
                        break
                    key = state * terms + c
                    at = bisect_left(more, key)
                    if at < len(more) and more[at] == key:
                        state, length = more_to[at], length + 1
                        break
                    if not state:
                        break
                    state = link[state]
                    length = lengths[state]
                if length >= least:
                    at = state
                    while lengths[link[at]] >= length:
                        at = link[at]
                    while True:  # from the longest run to the one of `least` words; each state up holds more items
                        n = min(length, lengths[at])
                        for item in self.item_of[self.item_from[at] : self.item_from[at + 1]]:
                            spans = out.setdefault(item, [])
                            if spans and spans[-1][1] >= i + 1 - n:
                                last = spans[-1]
                                last[0], last[1], last[2] = min(last[0], i + 1 - n), i + 1, max(last[2], n)
                            else:
                                spans.append([i + 1 - n, i + 1, n])
                        if lengths[link[at]] < least:
                            break
                        at = link[at]
        return out


def _shards(items: DataFrame, least: int, item_id: str, item_text: str, shard_bytes: int) -> DataFrame:
    """(shard, size, automaton), a row a shard."""
    held = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).distinct()
    total = held.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))

    def build(t: pa.Table) -> pa.Table:
        made = Automaton(sorted((i, words(x)) for i, x in zip(t["i"].to_pylist(), t["t"].to_pylist(), strict=True)), least)
        blob = pickle.dumps(made)
        return pa.table({"shard": t["shard"].slice(0, 1), "size": pa.array([len(blob)], pa.int64()), "automaton": pa.array([blob], pa.binary())})

    dealt = held.withColumn("shard", F.pmod(F.xxhash64("i"), F.lit(shards)))
    return cut(dealt.groupBy("shard").applyInArrow(build, "shard bigint, size bigint, automaton binary"), "automata")


def leaked_spans(documents: DataFrame, items: DataFrame, least: int = 12, coverage: float | None = None, shortest: int = 6, offsets: bool = True, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shard_bytes: int = 1_000_000, most_sent: int = 64_000_000) -> DataFrame:
    """(doc_id, item_id, span_start, span_end, words, longest, item_words, text_hash): each stretch of a document that it shares with an item.

    A stretch is made of runs of words that stand in the item, overlapping or touching. It counts if its longest run has
    at least `least` words or, with coverage given, if it has at least `shortest` words and that part of the item's. Its
    place is in code points of the text (null without offsets). Null or empty texts and items match nothing; items that
    share a text are each reported; an item_id with several texts has them all. Repeated documents give repeated rows.
    shard_bytes: text of a shard of items. most_sent: bytes of automata sent to all tasks at a time; one automaton larger
    than that, of a single item of many megabytes, is sent alone.
    """
    spark = documents.sparkSession
    floor = least if coverage is None else min(least, shortest)
    shards = _shards(items, floor, item_id, item_text, shard_bytes)
    loads: list[tuple[int, list[int]]] = []
    for shard, size in shards.select("shard", "size").orderBy("size", "shard").collect():  # two numbers a shard
        if not loads or loads[-1][0] + size > most_sent:
            loads.append((0, []))
        loads[-1] = (loads[-1][0] + size, [*loads[-1][1], shard])
    named = [("doc_id", "bigint"), ("item_id", "bigint"), ("span_start", "bigint"), ("span_end", "bigint"), ("words", "bigint"), ("longest", "bigint"), ("item_words", "bigint"), ("text_hash", "bigint")]
    schema = ", ".join(map(" ".join, named))
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h")).where(F.length("text") > 2 * floor - 2)
    out = None
    for _, mine in loads:
        blobs = [bytes(r[0]) for r in shards.where(F.col("shard").isin(mine)).select("automaton").collect()]  # at most most_sent bytes
        sent = spark.sparkContext.broadcast(blobs)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automata = [pickle.loads(b) for b in sent.value]
            for batch in batches:
                rows = []
                for d, t, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    tokens, at = words(t), None
                    for automaton in automata:
                        for item, spans in automaton.runs(tokens).items():
                            size = automaton.words[item]
                            for a, b, longest in spans:
                                if longest >= least or coverage is not None and b - a >= max(shortest, coverage * size):
                                    if offsets and at is None:
                                        at = placed_words(t)[1]
                                    rows.append((d, item, at[a][0] if offsets else None, at[b - 1][1] if offsets else None, b - a, longest, size, h))
                cols = list(zip(*rows, strict=True)) or [()] * len(named)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[n for n, _ in named])

        got = docs.mapInArrow(search, schema)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], schema)


def leaked_items(documents: DataFrame, items: DataFrame, least: int = 12, **more) -> DataFrame:
    """(doc_id, item_id, longest, covered, item_words): each item of whose text a document holds at least `least` consecutive words.

    longest is the longest such run, covered the document's words that lie in such runs of the item. Rows of one document
    and item are one, also where the document is repeated. Other cases are those of leaked_spans.
    """
    spans = leaked_spans(documents, items, least, offsets=False, **more)
    per_text = spans.groupBy("doc_id", "item_id", "text_hash", "item_words").agg(F.max("longest").alias("longest"), F.sum("words").alias("covered"))
    return per_text.groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"), F.max("covered").alias("covered"), F.max("item_words").alias("item_words"))


def without_leaks(documents: DataFrame, items: DataFrame, least: int = 12, coverage: float | None = 0.8, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """(doc_id, text, removed): every document with the stretches of leaked_spans taken out; removed counts their code points.

    Where a stretch is taken out one blank stays. Documents without leaks, null texts and null ids stay as they are.
    """
    spans = leaked_spans(documents, items, least, coverage, doc_id=doc_id, text=text, **more)
    places = spans.select("doc_id", "text_hash", F.struct("span_start", "span_end").alias("s")).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("s")).alias("spans"))
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts, at, gone = [], 0, 0
                for s in spans or ():
                    if s["span_end"] > at:
                        start = max(at, s["span_start"])
                        if s["span_start"] > at or not at:
                            parts.append(t[at:start])
                        gone += s["span_end"] - start
                        at = s["span_end"]
                texts.append(" ".join([*parts, t[at:]]) if spans else t)
                removed.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["doc_id", "text", "removed"])

    return docs.join(places, ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans").mapInArrow(take_out, "doc_id bigint, text string, removed bigint")
