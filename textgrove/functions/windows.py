"""Fuzzy location of a sentence in a text, by windows of words, and other Python functions SQL cannot express."""

from __future__ import annotations

import json
import random
import re
from bisect import bisect_left
from collections import Counter
from difflib import Match, SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"\S+")


def _common(at_letter: dict[str, int], n: int, text: str) -> int:
    """Length of the longest common subsequence of text and a string of n characters, given as a bit mask of places per character."""
    row = full = (1 << n) - 1
    for c in text:
        hit = row & at_letter.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


class _Matcher(SequenceMatcher):
    """SequenceMatcher for strings without junk, of equal results: only those places of the first string are visited whose
    character counts in the second, which in long strings, where frequent characters do not, are few."""

    def set_seq2(self, b: str) -> None:
        super().set_seq2(b)
        self.spots = [i for i, c in enumerate(self.a) if c in self.b2j]

    def find_longest_match(self, alo: int = 0, ahi: int | None = None, blo: int = 0, bhi: int | None = None) -> Match:
        a, b, places = self.a, self.b, self.b2j
        ahi, bhi = len(a) if ahi is None else ahi, len(b) if bhi is None else bhi
        i0, j0, size, before, runs = alo, blo, 0, -2, {}
        for i in self.spots[bisect_left(self.spots, alo) : bisect_left(self.spots, ahi)]:
            js = places[a[i]]
            ended = runs if i == before + 1 else {}
            runs, before = {}, i
            for j in js[bisect_left(js, blo) : bisect_left(js, bhi)]:
                n = runs[j] = ended.get(j - 1, 0) + 1
                if n > size:
                    i0, j0, size = i - n + 1, j - n + 1, n
        while i0 > alo and j0 > blo and a[i0 - 1] == b[j0 - 1]:
            i0, j0, size = i0 - 1, j0 - 1, size + 1
        while i0 + size < ahi and j0 + size < bhi and a[i0 + size] == b[j0 + size]:
            size += 1
        return Match(i0, j0, size)


def best_window(content: str | None, target: str | None) -> tuple[int, int, float]:
    """(start, end, score) of the window of as many words as target has that is most similar to it; the earliest of equals.

    No words in target, or an empty or null content: (0, 0, 0.0). A target of more words than content: (0, 0, -1.0).
    Similarity is twice the matched characters by the characters of both (SequenceMatcher, the target first). An equal
    window is looked for first; the others come in order of the score that their letters would allow, as long as that is
    not below the best one. A window is compared only if its longest common subsequence, of which the matched characters
    are one, allows the best score too.
    """
    content, wanted = content or "", _WORD.findall(target or "")
    if not wanted or not content:
        return 0, 0, 0.0
    spans = [m.span() for m in _WORD.finditer(content)]
    k = len(wanted)
    if k > len(spans):
        return 0, 0, -1.0
    low, goal = content.lower(), (target or "").lower()
    if len(low) != len(content):  # letters that grow when lowered: their offsets follow the lowered text
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in content)
    starts, ends = {s: i for i, (s, _) in enumerate(spans)}, {e for _, e in spans}
    at = low.find(goal)
    while at >= 0:  # an equal window cannot be beaten
        i = starts.get(at)
        if i is not None and at + len(goal) in ends and i + k <= len(spans) and spans[i + k - 1][1] == at + len(goal):
            return at, at + len(goal), 1.0
        at = low.find(goal, at + 1)
    begin, end = (np.array(x) for x in zip(*spans, strict=True))
    begin, end = begin[: len(spans) - k + 1], end[k - 1 :]
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    common = np.zeros(len(begin), np.int64)
    for letter, count in Counter(goal).items():
        at_ = np.flatnonzero(codes == ord(letter))
        common += np.minimum(np.searchsorted(at_, end) - np.searchsorted(at_, begin), count)
    possible = 2.0 * common / (len(goal) + end - begin)
    matcher = _Matcher(None)
    matcher.set_seq1(goal)
    at_letter: dict[str, int] = {}
    for i, c in enumerate(goal):
        at_letter[c] = at_letter.get(c, 0) | 1 << i
    best, where = -1.0, -1
    order = np.argsort(-possible, kind="stable").tolist()
    for first in range(0, len(order), 64):
        some = [i for i in order[first : first + 64] if possible[i] >= best]
        if not some:
            break
        texts = {i: low[begin[i] : end[i]] for i in some}
        bound = {i: 2.0 * _common(at_letter, len(goal), t) / (len(goal) + len(t)) for i, t in texts.items()}
        for i in sorted(some, key=lambda i: -bound[i]):
            if bound[i] < best:
                break
            matcher.set_seq2(texts[i])
            score = matcher.ratio()
            if score > best or (score == best and i < where):
                best, where = score, i
    return int(begin[where]), int(end[where]), best


def sentence_range(content: str | None, first: str | None, last: str | None) -> tuple[int, int]:
    """From the start of the first sentence's window to the end of the last one's; turned round if backwards, clipped to the content."""
    return scored_range(content, first, last)[:2]


def scored_range(content: str | None, first: str | None, last: str | None) -> tuple[int, int, float, float]:
    """sentence_range with the scores of the first and the last sentence's window."""
    (a, _, first_score), (_, b, last_score) = best_window(content, first), best_window(content, last)
    n = len(content or "")
    a, b = min(a, b), max(a, b)
    return max(0, min(a, n)), max(0, min(b, n)), first_score, last_score


@F.pandas_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
def find_window(content: pd.Series, target: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([best_window(c, t) for c, t in zip(content, target, strict=True)], columns=["start", "end", "score"])


@F.pandas_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("last_score", T.DoubleType())]))
def find_range(content: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scored_range(c, a, b) for c, a, b in zip(content, first, last, strict=True)], columns=["start", "end", "score", "last_score"])


@F.pandas_udf(T.DoubleType())
def seeded_draw(seed: pd.Series) -> pd.Series:
    """The first draw of Python's generator seeded with the string."""
    return seed.map(lambda s: random.Random(s).random())


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def letters(text: pd.Series) -> pd.Series:
    """Counts of a to z in the lower-cased text: the deterministic stand-in for a text embedding. Null for null."""
    return text.map(lambda t: None if t is None else np.bincount(np.frombuffer(t.lower().encode("utf-8", "surrogatepass"), np.uint8), minlength=123)[97:123].astype(np.float64))


def toc_components(text: str | None) -> list[dict]:
    """Components of a table of contents in JSON: name, description and children (name, description).

    A list that already has this form passes. An article (a key that begins with article_, in any case) is described by
    its name and has the titles of its sections as children, null where not a string. Other keys are described by their
    name or, if a string, by themselves; each other key in them is a child, described by its string, or its name, or
    null. Deeper levels are dropped. Anything else gives no components.
    """
    try:
        toc = json.loads(text) if text else None
    except ValueError:
        return []
    if isinstance(toc, list):
        sound = all(isinstance(c, dict) and "component_name" in c for c in toc)
        return [{"component_name": _text(c["component_name"]), "component_description": _text(c.get("component_description")), "childs": [(_text(x.get("component_name")), _text(x.get("component_description"))) for x in c.get("childs") or [] if isinstance(x, dict)]} for c in toc] if sound else []
    if not isinstance(toc, dict):
        return []
    out = []
    for key, value in toc.items():
        description, childs = value if isinstance(value, str) else None, []
        if isinstance(value, dict):
            description = value.get("name")
            if key.lower().startswith("article_"):
                inner = value.get("sections")
                childs = [(k, _text(v)) for k, v in inner.items()] if isinstance(inner, dict) else []
            else:
                childs = [(k, _text(v.get("name")) if isinstance(v, dict) else _text(v)) for k, v in value.items() if k != "name"]
        out.append({"component_name": key, "component_description": _text(description), "childs": childs})
    return out


def _text(v: object) -> str | None:
    return v if isinstance(v, str) else None


_NAMED = [T.StructField("component_name", T.StringType()), T.StructField("component_description", T.StringType())]
TOC_TYPE = T.ArrayType(T.StructType([*_NAMED, T.StructField("childs", T.ArrayType(T.StructType(_NAMED)))]))


@F.pandas_udf(TOC_TYPE)
def toc_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{**c, "childs": [{"component_name": n, "component_description": d} for n, d in c["childs"]]} for c in toc_components(t)])


def flat_tree(text: str | None, content: str | None) -> list[tuple]:
    """Rows (path, ord, depth, is_leaf, start, end) of a boundary tree in JSON, parents before children.

    A dictionary with strings start_sentence and end_sentence is a leaf, located in content; other dictionaries are inner
    nodes whose span is the envelope of their children's, an empty one having (0, 0); anything else is ignored. Text that
    is not a JSON object gives no rows.
    """
    try:
        tree = json.loads(text) if text else {}
    except ValueError:
        return []
    rows: list[tuple] = []

    def walk(node: dict, path: tuple[str, ...]) -> tuple[int, int]:
        spans, order = [], 0
        for name, child in node.items():
            if not isinstance(child, dict):
                continue
            at, here = len(rows), (*path, name)
            rows.append(())
            if isinstance(child.get("start_sentence"), str) and isinstance(child.get("end_sentence"), str):
                span, leaf = sentence_range(content, child["start_sentence"], child["end_sentence"]), True
            else:
                span, leaf = walk(child, here), False
            rows[at] = (list(here), order, len(path), leaf, *span)
            spans.append(span)
            order += 1
        return (min(s for s, _ in spans), max(e for _, e in spans)) if spans else (0, 0)

    if isinstance(tree, dict):
        walk(tree, ())
    return rows
