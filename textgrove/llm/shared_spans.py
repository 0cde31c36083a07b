"""Long spans that stand verbatim in more than one record, by recompression.

Every text is parsed by the same rounds: tokens (runs of letters and digits, or single other characters) become symbols;
a round merges runs of one symbol, then pairs whose left symbol falls into one half of the alphabet and whose right symbol
into the other, unless the result would exceed a length. A symbol is named by a hash of what it spells, so names are
global without a dictionary, and halves are drawn from names: equal substrings get equal symbols except near their ends.

How near is not guessed: each symbol carries the stretch of text that its two boundaries depend on, through all rounds. A
boundary whose symbols depend on nothing beyond REACH on either side is *certain*: wherever these 2 REACH code points
stand, it stands. So a window of `least` code points has the same certain boundaries in every record that holds it, and:

1. Each window is represented by that one of its certain boundaries whose surroundings have the least name (its seed), or,
   if it has none, by itself. Only seeds that represent some window leave a record. Two records that share a window share
   its seed, and a Spark aggregation by seed finds those that more than one record holds. Nothing is missed.
2. At boundaries with such a seed the window centred there is compared: windows equal in two records cover their stretch;
   this settles the inside of long spans.
3. A boundary whose surroundings are not wholly covered is at the edge of a shared span, or of a short one. All records
   that hold its seed list every window around it, and equal windows meet. A position is shared exactly if it lies in a
   window that stands in another record, so the stretches come out exact, without comparing records in pairs.

Windows are compared by 128 bits of hash, and whole texts, of which exact copies are parsed once, by 128 bits of another.
Groups of any size are reduced to their least and greatest record by partial aggregation; nothing is emitted per pair, and
no group is sorted or held in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import covered_periods
from ..session import cut, drop

REACH = 52
LONGEST = 40
ROUNDS = 2
SEGMENT = 1_000_000
MARGIN = 1_024
FAR = 1 << 40  # beyond any text

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_TABLE: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64."""
    held = _TABLE.get(f"p{which}")
    if held is None or len(held) < n:
        size = max(n, 1 << 16)
        base = int(_BASES[which])
        for name, b in (("p", base), ("i", pow(base, -1, 1 << 64))):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _TABLE[f"{name}{which}"] = np.cumprod(x)
    return _TABLE[f"p{which}"][:n], _TABLE[f"i{which}"][:n]


def _wordlike() -> np.ndarray:
    if "w" not in _TABLE:
        _TABLE["w"] = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _TABLE["w"]


class Spelling:
    """Hashes of any substring of a text in constant time."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.sums = codes, {}

    def of(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        if which not in self.sums:
            power, _ = _powers(len(self.codes) + 1, which)
            with np.errstate(over="ignore"):
                self.sums[which] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(self.codes.astype(np.uint64) + np.uint64(1)) * power[:-1])])
        s = self.sums[which]
        with np.errstate(over="ignore"):
            return _mix((s[end] - s[start]) * _powers(len(s), which)[1][start] + (end - start).astype(np.uint64))


def parse(codes: np.ndarray, spelling: Spelling, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the last round's symbols, and the stretch [low, high) that each depends on; no symbol spans two owners (texts laid end to end).

    A symbol at an end of its owner depends on what lies beyond it, so it is certain in no window. Equal symbols whose run
    is too long to become one depend on the whole run: they count as certain in no window either.
    """
    n = len(codes)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    word = _wordlike()[codes]
    inside = np.zeros(n, bool)
    inside[1:] = word[1:] & word[:-1] & (owner[1:] == owner[:-1])
    start = np.flatnonzero(~inside)
    length = np.diff(np.append(start, n))
    low, high = start - 1, start + length + 1
    far = length > LONGEST
    if far.any():  # a run too long to be a symbol is taken apart; so many of its code points show that it is too long
        apart = np.repeat(far, length)
        first, last = np.repeat(low, length), np.repeat(high, length)
        start = np.flatnonzero(~inside | apart)
        far, low, high = apart[start], first[start], last[start]
        low[far] = np.maximum(low, start - LONGEST - 2)[far]
        high[far] = np.minimum(high, start + LONGEST + 3)[far]
    kind = word[start]
    of = owner[start]
    edge = np.flatnonzero(of[1:] != of[:-1])
    low[np.append(0, edge + 1)], high[np.append(edge, len(high) - 1)] = -FAR, FAR
    end = np.append(start[1:], n)
    name, alike = spelling.of(start, end), of[1:] == of[:-1]

    def merged(head: np.ndarray) -> None:
        """Symbols from each head up to the next; those of one symbol keep their name."""
        nonlocal start, end, name, kind, of, alike, low, high
        low, high = np.minimum.reduceat(low, head), np.maximum.reduceat(high, head)
        fresh = np.flatnonzero(np.diff(np.append(head, len(start))) > 1)
        start, kind, of, name = start[head], kind[head], of[head], name[head]
        end = np.append(start[1:], n)
        name[fresh] = spelling.of(start[fresh], end[fresh])
        alike = of[1:] == of[:-1]

    for r in range(ROUNDS + 1):
        # runs: whether two symbols are one run depends on both
        before, after = np.where(alike, low[:-1], FAR), np.where(alike, high[1:], -FAR)
        np.minimum(low[1:], before, out=before)
        np.maximum(high[:-1], after, out=after)
        low[1:], high[:-1] = before, after
        same = np.zeros(len(start), bool)
        same[1:] = (name[1:] == name[:-1]) & alike
        if same.any():
            head = np.flatnonzero(~same)
            many = np.diff(np.append(head, len(start)))
            spread = np.repeat((np.diff(np.append(start[head], n)) > LONGEST) & (many > 1), many)
            low[spread], high[spread] = -FAR, FAR
            merged(np.flatnonzero(~same | spread))
        # pairs: in the first round a word takes what follows it
        with np.errstate(over="ignore"):
            right = ~kind if r == 0 else (_mix(name + np.uint64(r) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(40) & np.uint64(1)).astype(bool)
        join = np.zeros(len(start), bool)
        join[1:] = ~right[:-1] & right[1:] & (end[1:] - start[:-1] <= LONGEST) & alike
        # a symbol that stays alone depends on the neighbour that it might have joined
        before, after = np.where(alike & right[1:], low[:-1], FAR), np.where(alike & ~right[:-1], high[1:], -FAR)
        np.minimum(low[1:], before, out=before)
        np.maximum(high[:-1], after, out=after)
        low[1:], high[:-1] = before, after
        merged(np.flatnonzero(~join))
    return start, low, high


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(ids: list, texts: list[str]) -> Iterator[list[tuple]]:
    """Groups of (id, offset in the text, text, first and last position to report), of bounded size in all."""
    group, held = [], 0
    for i, t in zip(ids, texts, strict=True):
        for at in range(0, max(len(t), 1), SEGMENT):
            low, high = max(0, at - MARGIN), min(len(t), at + SEGMENT + MARGIN)
            group.append((i, low, t[low:high], at, at + SEGMENT))
            held += high - low
            if held >= SEGMENT:
                yield group
                group, held = [], 0
    if group:
        yield group


def _laid(group: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """codes, owner of each code, begin and end of each owner, shift from codes to offsets in the owner's text."""
    codes = _codes("".join(g[2] for g in group))
    size = np.array([len(g[2]) for g in group])
    begin = np.cumsum(size) - size
    return codes, np.repeat(np.arange(len(group)), size), begin, begin + size, np.array([g[1] for g in group]) - begin


def _least(p: np.ndarray, name: np.ndarray, room: int) -> np.ndarray:
    """Which positions p (ascending) have the least name in some range of `room` successive offsets; ties go to the first."""
    chosen = np.ones(len(p), bool)
    before, after = np.full(len(p), -FAR), np.full(len(p), FAR)
    for side, found, sign in ((np.less_equal, before, -1), (np.less, after, 1)):
        todo, step = np.arange(len(p)), 1
        while len(todo):
            to = todo + sign * step
            ok = (to >= 0) & (to < len(p))
            todo, to = todo[ok], to[ok]
            ok = np.abs(p[to] - p[todo]) <= room
            todo, to = todo[ok], to[ok]
            hit = side(name[to], name[todo])
            found[todo[hit]] = p[to[hit]]
            todo, step = todo[~hit], step + 1
    return chosen & (after - before > room)


def _seeds(least: int):
    """(cid, text) -> (cid, pos, seed, win) of the seeds that represent a window; win is null where the window centred at pos is not whole."""
    half, room = least // 2, least - 2 * REACH + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if len(met) > 1_000_000:
                met.clear()
            fresh = [not (c in met or met.add(c)) for c in ids]  # copies within a task are parsed once
            for group in _pieces([c for c, f in zip(ids, fresh, strict=True) if f], [t for t, f in zip(texts, fresh, strict=True) if f]):
                codes, owner, begin, end, shift = _laid(group)
                spelling = Spelling(codes)
                p, low, high = parse(codes, spelling, owner)
                # the symbols on both sides make a boundary
                pair = owner[p[1:]] == owner[p[:-1]] if len(p) else np.zeros(0, bool)
                lo, hi, p = np.minimum(low[1:], low[:-1])[pair], np.maximum(high[1:], high[:-1])[pair], p[1:][pair]
                o = owner[p]
                sure = (p - lo <= REACH) & (hi - p <= REACH) & (p - REACH >= begin[o]) & (p + REACH <= end[o])
                p = p[sure]
                o = owner[p]
                apart = p + o * np.int64(4 * least)  # owners lie further apart than a window is long
                name = spelling.of(p - REACH, p + REACH)
                kept = _least(apart, name, room)
                # windows without a certain boundary stand for themselves
                edges = [np.sort(np.concatenate([begin - REACH - 1, end + REACH, p]))]
                q = edges[0]
                bare_low, bare_high = np.maximum(q[:-1] - REACH + 1, 0), q[1:] - (least - REACH)
                some = bare_high > bare_low
                first, many = bare_low[some], (bare_high - bare_low)[some]
                t = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
                t = t[(t + least <= len(codes))]
                t = t[owner[t] == owner[np.minimum(t + least, len(codes)) - 1]]
                at = np.concatenate([p[kept], t + half])
                seed = np.concatenate([name[kept], spelling.of(t, t + least, 1)]).view(np.int64)
                o = owner[at]
                place = at + shift[o]
                keep = (place >= np.array([g[3] for g in group])[o]) & (place < np.array([g[4] for g in group])[o])
                at, seed, o, place = at[keep], seed[keep], o[keep], place[keep]
                cid = np.array([g[0] for g in group], np.int64)[o]
                whole = (at - half >= begin[o]) & (at - half + least <= end[o])
                a = np.where(whole, at - half, at)
                window = spelling.of(a, np.where(whole, a + least, at)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(place), pa.array(seed), pa.array(window, mask=~whole)], names=["cid", "pos", "seed", "win"])

    return run


def _edges(least: int):
    """Rows (cid, at: (pos, seed, full)) -> seeds whose windows are not all covered in this record."""
    half, span = least // 2, least - REACH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, size = batch.column(1), batch.column(2).to_numpy()
            parts = lists.value_lengths().to_numpy()
            flat = lists.flatten()
            pos, seed, full = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            out, at = [np.zeros(0, np.int64)], 0
            for n, k in zip(size.tolist(), parts.tolist(), strict=True):
                p, s, f = pos[at : at + k], seed[at : at + k], full[at : at + k].astype(bool)
                at += k
                c = np.sort(p[f])
                if not len(c):
                    out.append(s)
                    continue
                first = np.flatnonzero(np.concatenate([[True], c[1:] - half > c[:-1] - half + least]))
                begin, end = c[first] - half, c[np.append(first[1:], len(c)) - 1] - half + least
                low, high = np.maximum(p - span, 0), np.minimum(p + span, n)
                j = np.searchsorted(begin, low, side="right") - 1
                out.append(s[(j < 0) | (end[np.maximum(j, 0)] < high)])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)))], names=["seed"])

    return run


def _windows(least: int):
    """Rows (cid, text, positions) -> every window of `least` that holds a position with REACH on either side."""
    span = least - REACH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = len(text)
                for low in range(0, n, SEGMENT):
                    p = np.array([x for x in at if low - least <= x < low + SEGMENT + least], np.int64)
                    if not len(p):
                        continue
                    mark = np.zeros(min(n, low + SEGMENT) - low + 1, np.int32)
                    a, b = np.clip(p - span - low, 0, len(mark) - 1), np.clip(np.minimum(p - REACH, n - least) + 1 - low, 0, len(mark) - 1)
                    ok = a < b
                    np.add.at(mark, a[ok], 1)
                    np.add.at(mark, b[ok], -1)
                    i = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
                    if not len(i):
                        continue
                    spelling = Spelling(_codes(text[low : low + SEGMENT + least]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(i), cid, np.int64)), pa.array(i + low), pa.array(spelling.of(i, i + least, 0).view(np.int64)), pa.array(spelling.of(i, i + least, 1).view(np.int64))], names=["cid", "pos", "h0", "h1"]
                    )

    return run


def _shared(df: DataFrame, *key: str) -> DataFrame:
    """The keys that more than one record has, by partial aggregation."""
    return df.groupBy(*key).agg(F.min("cid").alias("__a"), F.max("cid").alias("__b")).where("__a <> __b").select(*key)


def _contents(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (id, t) -> members (id, cid, length), each id once; and rows (id, cid, t).

    Texts are the same if their 128-bit hashes are. cid is a 64-bit number for each; should two texts get one number, all
    numbers are drawn anew.
    """
    for salt in range(64):
        cid = F.xxhash64(F.lit(salt), "t")
        named = rows.select("id", cid.alias("cid"), F.unhex(F.md5(F.encode("t", "UTF-8"))).alias("h"), F.length("t").cast("bigint").alias("length"))
        members = cut(named.groupBy("id").agg(F.max(F.struct("cid", "h", "length")).alias("m")).select("id", "m.*"), "members")
        if members.groupBy("cid").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").isEmpty():
            break
        drop(members)
    return members, rows.select("id", cid.alias("cid"), "t")


def shared_spans(records: DataFrame, id_col: str = "doc_id", text: str = "content", least: int = 200, most_sent: int = 2_000_000) -> DataFrame:
    """(id, span_start, span_end, length): the maximal stretches of each record's text covered by substrings of at least
    `least` code points that stand identically in the text of a record with another id. length is that of the text.

    Stretches that overlap or touch are one. Each id counts once: of several texts the one with the greatest hash. Null
    ids and null texts take no part; texts shorter than least share nothing. Records with equal texts are parsed once.
    `least` is at least 156. Seeds that several records hold, and the edges, are sent to all tasks if they are at most most_sent (8
    bytes each), else joined.
    """
    if least < 3 * REACH:
        raise ValueError(f"least must be at least {3 * REACH}")
    rows = records.where(F.col(id_col).isNotNull() & (F.length(text) >= least)).select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    members, texts = _contents(rows)
    kept = cut(members.groupBy("cid").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.max("length").alias("length")), "contents")
    all_seeds = cut(texts.select("cid", "t").mapInArrow(_seeds(least), "cid bigint, pos bigint, seed bigint, win bigint"), "seeds")
    found = cut(_shared(all_seeds, "seed"), "shared-seeds")
    seeds = all_seeds.join(F.broadcast(found) if found.count() <= most_sent else found, "seed", "left_semi")
    # a text that is not, or no longer, its id's is in no record
    seeds = cut(seeds.join(kept.select("cid"), "cid", "left_semi").groupBy("cid", "pos").agg(F.first("seed").alias("seed"), F.first("win").alias("win")), "positions")
    drop(all_seeds, found)
    full = _shared(seeds.where("win is not null"), "seed", "win")
    marked = cut(seeds.join(full.withColumn("full", F.lit(True)), ["seed", "win"], "left").select("cid", "pos", "seed", F.coalesce("full", F.lit(False)).alias("full")), "marked")
    drop(seeds)
    per = marked.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("pos", "seed", "full"))).alias("at")).join(kept.select("cid", "length"), "cid")
    edges = per.select("cid", "at", "length").mapInArrow(_edges(least), "seed bigint").distinct()
    around = cut(marked.join(edges, "seed", "left_semi").groupBy("cid").agg(F.collect_list("pos").alias("at")).join(kept.select("cid", "id"), "cid"), "edges")
    sent = (around.agg(F.sum(F.size("at"))).first()[0] or 0) <= most_sent
    windows = texts.join(F.broadcast(around) if sent else around, ["id", "cid"]).select("cid", "t", "at").mapInArrow(_windows(least), "cid bigint, pos bigint, h0 bigint, h1 bigint")
    windows = cut(windows, "windows")
    exact = windows.join(_shared(windows, "h0", "h1"), ["h0", "h1"], "left_semi").select("cid", F.col("pos").alias("s"))
    inside = marked.where("full").select("cid", (F.col("pos") - least // 2).alias("s"))
    stretches = covered_periods(exact.unionByName(inside).withColumn("e", F.col("s") + least), "cid", "s", "e")
    alone = members.join(kept.where("n = 1").select("cid"), "cid", "left_semi")
    spans = alone.join(stretches.withColumn("cid", F.col("cid").cast("bigint")), "cid").select("id", F.col("period_start").alias("span_start"), F.col("period_end").alias("span_end"), "length")
    copies = members.join(kept.where("n > 1").select("cid"), "cid", "left_semi").select("id", F.lit(0).cast("bigint").alias("span_start"), F.col("length").alias("span_end"), "length")
    return spans.unionByName(copies)
