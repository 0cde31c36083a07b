"""Column expressions on text, JSON and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: white space that trimming removes, in both engines.
BLANKS = r"[ \t\n\r\f\x0b]"

# Fixed value: what separates the introduction from the body of a contract.
MARKER = "follows:"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without white space, line ends included, at either end."""
    return F.regexp_replace(_col(c), f"^{BLANKS}+|{BLANKS}+$", "")


def newlines(c: Column | str) -> Column:
    """CR LF and CR as LF, the way a text file is read."""
    return F.regexp_replace(_col(c), "\r\n?", "\n")


def first_of(*cs: Column | str) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in cs], F.lit(""))


def basename(c: Column | str) -> Column:
    """The part after the last slash."""
    return F.element_at(F.split(_col(c), "/"), -1)


def found_at(hay: Column | str, needle: Column | str) -> Column:
    """0-based offset of the first occurrence, -1 if there is none; an empty needle is found at 0."""
    return F.call_function("instr", _col(hay), _col(needle)) - 1


def piece(c: Column | str, start: Column, end: Column) -> Column:
    """The slice [start, end), clipped to the text; empty if backwards."""
    start = F.greatest(start, F.lit(0)).cast("int")
    return F.substring(_col(c), start + 1, F.greatest(end.cast("int") - start, F.lit(0)))


def split_at_marker(c: Column | str, marker: str = MARKER) -> dict[str, Column]:
    """intro, body, body_start and body_end around the first marker, in any case; without one the whole text is body.

    The marker belongs to neither part and nothing is trimmed. A null text has null parts.
    """
    c = _col(c)
    at = F.call_function("instr", F.lower(c), F.lit(marker.lower()))
    after = at - 1 + len(marker)
    return {
        "intro": F.when(at > 0, F.substring(c, F.lit(1), at - 1)).when(at == 0, F.lit("")),
        "body": F.when(at > 0, F.substring(c, after + 1, F.length(c))).when(at == 0, c),
        "body_start": F.when(at > 0, after).when(at == 0, F.lit(0)),
        "body_end": F.length(c),
    }


def model_json(c: Column | str) -> Column:
    """The JSON text in a model's answer: after the last closing think tag, and from the first json fence if there is one."""
    said = F.regexp_replace(_col(c), "(?s)^.*</think>", "")
    fence = "(?s)```json\n(.*?)\n```"
    return F.when(said.rlike(fence), F.regexp_extract(said, fence, 1)).otherwise(said)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.transform(_col(v), lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x * x))


def dot(v: Column | str, w: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(v), _col(w), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)


def cosine(v: Column | str, w: Column | str) -> Column:
    """Null for zero vectors, other widths, and nulls."""
    size = norm(v) * norm(w)
    return F.when((F.size(_col(v)) == F.size(_col(w))) & (size > 0), dot(v, w) / size)


def sentences(c: Column | str, n: int) -> Column:
    """The first n sentences (ends: a full stop and a blank), trimmed: the deterministic stand-in for a summary."""
    return trimmed(F.array_join(F.slice(F.split(_col(c), r"\. "), 1, n), ". "))


def unit(v: Column | str) -> Column:
    """v divided by its length; null for a null, empty or zero vector, or one that holds a null."""
    size = norm(v)
    return F.when(size > 0, F.transform(_col(v), lambda x: x.cast("double") / size))


def overlap(s: str, e: str, s2: str, e2: str) -> Column:
    return F.greatest(F.lit(0), F.least(F.col(e), F.col(e2)) - F.greatest(F.col(s), F.col(s2)))
