"""Models as injectable functions: text to text, text to vector; with deterministic defaults that need no network."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TextModel = Callable[[list[str]], list[str]]
Embedder = Callable[[list[str]], list[list[float]]]

_HEADING = re.compile(r"^[ \t]*((ARTICLE|Article)[ \t]+([IVXLCDM]+|\d+)\b.*|(?:Section|SECTION|§)[ \t]*\d+(?:\.\d+)*\b.*|(?:Exhibit|EXHIBIT|Annex|ANNEX)[ \t]+\w+.*)$", re.M)


def letter_counts(texts: list[str]) -> list[list[float]]:
    return [[float(low.count(chr(i))) for i in range(97, 123)] for low in map(str.lower, texts)]


def first_sentences(texts: list[str], n: int = 2) -> list[str]:
    return [". ".join(t.split(". ")[:n]).strip() for t in texts]


def toc_by_headings(texts: list[str]) -> list[str]:
    """A table of contents in JSON from heading lines; exhibits and annexes are gathered under their own keys."""
    out = []
    for text in texts:
        toc: dict = {}
        article = None
        for m in _HEADING.finditer(text):
            line = m[1].strip()
            if m[2]:
                article = toc.setdefault(f"ARTICLE_{m[3]}", {"name": line, "sections": {}})
            elif line[0] in "Ss§":
                if article is None:
                    article = toc.setdefault("ARTICLE_0", {"name": "", "sections": {}})
                article["sections"][f"s{len(article['sections']) + 1}"] = line
            else:
                kind = "Exhibits" if line[0] == "E" else "Annexes"
                toc.setdefault(kind, {})[f"{kind[0].lower()}{len(toc.get(kind, {})) + 1}"] = line
        out.append(json.dumps(toc, ensure_ascii=False))
    return out


def boundaries_by_headings(texts: list[str]) -> list[str]:
    """A boundary tree in JSON: each heading's part runs from its line to the line before the next heading."""
    out = []
    for text in texts:
        tree: dict = {}
        marks = list(_HEADING.finditer(text))
        group = None
        for i, m in enumerate(marks):
            end = marks[i + 1].start() if i + 1 < len(marks) else len(text)
            lines = [x.strip() for x in text[m.start() : end].split("\n") if x.strip()]
            node = {"start_sentence": lines[0], "end_sentence": lines[-1]}
            if m[2]:
                group = tree.setdefault(m[1].strip(), {})
                if len(lines) > 1 or i + 1 == len(marks) or marks[i + 1][2]:
                    group["heading"] = node
            else:
                (group if group is not None else tree)[m[1].strip()] = node
        out.append(json.dumps(tree, ensure_ascii=False))
    return out


def apply_model(df: DataFrame, text: str, model: Callable[[list[str]], list], out: str, kind: str, batch: int = 64, concurrency: int | None = None) -> DataFrame:
    """df with model(text) as column out, called with at most `batch` texts at a time; a null text gives null.

    concurrency, where given, is the number of tasks that call the model at once: for services that allow so many. The
    answers are spread over all partitions again. Without it every partition calls; rows keep their keys, so no order is
    relied on.
    """
    if concurrency:
        df = df.repartition(concurrency)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` {kind}"])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                b = whole.slice(start, batch)
                texts = b.column(at).to_pylist()
                asked = [t for t in texts if t is not None]
                answers = iter(model(asked) if asked else [])
                values = [None if t is None else next(answers) for t in texts]
                yield _with(b, out, values, kind)

    said = df.mapInArrow(run, schema)
    return said.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if concurrency else said


def _with(batch: pa.RecordBatch, name: str, values: list, kind: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32())}
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, types[kind])], names=[*batch.schema.names, name])


def embed(df: DataFrame, text: str, embedder: Embedder = letter_counts, out: str = "vector", batch: int = 4) -> DataFrame:
    """Vectors of the texts; blank texts get none."""
    blank = F.coalesce(F.trim(F.col(text)), F.lit("")) == ""
    asked = df.withColumn("__text", F.when(~blank, F.col(text)))
    return apply_model(asked, "__text", embedder, out, "array<double>", batch).drop("__text")
