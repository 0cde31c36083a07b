"""The package's functions under their names for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .windows import find_window, flat_tree, seeded_draw, toc_udf


class ChunkTree:
    def eval(self, tree: str, content: str):  # noqa: ANN201
        yield from flat_tree(tree, content)


def register(spark: SparkSession) -> None:
    """find_window(content, target), toc_components(json), seeded_draw(text), cosine(v, w), letter_embedding(text) and the table function chunk_tree(json, content)."""
    spark.udf.register("find_window", find_window)
    spark.udf.register("toc_components", toc_udf)
    spark.udf.register("seeded_draw", seeded_draw)
    spark.udtf.register("chunk_tree", udtf(ChunkTree, returnType="path array<string>, ord int, depth int, is_leaf boolean, start int, end int"))
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cosine(v ARRAY<DOUBLE>, w ARRAY<DOUBLE>) RETURNS DOUBLE RETURN "
        "aggregate(zip_with(v, w, (x, y) -> x * y), 0D, (a, x) -> a + x) / nullif(sqrt(aggregate(v, 0D, (a, x) -> a + x * x)) * sqrt(aggregate(w, 0D, (a, x) -> a + x * x)), 0)"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION letter_embedding(t STRING) RETURNS ARRAY<DOUBLE> RETURN transform(sequence(97, 122), c -> cast(length(t) - length(replace(lower(t), chr(c), '')) AS DOUBLE))")
