"""Helpers the corpus operators share: text keys, Arrow batches, components of links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.session import durable


def text_key(text: Column) -> Column:
    """128 bits that stand for one text: equal for copies, else different but with vanishing odds; null is null."""
    return F.when(text.isNotNull(), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")))


def binary_views(column: pa.Array) -> Iterator[memoryview | None]:
    """The bytes of each row of an Arrow string or binary column, without a copy; None for null."""
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    valid, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset: column.offset + len(column) + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    nulls = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
    for i in range(len(column)):
        yield None if nulls is not None and nulls[i] else view[at[i]: at[i + 1]]


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column by name, or a field of a struct column by `struct.field`."""
    outer, _, inner = name.partition(".")
    col = batch.column(batch.schema.get_field_index(outer))
    return col.field(inner) if inner else col


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about `most` bytes of a text column; a longer text is a slice alone."""
    for batch in batches:
        col = column_of(batch, column)
        if not len(col):
            continue
        sizes = np.fromiter((0 if v is None else len(v) for v in binary_views(col)), dtype=np.int64, count=len(col))
        ends = np.cumsum(sizes)
        start = 0
        while start < len(col):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def map_slices(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType, column: str = "text",
               most: int = 8 << 20) -> DataFrame:
    """`mapInArrow` with input slices of bounded size."""

    def run(batches):
        for part in slices(batches, column, most):
            yield work(part)

    return df.mapInArrow(run, schema)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has a link in `links` (a, b).

    Every round moves each root to its smallest neighbour, follows these moves eight steps and
    redraws the links between roots, so the links shrink and the rounds grow with the logarithm of
    the longest chain.  Each round is written to the shared folder.
    """
    ordered = links.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = durable(ordered.distinct(), "links")
    label = None
    while True:
        # every node with a smaller neighbour moves to its smallest one; moves always lead downwards
        moves = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        jump = durable(moves, "moves")
        if jump.limit(1).count() == 0:
            break
        for _ in range(3):
            onward = jump.select(F.col("node").alias("to"), F.col("to").alias("_next"))
            jump = jump.join(onward, "to", "left").select("node", F.coalesce("_next", "to").alias("to"))
        jump = durable(jump, "jumps")
        if label is None:
            ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
            label = ends.join(jump, "node", "left").select("node", F.coalesce("to", "node").alias("root"))
        else:
            step = jump.select(F.col("node").alias("root"), "to")
            label = label.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        label = durable(label, "roots")
        for end in ("a", "b"):
            other = "b" if end == "a" else "a"
            step = jump.select(F.col("node").alias(end), "to")
            edges = edges.join(step, end, "left").select(F.coalesce("to", end).alias(end), other)
        edges = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                        "links")
    return label if label is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
