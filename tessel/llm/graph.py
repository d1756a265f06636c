"""Connected components by alternating large stars and stars within partitions.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Edges
stay in tables.  In place of small stars, all edges of a partition that was
dealt by the upper node become stars at once, which links whatever a small star
does and more.  A large star only takes minima, so the many nodes below a root
are never gathered; and as the first step makes stars of each part of the
input, a node has one edge up for each of these parts at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.staging import drop, stage

#: Most edges of an input's part that become stars at once.
EDGES = 1 << 20


def _least(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of ``n`` reaches."""
    top = np.arange(n)
    while True:
        a, b = top[u], top[v]
        if (a == b).all():
            return top
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while (top[top] != top).any():
            top = top[top]


def _stars(most: int | None):
    """Edges (u, v) from each node to the least one it reaches within ``most`` edges, or within the partition."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        names = pc.unique(pa.chunked_array([*rows["u"].chunks, *rows["v"].chunks]))
        names = names.take(pc.array_sort_indices(names))
        top = _least(*(pc.index_in(rows[k], value_set=names).to_numpy() for k in ("u", "v")), len(names))
        low = np.flatnonzero(top != np.arange(len(top)))
        return pa.RecordBatch.from_arrays([names.take(pa.array(low)), names.take(pa.array(top[low]))], ["u", "v"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if most and sum(map(len, held)) >= most:
                yield stars(held)
                held = []
        if held:
            yield stars(held)

    return work


def _large(edges: DataFrame) -> DataFrame:
    """Edges point down (u > v): the upper neighbours of a node get the least of its neighbours and itself."""
    down = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = edges.select("u", "v").unionAll(down).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b) but the roots; a root is the least node it reaches."""
    a, b = F.col("a"), F.col("b")
    kind = edges.schema["a"].dataType.simpleString()
    schema = f"u {kind}, v {kind}"
    now = stage(edges.where(a != b).select(a.alias("u"), b.alias("v")).mapInArrow(_stars(EDGES), schema), "edges")
    while True:
        ends = now.select(F.col("u").alias("x"), "v", F.lit(0).alias("down")).unionAll(now.select("v", F.lit(None).cast(kind), F.lit(1)))
        seen = ends.groupBy("x").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("down").alias("down"), F.count("v").alias("n"))
        deep, again = seen.agg(F.count_if(F.expr("lo <> hi or (n > 0 and down > 0)")), F.count_if(F.expr("n > 1"))).first()
        if not deep and not again:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        nxt = stage(_large(now).repartition("u").mapInArrow(_stars(None), schema) if deep else now.distinct(), "edges")
        drop(now)
        now = nxt
