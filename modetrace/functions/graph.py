"""Connected components and least spanning forests of a table of edges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modetrace.sources import deal
from modetrace.sources.scratch import discard, materialise


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the (u, v) edges; root is one node of its
    component. Each round hooks every node to its least neighbour and contracts
    the edges, which at least halves what is left; each is a written table."""
    edges = materialise(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    found, before = edges.toDF("node", "root").where("false"), None
    while not edges.isEmpty():
        hooks = edges.union(edges.select("v", "u")).groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root"))
        first = materialise(hooks, "hooks")
        up = first.toDF("root", "up")
        hooks = materialise(first.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "hooks")
        discard(first)
        later = hooks.toDF("root", "up")
        found = materialise(found.join(later, "root", "left").select("node", F.coalesce("up", "root").alias("root")).union(hooks.join(found, "node", "left_anti")), "roots")
        ends = edges.join(hooks.toDF("u", "a"), "u").join(hooks.toDF("v", "b"), "v").where("a <> b")
        contracted = materialise(ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        discard(edges, hooks, *([before] if before is not None else []))
        edges, before = contracted, found
    return found


def least_forest(edges: DataFrame) -> DataFrame:
    """(u, v, weight): a minimum spanning forest of such edges of long nodes. Of equal weights
    the edge of the lesser nodes counts as less, which makes it one forest."""
    taken, _, left = _contracted(edges)
    return reduce(DataFrame.unionByName, taken, _finish(left, "u long, v long, weight double"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the (u, v, weight) edges between two of them; root is one
    node of its component."""
    _, roots, left = _contracted(edges)
    last = _finish(left, "node long, root long")
    if roots is None:
        return last
    return roots.join(last.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def _contracted(edges: DataFrame) -> tuple[list[DataFrame], DataFrame | None, DataFrame]:
    """Boruvka rounds until the edges are one task's rows: the edges (u, v, weight) that were taken,
    (node, root) as far as it was found, and what is left, (a, b, edge) between roots.

    In a round every node takes its least edge, and what that joins becomes one node, so a
    round at least halves the nodes. A node points at the one that its edge leads to; only the two
    that took one edge point at each other, of which the lesser is the root, and the others find
    theirs by looking where that points, twice as far each time: a long chain is a few steps."""
    left = materialise(edges.where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct("weight", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).alias("edge")), "edges")
    taken, roots = [], None
    while left.count() > deal.ROWS_A_TASK:
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"), "edge"))
        least = materialise(ends.groupBy("a").agg(F.min(F.struct("edge", "b")).alias("m")).select(F.col("a").alias("node"), F.col("m.b").alias("up"), "m.edge"), "least")
        taken.append(least.select("edge.*").distinct().select("u", "v", "weight"))
        back = least.select(F.col("node").alias("up"), F.col("up").alias("back"))
        is_root = (F.col("back") == F.col("node")) & (F.col("node") < F.col("up"))
        up = materialise(least.join(back, "up").select("node", F.when(is_root, F.col("node")).otherwise(F.col("up")).alias("up"), F.lit(True).alias("moved")), "up")
        while not up.where("moved").isEmpty():
            further = materialise(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "up")
            discard(up)
            up = further
        found = up.select("node", F.col("up").alias("root"))
        if roots is not None:
            found = roots.join(found.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        found, before = materialise(found, "roots"), roots
        ends = left.join(up.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("y")), "b").where("x <> y")
        shrunk = materialise(ends.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("edge").alias("edge")), "edges")
        discard(left, up, *([before] if before is not None else []))
        left, roots = shrunk, found
    return taken, roots, left


def _finish(left: DataFrame, schema: str) -> DataFrame:
    """What ``_contracted`` left, in one task: the edges of its forest, or (node, root)."""
    wanted = schema.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        a, b, u, v, weight = (rows.column(c).to_numpy() for c in ("a", "b", "u", "v", "weight"))
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        top = list(range(len(nodes)))

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        kept, ends = [], place.reshape(2, -1)
        order = np.lexsort((v, u, weight))
        for i, x, y in zip(order.tolist(), *ends[:, order].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                top[max(x, y)] = min(x, y)
                kept.append(i)
        if wanted == "node":
            yield pa.record_batch({"node": nodes, "root": nodes[[find(x) for x in range(len(nodes))]]})
        else:
            yield pa.record_batch({"u": u[kept], "v": v[kept], "weight": weight[kept]})

    return left.select("a", "b", "edge.*").coalesce(1).mapInArrow(run, schema)
