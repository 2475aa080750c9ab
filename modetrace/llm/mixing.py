"""Mixing sources to target weights by fitting subset sums.

A document's size is its number of words. Sources, by code point with null
last, get the weights 5, 2, 1, repeating, and share a budget of 150 % of all
sizes; a source's target is at most twice its size, and what it can't take is
reshared by weight among the others. A target below the source's size takes
each of its documents at most once; a target above it takes every document
once and the rest of the target a second time.

Which lengths are taken how often is fitted on the source's histogram of
exact lengths: the same share of every length first, then the words still
missing by bounded-knapsack dynamic programming over what is left. Which
documents of a length those are is settled by a seeded hash, with a binary
search of hash ranges in place of a ranking, so that no group, however large,
passes through one task. The hash is of doc_id and text, so that rows which share
an id spread by their texts; rows without an id spread by their place in the input
too, copies among them. Reruns agree, for rows without an id as long as the input
is split alike. Only copies that share an id, a source and a text fall in one range.

Null and empty texts have size 0 and are never taken. A null doc_id counts as
an id of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialise

WEIGHTS = (5, 2, 1)
SHARE, TIMES = 1.5, 2
#: The dynamic program covers so many words; more are first met by whole documents.
PROGRAM = 1 << 16
#: Ranges of the hash that a group of equal length is cut into.
RANGES, STRIDE = 4096, 64
SEED = 11


def with_sizes(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def _sizes(rows: DataFrame, seed: int, *more: str) -> DataFrame:
    """(doc_id, source, __size, mark, more), written: ``mark`` is what settles which
    documents of a length are taken."""
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    marked = with_sizes(rows).withColumn("mark", F.xxhash64(F.lit(seed), "doc_id", "text", place))
    return materialise(marked.select("doc_id", "source", "__size", "mark", *more), "sizes")


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """The target of each source. One entry a source, not a document."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    left, open_, out = SHARE * sum(sizes.values()), order, {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > TIMES * sizes[s]]
        if not above:
            return out | {s: left * weight[s] / total for s in open_}
        for s in above:
            out[s] = float(TIMES * sizes[s])
        left -= sum(out[s] for s in above)
        open_ = [s for s in open_ if s not in out]
    return out


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take, so that the words come as near to the
    budget as they can; lengths are positive and distinct."""
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    take = [c * budget // total for c in counts.tolist()]  # exact at any size
    taken = np.array(take, dtype=np.int64)
    left = budget - int((lengths * taken).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order.tolist():  # the longest first, until the program covers the rest
        if left <= PROGRAM:
            break
        k = min(int(counts[i] - taken[i]), (left - PROGRAM + int(lengths[i]) - 1) // int(lengths[i]), left // int(lengths[i]))
        taken[i] += k
        left -= k * int(lengths[i])
    if left > 0:
        taken += _knapsack(lengths, counts - taken, left)
    return taken


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: which sums up to a little over the budget can be
    reached. Each length is entered as bundles of 1, 2, 4, ... documents; the
    bundle that first reached a sum leads back."""
    size = budget + min(int(lengths.max()), budget) + 1
    reached = np.zeros(size, dtype=bool)
    reached[0] = True
    by = np.full(size, -1, dtype=np.int32)
    bundles: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        length, rest, bundle = int(lengths[i]), min(int(counts[i]), (size - 1) // int(lengths[i])), 1
        while rest > 0:
            k = min(bundle, rest)
            words = k * length
            if words < size:
                new = reached[:-words] & ~reached[words:]
                if new.any():
                    at = np.flatnonzero(new) + words
                    by[at] = len(bundles)
                    bundles.append((i, k))
                    reached[at] = True
            rest -= k
            bundle *= 2
        if reached[budget]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    out = np.zeros(len(lengths), dtype=np.int64)
    while at:
        i, k = bundles[by[at]]
        out[i] += k
        at -= k * int(lengths[i])
    return out


def _takes(goals: dict[str | None, tuple[int, float]]):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        source = rows["source"].iloc[0]
        size, target = goals[None if pd.isna(source) else source]
        whole = int(target >= size)
        budget = int(round(target)) - whole * size
        rows = rows.sort_values("__size", ignore_index=True)
        take = np.zeros(len(rows), dtype=np.int64)
        some = rows["__size"].to_numpy() > 0
        if some.any():
            take[some] = fit_lengths(rows["__size"].to_numpy()[some], rows["n"].to_numpy()[some], budget)
        return rows.assign(whole=np.where(some, whole, 0), take=take, source_size=size, target=target)[["source", "__size", "whole", "take", "n", "source_size", "target"]]

    return fit


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row:
    ``copies`` is how often the mix takes the document, 0 to TIMES."""
    return _copies(_sizes(docs.select("doc_id", "text", F.col("source").cast("string")), seed))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, with their columns, each as often as the mix takes it."""
    place, copies, copy = fresh(docs, "row", "copies", "copy")
    rows = materialise(docs.withColumn(place, F.monotonically_increasing_id()), "rows")
    sized = _sizes(rows.select("doc_id", "text", F.col("source").cast("string").alias("source"), F.col(place).alias("__row")), seed, "__row")
    taken = _copies(sized, ("__row",)).where("copies > 0").select(F.col("__row").alias(place), F.col("copies").alias(copies))
    return rows.join(taken, place).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def _copies(sized: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    histogram = materialise(sized.groupBy("source", "__size").agg(F.count("*").alias("n")), "lengths")
    totals = {r.source: int(r.words or 0) for r in histogram.groupBy("source").agg(F.sum(F.col("__size") * F.col("n")).alias("words")).collect()}
    goal = targets(totals)
    goals = {s: (totals[s], goal[s]) for s in totals}
    # one group a source: a row for each distinct length, not for each document
    takes = materialise(histogram.groupBy("source").applyInPandas(_takes(goals), "source string, __size long, whole int, take long, n long, source_size long, target double"), "takes")
    spread = F.pmod("mark", F.lit(RANGES)).cast("int")
    partial = takes.where("take > 0 AND take < n").select("source", "__size", "take")
    ranged = sized.select("source", "__size", spread.alias("range")).join(partial, (sized["source"].eqNullSafe(partial["source"])) & (sized["__size"] == partial["__size"])).select(sized["source"], sized["__size"], "range", "take")
    cells = materialise(ranged.groupBy("source", "__size", "range", "take").agg(F.count("*").alias("k")).withColumn("part", F.floor(F.col("range") / STRIDE)), "cells")
    # the range where the count is met is the only one whose documents are ranked; first
    # the part of the ranges is found, then the range in it, so that a window has few rows
    whole = ("source", "__size")
    parts = _met(cells.groupBy(*whole, "part", "take").agg(F.sum("k").alias("k")), whole, "part")
    inner = _left(cells.drop("take"), parts.select(*whole, F.col("part").alias("own"), F.col("need").alias("take")), whole).where("part = own")
    met = materialise(_met(inner, (*whole, "part"), "range").select(*whole, F.col("range").alias("last"), "need"), "met")
    plan = materialise(_left(takes, met, ("source", "__size")), "plan")
    joined = _left(sized.withColumn("range", spread), plan, ("source", "__size"))
    edge = F.col("range") == F.col("last")
    decided = joined.select(*more, "doc_id", "source", "__size", "mark", "need", edge.alias("edge"), F.coalesce(F.when(F.col("last").isNotNull(), F.col("range") < F.col("last")).otherwise(F.col("take") > 0), F.lit(False)).alias("in"), "whole", "source_size", "target")
    decided = materialise(decided, "decided")
    rank = F.row_number().over(Window.partitionBy("source", "__size").orderBy("mark", "doc_id", *more))
    kept = [*more, "doc_id", "source", "__size", "in", "whole", "source_size", "target"]
    ranked = decided.where("edge").withColumn("in", rank <= F.col("need")).select(kept)
    out = decided.where("edge IS NULL OR NOT edge").select(kept).unionByName(ranked)
    return out.select(*more, "doc_id", "source", F.col("__size").alias("size"), "source_size", "target", (F.col("whole") + F.col("in").cast("int")).alias("copies"))


def _met(cells: DataFrame, keys: tuple[str, ...], by: str) -> DataFrame:
    """Of each group's cells, in order, the one with which ``k`` adds up to
    ``take``; ``need`` is what is missing before it."""
    up_to = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("upto", F.sum("k").over(up_to)).where("upto >= take AND upto - k < take").withColumn("need", F.col("take") - F.col("upto") + F.col("k"))


def _left(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Left join on keys of which the source may be null."""
    renamed = b
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__k_{k}")
    on = None
    for k in keys:
        test = a[k].eqNullSafe(F.col(f"__k_{k}"))
        on = test if on is None else on & test
    return a.join(renamed, on, "left").drop(*(f"__k_{k}" for k in keys))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, copies counted)."""
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
