"""Exact top-k inner products by MaxScore over integer vectors.

A dimension is a term, a vector's component there its weight, and a shard
keeps a posting list for each dimension with the least and greatest weight in
it. For a query the dimensions are ordered by the most they can add; those
that together can't lift a vector to the current k-th score are non-essential.
The essential postings are traversed, and the others are probed, greatest
bound first, only for vectors that can still reach the k-th score. Each task
carries its k best on from shard to shard; the tasks' results are merged.

Components become floor(256 x). Vectors that are null or hold a null or
non-finite component, and rows with a null vec_id, take no part. Sums are doubles
where the query's and the vector's sizes, over all dimensions, keep every partial sum
below EXACT; elsewhere they are 64-bit integers, or Python's; a score that is no BIGINT
is an error. A component that a shorter vector lacks is 0. Ties go to the
smaller vec_id. Every row is a query or candidate of its own, also where vec_ids
or whole rows repeat: a query gets one more than k rows, and of those that are
like itself one is dropped; of equal query rows one is searched for.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder

SCALE = 256
#: Sums of products below these are exact in doubles, and in 64-bit integers; half the
#: true bounds, as they are compared with sums of doubles.
EXACT, LONG = 2.0**52, 2.0**62
#: Queries with a component beyond this are searched for apart, so that they don't slow the others.
LARGEST = 1 << 20
#: Queries a pass broadcasts, vectors a shard holds, and numbers it holds.
QUERIES, SHARD, NUMBERS = 4096, 4096, 1 << 22
QUERY_EVERY, K = 50, 5


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part, components as doubles."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(v, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)


class Shard:
    """Posting lists of some vectors: for each dimension the places and
    weights of the vectors that have it, or all weights if most have it."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.size = ids, len(ids)
        columns = np.ascontiguousarray(rows.T, dtype=float)
        self.columns = columns
        some = columns != 0
        filled = some.sum(axis=1)
        self.places = [None if 2 * n >= self.size else np.flatnonzero(s) for n, s in zip(filled, some, strict=True)]
        # a vector without a posting adds 0, unless every vector has one
        self.high, self.low = columns.max(axis=1, initial=-np.inf), columns.min(axis=1, initial=np.inf)
        self.untouched = filled < self.size

    def bounds(self, query: np.ndarray) -> np.ndarray:
        most = np.maximum(query * self.high, query * self.low)
        return np.where(self.untouched, np.maximum(most, 0.0), most)

    def search(self, query: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the vectors that may be among the k best, given
        that the k-th score so far is ``least``."""
        dims = np.flatnonzero(query[: len(self.columns)])
        most = self.bounds(query[: len(self.columns)])[dims]
        order = np.argsort(most, kind="stable")
        dims, most = dims[order], most[order]
        below = np.concatenate(([0.0], np.cumsum(most)))
        # the first dims are non-essential: all of them together stay under the k-th score
        first = 0
        if least > -np.inf:
            while first < len(dims) and below[first + 1] < least:
                first += 1
        score = np.zeros(self.size)
        touched = np.zeros(self.size, dtype=bool)
        for d in dims[first:]:
            places = self.places[d]
            if places is None:
                score += query[d] * self.columns[d]
                touched = None
            else:
                score[places] += query[d] * self.columns[d][places]
                if touched is not None:
                    touched[places] = True
        live = np.ones(self.size, dtype=bool)
        if touched is not None and first:
            live = touched  # without an essential posting a vector can't reach the k-th score
        if least > -np.inf:
            live &= score + below[first] >= least
        at = np.flatnonzero(live)
        score = score[at]
        for i in range(first - 1, -1, -1):
            if not len(at):
                break
            score = score + query[dims[i]] * self.columns[dims[i]][at]
            if least > -np.inf:
                keep = score + below[i] >= least
                at, score = at[keep], score[keep]
        return self.ids[at], score


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def scaled(vector: list[float]) -> list[int]:
    """floor(256 x) of each component, whatever its size."""
    return [int(x) * SCALE if abs(x) >= 1 << 52 else int(np.floor(x * SCALE)) for x in vector]


def _products(query: np.ndarray, integers: list[int], matrix: np.ndarray, lists) -> np.ndarray:
    """Exact scores of rows of whole numbers; ``lists(i)`` are those of row i."""
    dims = min(len(query), matrix.shape[1])
    q, m = query[:dims], matrix[:, :dims]
    with np.errstate(over="ignore", invalid="ignore"):
        short = np.abs(m) @ np.abs(q) < LONG
        scores = np.where(short[:, None] & (q != 0), m, 0.0).astype(np.int64) @ np.where(np.abs(q) < LONG, q, 0.0).astype(np.int64)
    rest = np.flatnonzero(~short)
    if len(rest):
        scores[rest] = _exact(integers, [lists(i) for i in rest.tolist()])
    return scores


def _exact(query: list[int], lists: list[list[int]]) -> np.ndarray:
    scores = [sum(a * b for a, b in zip(query, v, strict=False)) for v in lists]
    if any(not -(1 << 63) <= x < 1 << 63 for x in scores):
        raise OverflowError("a score is no BIGINT")
    return np.array(scores, dtype=np.int64)


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """floor(256 x) of each list as a row, zeros after its end."""
    ends = lists.offsets.to_numpy()
    size = np.diff(ends)
    inside = np.arange(size.max(initial=0)) < size[:, None]
    out = np.zeros(inside.shape)
    with np.errstate(over="ignore"):
        out[inside] = np.floor(lists.values.to_numpy()[ends[0] : ends[-1]] * SCALE)
    return out


def shard_rows(lists: pa.ListArray, start: int) -> int:
    """How many vectors from a place make a shard, by the longest of them."""
    sizes = np.diff(lists.offsets.to_numpy())[start : start + SHARD]
    longest = np.maximum(np.maximum.accumulate(sizes), 1)
    return max(1, int(np.searchsorted(longest * np.arange(1, len(longest) + 1), NUMBERS, side="right")))


class Queries:
    """A pass's queries: distinct (vec_id, v), how many rows have each, and the
    score of each with itself."""

    def __init__(self, rows: list):
        self.ids, self.lists, self.times = [r.vec_id for r in rows], [scaled(r.v) for r in rows], [r.times for r in rows]
        self.own = [int(_exact(v, [v])[0]) for v in self.lists]
        self.matrix = _matrix(pa.array([r.v for r in rows], pa.list_(pa.float64())))
        self.wide = (np.abs(self.matrix) >= LARGEST).any(axis=1)
        #: the most that a query searched for in shards has in each dimension
        self.most = np.abs(self.matrix[~self.wide]).max(axis=0, initial=0.0)


def search(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``usable`` queries and vectors, where
    the queries are among the vectors.

    A pass broadcasts about QUERIES queries, cut by a hash, and reads all
    vectors; passes append what tasks found, k + 1 rows a query and task.
    """
    spark = vectors.sparkSession
    queries = queries.groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    passes = max(1, -(-queries.count() // QUERIES))
    folder = shared_folder(spark, "topk")
    schema = "pass long, q long, query_id long, own long, times long, vec_id long, score long"
    for number in range(passes):
        rows = queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(passes)) == number).orderBy("vec_id", "v").collect()
        sent = spark.sparkContext.broadcast(Queries(rows))

        def find(batches, sent=sent, number=number):
            sought = sent.value
            top = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(sought.ids)
            for batch in batches:
                start = 0
                while start < batch.num_rows:
                    rows = shard_rows(batch.column("v"), start)
                    part = batch.slice(start, rows)
                    start += rows
                    all_ids = part.column("vec_id").to_numpy()
                    matrix = _matrix(part.column("v"))
                    dims = min(matrix.shape[1], len(sought.most))
                    with np.errstate(over="ignore", invalid="ignore"):
                        near = np.abs(matrix[:, :dims]) @ sought.most[:dims] < EXACT
                    far = np.flatnonzero(~near)
                    lists = functools.lru_cache(maxsize=None)(lambda i, part=part: scaled(part.column("v")[i].as_py()))
                    shard = Shard(all_ids[near], matrix[near])
                    for i, query in enumerate(sought.matrix):
                        ids, scores = top[i]
                        # just below the last score, which may be no double
                        least = np.nextafter(float(scores[-1]), -np.inf) if len(scores) > k else -np.inf
                        more_ids, more = (all_ids[:0], scores[:0]) if sought.wide[i] else shard.search(query, k + 1, least)
                        more = more.astype(np.int64)
                        left = np.arange(len(all_ids)) if sought.wide[i] else far
                        if len(left):
                            scores_left = _products(query, sought.lists[i], matrix[left], lambda j, left=left, lists=lists: lists(int(left[j])))
                            more_ids, more = np.concatenate((more_ids, all_ids[left])), np.concatenate((more, scores_left))
                        if len(more):
                            top[i] = best(np.concatenate((ids, more_ids)), np.concatenate((scores, more)), k + 1)
            for i in range(0, len(top), 1000):
                found = top[i : i + 1000]
                each = [len(ids) for ids, _ in found]
                of = np.repeat(np.arange(i, i + len(found)), each)
                known = [np.array(x, dtype=np.int64)[of] for x in (sought.ids, sought.own, sought.times)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(of), number), of, *known, np.concatenate([ids for ids, _ in found]), np.concatenate([x for _, x in found]))], ["pass", "q", "query_id", "own", "times", "vec_id", "score"])

        vectors.mapInArrow(find, schema).write.mode("append").parquet(folder)
        sent.unpersist()
    found = spark.read.schema(schema).parquet(folder)
    of = Window.partitionBy("pass", "q")
    place = F.row_number().over(of.orderBy(F.desc("score"), "vec_id"))
    itself = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    gone = F.coalesce(F.min(F.when(itself, F.col("place"))).over(of), F.lit(1 << 40))
    ranked = found.withColumn("place", place).where(F.col("place") <= k + 1).withColumn("gone", gone).where("place <> gone")
    ranked = ranked.withColumn("rank", F.col("place") - (F.col("gone") < F.col("place")).cast("int")).where(F.col("rank") <= k)
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def search_own(vectors: DataFrame, every: int = QUERY_EVERY, k: int = K) -> DataFrame:
    """The rows whose vec_id is divisible by ``every``, against all rows."""
    all_rows = usable(vectors)
    return search(all_rows.where(F.col("vec_id") % every == 0), all_rows, k)


ORACLE_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON c.place <> q.place
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
