"""SimHash near duplicates by tiled exact comparison.

A fingerprint has a bit set where more than half of a text's word shingles
(repeats included) have it set in their XXH64. Texts of fewer words than a
shingle count as one shingle; texts of no word, null texts among them, have
fingerprint 0 and link like any other. Fingerprints within ``radius`` bits
are linked, and ``component_id`` is the smallest doc_id that links reach
(null only if every doc_id of the component is null). Each row of a repeated
document is returned.

Comparison is over distinct fingerprints, so groups of copies cost nothing.
They are cut, in order of population count, into tiles of equal size; two
tiles whose population counts lie further apart than the radius are never
brought together, and inside a pair of tiles the same test on the population
counts of each 16-bit quarter skips blocks. A pair of tiles emits a spanning
forest of its links, at most one edge a fingerprint, however dense a group is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modetrace.functions.graph import connected

from .common import fresh, lower_words_of, map_text, materialise, text_slices, texts

SEED = 42
SHINGLE = 4
RADIUS = 4
#: Fingerprints in a tile at most; and how many tiles a small input gets at least.
TILE = 65_536
TILES = 24
_ROWS, _COLUMNS = 256, 2048


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest as digest

    w = lower_words_of(text)
    if not w:
        return 0
    if len(w) <= shingle:
        return digest(" ".join(w), SEED)
    if shingle == 4:
        hashes = [digest(f"{a} {b} {c} {d}", SEED) for a, b, c, d in zip(w, w[1:], w[2:], w[3:], strict=False)]
    else:
        hashes = [digest(" ".join(w[i : i + shingle]), SEED) for i in range(len(w) - shingle + 1)]
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[at : at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit integer."""

    def make():
        def work(b):
            prints = np.array([fingerprint(t, shingle) for t in texts(b)], dtype=np.uint64)
            return {"doc_id": b.column("doc_id").cast(pa.int64()), "fp": pa.array(prints.view(np.int64))}

        return work

    return map_text(docs, ["doc_id", "text"], "doc_id long, fp long", make)


def _join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the classes of linked places; labels stay fully compressed."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def _quarters(prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _blocks(quarters: np.ndarray, size: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    return [(i, min(i + size, len(quarters)), (q := quarters[i : i + size]).min(axis=0), q.max(axis=0)) for i in range(0, len(quarters), size)]


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, root) of all links between two tiles, or
    within one tile if ``b`` is None; unsigned fingerprints in and out."""

    def ordered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = _quarters(x)
        order = np.lexsort((x, q[:, 3], q[:, 2], q[:, 1], q[:, 0]))
        return x[order], q[order]

    a, qa = ordered(a)
    b, qb, base = (a, qa, 0) if b is None else (*ordered(b), len(a))
    nodes = a if base == 0 else np.concatenate((a, b))
    labels = np.arange(len(nodes))
    columns = _blocks(qb, _COLUMNS)
    for i, to_i, low, high in _blocks(qa, _ROWS):
        for j, to_j, low_b, high_b in columns:
            if base == 0 and to_j <= i:
                continue
            apart = np.maximum(np.maximum(low_b - high, low - high_b), 0).sum()
            if apart > radius:
                continue
            near = np.bitwise_count(a[i:to_i, None] ^ b[None, j:to_j]) <= radius
            x, y = np.nonzero(near)
            if len(x):
                _join_labels(labels, x + i, y + j + base)
    linked = np.flatnonzero(labels != np.arange(len(nodes)))
    return nodes[linked], nodes[labels[linked]]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): edges between distinct fingerprints with the same components
    as all links. ``prints`` holds each fingerprint once, with ``ones``, its
    population count. Only the 65 counts of that histogram reach the driver."""
    spark = prints.sparkSession
    counts = dict(prints.groupBy("ones").count().collect())
    total = sum(counts.values())
    tiles = max(-(-total // TILE), min(TILES, -(-total // 64)), 1)
    before, below, low, high = [], 0, {}, {}
    for p in range(65):
        before.append(below)
        n = counts.get(p, 0)
        if n:
            for t in range(below * tiles // total, min(tiles - 1, (below + n) * tiles // total) + 1):
                low.setdefault(t, p)
                high[t] = p
        below += n
    # tiles are in order of population count, so a tile's partners are a range
    used = sorted(low)
    partners = []
    first = last = 0
    for k, t in enumerate(used):
        while high[used[first]] < low[t] - radius:
            first += 1
        last = max(last, k)
        while last + 1 < len(used) and low[used[last + 1]] <= high[t] + radius:
            last += 1
        partners.append((t, used[first], used[last]))
    ranges = spark.createDataFrame(partners or [(0, 0, 0)], "tile long, a long, z long")
    share = F.pmod(F.xxhash64("fp"), F.lit(1 << 24)) / float(1 << 24)

    def at(values: list[int]):
        return F.element_at(F.array(*(F.lit(float(x)) for x in values)), F.col("ones").cast("int") + 1)

    spread = (
        prints.select("fp", F.least(F.floor((at(before) + share * at([counts.get(p, 0) for p in range(65)])) * tiles / max(total, 1)), F.lit(tiles - 1)).cast("long").alias("tile"))
        .join(F.broadcast(ranges), "tile")  # one row a tile of up to TILE fingerprints
        .select("fp", "tile", F.explode(F.sequence("a", "z")).alias("other"))
        .select("fp", (F.col("tile") <= F.col("other")).alias("left"), F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"))
    )

    def compare(key, table):  # no type hints: Spark would read them as an evaluation type
        fp, left = table.column("fp").to_numpy().view(np.uint64), table.column("left").to_numpy(zero_copy_only=False)
        node, root = forest(fp[left], None if key[0] == key[1] else fp[~left], radius)
        return pa.table({"u": node.view(np.int64), "v": root.view(np.int64)})

    return spread.groupBy("a", "b").applyInArrow(compare, "u long, v long")


def classes(prints: DataFrame, radius: int = RADIUS, key: str = "doc_id") -> DataFrame:
    """(fp, least): for each fingerprint of (fp, key) rows the least key that
    links reach from it."""
    distinct = materialise(prints.groupBy("fp").agg(F.min(key).alias("own")).withColumn("ones", F.bit_count("fp")), "distinct")
    roots = connected(links(distinct, radius))
    linked = materialise(distinct.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "own"), "linked")
    least = linked.groupBy("root").agg(F.min("own").alias("class_least"))
    found = linked.join(least, "root").select("fp", "class_least")
    return materialise(distinct.join(found, "fp", "left").select("fp", F.coalesce("class_least", "own").alias("least")), "classes")


def components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    prints = materialise(fingerprints(docs, shingle), "fingerprints")
    return prints.join(classes(prints, radius), "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, with their columns, less all but one of each
    component: the one of the least doc_id stays (null only if all are), of
    equal doc_ids the first that was read."""
    fp, place = fresh(docs, "fp", "row")
    schema = T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType()), T.StructField(place, T.LongType())])

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in text_slices(batch):
                prints = np.array([fingerprint(t, shingle) for t in texts(part)], dtype=np.uint64)
                part = part.append_column(fp, pa.array(prints.view(np.int64)))
                yield part.append_column(place, pa.array(np.arange(row, row + len(prints))))
                row += len(prints)

    printed = materialise(docs.mapInArrow(run, schema), "printed")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(place).alias("row"))
    found = classes(printed.select(F.col(fp).alias("fp"), key.alias("key")), radius, "key")
    stay = found.select(F.col("least.row").alias(place)).distinct()
    return printed.join(stay, place, "left_semi").select(*docs.columns)


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
