"""Near copies of which the shingle sets are alike, by sketches and exact sets.

Two texts are near copies if the sets of their five-word shingles have a
Jaccard similarity of 0.8 or more; a text of fewer words is one shingle, and
texts of no word are alike. Near copies form components, of which the least
doc_id stays.

A text's sketch has 256 bits: the SimHash of its set (64 bits) and one bit of
each of 192 min-hashes. At similarity 0.8 these differ by about 29 bits (10 and
19) with a deviation of 5, those of unrelated texts by 128 with one of 8; WIDE
lies 4.5 deviations above the one and 9 below the other. Sketches are compared
in tiles, all those of sets whose sizes lie within 0.8, by exclusive-or and bit
counts; a pair of tiles gives a spanning forest of what lies within WIDE, and
the components of the forests are clusters.

Within a cluster the sets decide: they are cut into blocks, and a task that has
two blocks takes the exclusive-or of the sets as bit maps over the shingles that
several of them share. For sets of a and b shingles that differ in x the
similarity is (a + b - x) / (a + b + x). Again a forest of the links comes out,
so that dense groups of copies give no pairs but one link a text and task. A
cluster of n texts has n / BLOCK blocks, and each text goes to so many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modetrace.functions.graph import connected

from .common import fresh, lower_words_of, materialise, text_slices, texts
from .simhash import SEED, TILE, TILES, _join_labels

SHINGLE = 5
#: Similarity of near copies, as a fraction.
ALIKE, OF = 4, 5
WORDS, WIDE = 4, 52
#: Texts of a block at most, and shingles that it holds; shingles compared at once.
BLOCK, BLOCK_SHINGLES, AT_ONCE = 1024, 1 << 20, 1 << 16
#: Buckets of set sizes, so many in a factor of e, and how many apart sizes within ALIKE / OF can lie.
STEPS, BUCKETS, REACH = 20, 256, 5
_ROWS, _COLUMNS = 256, 2048
_RNG = np.random.default_rng(SEED)
_HASHES = 64 * (WORDS - 1)
_ODD, _ADD = (_RNG.integers(0, 1 << 63, _HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1), _RNG.integers(0, 1 << 63, _HASHES, dtype=np.uint64)
SKETCH = tuple(f"s{k}" for k in range(WORDS))


def shingles(text: str) -> np.ndarray:
    """The hashes of a text's shingles, each once and in order."""
    from xxhash import xxh64_intdigest as digest

    w = lower_words_of(text)
    if len(w) <= SHINGLE:
        return np.array([digest(" ".join(w), SEED)] if w else [], dtype=np.uint64)
    return np.unique(np.array([digest(f"{a} {b} {c} {d} {e}", SEED) for a, b, c, d, e in zip(w, w[1:], w[2:], w[3:], w[4:], strict=False)], dtype=np.uint64))


def sketch(found: np.ndarray) -> list[int]:
    """The WORDS words of a set's sketch."""
    if not len(found):
        return [0] * WORDS
    ones, least = np.zeros(64, dtype=np.int64), np.full(_HASHES, ~np.uint64(0))
    for at in range(0, len(found), 1 << 12):
        some = found[at : at + (1 << 12)]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        np.minimum(least, (some[:, None] * _ODD + _ADD).min(axis=0), out=least)
    bits = np.concatenate((2 * ones > len(found), (least >> np.uint64(20)) & np.uint64(1) == 1))
    return np.packbits(bits, bitorder="little").view("<u8").tolist()


def _blocks(size: np.ndarray, step: int) -> list[tuple[int, int, int, int]]:
    return [(i, (j := min(i + step, len(size))), int(size[i]), int(size[j - 1])) for i in range(0, len(size), step)]


def forest(a: dict[str, np.ndarray], b: dict[str, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (id, id) of the sketches within WIDE, of sets whose
    sizes allow it, between two tiles or within one if ``b`` is None."""

    def ordered(x):
        order = np.lexsort((x["id"], x["size"]))
        return {k: v[order] for k, v in x.items()}

    a = ordered(a)
    b, base = (a, 0) if b is None else (ordered(b), len(a["id"]))
    ids = a["id"] if base == 0 else np.concatenate((a["id"], b["id"]))
    labels = np.arange(len(ids))
    columns = _blocks(b["size"], _COLUMNS)
    for i, to_i, low, high in _blocks(a["size"], _ROWS):
        for j, to_j, low_b, high_b in columns:
            if base == 0 and to_j <= i or OF * high < ALIKE * low_b or OF * high_b < ALIKE * low:
                continue
            far = np.zeros((to_i - i, to_j - j), dtype=np.uint16)
            for word in SKETCH:
                far += np.bitwise_count(a[word][i:to_i, None] ^ b[word][None, j:to_j])
            x, y = np.nonzero(far <= WIDE)
            x, y = x + i, y + j
            sizes = a["size"][x], b["size"][y]
            near = OF * np.minimum(*sizes) >= ALIKE * np.maximum(*sizes)
            _join_labels(labels, x[near], y[near] + base)
    linked = np.flatnonzero(labels != np.arange(len(ids)))
    return ids[linked], ids[labels[linked]]


def links(nodes: DataFrame) -> DataFrame:
    """(u, v) of ``forest`` over all (id, SKETCH, size). Tiles are in order of
    size; the counts of at most BUCKETS sizes reach the driver."""
    spark = nodes.sparkSession
    nodes = nodes.withColumn("bucket", F.least(F.floor(F.log(F.col("size") + 1.0) * STEPS), F.lit(BUCKETS - 1)).cast("int"))
    counts = dict(nodes.groupBy("bucket").count().collect())
    total = sum(counts.values())
    tiles = max(-(-total // TILE), min(TILES, -(-total // 64)), 1)
    before, below, low, high = [], 0, {}, {}
    for p in range(BUCKETS):
        before.append(below)
        n = counts.get(p, 0)
        if n:
            for t in range(below * tiles // total, min(tiles - 1, (below + n) * tiles // total) + 1):
                low.setdefault(t, p)
                high[t] = p
        below += n
    partners = []
    for t in sorted(low):
        near = [u for u in low if low[u] <= high[t] + REACH and low[t] <= high[u] + REACH]
        partners.append((t, min(near), max(near)))
    ranges = spark.createDataFrame(partners or [(0, 0, 0)], "tile long, a long, z long")
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 24)) / float(1 << 24)

    def at(values: list[int]):
        return F.element_at(F.array(*(F.lit(float(x)) for x in values)), F.col("bucket") + 1)

    spread = (
        nodes.withColumn("tile", F.least(F.floor((at(before) + share * at([counts.get(p, 0) for p in range(BUCKETS)])) * tiles / max(total, 1)), F.lit(tiles - 1)).cast("long"))
        .join(F.broadcast(ranges), "tile")  # one row a tile of up to TILE sets
        .withColumn("other", F.explode(F.sequence("a", "z")))
        .select("id", *SKETCH, "size", (F.col("tile") <= F.col("other")).alias("left"), F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"))
    )

    def compare(key, table):  # no type hints: Spark would read them as an evaluation type
        x = {k: table.column(k).to_numpy() for k in ("id", *SKETCH, "size")}
        x |= {k: x[k].view(np.uint64) for k in SKETCH}
        left = table.column("left").to_numpy(zero_copy_only=False)
        u, v = forest({k: c[left] for k, c in x.items()}, None if key[0] == key[1] else {k: c[~left] for k, c in x.items()})
        return pa.table({"u": u, "v": v})

    return spread.groupBy("a", "b").applyInArrow(compare, "u long, v long")


def alike(sets: list[np.ndarray], left: np.ndarray) -> np.ndarray:
    """Labels, the least place of each component, of sets (hashes in order) and
    their links: those between the ones that are ``left`` and the others, or
    between all if all are."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, number, times = np.unique(hashes, return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    shared = times[number] > 1  # the others differ from every other set's
    number, owner = rank[number[shared]], owner[shared]
    alone = size - np.bincount(owner, minlength=len(sets))
    rows, columns = np.flatnonzero(left), np.arange(len(sets)) if left.all() else np.flatnonzero(~left)
    differ = (alone[rows][:, None] + alone[columns][None]).astype(np.int64)
    for at in range(0, int(rank[-1]) + 1 if len(rank) else 0, AT_ONCE):
        here = (number >= at) & (number < at + AT_ONCE)
        width = min(AT_ONCE, int(rank[-1]) + 1 - at)
        maps = np.zeros((len(sets), -(-width // 64) * 64), dtype=bool)
        maps[owner[here], number[here] - at] = True
        maps = np.packbits(maps, axis=1, bitorder="little").view(np.uint64)
        for k in range(0, len(rows), 16):
            differ[k : k + 16] += np.bitwise_count(maps[rows[k : k + 16], None] ^ maps[columns][None]).sum(axis=2, dtype=np.int64)
    both = size[rows][:, None] + size[columns][None]
    x, y = np.nonzero(OF * (both - differ) >= ALIKE * (both + differ))
    labels = np.arange(len(sets))
    _join_labels(labels, rows[x], columns[y])
    return labels


def exact_links(nodes: DataFrame, clusters: DataFrame, rows: DataFrame) -> DataFrame:
    """(u, v): a forest of the near copies within each cluster. ``nodes`` have
    (id, size), ``clusters`` (id, root) and ``rows`` (id, text)."""
    member = nodes.select("id", "size").join(clusters, "id")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks")
    member = member.join(member.groupBy("root").agg(blocks), "root").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))

    def cut(batches):
        for batch in batches:
            for part in text_slices(batch):
                found = [shingles(t).view(np.int64) for t in texts(part)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "root", "block", "blocks")), pa.array(found, pa.list_(pa.int64()))], ["id", "root", "block", "blocks", "found"])

    sets = rows.join(member.select("id", "root", "block", "blocks"), "id").select("id", "root", "block", "blocks", "text").mapInArrow(cut, "id long, root long, block long, blocks long, found array<long>")
    spread = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("id", "root", "found", (F.col("block") <= F.col("other")).alias("left"), F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))

    def compare(key, table):  # no type hints: Spark would read them as an evaluation type
        ids, left = table.column("id").to_numpy(), table.column("left").to_numpy(zero_copy_only=False)
        found = table.column("found").combine_chunks()
        values, ends = found.flatten().to_numpy().view(np.uint64), found.offsets.to_numpy()
        labels = alike([values[i:j] for i, j in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)], left)
        linked = np.flatnonzero(labels != np.arange(len(ids)))
        return pa.table({"u": ids[linked], "v": ids[labels[linked]]})

    return spread.groupBy("root", "a", "b").applyInArrow(compare, "u long, v long")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns, less all but one of each
    component: the one of the least doc_id stays (null only if all are), of
    equal doc_ids the first that was read."""
    extra = fresh(docs, *SKETCH, "size", "set", "row")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, T.LongType()) for name in extra)])

    def run(batches):
        from xxhash import xxh64_intdigest as digest

        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in text_slices(batch):
                made = []
                for t in texts(part):
                    found = shingles(t)
                    made.append((*sketch(found), len(found), digest(found.tobytes(), SEED), place))
                    place += 1
                columns = np.array(made, dtype=np.uint64).reshape(-1, len(extra)).T
                for name, values in zip(extra, columns, strict=True):
                    part = part.append_column(name, pa.array(np.ascontiguousarray(values).view(np.int64)))
                yield part

    printed = materialise(docs.mapInArrow(run, schema), "printed")
    *words, size, set_, row = extra
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row"))
    sketches = F.struct(*(F.col(c).alias(k) for c, k in zip(words, SKETCH, strict=True)), F.col(size).alias("size"))
    same = printed.groupBy(set_).agg(F.min(key).alias("own"), F.min(sketches).alias("s"))
    nodes = materialise(same.select(F.col("own.row").alias("id"), "own", "s.*"), "nodes")
    clusters = connected(links(nodes)).toDF("id", "root")
    root = connected(exact_links(nodes, clusters, printed.select(F.col(row).alias("id"), "text"))).toDF("id", "root")
    stay = nodes.join(root, "id", "left").groupBy(F.coalesce("root", "id").alias("class")).agg(F.min("own").alias("own")).select(F.col("own.row").alias(row))
    return printed.join(stay, row, "left_semi").select(*docs.columns)
