"""Helpers that the operators of this subpackage share.

Conventions that hold for every operator here:

* a null text is an empty text; a null ``doc_id`` is kept as a row of its own;
* repeated rows stay repeated rows: no operator merges rows by ``doc_id``;
* only the columns an operator needs are read, so extra columns of any name
  cannot clash with what it adds.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modetrace.sources.scratch import materialise, shared_folder  # noqa: F401

#: A word: a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: How many bytes of text a Python worker holds in one slice.
SLICE_BYTES = 8 << 20


class Memo(dict):
    """Values by key, made when first asked for. Of two generations of at most
    ``limit`` keys each the older goes when the younger is full."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def _words(raw: bytes) -> list[str]:
    """``bytes.split`` splits at just the ASCII white space that ends a word."""
    joined = b" ".join(raw.split())
    return joined.decode().split(" ") if joined else []


def words_of(text: str) -> list[str]:
    """The words of a text; ``str.split`` would also split at other spaces."""
    return _words(text.encode())


def lower_words_of(text: str) -> list[str]:
    """The words of a text with A-Z, and nothing else, in lower case."""
    return _words(text.encode().lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, made longer where the table already has such a column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of about ``limit`` bytes of text, whole rows."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += int(n)
    yield batch.slice(begin)


def map_text(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], limit: int = SLICE_BYTES, column: str = "text") -> DataFrame:
    """Apply a function to every row's text in Arrow slices of about ``limit`` bytes.

    ``make`` is called once in each task and returns the function, which gets
    a slice with ``columns`` and returns the output columns by name.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(200_000, 50, 100)  # what a worker remembers isn't garbage; seldom look through it
        work = make()
        for batch in batches:
            for part in text_slices(batch, column, limit):
                got = work(part)
                yield pa.RecordBatch.from_arrays([x if isinstance(x := got[f.name], pa.Array) else pa.array(x, f.type) for f in out], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def fold_of(doc_id: int | None, folds: int = 5) -> int:
    """crc32 of the id as text, modulo the folds; a null id counts as ''."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def fold_column(doc_id: str = "doc_id", folds: int = 5):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int = 0) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` labelled rows of each
    class 0 and 1, outside the held-out fold 0, the first in a seeded order of
    doc_ids. Only the chosen ids, a bounded number, are broadcast. Ids with a
    null label, or with both labels, are not taken; of rows that repeat an id the
    one of the least text is."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold_column() != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("most")).where("label = most").drop("most")
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(order, "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
