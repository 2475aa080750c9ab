"""Token ids in Simple-8b shards.

``encode`` writes the ids of every text, in ascending ``doc_id`` order, to
shard files in a shared folder; ``decode`` reads them back. A shard is a
sequence of segments, each of which stands alone:

    magic, then as little-endian 64-bit numbers: documents, ids, words,
    blocks, escapes, ids a block; then the sections doc_id (int64, null as the
    least int64), id offset of each document and the end, word offset of each
    block and the end, words (uint64), escapes (uint64).

A word holds a selector in its top 4 bits and a run of ids of equal width in
the other 60; a block is a fixed number of ids that starts at a word, so that
blocks are packed side by side and any of them can be read alone. An id that
needs more than 60 bits is an escape: its word holds its place in the section
of escapes.

Null texts count as empty; every document gets the end id, so the fewest ids
of a document are one. Null doc_ids come first; equal doc_ids are ordered by
a hash of the text, then by the text. An empty table gives no shard.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, shared_folder, shuffle_partitions, text_slices, texts, tokenizer_path

MAGIC = b"MTSIMP8B"
HEAD = struct.Struct("<8s6Q")
BLOCK = 1024
#: Ids a word and bits an id for the selectors 1 to 14; 15 is the escape.
PACKINGS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
_PAD = 60
_COUNT = np.array([0, *(n for n, _ in PACKINGS), 1], dtype=np.int64)
#: A segment is closed at this many ids.
SEGMENT_IDS = 250_000
END_ID = 2
NULL_ID = -(1 << 63)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, 0 for 0, as bytes."""
    width = np.zeros(ids.shape, dtype=np.uint8)
    top = int(ids.max(initial=0)).bit_length()
    for b in range(top):
        width += ids >= np.uint64(1 << b)
    return width


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offset of each block and the end, escapes) of uint64 ids.

    All blocks advance together: the widest id of the next 1, 2, 3, ... ids is
    a running maximum over the whole array, so each place knows its selector,
    and one vector step moves every block on by its own word.
    """
    n = len(ids)
    blocks = -(-n // block)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    stride = block + _PAD
    grid = np.zeros((blocks, stride), dtype=np.uint64)
    flat = np.zeros(blocks * block, dtype=np.uint64)
    flat[:n] = ids
    grid[:, :block] = flat.reshape(blocks, block)
    grid = grid.reshape(-1)
    width = _widths(grid)
    selector = np.full(grid.shape, ESCAPE, dtype=np.uint8)
    widest = {1: width}
    for number, (count, bits) in reversed(list(enumerate(PACKINGS, 1))):
        if count not in widest:
            near = max(widest)
            most = widest[near].copy()
            short = count - near
            np.maximum(most[:-short], widest[near][short:], out=most[:-short])
            widest[count] = most
        fits = widest[count] <= bits
        if not fits.any():
            break
        selector[fits] = number
    ends = np.arange(blocks, dtype=np.int64) * stride
    ends += np.minimum(block, n - np.arange(blocks) * block)
    starts = np.zeros(grid.shape, dtype=bool)
    at, to, step = np.arange(blocks, dtype=np.int64) * stride, ends, _COUNT[selector]
    while len(at):
        starts[at] = True
        at = at + step[at]
        on = at < to
        if not on.all():
            at, to = at[on], to[on]
    where = np.flatnonzero(starts)
    chosen = selector[where]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for number, (count, bits) in enumerate(PACKINGS, 1):
        mine = np.flatnonzero(chosen == number)
        if len(mine):
            base, value = where[mine], np.zeros(len(mine), np.uint64)
            for k in range(count):
                value |= grid[base + k] << np.uint64(bits * k)
            words[mine] |= value
    out = np.flatnonzero(chosen == ESCAPE)
    words[out] |= np.arange(len(out), dtype=np.uint64)
    offsets = np.searchsorted(where, np.arange(blocks + 1, dtype=np.int64) * stride)
    return words, offsets.astype(np.int64), grid[where[out]]


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ids that ``pack`` was given: one vector step for each selector."""
    blocks = len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64)
    stride = block + _PAD
    grid = np.zeros(blocks * stride, dtype=np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.uint8)
    counts = _COUNT[chosen]
    before = np.concatenate(([0], np.cumsum(counts)))
    of = np.repeat(np.arange(blocks), np.diff(offsets))
    at = before[:-1] - before[offsets[of]] + of * stride
    for number, (count, bits) in enumerate(PACKINGS, 1):
        mine = np.flatnonzero(chosen == number)
        if len(mine):
            base, value, mask = at[mine], words[mine], np.uint64((1 << bits) - 1)
            for k in range(count):
                grid[base + k] = (value >> np.uint64(bits * k)) & mask
    out = np.flatnonzero(chosen == ESCAPE)
    grid[at[out]] = escapes[(words[out] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return grid.reshape(blocks, stride)[:, :block].reshape(-1)[:n]


class Segment(NamedTuple):
    doc_ids: np.ndarray
    offsets: np.ndarray
    ids: np.ndarray


def write_segment(out, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> None:
    words, blocks, escapes = pack(ids.astype(np.uint64))
    out.write(HEAD.pack(MAGIC, len(doc_ids), len(ids), len(words), len(blocks) - 1, len(escapes), BLOCK))
    out.write(np.array([NULL_ID if x is None else x for x in doc_ids], dtype="<i8").tobytes())
    out.write(np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))).astype("<i8").tobytes())
    for section, kind in ((blocks, "<i8"), (words, "<u8"), (escapes, "<u8")):
        out.write(section.astype(kind, copy=False).tobytes())


def read_segments(source) -> Iterator[Segment]:
    """The segments of an open shard, one at a time."""
    while head := source.read(HEAD.size):
        magic, docs, n, n_words, blocks, n_escapes, block = HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a Simple-8b shard")

        def section(count: int, kind: str) -> np.ndarray:
            return np.frombuffer(source.read(8 * count), dtype=kind)

        doc_ids, offsets, starts = section(docs, "<i8"), section(docs + 1, "<i8"), section(blocks + 1, "<i8")
        words, escapes = section(n_words, "<u8"), section(n_escapes, "<u8")
        yield Segment(doc_ids, offsets, unpack(words, starts, escapes, n, block))


# The normaliser and the pre-tokeniser of a file whose Latin-1 texts PIECE cuts.
CUT_BY_PIECE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


class WordTokenizer:
    """The library's ids for a whole text.

    The file's pipeline lower-cases, drops white space and cuts at character
    classes, so a piece's ids depend on the piece alone. For Latin-1 texts the
    pieces are cut here and each goes through the library's own model once;
    any other text, one that holds a special token, and every text where the
    file's pipeline is another one, goes through the library whole.
    """

    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
    OTHER = re.compile("[^\0-\xff]")
    MEMO = 120_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.specials = [t["content"] for t in parts["added_tokens"]]
        self.by_piece = all(parts.get(k) == v for k, v in CUT_BY_PIECE.items())
        mapped = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # the characters that stand for the UTF-8 bytes of each Latin-1 character
        self.standing = {i: mapped.pre_tokenize_str(chr(i))[0][0] for i in range(256)}
        self.model = self.whole.model
        self.pieces = Memo(self._piece, self.MEMO)

    def _piece(self, piece: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(piece.translate(self.standing))], dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.by_piece or self.OTHER.search(text) or any(s in text for s in self.specials):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.pieces.__getitem__, self.PIECE.findall(text.lower())))


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


#: Schemes that Spark's file systems and pyarrow's both know, and how pyarrow spells them.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def place_of(spark: SparkSession, folder: str) -> str:
    """The folder as a URI that every worker reads the same way: without a scheme it
    lies where Spark itself would put it. A file system that workers can't write to
    is an error here, before any work."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    scheme = path.toUri().getScheme()
    if scheme is None:
        path = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)
        scheme = path.toUri().getScheme()
    if scheme not in SCHEMES:
        raise ValueError(f"shards can't be written to {folder!r}: {scheme} isn't one of {', '.join(SCHEMES)}")
    uri = path.toUri().toString()
    if scheme == "file":
        return "file://" + path.toUri().getPath()
    return SCHEMES[scheme] + uri[len(scheme) :]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def encode(docs: DataFrame, path: str | None = None, folder: str | None = None, end_id: int = END_ID) -> list[tuple[str, int, int]]:
    """Write the shards; (shard file, its documents, its ids) in doc_id order.

    Range partitioning by doc_id, and by a hash of the text where many rows share
    one, makes partition numbers ascend with the ids, and Spark's sort, which can
    spill, orders each. A task names its file after
    its attempt and only what successful attempts report is listed, so a lost
    or repeated task leaves at most an unlisted file.
    """
    spark = docs.sparkSession
    folder = place_of(spark, folder or shared_folder(spark, "simple8b"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path or tokenizer_path("word_bpe_49k.json"))
        filesystem, place = _filesystem(folder)
        shard = TaskContext.get().partitionId()
        file = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}.s8b"
        out, docs_in, ids_in = None, 0, 0
        pending: tuple[list, list, list] = ([], [], [])
        held = 0

        def flush() -> None:
            nonlocal out, held
            if not pending[0]:
                return
            if out is None:
                filesystem.create_dir(place, recursive=True)
                out = filesystem.open_output_stream(f"{place}/{file}")
            write_segment(out, pending[0], pending[1], np.frombuffer(b"".join(pending[2]), dtype="<u4"))
            for x in pending:
                x.clear()
            held = 0

        for batch in batches:
            for part in text_slices(batch, limit=2 << 20):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts(part), strict=True):
                    ids = tokenizer.encode(text) + end
                    n = len(ids) // 4
                    for x, y in zip(pending, (doc_id, n, ids), strict=True):
                        x.append(y)
                    docs_in, ids_in, held = docs_in + 1, ids_in + n, held + n
                    if held >= SEGMENT_IDS:
                        flush()
        flush()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [file], "docs": [docs_in], "ids": [ids_in]})

    rows = (
        docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"))
        .repartitionByRange(shuffle_partitions(spark), "doc_id", "mark")
        .sortWithinPartitions("doc_id", "mark", "text")
        .select("doc_id", "text")
        .mapInArrow(write, "shard long, file string, docs long, ids long")
        .collect()
    )
    shards = [(f"{folder}/{r.file}", r.docs, r.ids) for r in sorted(rows, key=lambda r: r.shard)]
    if shards:
        filesystem, place = _filesystem(folder)
        with filesystem.open_output_stream(f"{place}/_shards.json") as f:
            f.write(json.dumps([{"file": a.rsplit("/", 1)[1], "docs": b, "ids": c} for a, b, c in shards]).encode())
    return shards


def decode(spark: SparkSession, shards: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, ids) of each document in the shards, read a segment at a
    time; ``start`` counts the ids of all documents before it and ``ids`` are
    little-endian unsigned 32-bit integers. The list of shards is a few dozen bytes for each shard file."""
    starts = np.concatenate(([0], np.cumsum([n for _, _, n in shards], dtype=np.int64))).tolist()
    listed = spark.createDataFrame([(f, s) for (f, _, _), s in zip(shards, starts, strict=False)], "file string, start long")
    if len(shards) > 1:
        listed = listed.repartition(len(shards))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(*(batch.column(c).to_pylist() for c in ("file", "start")), strict=True):
                filesystem, place = _filesystem(file)
                with filesystem.open_input_stream(place) as source:
                    for s in read_segments(source):
                        ids = s.ids.astype("<u4")
                        view, bounds = memoryview(ids.tobytes()), s.offsets.tolist()
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(s.doc_ids, mask=s.doc_ids == NULL_ID),
                                pa.array(s.offsets[:-1] + start),
                                pa.array([view[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary()),
                            ],
                            ["doc_id", "start", "ids"],
                        )
                        start += len(ids)

    return listed.mapInArrow(read, "doc_id long, start long, ids binary")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of ``decode``'s rows."""
    return rows.select("doc_id", "start", F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
