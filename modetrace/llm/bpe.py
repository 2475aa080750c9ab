"""Byte-level BPE encoding and decoding.

A text is cut into pieces, each piece becomes a doubly linked list of byte
symbols, and a priority queue of (rank, position) merges neighbours; entries
whose symbols have changed meanwhile are stale and are skipped. Decoding
concatenates the byte strings of the vocabulary. The results equal those of
the tokenizers library for the same file, special tokens in a text included.

Null texts encode as empty texts (no ids); an empty id list decodes to ''.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_text, texts, tokenizer_path

#: Fixed values of the file format: bytes that stand for themselves.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Below this code point every Unicode version has the same classes.
STABLE = 0x530
#: Pieces in each of the two generations that a worker remembers.
MEMO = 150_000


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for the bytes in the vocabulary file."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


def _class(kind: str) -> str:
    """A regex class of the characters of a major category below STABLE."""
    return "".join(re.escape(chr(c)) for c in range(STABLE) if unicodedata.category(chr(c))[0] == kind)


def _piece_pattern() -> re.Pattern:
    letter, number, space = _class("L"), _class("N"), r"\t-\r \x85\xa0"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class BytePairCodec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.byte_id = [0] * 256
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        #: left id << 17 | right id -> rank << 49 | merged id << 32, to which a position can be added
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"])
        self.merges = {vocab[a] << 17 | vocab[b]: rank << 49 | vocab[a + b] << 32 for rank, (a, b) in enumerate(pairs)}
        self.pattern = _piece_pattern()
        self.unstable = re.compile(f"[^\0-{chr(STABLE - 1)}]")
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = Memo(self.merge, MEMO)
        self._splitter = None

    def merge(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece: a queue of merges over a linked list."""
        ids = [*map(self.byte_id.__getitem__, piece.encode())]
        n = len(ids)
        merge_of = self.merges.get
        queue = [m + i for i in range(n - 1) if (m := merge_of(ids[i] << 17 | ids[i + 1]))]
        if not queue:
            return tuple(ids)
        heapify(queue)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n or merge_of(ids[i] << 17 | ids[j]) != entry - i:
                continue  # stale: one of the two has been merged since
            ids[i] = new = entry >> 32 & 0x1FFFF
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merge_of(new << 17 | ids[k]):
                    heappush(queue, m + i)
            if (h := before[i]) >= 0 and (m := merge_of(ids[h] << 17 | new)):
                heappush(queue, m + h)
        return tuple([x for x in ids if x >= 0])

    def _split_other(self, text: str) -> list[str]:
        """Pieces of a text with characters that Unicode versions class
        differently: the library's own cutter says where they end."""
        if self._splitter is None:
            from tokenizers import pre_tokenizers

            self._splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in self._splitter.pre_tokenize_str(text)]

    def _plain(self, text: str) -> list[int]:
        if not text:
            return []
        if self.unstable.search(text):
            return list(chain.from_iterable(map(self.pieces.__getitem__, self._split_other(text))))
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.pattern.findall(text))))

    def encode(self, text: str) -> list[int]:
        if self.specials is None or not any(s in text for s in self.special):
            return self._plain(text)
        out: list[int] = []
        for part in self.specials.split(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                out += self._plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """Ids without an entry in the vocabulary decode to nothing."""
        try:
            return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")
        except KeyError:
            return b"".join(self.strings.get(i, b"") for i in ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> BytePairCodec:
    return BytePairCodec(path)


def _open(path: str | None, name: str):
    return codec(path or tokenizer_path(name))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every text; ids is empty for a null or empty text."""

    def make():
        c = _open(path, "byte_bpe_50k.json")
        return lambda b: {"doc_id": b.column("doc_id"), "ids": [c.encode(t) for t in texts(b)]}

    return map_text(docs, ["doc_id", "text"], "doc_id long, ids array<int>", make)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids decode to ''."""

    def run(batches):
        c = _open(path, "byte_bpe_50k.json")
        for b in batches:
            out = [c.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def roundtrip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): encoding and decoding in one pass, so that the
    ids needn't travel between two Python workers."""

    def make():
        c = _open(path, "byte_bpe_50k.json")

        def work(b):
            ids = [c.encode(t) for t in texts(b)]
            return {"doc_id": b.column("doc_id"), "ids": ids, "decoded": [c.decode(x) for x in ids]}

        return work

    return map_text(docs, ["doc_id", "text"], "doc_id long, ids array<int>, decoded string", make)


def digests(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``roundtrip``'s rows."""
    return rows.select(
        "doc_id",
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
