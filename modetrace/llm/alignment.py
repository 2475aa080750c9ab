"""Alignment of two tokenizers' tokens of the same text, and corpus-wide counts of
the id pairs that it links.

Tokenizer A is a byte-level BPE and gets a space and the text, B is a sentencepiece
model that puts the space there itself. A token of A and one of B that share bytes
are an edge of a bipartite graph; its connected components, found by union-find over
all tokens of a slice of texts at once, are the minimal groups between two places
where tokens of both end. Of a component's members the last of A and the last of B
end together: they are a link. Any two tokens whose ranges end together are the last
of one component, so these are all links.

Links are counted over the corpus by id pair, and each document gets the sum of its
links' counts. The pairs that recur most, at most ``FREQUENT`` of them, are
broadcast; the occurrences of the others, none of which can be frequent, are joined
by pair. What B id links to most often is one row a B id, bounded by the vocabulary.

Null and empty texts, and texts whose tokens don't spell a space and the text, have
no tokens. Strings of special tokens in a text are plain text. Repeated rows and ids
are rows of their own, each with its links counted.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import STABLE, byte_alphabet
from .common import fresh, map_text, materialise, texts, tokenizer_path

A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Most pairs of which every worker gets the counts.
FREQUENT = 1 << 20
#: Bytes of text whose tokens a worker holds at a time.
SLICE = 1 << 20


def components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, for edges (u, v) of n nodes.
    Each round hooks the greater root of an edge to the lesser and then makes
    every node point at its root."""
    parent = np.arange(n, dtype=np.int32)
    while len(u):
        ru, rv = parent[u], parent[v]
        apart = ru != rv
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        parent[np.maximum(ru, rv)] = np.minimum(ru, rv)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


class Aligned(NamedTuple):
    """The tokens of several texts end to end, and the groups they fall into."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray  # of each text
    n_b: np.ndarray
    group_a: np.ndarray  # of each token
    group_b: np.ndarray
    groups: np.ndarray  # of each text, how many

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The A and B id of each group's link."""
        last_a = np.flatnonzero(np.diff(self.group_a, append=-1))
        last_b = np.flatnonzero(np.diff(self.group_b, append=-1))
        return self.a[last_a], self.b[last_b]


def _library(path: str):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(path)
    tool.no_truncation()
    tool.no_padding()
    tool.encode_special_tokens = True
    return tool


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        self.path_a, self._library = path_a, None
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items() if s not in special} | {i: s.encode() for s, i in special.items()}
        self.a_bytes = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b_bytes = [bytes([int(s[3:5], 16)]) if self.pieces.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        # the same vocabulary for a faster library, which takes a token's id as its rank
        pair = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocab[x + y] for x, y in pair]
        self.quick = None
        if made == sorted(made):
            import public_tokenizers

            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: i for i, x in strings.items() if i not in special.values()}, special_tokens={})
        #: What the two libraries may treat differently: letters that Unicode versions class differently, and long runs of white space
        self.unlike = re.compile(rf"[^\0-{chr(STABLE - 1)}]|\s{{500}}")
        #: a token's id after what goes before it, for the first of a group, the first of B in one, and the others
        n = max(len(self.a_bytes), len(self.b_bytes))
        self.spelled = np.array([s + b"%d" % i for s in (b";", b"|", b",") for i in range(n)], dtype=object)
        self.width = n

    def encode_a(self, text: str) -> list[int]:
        """A's ids of a space and the text."""
        if self.quick is None or self.unlike.search(text):
            if self._library is None:
                self._library = _library(self.path_a)
            return self._library.encode(" " + text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(" " + text)

    def tokens(self, text: str) -> tuple[bytes, bytes]:
        """The packed ids of both tokenizers; none if they don't spell the text."""
        if not text:
            return b"", b""
        a, b, whole = self.encode_a(text), self.pieces.encode(text, num_threads=1), (" " + text).encode()
        if not b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b)):
            return b"", b""
        return array("i", a).tobytes(), array("i", b).tobytes()

    def align(self, found: list[str]) -> Aligned:
        pairs = [self.tokens(text) for text in found]
        n_a, n_b = (np.array([len(p[i]) // 4 for p in pairs], dtype=np.int64) for i in (0, 1))
        a, b = (np.frombuffer(b"".join([p[i] for p in pairs]), dtype=np.int32) for i in (0, 1))
        # both spell the same bytes, so that one line of offsets serves all texts
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        size = int(end_a[-1]) + 1 if len(a) else 1
        ends_a, ends_b = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        ends_a[end_a] = ends_b[end_b] = True
        ends = np.flatnonzero(ends_a | ends_b)
        # every stretch between two ends lies in one token of each: an edge
        of_a, of_b = (np.cumsum(e, dtype=np.int32)[ends] - e[ends] for e in (ends_a, ends_b))
        roots = components(of_a, len(a) + of_b, len(a) + len(b))
        first = roots == np.arange(len(roots))  # a component's least node is its first A token
        group = (np.cumsum(first, dtype=np.int32) - 1)[roots]
        group_a, group_b = group[: len(a)], group[len(a) :]
        upto = np.concatenate([[0], group_a + 1])[np.cumsum(n_a)]
        return Aligned(a, b, n_a, n_b, group_a, group_b, np.diff(upto, prepend=0))

    def digests(self, x: Aligned) -> list[str]:
        """The hash of each text's groups, written like a1,a2|b1;a3|b2,b3."""
        count = int(x.groups.sum())
        first_a, first_b = (np.diff(g, prepend=-1) != 0 for g in (x.group_a, x.group_b))
        of_a, of_b = (np.bincount(g, minlength=count) for g in (x.group_a, x.group_b))
        place_a = np.arange(len(x.a)) + (np.cumsum(of_b) - of_b)[x.group_a]
        place_b = np.arange(len(x.b)) + np.cumsum(of_a)[x.group_b]
        spelled = np.empty(len(x.a) + len(x.b), dtype=np.int64)
        spelled[place_a] = np.where(first_a, 0, 2) * self.width + x.a
        spelled[place_b] = np.where(first_b, 1, 2) * self.width + x.b
        parts, out, at = self.spelled[spelled].tolist(), [], 0
        for n in (x.n_a + x.n_b).tolist():
            out.append(hashlib.sha256(b"".join(parts[at : at + n])[1:]).hexdigest() if n else "")
            at += n
        return out


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _open(path_a: str | None, path_b: str | None) -> Aligner:
    return aligner(path_a or tokenizer_path(A_NAME), path_b or tokenizer_path(B_NAME))


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def groups(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(doc_id, a, b): the groups of every text in order, as two lists of lists of
    ids; empty where a text has no tokens."""

    def make():
        tool = _open(path_a, path_b)

        def work(batch):
            x = tool.align(texts(batch))
            count = int(x.groups.sum())
            lists = {c: _lists(_lists(pa.array(ids), np.bincount(group, minlength=count)), x.groups) for c, ids, group in (("a", x.a, x.group_a), ("b", x.b, x.group_b))}
            return {"doc_id": batch.column("doc_id").cast(pa.int64())} | lists

        return work

    return map_text(docs, ["doc_id", "text"], "doc_id long, a array<array<int>>, b array<array<int>>", make, SLICE)


def links(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, groups_sha256, links) of every text: ``row``
    tells rows apart, and a link is an A id times 2^32 plus a B id. Written once."""
    (row,) = fresh(docs, "row")

    def make():
        tool = _open(path_a, path_b)

        def work(batch):
            x = tool.align(texts(batch))
            a, b = x.links()
            return {
                "row": batch.column(row),
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "n_a": x.n_a,
                "n_b": x.n_b,
                "n_groups": x.groups,
                "groups_sha256": tool.digests(x),
                "links": _lists(pa.array(a.astype(np.int64) << 32 | b), x.groups),
            }

        return work

    numbered = docs.select("doc_id", "text").withColumn(row, F.monotonically_increasing_id())
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>"
    return materialise(map_text(numbered, [row, "doc_id", "text"], schema, make, SLICE), "links")


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n, best) of every id pair: how many links hold it, and whether no
    other pair of its B id has more. Written once."""
    counted = materialise(linked.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    highest = counted.groupBy(b.alias("b")).agg(F.max("n").alias("highest"))  # at most one row an id of B
    return counted.withColumn("b", b).join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def _frequent(counts: DataFrame, limit: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(least n, pairs in order, twice n plus best) of the pairs with the greatest
    counts, down to a power of two that at most ``limit`` of them reach."""
    power = F.floor(F.log2(F.col("n").cast("double") + 0.5)).cast("int")
    sizes = {r.power: r.k for r in counts.groupBy(power.alias("power")).agg(F.count("*").alias("k")).collect()}  # at most 63 rows
    least, total = 63, 0
    while least > 0 and total + sizes.get(least - 1, 0) <= limit:
        least -= 1
        total += sizes.get(least, 0)
    top = counts.where(power >= least).select("pair", (F.col("n") * 2 + F.col("best").cast("long")).alias("value")).toArrow().sort_by("pair")
    return least, *(top.column(c).to_numpy() for c in ("pair", "value"))


def counted(linked: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """The rows of ``links`` with n_links, n_best and count_sum in place of links."""
    spark = linked.sparkSession
    least, pairs, values = _frequent(counts, frequent)
    shared = spark.sparkContext.broadcast((pairs, values))
    kept = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string"
    names = [x.split()[0] for x in kept.split(", ")]

    def sums(batches):
        pairs, values = shared.value
        for batch in batches:
            column = batch.column("links")
            of = np.repeat(np.arange(len(batch)), np.diff(column.offsets.to_numpy()))
            found = column.flatten().to_numpy()
            at = np.minimum(np.searchsorted(pairs, found), max(len(pairs) - 1, 0))
            known = pairs[at] == found if len(pairs) else np.zeros(len(found), dtype=bool)
            value = np.where(known, values[at], 0) if len(pairs) else np.zeros(len(found), dtype=np.int64)
            n_best, total = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            np.add.at(n_best, of, value & 1)
            np.add.at(total, of, value >> 1)
            rest = _lists(pa.array(found[~known], pa.int64()), np.bincount(of[~known], minlength=len(batch)))
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(np.diff(column.offsets.to_numpy()), pa.int64()), pa.array(n_best), pa.array(total), rest], [*names, "n_links", "n_best", "count_sum", "rest"])

    first = linked.mapInArrow(sums, f"{kept}, n_links long, n_best long, count_sum long, rest array<long>")
    if least == 0:
        return first.drop("rest")  # every pair is among the frequent ones
    rest = first.select("row", F.explode("rest").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("k"))
    rest = rest.join(counts, "pair").groupBy("row").agg(F.sum(F.col("k") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("more_best"))
    both = first.drop("rest").join(rest, "row", "left")
    return both.select(*names, "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of
    every document."""
    linked = links(docs, path_a, path_b)
    rows = counted(linked, pair_counts(linked), frequent)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
