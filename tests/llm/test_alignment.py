"""Alignment of two tokenizers against a plain version, token by token."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from modetrace.llm import alignment
from modetrace.llm.common import tokenizer_path
from modetrace.llm.registry import op11_alignment

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tool():
    return alignment.aligner(*map(tokenizer_path, (alignment.A_NAME, alignment.B_NAME)))


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def plainly(encoders, texts):
    """The contract's words: (n_a, n_b, n_groups, n_links, n_best, count_sum, sha)."""
    a_tool, b_tool = encoders
    names = {v: k for k, v in a_tool.get_vocab().items()}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printable)}
    docs, counts = [], Counter()
    for text in texts:
        a, b = (a_tool.encode(" " + text, add_special_tokens=False).ids, b_tool.encode(text)) if text else ([], [])
        raw_a = [bytes(byte_of[c] for c in names[i]) for i in a]
        raw_b = [bytes([int(p[3:5], 16)]) if b_tool.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_tool.id_to_piece(i)]]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            docs.append(None)
            continue
        groups, links, i, j, at_a, at_b = [], [], 0, 0, 0, 0
        left, right = [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                at_a += len(raw_a[i])
                left.append(a[i])
                i += 1
            else:
                at_b += len(raw_b[j])
                right.append(b[j])
                j += 1
            if at_a == at_b and right:
                groups.append((left, right))
                links.append((left[-1], right[-1]))
                left, right = [], []
        docs.append((a, b, groups, links))
        counts.update(links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = d
        spelled = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(spelled.encode()).hexdigest()))
    return out


def _got(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


def test_components():
    rng = random.Random(5)
    for _ in range(30):
        n = rng.randrange(1, 60)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(80))]
        least = list(range(n))
        for _ in range(n):
            for u, v in edges:
                least[u] = least[v] = min(least[u], least[v])
        u, v = (alignment.np.array([e[i] for e in edges], dtype=int) for i in (0, 1))
        assert alignment.components(u, v, n).tolist() == least


def test_whole_table(spark, encoders):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted((r.doc_id, *x) for r, x in zip(rows, plainly(encoders, [r.text or "" for r in rows]), strict=True))
    assert sorted((r.doc_id, *_got(r)) for r in op11_alignment(spark, SF).collect()) == want
    assert sum(x[3] for x in want) > 100_000


TEXTS = [None, "", " ", "  two  spaces ", "a\nb\n\n c", "<|endoftext|> and <s> <0x41>", "naïve Größe ▁ x", "日本語 ﬁ 🙂", "\x85\xa0 \x00 end", "same words", "same words", "x" * 5000, " " * 3000 + "y", "word " * 40_000]


@pytest.mark.parametrize("frequent", [0, 7, 1 << 20])
def test_rows_of_any_kind(spark, encoders, frequent):
    """However few pairs are broadcast, the sums are the same."""
    rows = [(None if i == 3 else i % 9, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], "doc_id long, text string, row long, links string, n long").repartition(3)
    want = sorted(zip((str(r[0]) for r in rows), plainly(encoders, [t or "" for t in TEXTS]), strict=True))
    assert sorted((str(r.doc_id), _got(r)) for r in alignment.align(df, frequent=frequent).collect()) == want
    assert alignment.align(df.where("false"), frequent=frequent).count() == 0


def test_groups_spell_the_text(spark, tool):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in alignment.groups(df).collect():
        text = TEXTS[r.doc_id] or ""
        assert len(r.a) == len(r.b)
        for a, b in zip(r.a, r.b, strict=True):
            assert b"".join(tool.a_bytes[i] for i in a) == b"".join(tool.b_bytes[i] for i in b) != b""
        if r.a:
            assert b"".join(tool.a_bytes[i] for g in r.a for i in g) == (" " + text).encode()


def test_quick_library_is_the_same(tool, encoders):
    """Every pair of characters below the bound, and random strings of them."""
    rng = random.Random(3)
    kinds = "a'sétß1²٣ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0-_.ªµʰ̀҃Ж֏\x00"
    found = ["".join(p) for x in kinds for y in kinds for p in (x + y, "b" + x + y, x + " " + y + " ")]
    found += ["".join(map(chr, range(i, i + 64))) for i in range(0, alignment.STABLE - 64, 16)]
    found += ["".join(rng.choice(kinds) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for text in found:
        assert tool.encode_a(text) == encoders[0].encode(" " + text, add_special_tokens=False).ids, text
    assert tool.quick is not None


def test_quick_library_on_the_corpus(spark, tool, encoders):
    for r in spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") % 7 == 3).collect():
        assert tool.encode_a(r.text) == encoders[0].encode(" " + r.text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 300_000, "x" * 300_000, "\n\t" * 100_000])
def test_long_runs(tool, text):
    x = tool.align([text, "after it"])
    assert x.groups[1] > 0 and len(x.n_a) == 2
