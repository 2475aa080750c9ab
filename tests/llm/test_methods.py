"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modetrace.llm import bpe, common, maxscore, mixing, pii, quality, registry, secret_scan, simhash, simple8b, spans, toxicity

SF = "/root/testdata/sf0.001"
settings.register_profile("slow", deadline=None)
settings.load_profile("slow")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = st.lists(st.sampled_from(list("ab 'ABÉ\"sré12 \n\t\x1c\x85\xa0世<>|'llµß²½ªİΣ՘") + ["<|endoftext|>", "’s", "e\u0301"]), max_size=14).map("".join)


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet') ORDER BY 1").fetchall()


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def frame(spark, name):
    return registry.queries()[name](spark, SF).toPandas().sort_values("doc_id", ignore_index=True)


@given(ODD)
def test_words(text):
    assert common.words_of(text) == WORD.findall(text)
    assert common.lower_words_of(text) == WORD.findall(lower(text))


@given(ODD)
def test_bpe_is_the_librarys(text):
    from tokenizers import Tokenizer

    library = _open("byte_bpe_50k.json", Tokenizer)
    mine = bpe.codec(common.tokenizer_path("byte_bpe_50k.json"))
    ids = library.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == ids and mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


@given(ODD)
def test_word_ids_are_the_librarys(text):
    from tokenizers import Tokenizer

    library = _open("word_bpe_49k.json", Tokenizer)
    mine = simple8b._tokenizer(common.tokenizer_path("word_bpe_49k.json"))
    assert np.frombuffer(mine.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_another_pipeline_goes_through_the_library(monkeypatch):
    path = common.tokenizer_path("word_bpe_49k.json")
    assert simple8b.WordTokenizer(path).by_piece
    monkeypatch.setattr(simple8b, "CUT_BY_PIECE", {"normalizer": None})
    other = simple8b.WordTokenizer(path)
    assert not other.by_piece and other.encode("Some words, 12") == simple8b._tokenizer(path).encode("Some words, 12")


_CACHE = {}


def _open(name, kind):
    return _CACHE.setdefault(name, kind.from_file(common.tokenizer_path(name)))


@settings(max_examples=60)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=300), st.sampled_from([7, 64, 1024]))
def test_simple8b_roundtrip(ids, block):
    x = np.array(ids, dtype=np.uint64)
    words, offsets, escapes = simple8b.pack(x, block)
    assert (simple8b.unpack(words, offsets, escapes, len(x), block) == x).all()
    assert len(escapes) == sum(i >= 2**60 for i in ids)


def test_token_files(spark, texts):
    from tokenizers import Tokenizer

    library, start = _open("word_bpe_49k.json", Tokenizer), 0
    for (doc_id, text), r in zip(texts, frame(spark, "op2_simple8b").itertuples(), strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_components(spark, texts):
    import xxhash

    def fingerprint(text):
        w = WORD.findall(lower(text))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(t) for _, t in texts]
    least = _brute_components(prints, 4)
    got = frame(spark, "op3_simhash")
    assert got["fingerprint"].tolist() == [format(p, "016x") for p in prints]
    assert got["component_id"].tolist() == [texts[k][0] for k in least]


def _brute_components(prints, radius):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius and find(a) != find(b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(prints))]


def test_chains_link(spark):
    rng = random.Random(5)
    prints = []
    for _ in range(30):  # chains whose ends are far apart
        x = rng.getrandbits(64)
        for _ in range(12):
            prints.append(x)
            for _ in range(4):
                x ^= 1 << rng.randrange(64)
    rng.shuffle(prints)
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    found = {r.fp: r.least for r in simhash.classes(df).collect()}
    assert [found[p] for _, p in rows] == _brute_components(prints, 4)


@settings(max_examples=40)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 6), min_size=1, max_size=12), st.integers(0, 800))
def test_length_budgets(histogram, budget):
    lengths, counts = np.array(list(histogram)), np.array(list(histogram.values()))
    take = mixing.fit_lengths(lengths, counts, budget)
    assert ((take >= 0) & (take <= counts)).all()
    sums = {0}
    for n, k in histogram.items():
        sums = {s + n * i for s in sums for i in range(k + 1)}
    best = min(abs(s - budget) for s in sums)
    assert abs(int((take * lengths).sum()) - budget) <= best + max(histogram)


def test_targets():
    got = mixing.targets({"a": 10, "b": 10, None: 10, "c": 10})
    assert got["a"] == 20 and sum(got.values()) == pytest.approx(60) and max(got.values()) <= 20
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


@pytest.mark.parametrize("ids", ["null", "equal"])
def test_mix_spreads_rows_without_ids(spark, ids):
    doc_id = F.lit(None).cast("long") if ids == "null" else F.lit(7).cast("long")
    text = F.lit("one two three") if ids == "null" else F.concat(F.lit("one two "), F.col("id"))
    docs = spark.range(20_000).select(doc_id.alias("doc_id"), text.alias("text"), F.lit("web").alias("source"))
    sized = mixing._sizes(docs, mixing.SEED)
    largest = sized.groupBy(F.pmod("mark", F.lit(mixing.RANGES))).count().agg(F.max("count")).first()[0]
    assert largest < 40
    rows = mixing.digests(mixing.mix(docs))
    target, taken = rows.agg(F.first("target"), F.sum("taken")).first()
    assert target == 90_000 and taken == 90_000
    assert mixing.mixed(docs).count() == 30_000


def test_mix(spark, texts):
    got = frame(spark, "op5_mixing")
    assert got["size"].tolist() == [len(WORD.findall(t or "")) for _, t in texts]
    source = dict(duckdb.sql(f"SELECT doc_id, source FROM read_parquet('{SF}/documents.parquet')").fetchall())
    sizes = collections.Counter()
    for i, t in texts:
        sizes[source[i]] += len(WORD.findall(t or ""))
    # the targets, written plainly: shares by weight, and what a source can't take goes to the others
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight, full, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, set(order)
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(full.values())
        target = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        above = {s for s in left if target[s] > 2 * sizes[s]}
        if not above:
            break
        full |= {s: 2.0 * sizes[s] for s in above}
        left -= above
    target |= full
    assert got["target"].tolist() == pytest.approx([target[source[i]] for i, _ in texts])
    for _, g in got.groupby(got["doc_id"].map(source)):
        assert g["source_size"].iloc[0] == g["size"].sum() and abs(g["taken"].sum() - g["target"].iloc[0]) <= max(g["size"])
        assert (g["taken"] <= 2 * g["size"]).all()


def test_topk_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = duckdb.sql(maxscore.ORACLE_SQL).fetchall()
    assert sorted(want) == sorted(map(tuple, registry.queries()["op6_maxscore"](spark, SF).collect()))


def test_maxscore_against_brute_force():
    rng = np.random.default_rng(1)
    for t in range(200):
        n, d, k = int(rng.integers(1, 200)), int(rng.integers(1, 12)), 5
        x = rng.integers(-6, 7, (n, d)) * ((rng.random((n, d)) < 0.2) if t % 2 else 1)
        ids, q = rng.permutation(n), rng.integers(-5, 6, d).astype(float)
        top = (np.zeros(0, np.int64), np.zeros(0))
        for a in range(0, n, 17):
            least = top[1][-1] if len(top[1]) == k else -np.inf
            i, s = maxscore.Shard(ids[a : a + 17], x[a : a + 17].astype(float)).search(q, k, least)
            top = maxscore.best(np.concatenate((top[0], i)), np.concatenate((top[1], s)), k)
        want = maxscore.best(ids, x @ q, k)
        assert (top[0] == want[0]).all() and (top[1] == want[1]).all()


def test_several_passes(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(600)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, maxscore.search_own(df, every=7).collect()))
    monkeypatch.setattr(maxscore, "QUERIES", 20)
    assert sorted(map(tuple, maxscore.search_own(df, every=7).collect())) == want


ASSIGN = regex.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", regex.ASCII)
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


@settings(max_examples=300)
@given(st.lists(st.sampled_from("a1.@-2+ 5()9"), max_size=45).map("".join))
def test_identifiers_against_the_patterns(text):
    def good(kind, m):
        digits = [int(c) for c in m if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 12 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    want = [(k, *m.span()) for k, p in PLAIN.items() for m in regex.finditer(p, text) if good(k, m.group())]
    assert pii.identifiers(text) == want


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail bob [at] example [dot] com now", "email", "bob [at] example [dot] com"),
        ("bob at example dot com", "email", "bob at example dot com"),
        ("to ｂｏｂ＠example.com!", "email", "ｂｏｂ＠example.com"),
        ("see аlice@exаmple.com", "email", "аlice@exаmple.com"),
        ("j​oe@exam​ple.org", "email", "j​oe@exam​ple.org"),
        ("call plus one five five five one two three four five six now", "phone", "plus one five five five one two three four five six"),
        ("pay four nine two nine 3483 8514 6307 six soon", "card", None),
    ],
)
def test_disguises(text, kind, span):
    found = [text[a:b] for k, a, b, base in pii.find_in(text) if k == kind and not base]
    assert found == ([span] if span else found)
    if span:
        assert span not in pii.mask(text, pii.find_in(text))


def test_plain_prose_has_no_identifiers():
    assert pii.find_in("He sat at the dot of one two three (four) in 2024, point by point.") == []


@settings(max_examples=200)
@given(st.lists(st.sampled_from(list("ab:= \"'1fF") + ["token", "SECRET", "Api_key", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "ſecret"]), max_size=30).map("".join))
def test_secret_patterns(text):
    finder = _CACHE.setdefault("finder", secret_scan.SecretFinder(common.tokenizer_path("byte_bpe_50k.tiktoken")))
    want = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    want += [("access", *m.span()) for m in regex.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    want += [("hex", *m.span()) for m in regex.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    assert [s[:3] for s in finder.base(text)] == want
    assert spans.in_order(finder(text), secret_scan.KINDS) == finder(text)


def test_random_strings_stand_out():
    finder = secret_scan.SecretFinder(common.tokenizer_path("byte_bpe_50k.tiktoken"))
    assert [s[0] for s in finder("key q8Zt3LxV0bN7mKpR2sYwE4uH done")] == ["random"]
    for text in ("getUserAccountByIdentifier", "550e8400-e29b-41d4-a716-446655440000", "2024-01-01_12-30-00-123456", "a_very_long_snake_case_name_here", "D41D8CD98F00B204E9800998ECF8427E"):
        assert finder(text) == []


def test_quality_counts(spark, texts):
    got = frame(spark, "op8_quality")
    for (_, text), r in zip(texts, got.itertuples(), strict=True):
        w = WORD.findall(text or "")
        windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), failed)
        assert not (r.base_failed and r.kept)


def test_trees_are_monotone_and_accurate():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.5) & (x[:, 2] > 0.2)).astype(float)
    flip = rng.random(3000) < 0.05
    trees = quality.grow(x[:2000], np.where(flip, 1 - y, y)[:2000], [-1, 0, 0])
    assert ((trees.probability(x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean() > 0.95
    # the flat arrays against a walk from node to node
    for row, logit in zip(x[2000:2100], trees.logit(x[2000:2100]), strict=True):
        total = trees.base
        for at in trees.roots.tolist():
            while trees.left[at] != at:
                at = int((trees.left if row[trees.feature[at]] <= trees.threshold[at] else trees.right)[at])
            total += trees.value[at]
        assert logit == pytest.approx(total)
    more = x[2000:].copy()
    more[:, 0] = np.minimum(1, more[:, 0] + rng.random(1000))
    assert (trees.logit(more) <= trees.logit(x[2000:]) + 1e-12).all()


def test_noisy_or_of_every_text(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    texts = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf}/documents.parquet') ORDER BY 1").fetchall()
    model = toxicity.fit(docs, labels)
    got = registry.op1_toxicity(spark, sf).toPandas().sort_values("doc_id", ignore_index=True)
    assert model.weights and model == toxicity.fit(docs.repartition(5), labels)
    for (_, text), r in zip(texts, got.itertuples(), strict=True):
        clean, low = 1.0, (text or "").lower()
        for sentence in re.split(r"[.!?\n]+", low):
            words = re.findall(r"[^\W\d_]+", sentence)
            if words:
                z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in [w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) > n)])
                clean *= 1 - 1 / (1 + math.exp(-max(-30, min(30, z))))
        assert r.score == pytest.approx(1 - clean, abs=1e-9) and r.predicted == (r.score >= 0.5)
        spans = [tuple(map(int, s.split(":"))) for s in r.offending.split(",")] if r.offending else []
        assert all(0 <= a < b <= len(text) for a, b in spans) and (r.predicted or not spans)


def test_bpe_rows(spark, texts):
    from tokenizers import Tokenizer

    library = _open("byte_bpe_50k.json", Tokenizer)
    for (_, text), r in zip(texts, frame(spark, "op4_bpe").itertuples(), strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_toxicity_held_out(spark):
    rows = registry.queries()["op1_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    labels = duckdb.sql("SELECT doc_id, toxic FROM read_parquet('/root/testdata/sf0.1/labels.parquet')").df()
    held = rows[rows["held_out"]].merge(labels, on="doc_id")
    assert (held["predicted"] == held["toxic"]).mean() > 0.95
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"]]).all()
    assert rows["score"].between(0, 1).all()


def test_quality_keeps_good_documents(spark):
    rows = registry.queries()["op8_quality"](spark, "/root/testdata/sf0.1").toPandas()
    labels = duckdb.sql("SELECT doc_id, quality AS good FROM read_parquet('/root/testdata/sf0.1/labels.parquet')").df()
    rows["fold"] = [zlib.crc32(str(i).encode()) % 5 for i in rows["doc_id"]]
    known = rows.merge(labels, on="doc_id").query("not base_failed and fold == 0")  # the trees never see this fold
    assert known[known["good"] == 1]["kept"].mean() > 0.98 and known[known["good"] == 0]["kept"].mean() < 0.2
