"""Every operator on nulls, empty and long texts, ties, repeated rows, empty
tables and extra columns with clashing names."""

import hashlib
import importlib
import math
import time
import zlib

import pytest
from pyspark.sql import functions as F

from modetrace.llm import bloom_lm, bpe, maxscore, mixing, pii, quality, secret_scan, simhash, simple8b, toxicity

pipeline = importlib.import_module("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, fp long, size long, component_id string, spans string, kept boolean, Level string, row long, __row long, copies int, copy int, s0 long, `set` long, __size long"
LONG = " ".join(f"word{i % 997} mail{i}@host.org" for i in range(20_000))
PROSE = " ".join(f"a{i}x and b{i * 7 % 89} of" for i in range(60)) + "."
TEXTS = [None, "", " \n\t", "one", "one two", PROSE, PROSE, PROSE + " end", LONG, "idiot. " + PROSE, "​ ７ Ünï \x85 x", "<|endoftext|> a", "a\nb\na\nb\n"]
ROWS = [(None if i == 4 else min(i, 11), t, "en", (None, "s1", "s2")[i % 3], 0 if t is None else len(t), 0.5, "x", 1, 2, "c", "s", True, "l", 7, 7, 7, 7, 7, 7, 7) for i, t in enumerate(TEXTS)]
LABELS = [(i, int(i % 2), int(i in (9, 3))) for i in range(12)] + [(5, None, None), (None, 1, 1), (7, 0, 0), (7, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def _toxicity(docs, labels):
    return toxicity.verdicts(toxicity.score(docs, toxicity.fit(docs, labels)))


def _tokens(docs, labels):
    return simple8b.digests(simple8b.decode(docs.sparkSession, simple8b.encode(docs)))


QUERIES = {
    "op1": _toxicity,
    "op2": _tokens,
    "op3": lambda d, _: simhash.digests(simhash.components(d)),
    "op4": lambda d, _: bpe.digests(bpe.roundtrip(d)),
    "op5": lambda d, _: mixing.digests(mixing.mix(d)),
    "op7": lambda d, _: secret_scan.digests(secret_scan.find(d)),
    "op8": lambda d, lab: quality.digests(quality.judge(d, quality.fit(d, lab))),
    "op9": lambda d, _: bloom_lm.held_out_scores(d),
    "op10": lambda d, _: pii.digests(pii.find(d)),
}


@pytest.mark.parametrize("name", QUERIES)
def test_every_row_comes_back(docs, labels, nothing, name):
    rows = QUERIES[name](docs, labels).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)
    for r in rows:
        assert all(v is not None for k, v in r.asDict().items() if k not in ("doc_id", "component_id"))
    assert QUERIES[name](nothing, labels.where("false")).count() == 0


def test_stages_keep_columns(spark, docs, nothing, tmp_path):
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for start in (docs, nothing):
        now = start
        for name, stage in pipeline.STAGES[:-1]:
            before, now = now, stage(spark, now, str(tmp_path))
            assert now.columns == before.columns, name
            now = pipeline.materialise(now, name)
            assert now.where("row <> 7 OR __row <> 7 OR copies <> 7 OR copy <> 7 OR s0 <> 7 OR `set` <> 7 OR __size <> 7").count() == 0, name
        last = pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert last.count() == now.count()
    assert len(simhash.deduplicate(docs).where(F.col("text") == PROSE).collect()) == 1
    assert simhash.deduplicate(docs).where("text IS NULL OR text IN ('', ' \\n\\t')").count() == 1


def test_redaction_keeps_rows(docs):
    rows = {(r.doc_id, r.text is None): r for r in pii.redact(docs).collect()}
    assert len(rows) == len({(r[0], r[1] is None) for r in ROWS})
    long = rows[(8, False)]
    assert "@" not in long.text and long.n_chars == len(long.text) and rows[(0, True)].n_chars == 0


def test_mix_repeats_documents(docs):
    taken = mixing.digests(mixing.mix(docs))
    copies = sum(r.taken // r["size"] for r in taken.collect() if r["size"])
    assert mixing.mixed(docs).count() == copies
    assert sorted(map(tuple, taken.collect()), key=str) == sorted(map(tuple, mixing.digests(mixing.mix(docs)).collect()), key=str)


def test_vectors(spark):
    rows = [(0, [1.0, -0.5]), (0, [1.0, -0.5]), (50, [0.25, 0.25]), (1, [1.0, -0.5]), (2, [1.0, -0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (None, [1.0, 1.0]), (7, []), (8, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("x")).withColumn("score", F.lit(1))
    got = {}
    for r in maxscore.search_own(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got[0] == [(i, v, s) for i, (v, s) in enumerate([(0, 81920), (1, 81920), (2, 81920), (8, 65536), (50, 8192)], 1) for _ in range(2)]
    assert got[50][:3] == [(1, 8, 16384), (2, 0, 8192), (3, 0, 8192)]
    assert maxscore.search_own(df.where("false")).count() == 0


def test_a_score_beyond_bigint_is_an_error(spark):
    df = spark.createDataFrame([(0, [1.0, -0.5]), (9, [1e300, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="no BIGINT"):
        maxscore.search_own(df).collect()


def test_toxicity_locates(spark):
    rows = [("you are a moron. nice day", 1), ("what a moron he is. hello there", 1), ("nice day to all. hello there", 0), ("hello there. fine words", 0)] * 40
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5][: len(rows)]
    docs = spark.createDataFrame([(i, t + f" u{i}. v{i}") for i, (t, _) in zip(ids, rows, strict=True)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in zip(ids, rows, strict=True)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.weights["moron"] > 1 > model.weights.get("nice", 0.0)
    text = "Hello there. Such a MORON here! Nice day"
    found = {r.doc_id: r for r in toxicity.score(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), model).collect()}
    assert [text[s.start : s.end] for s in found[1].sentences] == ["Such a MORON here"] and found[2].sentences == [] == found[3].sentences
    # the noisy-or over sentences, written plainly
    clean = 1.0
    for sentence in ("hello there", "such a moron here", "nice day"):
        z = model.bias + sum(model.weights.get(f, 0.0) for w in sentence.split() for f in [w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) > n)])
        clean *= 1 - 1 / (1 + math.exp(-z))
    assert found[1].score == pytest.approx(1 - clean)


def test_bpe_encode_decode(docs):
    back = bpe.decode(bpe.encode(docs)).toPandas()
    assert sorted(back["text"]) == sorted(t or "" for t in TEXTS)
    assert bpe.digests(bpe.roundtrip(docs)).where(F.col("doc_id") == 1).first().ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_long_texts_are_located_in_linear_time():
    model = toxicity.Scorer(toxicity.Model(-3.0, {"idiot": 9.0}))
    text = " ".join(f"You are an idiot number {i}." for i in range(30_000))
    began = time.perf_counter()
    found = model.locate(text, 0.5)
    assert len(found) == 30_000 and text[found[7][0] : found[7][1]].startswith("You are an idiot")
    assert time.perf_counter() - began < 6


def test_folders_of_shards(spark, docs, tmp_path):
    place = simple8b.place_of(spark, str(tmp_path / "plain"))
    assert place == f"file://{tmp_path}/plain" == simple8b.place_of(spark, f"file:{tmp_path}/plain")
    shards = simple8b.encode(docs, folder=str(tmp_path / "plain"))
    assert all(f.startswith(place) for f, _, _ in shards)
    assert simple8b.decode(spark, shards).count() == docs.count()
    assert simple8b.place_of(spark, "s3a://bucket/a/b") == "s3://bucket/a/b"
    with pytest.raises(ValueError, match="can't be written"):
        simple8b.encode(docs, folder="ftp://host/a")
