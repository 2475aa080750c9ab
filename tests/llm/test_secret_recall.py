"""Random keys by alphabet and length, clean text, and the query's rows."""

import hashlib
import random
import re
import string
import time

import duckdb
import pytest

from modetrace.llm import common, registry, secret_scan

ALPHABETS = {
    "lower": string.ascii_lowercase,
    "upper": string.ascii_uppercase,
    "letters": string.ascii_letters,
    "lower and digits": string.ascii_lowercase + string.digits,
    "upper and digits": string.ascii_uppercase + string.digits,
    "alphanumeric": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "+/",
    "base64url": string.ascii_letters + string.digits + "-_",
    "base32": string.ascii_uppercase + "234567",
}
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


@pytest.fixture(scope="module")
def finder():
    return secret_scan.SecretFinder(common.tokenizer_path("byte_bpe_50k.tiktoken"))


@pytest.mark.parametrize("alphabet", ALPHABETS)
@pytest.mark.parametrize("length", [20, 24, 32, 40, 64])
def test_recall(finder, alphabet, length):
    rng = random.Random(f"{alphabet} {length}")
    found = 0
    for _ in range(300):
        key = "".join(rng.choice(ALPHABETS[alphabet]) for _ in range(length))
        text = f"the key is {key} and that is all"
        found += any(kind == "random" and text[a:b] == key for kind, a, b, _ in finder(text)) or any(base for *_, base in finder(text))
    assert found >= 0.9 * 300


def test_a_key_around_a_base_span_is_whole(finder):
    key = "Zq8X" + "0123456789abcdef" + "XwPt7LmN9vKcRb3Hs5Gd" + "Jf"
    text = f"use {key} now"
    assert [(k, text[a:b]) for k, a, b, _ in finder(text)] == [("random", key), ("hex", "0123456789abcdef")]
    assert [s[0] for s in finder("token=q8Zt3LxV0bN7mKpR2sYwE4uH")] == ["assign"]


def test_clean_text_has_none(finder):
    for text in (
        "incomprehensibilities internationalization counterrevolutionaries Donaudampfschifffahrtsgesellschaft",
        "src/main/java/org/example/service/UserAccountServiceImplementation and https://example.org/a/long/path/to/page",
        "MAX_NUMBER_OF_RETRIES_ALLOWED = get_user_account_by_identifier(accountIdentifierForLookup)",
        "----------------------------------------- ======================= ____________________________",
        "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa 12345678901234567890123 2024-01-01_12-30-00-123456",
        "D41D8CD98F00B204E9800998ECF8427E 550e8400-e29b-41d4-a716-446655440000",
    ):
        assert [s for s in finder(text) if s[0] == "random"] == [], text


def test_rows_of_the_query(spark, finder):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in registry.op7_secrets(spark, sf).collect()}
    texts = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM read_parquet('{sf}/documents.parquet')").fetchall()
    assert len(rows) == len(texts)
    extra = 0
    for doc_id, text in texts:
        base = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
        base += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
        base += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
        base.sort(key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
        r = rows[doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, *_ in base) for kind in ("assign", "access", "hex"))
        joined = ["%s:%d:%d" % s for s in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("random")] == joined
        extra += len(spans) - len(joined)
    assert extra < 0.01 * len(texts)  # clean documents are left alone


CONTEXTS = {
    "prose": "the key is {} and that is all",
    "path": "see /var/lib/service/configuration/{}/readme for it",
    "prefix": "use my-service-production-key-{} today",
    "path and prefix": "in /srv/data/my-service-key-{}/latest now",
    "url": "https://api.example.com/v1/customers/{}/orders?page=2",
    "name": "export SERVICE_ACCOUNT_{}",
}


@pytest.mark.parametrize("context", CONTEXTS)
@pytest.mark.parametrize(("alphabet", "length"), [("alphanumeric", 16), ("alphanumeric", 18), ("alphanumeric", 24), ("base32", 19), ("lower and digits", 24), ("upper and digits", 40)])
def test_exact_spans_in_context(finder, context, alphabet, length):
    rng, found = random.Random(f"{context} {alphabet} {length}"), 0
    for _ in range(300):
        key = "".join(rng.choice(ALPHABETS[alphabet]) for _ in range(length))
        text = CONTEXTS[context].format(key)
        found += [text[a:b] for kind, a, b, base in finder(text) if not base] == [key] or any(base for *_, base in finder(text))
    assert found >= 0.9 * 300


def test_contexts_alone_have_none(finder):
    words = "quarterly report archive settings-backup user_profile_images CustomerAccount v2 2024-01-31 index".split()
    rng = random.Random(9)
    for context in CONTEXTS.values():
        for _ in range(200):
            text = context.format("/".join(rng.choice(words) for _ in range(rng.randint(1, 5))))
            assert finder(text) == [], text


def test_many_spans_take_linear_time(finder):
    text = " ".join(f"token={i:012d}abcdefg /usr/share/Zq8XwPt7LmN9vKcRb3{i:05d}" for i in range(20_000))
    began = time.perf_counter()
    assert len(finder(text)) >= 40_000
    assert time.perf_counter() - began < 6
