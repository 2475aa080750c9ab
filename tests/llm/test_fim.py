"""Fill-in-the-middle against the pattern itself, SQL and an exact round trip."""

import hashlib
import re
import time

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from modetrace.llm import fim
from modetrace.llm.registry import op13_fim, oracle_sql

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]")
SF = "/root/testdata/sf0.01"
TEXT = st.text(alphabet="abZ <PSM>é\n9▁\U0001f600", max_size=60)


def plainly(text, doc_id, seed=1):
    """The contract's words, one by one."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = UNITS.findall(text)
    n = len(units)
    if not text or re.search("<P>|<S>|<M>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(TEXT)
def test_starts_and_ranks(text):
    bits, at, starts = fim.unit_starts(text), 0, []
    for unit in UNITS.findall(text):
        starts.append(at)
        at += len(unit)
    assert [i for i in range(len(text)) if bits >> i & 1] == starts
    assert [fim.ranked_bit(bits, k, len(text)) for k in range(len(starts))] == starts


@given(TEXT, st.one_of(st.none(), st.integers(-5, 10**12)))
def test_cut_by_the_contract(text, doc_id):
    n, form, p, m = fim.cut(text, doc_id, 1)
    output = fim.assemble(text, form, p, m)
    assert (n, form, *((None, None) if form == "plain" else (p, m - p)), output) == plainly(text, doc_id)
    assert fim.rebuild(output, form) == text


def test_all_forms_come_up():
    forms = {fim.cut("a b c d e f", i, 1)[1] for i in range(200)}
    assert forms == {"plain", "psm", "spm"}


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got, want = op13_fim(spark, SF).toPandas(), con.sql(oracle_sql()["op13_fim"]).df()
    assert len(got) == len(want) > 900
    key = ["doc_id", "output_sha256"]
    got, want = (x[sorted(want.columns)].sort_values(key).reset_index(drop=True) for x in (got, want))
    for c in want.columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_rows_of_any_kind(spark):
    rows = [(None, "a b"), (1, None), (1, ""), (2, "x <M> y"), (3, "é😀 abc" * 9), (3, "é😀 abc" * 9), (4, "Z" * 300_000 + " é" * 200_000)]
    df = spark.createDataFrame([(*r, "out", 7) for r in rows], "doc_id long, text string, output string, n long")
    got = fim.restore(fim.transform(df)).collect()
    assert sorted((str(r.doc_id), r.restored) for r in got) == sorted((str(i), t or "") for i, t in rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly(r.restored, r.doc_id)
    assert fim.digests(fim.restore(fim.transform(df.where("false")))).count() == 0


@pytest.mark.parametrize("text", ["a" * 4_000_000, "é " * 2_000_000])
def test_time_grows_with_the_text(text):
    began = time.perf_counter()
    n, form, p, m = fim.cut(text, 7, 1)
    assert fim.rebuild(fim.assemble(text, form, p, m), form) == text
    assert time.perf_counter() - began < 2
