"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, and put
together with sentinels so that a model learns to write the middle.

The units of a cut are runs of A-Z and a-z, and every other character by itself.
Where they begin is found for a whole text at once: ``bytes.translate`` turns its
characters into a mask of letters, which is read as one big integer; shifting it by
one and boolean operations mark the first character of each unit, ``bit_count`` is
the number of units, and the place of the k-th of them is found by halving the
integer again and again, which takes time in proportion to the text.

Two of the hash's numbers are the cuts, a third decides whether a text stays plain,
and a fourth the order: psm (prefix, suffix, middle) or spm (suffix, prefix, middle).
Texts that hold a sentinel, and empty ones, stay plain. A null text is an empty
text. The numbers depend on doc_id alone, a null one is hashed as an empty string:
rows that repeat an id are cut by the same numbers, each in its own text.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100: documents that change form, and of these the ones with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
_LETTERS = bytes(0x31 if 65 <= b <= 90 or 97 <= b <= 122 else 0x30 for b in range(256))


def unit_starts(text: str) -> int:
    """An integer whose bit i is set if a unit begins at character i."""
    if not text:
        return 0
    mask = text.encode("ascii", "replace").translate(_LETTERS)  # one byte a code point
    letters = int(mask[::-1], 2)
    return ((1 << len(text)) - 1) & ~(letters & letters << 1)


def ranked_bit(bits: int, rank: int, width: int) -> int:
    """The place of the set bit that has ``rank`` set bits below it."""
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & (1 << half) - 1
        below = low.bit_count()
        if rank < below:
            bits, width = low, half
        else:
            bits, width, rank, at = bits >> half, width - half, rank - below, at + half
    return at


def numbers(doc_id: int | None, seed: int) -> list[int]:
    """The first four 8-digit groups of the hash of a document's id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def cut(text: str, doc_id: int | None, seed: int) -> tuple[int, str, int, int]:
    """(n, form, where the prefix ends, where the middle ends); the ends are in
    code points and 0 for a plain text."""
    starts = unit_starts(text)
    n = starts.bit_count()
    h1, h2, h3, h4 = numbers(doc_id, seed)
    if not text or h3 % 100 >= TRANSFORMED or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", 0, 0
    ends = [ranked_bit(starts, k, len(text)) if k < n else len(text) for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
    return n, "spm" if h4 % 100 < SUFFIX_FIRST else "psm", *ends


def assemble(text: str, form: str, prefix_end: int, middle_end: int) -> str:
    if form == "plain":
        return text
    prefix, middle, suffix = text[:prefix_end], text[prefix_end:middle_end], text[middle_end:]
    first = f"{PREFIX}{prefix}{SUFFIX}{suffix}" if form == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}"
    return f"{first}{MIDDLE}{middle}"


def rebuild(output: str, form: str) -> str:
    """The text of an output. No part of a text holds a sentinel, and none begins
    inside one, so the first of each is where the parts meet."""
    if form == "plain":
        return output
    first, middle = output.split(MIDDLE, 1)
    if form == "psm":
        prefix, suffix = first[len(PREFIX) :].split(SUFFIX, 1)
    else:
        suffix, prefix = first[len(SUFFIX) :].split(PREFIX, 1)
    return prefix + middle + suffix


def transform(docs: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document;
    the two lengths are null where the form is plain."""

    def make():
        def work(b):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                n, form, p, m = cut(text, doc_id, seed)
                rows.append((n, form, *((None, None) if form == "plain" else (p, m - p)), assemble(text, form, p, m)))
            return {"doc_id": b.column("doc_id").cast(pa.int64())} | dict(zip(("n", "form", "prefix_chars", "middle_chars", "output"), ([r[i] for r in rows] for i in range(5)), strict=True))

        return work

    return map_text(docs, ["doc_id", "text"], "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", make)


def restore(rows: DataFrame) -> DataFrame:
    """The rows of ``transform`` with ``restored``, rebuilt from output and form alone."""
    fields = rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")

    def run(batches):
        for b in batches:
            restored = [rebuild(o, f) for o, f in zip(b.column("output").to_pylist(), b.column("form").to_pylist(), strict=True)]
            yield b.append_column("restored", pa.array(restored, pa.string()))

    return fields.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in fields.schema)}, restored string")


def digests(rows: DataFrame) -> DataFrame:
    """The rows of ``restore`` with hashes in place of the two texts."""
    return rows.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        *(F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")),
    )


def _number(i: int) -> str:
    return f"CAST('0x' || substr(h, {1 + 8 * i}, 8) AS UBIGINT)"


#: The same rows, with the units as a list of strings.
ORACLE_SQL = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents
), cuts AS (
  SELECT *, len(units) AS n, CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {_number(2)} % 100 >= {TRANSFORMED} THEN 'plain'
         WHEN {_number(3)} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form,
         CAST(least({_number(0)} % (len(units) + 1), {_number(1)} % (len(units) + 1)) AS BIGINT) AS k1,
         CAST(greatest({_number(0)} % (len(units) + 1), {_number(1)} % (len(units) + 1)) AS BIGINT) AS k2 FROM hashed
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(units[:k1], '') AS p, array_to_string(units[k1 + 1:k2], '') AS m, array_to_string(units[k2 + 1:], '') AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
