"""Secrets in texts: fixed patterns, and random strings by token efficiency.

A BPE vocabulary is learnt from prose and code, so it spells a random string
with few characters a token and a word with many. A run of 16 key characters or
more, without the ordinary words, numbers and identifiers that a path or a prefix puts
at its ends, is a secret of kind ``random`` if it has at most ``MAX_RATIO`` characters a
token (``MAX_RATIO_WORD`` if it could be a word, all small letters; below 20 characters
``MAX_RATIO_SHORT``, and no word), once known digests (hexadecimal of a digest's length,
UUIDs), numbers and identifiers (several words joined by separators or by case) are put
aside. A run within a
span of the fixed patterns adds nothing; one that reaches beyond it does. Null
and empty texts have no spans.
"""

from __future__ import annotations

import base64
import functools
import re

from pyspark.sql import DataFrame

from .common import Memo, tokenizer_path
from .spans import Span, Within, digests as span_digests, find_spans, in_order

KINDS = ("assign", "access", "hex", "random")
# The patterns, each keyword letter in either case, and the least lengths.
_WORDS = ("password", "passwd", "secret", "token")
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in _WORDS) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = re.compile(rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}+={0,2}")
VERSION = re.compile(r"[A-Za-z]{1,3}[0-9]{1,2}")
_BETWEEN = re.compile(r"[/_-]+")
HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Words of an identifier: letters of one case (a first capital aside), and short numbers.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
MAX_RATIO, MAX_RATIO_WORD = 2.05, 1.9
#: Runs of fewer characters than LONG must be less efficient; an ordinary word is more efficient than WORD_RATIO.
LONG, SHORT, MAX_RATIO_SHORT, WORD_RATIO = 20, 16, 1.8, 2.3


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_known(run: str) -> bool:
    """Digests, UUIDs, numbers and identifiers are no secrets of themselves."""
    if HEXADECIMAL.fullmatch(run) and len(run) in DIGEST_LENGTHS or UUID.fullmatch(run):
        return True
    body = run.strip("=")
    pieces = [x for x in re.split(r"[_/+=-]+", body) if x]
    if all(x.isdigit() for x in pieces):
        return True
    # an identifier is made of several parts, few for its length: of four letters or more on average
    parts = [p for x in pieces for p in PART.findall(x)]
    plain = all(x.isalpha() or x.isdigit() for x in pieces)
    return plain and len(parts) > 1 and len("".join(parts)) >= 4 * len(parts)


class SecretFinder:
    def __init__(self, path: str, max_ratio: float = MAX_RATIO):
        self.encoding, self.max_ratio = _encoding(path), max_ratio
        self.max_ratio_word = min(max_ratio, MAX_RATIO_WORD)
        self.ratios = Memo(lambda run: len(run) / max(1, len(self.encoding.encode_ordinary(run))), 20_000)

    def is_random(self, run: str) -> bool:
        word = run.isalpha() and (run.islower() or run[1:].islower())
        if len(run.rstrip("=")) < LONG:
            return not word and not is_known(run) and self.ratios[run] <= min(self.max_ratio, MAX_RATIO_SHORT)
        return not is_known(run) and self.ratios[run] <= (self.max_ratio_word if word and run.islower() else self.max_ratio)

    def is_ordinary(self, piece: str) -> bool:
        """A word, a number, a short name or an identifier, as paths and prefixes have."""
        if piece.isdigit() or VERSION.fullmatch(piece) or len(piece) <= 4 and piece.isalpha() and PART.fullmatch(piece):
            return True
        return piece.isalpha() and (is_known(piece) or bool(PART.fullmatch(piece)) and self.ratios[piece] > WORD_RATIO)

    def bare(self, run: str) -> tuple[int, int]:
        """Where a run begins and ends without ordinary pieces at its ends: a key in
        a path or behind a prefix is judged, and marked, by itself."""
        pieces, a, b = [], 0, len(run)
        for m in _BETWEEN.finditer(run):
            pieces.append((a, m.start()))
            a = m.end()
        pieces.append((a, b))
        first, last = self.ordinary(run, pieces), len(pieces) - self.ordinary(run, pieces[::-1])
        return (pieces[first][0] if first else 0, pieces[last - 1][1] if last < len(pieces) else b) if first < last else (0, 0)

    def ordinary(self, run: str, pieces: list[tuple[int, int]]) -> int:
        """How many pieces from an end are ordinary. A random key may begin with a
        letter and a dash, so short ones alone count only in a path, or as several."""
        n = named = 0
        for x, y in pieces:
            if x < y and not self.is_ordinary(run[x:y]):
                break
            n, named = n + 1, named + (y - x > 1) + (y - x > 3)
        if n and named < 2:
            return int(pieces[0][0] == pieces[0][1] and run[:1] == "/" and pieces[0][0] == 0)
        return n

    def base(self, text: str) -> list[Span]:
        found: list[Span] = []
        if "=" in text or ":" in text:
            found += [("assign", m.start(), m.end(), True) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
        if "AKIA" in text:
            found += [("access", m.start(), m.end(), True) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
        found += [("hex", m.start(), m.end(), True) for m in HEX.finditer(text)]
        return found

    def __call__(self, text: str) -> list[Span]:
        found = self.base(text)
        taken = Within([("", a, b) for _, a, b, _ in found])
        for m in CANDIDATE.finditer(text):
            a, b = self.bare(m.group())
            if is_known(m.group()) or any(u.start() <= a and b <= u.end() for u in UUID.finditer(m.group())):
                continue
            run = m.group()[a:b]
            a, b = m.start() + a, m.start() + b
            if len(run) >= SHORT and not taken("", a, b) and self.is_random(run):
                found.append(("random", a, b, False))
        return in_order(found, KINDS) if len(found) > 1 else found


def find(docs: DataFrame, path: str | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """(doc_id, spans) of every text."""
    return find_spans(docs, lambda: SecretFinder(path or tokenizer_path("byte_bpe_50k.tiktoken"), max_ratio))


def digests(rows: DataFrame) -> DataFrame:
    return span_digests(rows, ["assign", "access", "hex"])
