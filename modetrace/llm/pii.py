"""Personal data in texts, also in disguise.

Fixed patterns find e-mail and IP addresses, card and phone numbers. Then a
cascade of transducers rewrites the text: each look-alike character becomes the
ASCII one (those that Unicode's compatibility form or its digits tell, and a list
of Cyrillic, Greek and other letters), invisible ones go, spelled digits become
digits, and at/dot disguises become '@' and '.'. It keeps for each piece of its
output the source range it came from, the same patterns run over the output, and
each match is mapped back to source code points. A match within a base span of
its kind adds nothing.

At and dot in bare words are an address only together: 'name at host dot end',
in words of one language; the end must look like one (two letters or more), and
where the dots are signs, so that only 'at' speaks for an address, be of two
letters or a common one. 'at the ...' starts no host. The English 'at' with plain dots
('he works at example.com') needs a word for mail near it, and a name before it that is
no pronoun or verb of the list: prose stays, and a disguise without such a word is
missed.

Null and empty texts have no spans; ``redact`` leaves them as they are.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts, text_slices
from .spans import Span, Within, digests as span_digests, find_spans, in_order

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
DOTTED = re.compile(r"\.[0-9]+\.[0-9]")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = range(12, 20), range(9, 16)

# Characters that look like ASCII ones, and digits in words (en, de, fr, es).
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S",
    "ο": "o", "α": "a", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "․": ".", "。": ".", "﹒": ".", "•": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "\u00a0": " ", "\u2009": " ", "\u202f": " ", "﹢": "+",
}
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Fewer digits in a row than this are left as words.
RUN = 4

#: Where disguised ASCII characters are looked for: up to the end of the mathematical letters.
_REACH = 0x1D800


def _ascii_of(c: str) -> str | None:
    """What a character stands for: an ASCII one, nothing, or itself (None)."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    kind = unicodedata.category(c)
    if kind == "Cf":
        return ""
    if kind == "Nd":
        return str(unicodedata.digit(c))
    same = unicodedata.normalize("NFKC", c)
    return same if len(same) == 1 and " " <= same < "\x7f" else None


_STANDS_FOR = {c: to for c in map(chr, range(0x80, _REACH)) if (to := _ascii_of(c)) is not None}
_ONE_TO_ONE = str.maketrans({c: to for c, to in _STANDS_FOR.items() if to})
_INVISIBLE = re.compile("[" + re.escape("".join(c for c, to in _STANDS_FOR.items() if not to)) + "]+")
_DIGIT = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + "|[0-9])"
_SPELLED = re.compile(rf"(?<![^\W_]){_DIGIT}(?:[\x20,.-]{{1,2}}{_DIGIT}){{{RUN - 1},}}(?![^\W_])", re.IGNORECASE)
_DIGIT_PART = re.compile(_DIGIT, re.IGNORECASE)
_PLUS = re.compile(r"(?<![^\W_])plus\x20+(?=[0-9])", re.IGNORECASE)
_AT, _DOT = r"(?:at|ät|arobase|arroba|chez|@)", r"(?:dot|punkt|point|punto|\.)"
_BRACKETED_AT = re.compile(rf"[\[({{<]\x20*{_AT}\x20*[\])}}>]\x20*", re.IGNORECASE)
_BRACKETED_DOT = re.compile(rf"[\[({{<]\x20*{_DOT}\x20*[\])}}>]\x20*", re.IGNORECASE)
_BRACKET = re.compile(r"[\[({<]")
#: At in bare words, and the words for a dot that go with it.
_DOTS_OF = {"at": ("dot", "punkt"), "ät": ("dot", "punkt"), "arobase": ("dot", "point"), "arroba": ("dot", "punto")}
_SEPARATOR = re.compile(r"(?<=[A-Za-z0-9._%+-])(?:\x20+(at|ät|arobase|arroba)\x20+|_(at)_|\x20*@\x20*)(?=[A-Za-z0-9])", re.IGNORECASE)
_DOT_WORD = r"(?:\x20+(?:dot|punkt|point|punto)\x20+|_dot_)"
_HOST = re.compile(rf"([A-Za-z0-9-]+)((?:(?:{_DOT_WORD}|\.)[A-Za-z0-9-]+)+)", re.IGNORECASE)
_DOTS = re.compile(_DOT_WORD, re.IGNORECASE)
_DOT_WORDS = frozenset(("dot", "punkt", "point", "punto"))
_END = re.compile(r"(?:[A-Za-z]{2,}|xn--[A-Za-z0-9-]+)\Z")
# Common ends of addresses, and words that follow 'at' in prose.
COMMON_ENDS = frozenset("com org net edu gov mil int info biz name dev app pro museum jobs mobi travel online site shop blog cloud email".split())
#: With 'at' and plain dots only: how near a word for mail must be, words that are no name there, and ends of files.
NEAR = 60
_MAIL = re.compile(r"(?<![^\W_])(?:e-?mails?|mails?|mailto|contact|write|reach|address|inbox|gmail|kontakt|schreib|mailadresse|adresse|courriel|écri|ecri|contacter|correo|escrib|contacto|dirección)", re.IGNORECASE)
NO_NAME = frozenset("i me you he him she her it we us they them one who that this these those and or but not is am are was were be been being do does did work works worked working look looks looked looking meet meets met stay stays stayed live lives lived visit visits visited arrive arrives arrived sit sits sat find found shop shops buy bought read reads see seen call calls called only also now here there all both available online hosted held sold based".split())
FILE_ENDS = frozenset("py sh rs md js ts rb cs go pl cc hh mm vb".split())
NO_HOST = frozenset("a an the this that these those his her its my your our their some any each every no which what one".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, '@' and dotted domain. Neither part can
    hold an '@', so each '@' decides alone, from the run before it."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            floor = m.end()
            found.append((start, floor))
        else:
            floor = at + 1
        at = text.find("@", floor)
    return found


def identifiers(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, kind by kind."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DOTTED.search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS[0] and len(d := _digits(m.group())) in CARD_DIGITS and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if len(_digits(m.group())) in PHONE_DIGITS]
    return found


class Rewritten:
    """A text with pieces replaced, and where in the source each piece was.

    ``at`` and ``source`` hold, for each piece of the output, where it starts
    and the source range it stands for; a piece that was copied maps character
    by character, a replaced one as a whole.
    """

    def __init__(self, text: str):
        self.text, self.at, self.source = text, [0], [(0, len(text), True)]

    def back(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        a, _, same = self.source[i]
        first = a + start - self.at[i] if same else a
        a, b, same = self.source[j]
        return first, a + end - self.at[j] if same else b

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply edits (start, end, new), in order and disjoint."""
        if not edits:
            return
        parts, at, source, size, done = [], [], [], 0, 0

        def copy(a: int, b: int) -> None:
            nonlocal size
            k = bisect_right(self.at, a) - 1
            while a < b:
                stop = min(b, self.at[k + 1] if k + 1 < len(self.at) else len(self.text))
                if stop > a:
                    s, e, same = self.source[k]
                    at.append(size)
                    source.append((s + a - self.at[k], s + stop - self.at[k], True) if same else (s, e, False))
                    size += stop - a
                a, k = stop, k + 1

        for a, b, new in edits:
            copy(done, a)
            parts += [self.text[done:a], new]
            if new:
                at.append(size)
                source.append((*self.back(a, b), False))
                size += len(new)
            done = b
        copy(done, len(self.text))
        parts.append(self.text[done:])
        self.text, self.at, self.source = "".join(parts), at or [0], source or [(0, 0, True)]


def _back(text: str, at: int, floor: int, inside) -> int:
    while at > floor and inside(text[at - 1]):
        at -= 1
    return at


def _bracketed(pattern: re.Pattern, text: str, new: str) -> list[tuple[int, int, str]]:
    """Edits of a sign in brackets, with the spaces around it."""
    edits, floor = [], 0
    for m in pattern.finditer(text):
        edits.append((_back(text, m.start(), floor, " ".__eq__), m.end(), new))
        floor = m.end()
    return edits


def _in_prose(text: str, start: int, end: int, host: str) -> bool:
    """Whether 'word at host.end' with a plain dot is prose: no word for mail is
    near, the word before 'at' is one that prose has there, or the host is a file."""
    if text[start:end].lower() in NO_NAME or host.count(".") == 1 and host.rsplit(".", 1)[1].lower() in FILE_ENDS:
        return True
    return not _MAIL.search(text, max(0, start - NEAR), start) and not _MAIL.search(text, end, end + NEAR)


def _local_start(text: str, end: int, floor: int) -> tuple[int, list[tuple[int, int]]]:
    """Where the local part that ends at ``end`` starts, and its dots in words."""
    start, dots = _back(text, end, floor, _LOCAL.__contains__), []
    while True:
        space = _back(text, start, floor, " ".__eq__)
        word = _back(text, space, floor, str.isalpha)
        before = _back(text, word, floor, " ".__eq__)
        if not before < word < space < start or text[word:space].lower() not in _DOT_WORDS or before == floor or text[before - 1] not in _LOCAL:
            return start, dots[::-1]
        dots.append((before, start))
        start = _back(text, before, floor, _LOCAL.__contains__)


def _addresses_in_words(text: str) -> list[tuple[int, int, str]]:
    """Edits that turn addresses in bare words into plain ones."""
    edits, floor = [], 0
    for m in _SEPARATOR.finditer(text):
        if m.start() < floor or not (host := _HOST.match(text, m.end())):
            continue
        word = (m.group(1) or m.group(2) or "").lower()
        dots = [(d.start(), d.end()) for d in _DOTS.finditer(text, host.start(2), host.end(2))]
        names = {text[a:b].strip(" _").lower() for a, b in dots}
        end = re.split(r"[\x20._]", host.group(2))[-1]
        if not _END.search(end) or word and not names <= set(_DOTS_OF[word]):
            continue
        if word and not m.group(2):
            if host.group(1).lower() in NO_HOST or not dots and not (end.islower() and (len(end) == 2 or end in COMMON_ENDS)):
                continue
        start, before = _local_start(text, m.start(), floor)
        if word == "at" and not m.group(2) and not dots and not before and _in_prose(text, start, m.start(), host.group()):
            continue
        if start == m.start() or m.group() == "@" and not dots and not before:
            continue
        edits += [(a, b, ".") for a, b in before] + [(*m.span(), "@")] + [(a, b, ".") for a, b in dots]
        floor = host.end()
    return edits


def rewrite(text: str) -> Rewritten | None:
    """The text without its disguises, or None if it has none."""
    out = Rewritten(text)
    if not text.isascii():
        out.text = text.translate(_ONE_TO_ONE)  # one for one, so that places stay
        out.replace([(*m.span(), "") for m in _INVISIBLE.finditer(out.text)])
    out.replace([(*m.span(), "".join(DIGIT_WORDS.get(p.lower(), p) for p in _DIGIT_PART.findall(m.group()))) for m in _SPELLED.finditer(out.text) if any(c.isalpha() for c in m.group())])
    out.replace([(*m.span(), "+") for m in _PLUS.finditer(out.text)])
    if _BRACKET.search(out.text):
        out.replace(_bracketed(_BRACKETED_AT, out.text, "@"))
        out.replace(_bracketed(_BRACKETED_DOT, out.text, "."))
    out.replace(_addresses_in_words(out.text))
    return out if out.text != text else None


def find_in(text: str) -> list[Span]:
    base = identifiers(text)
    found: list[Span] = [(k, a, b, True) for k, a, b in base]
    clear = rewrite(text)
    if clear is not None:
        known = Within(base)
        for kind, a, b in identifiers(clear.text):
            a, b = clear.back(a, b)
            if not known(kind, a, b):
                found.append((kind, a, b, False))
    return in_order(found, KINDS) if len(found) > 1 else found


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every text."""
    return find_spans(docs, lambda: find_in)


def digests(rows: DataFrame) -> DataFrame:
    return span_digests(rows, list(KINDS))


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind."""
    out, done = [], 0
    for kind, a, b, _ in spans:
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every identifier in ``text`` masked and ``n_chars``, where
    there is such a column, counted anew; all rows and columns stay."""
    schema = docs.schema

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                old = part.column("text").to_pylist()
                new = [mask(t, find_in(t)) if t else t for t in old]
                for name, values in (("text", new), ("n_chars", [None if t is None else len(t) for t in new])):
                    i = part.schema.get_field_index(name)
                    if i >= 0:
                        field = part.schema.field(i)
                        keep = part.column(i).to_pylist() if name == "n_chars" else old
                        values = [v if a != b else k for v, a, b, k in zip(values, old, new, keep, strict=True)]
                        part = part.set_column(i, field, pa.array(values, field.type))
                yield part

    return docs.mapInArrow(run, schema)
