"""Pictures as PNG files: a canvas of pixels, rectangles, text in a small font of its
own, and the file format (chunks of a checksum each around deflated rows)."""

from __future__ import annotations

import colorsys
import re
import struct
import unicodedata
import zlib
from pathlib import Path

import numpy as np

#: Letters 3 pixels wide and 5 high: a digit a row, whose bits are pixels from left to right.
FONT = {
    "A": "25755", "B": "65656", "C": "34443", "D": "65556", "E": "74647", "F": "74644", "G": "34553", "H": "55755", "I": "72227", "J": "11152", "K": "55655", "L": "44447", "M": "57755", "N": "65555", "O": "25552", "P": "65644", "Q": "25563", "R": "65655", "S": "34216", "T": "72222", "U": "55557", "V": "55552", "W": "55775", "X": "55255", "Y": "55222", "Z": "71247",
    "0": "75557", "1": "26227", "2": "61247", "3": "61216", "4": "55711", "5": "74616", "6": "34652", "7": "71222", "8": "25252", "9": "25316",
    " ": "00000", "-": "00700", ">": "42124", "<": "12421", "+": "02720", ".": "00002", ",": "00024", ":": "02020", "%": "51245", "/": "11244", "(": "24442", ")": "21112", "_": "00007", "?": "61202",
}
WHITE, BLACK, SILVER = (255, 255, 255), (0, 0, 0), (192, 192, 192)
_HSL = re.compile(r"hsl\((\d+),(\d+)%,(\d+)%\)")
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def rgb(color: str | tuple[int, int, int]) -> tuple[int, int, int]:
    """The bytes of a colour written as hsl(h,s%,l%); tuples are such already."""
    if isinstance(color, tuple):
        return color
    found = _HSL.fullmatch(color)
    if not found:
        return 128, 128, 128
    h, s, lightness = map(int, found.groups())
    return tuple(round(255 * c) for c in colorsys.hls_to_rgb(h / 360, lightness / 100, s / 100))


class Canvas:
    def __init__(self, width: int, height: int):
        self.pixels = np.full((height, width, 3), 255, dtype=np.uint8)

    def rectangle(self, x: float, y: float, width: float, height: float, color) -> None:
        """Whole pixels; what lies outside is cut off."""
        x, y, right, bottom = (max(0, round(v)) for v in (x, y, x + width, y + height))
        self.pixels[y:bottom, x:right] = rgb(color)

    def text(self, x: int, y: int, text: str, scale: int = 2, color=BLACK) -> None:
        """Capitals without accents; a character without a picture is a question mark."""
        plain = unicodedata.normalize("NFKD", text.replace("→", ">")).upper()
        for c in (c for c in plain if not unicodedata.combining(c)):
            for row, bits in enumerate(FONT.get(c, FONT["?"])):
                for column in range(3):
                    if int(bits) >> (2 - column) & 1:
                        self.rectangle(x + column * scale, y + row * scale, scale, scale, color)
            x += 4 * scale

    def encode(self) -> bytes:
        height, width, _ = self.pixels.shape

        def chunk(kind: bytes, data: bytes) -> bytes:
            return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

        rows = np.zeros((height, 1 + 3 * width), dtype=np.uint8)  # each begins with its filter, none
        rows[:, 1:] = self.pixels.reshape(height, -1)
        header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
        return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 9)) + chunk(b"IEND", b"")

    def write(self, path: str) -> None:
        Path(path).write_bytes(self.encode())
