"""Facts of image files from their headers, read a batch at a time."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StructType

# Markers of a JPEG frame that give its size, and those without a length.
_FRAMES = (0xC0, 0xC1, 0xC2, 0xC3)
_BARE = {0x01, *range(0xD0, 0xD9)}


def _jpeg(data: bytes) -> tuple[int, int] | None:
    """Segment by segment up to the frame header; the scan's data is never read."""
    at = 2
    while (at := data.find(b"\xff", at)) >= 0 and at + 4 <= len(data):
        marker = data[at + 1]
        if marker in (0xD9, 0xDA):
            return None
        if marker in _FRAMES:
            if at + 9 > len(data):
                return None
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height
        if marker == 0xFF:
            at += 1
        elif marker in _BARE or marker == 0:
            at += 2
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def size_of(data: bytes | None) -> tuple[int, int] | None:
    """Width and height of a PNG, GIF or JPEG file; None of anything else or a cut header."""
    if data is None or len(data) < 10:
        return None
    if data.startswith(b"\x89PNG\r\n\x1a\n") and data[12:16] == b"IHDR" and len(data) >= 24:
        return struct.unpack_from(">II", data, 16)
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack_from("<HH", data, 6)
    return _jpeg(data) if data[:2] == b"\xff\xd8" else None


@pandas_udf(StructType().add("width", IntegerType()).add("height", IntegerType()))
def image_size(content: pd.Series) -> pd.DataFrame:
    """struct(width, height), both null where the size can't be read."""
    sizes = [size_of(None if x is None else bytes(x)) or (None, None) for x in content]
    fits = [(w, h) if w is None or max(w, h) < 2**31 else (None, None) for w, h in sizes]
    return pd.DataFrame(fits, columns=["width", "height"], dtype="Int32")
