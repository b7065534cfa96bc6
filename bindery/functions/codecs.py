"""Byte codecs and hashes that no built-in has. Each has a vectorised function for columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StringType

# The parameters of FNV-1a with 64 bits.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
RECORD = 4096


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def seeded_uuid(seed: str) -> str:
    """A version 4 identifier: the hash of the bytes, then that of the bytes turned round."""
    raw = seed.encode()
    b = bytearray(fnv1a(raw).to_bytes(8, "big") + fnv1a(raw[::-1]).to_bytes(8, "big"))
    b[6], b[8] = b[6] & 0x0F | 0x40, b[8] & 0x3F | 0x80
    h = b.hex()
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


def varint(n: int, stop_first: bool = False) -> bytes:
    """Groups of seven bits, the highest first; the stop bit is on the last byte, or on the first one."""
    groups = [n & 0x7F]
    while n := n >> 7:
        groups.append(n & 0x7F)
    groups.reverse()
    groups[0 if stop_first else -1] |= 0x80
    return bytes(groups)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The number of a forward varint, and where the next one begins."""
    n = 0
    while True:
        b = data[at]
        n, at = n << 7 | b & 0x7F, at + 1
        if b & 0x80:
            return n, at


def compress(data: bytes, window: int = 2047, longest: int = 10) -> bytes:
    """LZ77 of one record: runs of literals, matches of 3 to 10 bytes, and a space joined to a letter."""
    out, literals, seen, k = bytearray(), bytearray(), {}, 0

    def flush():
        for a in range(0, len(literals), 8):
            part = literals[a : a + 8]
            if all(b == 0 or 9 <= b <= 0x7F for b in part):
                out.extend(part)
            else:
                out.append(len(part))
                out.extend(part)
        literals.clear()

    while k < len(data):
        best, where = 0, 0
        for p in reversed(seen.get(data[k : k + 3], ())[-64:]):
            if k - p > window:
                break
            n = 3
            while n < longest and k + n < len(data) and data[p + n] == data[k + n]:
                n += 1
            if n > best:
                best, where = n, p
        if best >= 3:
            flush()
            code = 0x8000 | (k - where) << 3 | best - 3
            out += code.to_bytes(2, "big")
            step = best
        elif data[k] == 0x20 and k + 1 < len(data) and 0x40 <= data[k + 1] <= 0x7F:
            flush()
            out.append(data[k + 1] ^ 0x80)
            step = 2
        else:
            literals.append(data[k])
            step = 1
        for p in range(k, k + step):
            seen.setdefault(data[p : p + 3], []).append(p)
        k += step
    flush()
    return bytes(out)


def decompress(data: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(data):
        b = data[k]
        k += 1
        if 1 <= b <= 8:
            out += data[k : k + b]
            k += b
        elif b < 0x80:
            out.append(b)
        elif b >= 0xC0:
            out += bytes((0x20, b ^ 0x80))
        else:
            code = b << 8 | data[k]
            k += 1
            distance, length = code >> 3 & 0x7FF, (code & 7) + 3
            for _ in range(length):
                out.append(out[-distance])
    return bytes(out)


def numeric_entities(text: str) -> str:
    """Hexadecimal, then decimal character references; those of no character stay."""
    import re

    def put(base):
        def one(m):
            n = int(m[1], base)
            return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]

        return one

    return re.sub(r"&#([0-9]+);", put(10), re.sub(r"&#[xX]([0-9a-fA-F]+);", put(16), text))


@pandas_udf(StringType())
def fnv1a_hex(x: pd.Series) -> pd.Series:
    """FNV-1a of each text's UTF-8, in hexadecimal: all rows of a batch advance byte by byte together."""
    raw = [None if v is None else v.encode() for v in x]
    h = np.full(len(raw), FNV_OFFSET, np.uint64)
    lengths = np.array([-1 if r is None else len(r) for r in raw])
    order = np.argsort(-lengths, kind="stable")
    for at in range(int(lengths.max(initial=0))):
        live = order[: int((lengths > at).sum())]
        bytes_ = np.fromiter((raw[k][at] for k in live), np.uint64, len(live))
        h[live] = (h[live] ^ bytes_) * np.uint64(FNV_PRIME)
    return pd.Series([None if r is None else f"{v:016x}" for r, v in zip(raw, h.tolist())])


@pandas_udf(StringType())
def uuid_of(x: pd.Series) -> pd.Series:
    return x.map(seeded_uuid, na_action="ignore")


@pandas_udf(BinaryType())
def varint_of(x: pd.Series) -> pd.Series:
    return x.map(lambda n: varint(int(n)), na_action="ignore")


@pandas_udf(BinaryType())
def compressed(x: pd.Series) -> pd.Series:
    return x.map(lambda b: compress(bytes(b)), na_action="ignore")


@pandas_udf(BinaryType())
def decompressed(x: pd.Series) -> pd.Series:
    return x.map(lambda b: decompress(bytes(b)), na_action="ignore")


@pandas_udf(StringType())
def unescape_numeric(x: pd.Series) -> pd.Series:
    return x.map(numeric_entities, na_action="ignore")
