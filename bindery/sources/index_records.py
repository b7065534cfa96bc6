"""Index records: sorted terms as entries in records of bounded size, and back.

An entry is a length byte, the label, a control byte that says which tags follow, and the tags'
values as varints whose last byte has the stop bit. A record is a header, its entries, and a list of
their 16-bit offsets. A routing record holds the last label and the number of entries of each
data record, and the tag table, which is what a reader decodes entries by."""

from __future__ import annotations

import struct
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from ..functions.codecs import read_varint, varint
from ..operators.layout import greedy_pack

# The header's length, the longest label, the bound of a record's entries, and the tags of a term.
HEADER, LONGEST_LABEL, RECORD_LIMIT = 192, 254, 64_000
TERM_TAGS = [(1, 1, 1), (2, 1, 2)]  # start position, text length: tag, values, mask
NONE = 0xFFFFFFFF


def entry(label: bytes, values: dict[int, int], tags=TERM_TAGS) -> bytes:
    """A label of UTF-16 is never cut inside a unit, as the longest length is even, nor inside a pair of them."""
    if len(label) > LONGEST_LABEL:
        half = 0xD8 <= label[LONGEST_LABEL - 2] <= 0xDB
        label = label[: LONGEST_LABEL - 2 * half]
    present = [(tag, mask) for tag, _, mask in tags if tag in values]
    return bytes([len(label)]) + label + bytes([sum(m for _, m in present)]) + b"".join(varint(values[t]) for t, _ in present)


def parse_entry(data: bytes, at: int, tags=TERM_TAGS) -> tuple[bytes, dict[int, int]]:
    """The label and the tag values of the entry at a place, by a table of tags."""
    size = data[at]
    label, control, at = data[at + 1 : at + 1 + size], data[at + 1 + size], at + 2 + size
    values = {}
    for tag, _, mask in tags:
        if control & mask:
            values[tag], at = read_varint(data, at)
    return label, values


def tag_table(tags=TERM_TAGS) -> bytes:
    body = b"".join(bytes([*t, 0]) for t in tags) + b"\0\0\0\1"
    return b"TAGX" + struct.pack(">II", 12 + len(body), 1) + body


def parse_tag_table(data: bytes) -> list[tuple[int, int, int]]:
    at = data.index(b"TAGX")
    size = int.from_bytes(data[at + 4 : at + 8], "big")
    rows = [tuple(data[p : p + 4]) for p in range(at + 12, at + size, 4)]
    return [r[:3] for r in rows if not r[3]]


def record(entries: list[bytes], more: bytes = b"", generation: int = 1) -> bytes:
    """more stands between header and entries."""
    offsets, at = [], HEADER + len(more)
    for e in entries:
        offsets.append(at)
        at += len(e)
    if offsets and offsets[-1] > 0xFFFF:
        raise ValueError("entries of a record must begin within 16 bits")
    head = bytearray(HEADER)
    struct.pack_into(">4sIII", head, 0, b"INDX", HEADER, 0, generation)
    struct.pack_into(">IIII", head, 20, at, len(entries), NONE, NONE)
    out = bytes(head) + more + b"".join(entries) + b"IDXT" + b"".join(struct.pack(">H", o) for o in offsets)
    return out + b"\0" * (len(out) % 2)


def parse_record(data: bytes, tags=TERM_TAGS) -> list[tuple[bytes, dict[int, int]]]:
    at, n = struct.unpack_from(">II", data, 20)
    offsets = struct.unpack_from(f">{n}H", data, at + 4)
    return [parse_entry(data, o, tags) for o in offsets]


def routing(lasts: list[tuple[bytes, int]], tags=TERM_TAGS) -> bytes:
    """One entry for each data record: its last label and its number of entries."""
    return record([bytes([len(label[:LONGEST_LABEL])]) + label[:LONGEST_LABEL] + struct.pack(">H", n) for label, n in lasts], tag_table(tags), 0)


def parse_routing(data: bytes) -> list[tuple[bytes, int]]:
    at, n = struct.unpack_from(">II", data, 20)
    rows = []
    for o in struct.unpack_from(f">{n}H", data, at + 4):
        size = data[o]
        rows.append((data[o + 1 : o + 1 + size], int.from_bytes(data[o + 1 + size : o + 3 + size], "big")))
    return rows


@pandas_udf(BinaryType())
def term_entry(label: pd.Series, start: pd.Series, length: pd.Series) -> pd.Series:
    return pd.Series([entry(bytes(b), {1: int(s), 2: int(n)}) for b, s, n in zip(label, start, length)])


def _record(pdf: pd.DataFrame, by: str) -> pd.DataFrame:
    pdf = pdf.sort_values("index_ord")
    built = record([bytes(e) for e in pdf["entry"]])
    return pd.DataFrame({by: [pdf[by].iloc[0]], "bin": [pdf["bin"].iloc[0]], "n": [len(pdf)], "last_label": [bytes(pdf["bytes"].iloc[-1])], "record": [built]})


def index_records(terms: DataFrame, by: str = "pkg_id", limit: int = RECORD_LIMIT) -> DataFrame:
    """terms: by, label, index_ord, start_pos, text_len -> by, bin, n, last_label, record.

    A record's entries are a group of bounded size; only sizes are packed package by package."""
    label = F.encode("label", "UTF-16BE")
    built = terms.select(by, "index_ord", label.alias("bytes"), term_entry(label, F.col("start_pos"), F.col("text_len")).alias("entry"))
    sized = built.select(by, "index_ord", (F.octet_length("entry") + 2).cast("long").alias("size"))
    binned = greedy_pack(sized, "size", "index_ord", by, limit).select(by, "index_ord", "bin")
    kinds = f"{terms.select(by)._jdf.schema().toDDL()}, bin long, n long, last_label binary, record binary"
    return built.join(binned, [by, "index_ord"]).groupBy(by, "bin").applyInPandas(partial(_record, by=by), kinds)
