"""Record containers: reading, writing, metadata records and checks of the layout.

A container has a header of 78 bytes, with its name in the first 32 and the number of records at
byte 76, then 8 bytes for each record (offset and attributes), 2 bytes, and the records."""

from __future__ import annotations

import struct
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADER, ENTRY, PAD = 78, 8, 2
NAME_BYTES = 31


def container_name(title: str) -> bytes:
    """The name field: ASCII letters, digits and underscores of a title, cut to 31 bytes."""
    kept = "".join(c if c.isascii() and (c.isalnum() or c in "-_") else "_" for c in title)
    return kept.encode()[:NAME_BYTES].ljust(32, b"\0")


def build(title: str, records: list[bytes], kind: bytes = b"BOOKMOBI", stamp: int = 0) -> bytes:
    offsets, at = [], HEADER + ENTRY * len(records) + PAD
    for r in records:
        offsets.append(at)
        at += len(r)
    head = container_name(title) + struct.pack(">HHIIIIII", 0, 0, stamp, stamp, 0, 0, 0, 0) + kind + struct.pack(">IIH", 2 * len(records) - 1 if records else 0, 0, len(records))
    table = b"".join(struct.pack(">II", o, 2 * k) for k, o in enumerate(offsets))
    return head + table + b"\0" * PAD + b"".join(records)


def parse(data: bytes) -> list[tuple[int, int, bytes]]:
    """(number, offset, bytes) of each record; offsets beyond the file end it."""
    if len(data) < HEADER:
        return []
    n = int.from_bytes(data[76:78], "big")
    offsets = [int.from_bytes(data[HEADER + ENTRY * k : HEADER + ENTRY * k + 4], "big") for k in range(n)]
    return [(k, a, data[a:b]) for k, (a, b) in enumerate(zip(offsets, [*offsets[1:], len(data)])) if a <= len(data)]


def _records(frames):
    for pdf in frames:
        rows = [(i, *r) for i, content in zip(pdf["file_id"], pdf["content"]) for r in parse(bytes(content))]
        yield pd.DataFrame(rows, columns=["file_id", "rec_no", "offset", "bytes"])


def records(files: DataFrame) -> DataFrame:
    """files: file_id, content -> file_id, rec_no, offset, bytes."""
    return files.select("file_id", "content").mapInPandas(_records, "file_id string, rec_no int, offset long, bytes binary")


def _built(pdf: pd.DataFrame, kind: bytes) -> pd.DataFrame:
    pdf = pdf.sort_values("rec_no")
    return pd.DataFrame({"file_id": [pdf["file_id"].iloc[0]], "content": [build(pdf["title"].iloc[0], [bytes(b) for b in pdf["bytes"]], kind)]})


def containers(rows: DataFrame, kind: bytes = b"BOOKMOBI") -> DataFrame:
    """rows: file_id, title, rec_no, bytes -> file_id, content. A container is one file, so its records meet."""
    return rows.groupBy("file_id").applyInPandas(partial(_built, kind=kind), "file_id string, content binary")


def number(x: Column, at: int | Column, size: int) -> Column:
    """A big-endian number at a 0-based place of a binary column."""
    begin = at + 1 if isinstance(at, int) else (at + 1).cast("int")
    return F.conv(F.hex(F.substring(x, begin, size) if isinstance(begin, int) else F.substr(x, begin, F.lit(size))), 16, 10).cast("long")


def metadata_block(pairs: list[tuple[int, bytes]]) -> bytes:
    """Type, length and data of each record after a mark, a length and a count, padded to 4 bytes."""
    body = b"".join(struct.pack(">II", t, len(v) + 8) + v for t, v in pairs)
    block = b"EXTH" + struct.pack(">II", 12 + len(body), len(pairs)) + body
    return block + b"\0" * (-len(block) % 4)


def parse_metadata(data: bytes) -> list[tuple[int, int, bytes]]:
    """(place, type, value) of the metadata block of a first record, or of none."""
    at = data.find(b"EXTH")
    if at < 0 or at + 12 > len(data):
        return []
    n, out, p = int.from_bytes(data[at + 8 : at + 12], "big"), [], at + 12
    for k in range(n):
        if p + 8 > len(data):
            break
        kind, length = struct.unpack(">II", data[p : p + 8])
        if length < 8:
            break
        out.append((k, kind, data[p + 8 : p + length]))
        p += length
    return out


def _metadata(frames):
    for pdf in frames:
        rows = [(i, *m) for i, b in zip(pdf["file_id"], pdf["bytes"]) for m in parse_metadata(bytes(b))]
        yield pd.DataFrame(rows, columns=["file_id", "ord", "type", "value"])


def metadata(recs: DataFrame) -> DataFrame:
    """file_id, ord, type, value of the metadata in each file's first record."""
    return recs.where("rec_no = 0").select("file_id", "bytes").mapInPandas(_metadata, "file_id string, ord int, type int, value binary")


# Names of the metadata types, and the types and the place in the first record that tell protection.
TYPE_NAMES = {
    100: "creator", 101: "publisher", 103: "description", 104: "isbn", 105: "subject", 106: "publishingdate", 108: "contributor", 109: "rights",
    112: "source", 113: "asin", 114: "versionnumber", 115: "sample", 116: "startreading", 117: "adult", 118: "retail_price", 119: "retail_price_currency",
    121: "kf8boundary", 125: "kf8_count_resources_fonts", 129: "kf8_thumbnail_uri", 131: "kf8_unknown131", 201: "coveroffset", 202: "thumboffset",
    203: "hasfakecover", 204: "creatorsoftware", 205: "creatormajor", 206: "creatorminor", 207: "creatorbuild", 208: "watermark", 209: "tamperkey",
    300: "fontsignature", 401: "clippinglimit", 402: "publisherlimit", 403: "unknown403", 404: "ttsdisable", 406: "rental_expiration",
    450: "unknown450", 451: "unknown451", 452: "unknown452", 453: "unknown453", 501: "cde_content_type", 502: "lastupdatetime", 503: "updatedtitle",
    504: "asin2", 524: "language", 525: "writingmode", 526: "nominalpagecount", 527: "pageprogressiondirection", 528: "overrideslhfeatures",
    529: "originalsourcedesc", 534: "inputsourcetype", 535: "creatorbuildrev", 536: "containerinfo", 538: "originalresolution", 542: "unknown542",
}
PROTECTED_TYPES, ENCRYPTION_AT = (401, 402, 403), 12


def named_metadata(meta: DataFrame) -> DataFrame:
    """Adds name, unknown for other types, and number: the value of up to four bytes as one."""
    names = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    short = F.when(F.octet_length("value").between(1, 4), F.conv(F.hex("value"), 16, 10).cast("long"))
    return meta.withColumn("name", F.coalesce(F.try_element_at(names, F.col("type")), F.lit("unknown"))).withColumn("number", short)


def text_header(recs: DataFrame) -> DataFrame:
    """file_id, compression, text_length, text_records, record_size, encryption of each file's first record."""
    at = lambda place, size: number(F.col("bytes"), place, size)
    first = recs.where((F.col("rec_no") == 0) & (F.octet_length("bytes") >= 16))
    return first.select("file_id", at(0, 2).alias("compression"), at(4, 4).alias("text_length"), at(8, 2).alias("text_records"), at(10, 2).alias("record_size"), at(ENCRYPTION_AT, 2).alias("encryption"))


def refused(recs: DataFrame) -> DataFrame:
    """file_id of the files that are protected, by the header or by a metadata type; they are never rewritten."""
    marked = metadata(recs).where(F.col("type").isin(*PROTECTED_TYPES)).select("file_id")
    return text_header(recs).where("encryption <> 0").select("file_id").unionByName(marked).distinct()


def layout_problems(recs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Assertions on the layout: offsets that go back, begin before the table ends or pass the file's end.

    sizes: file_id, size."""
    w = Window.partitionBy("file_id").orderBy("rec_no")
    n = F.count(F.lit(1)).over(Window.partitionBy("file_id"))
    x = recs.withColumn("next", F.lead("offset").over(w)).withColumn("n", n).join(sizes, "file_id")
    problem = F.when(F.col("next") < F.col("offset"), "goes back").when(F.col("offset") < HEADER + ENTRY * F.col("n"), "in the table").when(F.col("offset") > F.col("size"), "past the end")
    return x.withColumn("problem", problem).where("problem is not null").select("file_id", "rec_no", "offset", "problem")
