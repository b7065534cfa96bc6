"""Sinks: zip publications and word list bundles. Each gives rows pkg_id, name, content, one for a file,
which any writer of binary columns can store; a file's parts meet in its package's group."""

from __future__ import annotations

import io
import struct
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.terms import inverted_index

FILES = "pkg_id string, name string, content binary"


def _zipped(pdf: pd.DataFrame) -> pd.DataFrame:
    """The type comes first and is stored; the other files follow by path."""
    raw, pkg = io.BytesIO(), pdf["pkg_id"].iloc[0]
    with zipfile.ZipFile(raw, "w") as z:
        stamp = (1980, 1, 1, 0, 0, 0)
        z.writestr(zipfile.ZipInfo("mimetype", stamp), b"application/epub+zip", zipfile.ZIP_STORED)
        for path, content in sorted(zip(pdf["path"], pdf["content"])):
            if path != "mimetype":
                z.writestr(zipfile.ZipInfo(path, stamp), bytes(content), zipfile.ZIP_DEFLATED)
    return pd.DataFrame({"pkg_id": [pkg], "name": [f"{pkg}.epub"], "content": [raw.getvalue()]})


def epubs(files: DataFrame) -> DataFrame:
    """files: pkg_id, path, content -> one zip for each package."""
    return files.select("pkg_id", "path", "content").groupBy("pkg_id").applyInPandas(_zipped, FILES)


def _bundle(pdf: pd.DataFrame) -> pd.DataFrame:
    pkg, pdf = pdf["pkg_id"].iloc[0], pdf.sort_values(["kind", "place", "word"])
    words, forms = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1]
    index = b"".join(w.encode() + b"\0" + struct.pack(">II", o, s) for w, o, s in zip(words["word"], words["offset"], words["size"]))
    text = b"".join(h.encode() for h in words["html"])
    synonyms = b"".join(w.encode() + b"\0" + struct.pack(">I", i) for w, i in zip(forms["word"], forms["idx"]))
    about = f"StarDict's dict ifo file\nversion=2.4.2\nbookname={pkg}\nwordcount={len(words)}\nsynwordcount={len(forms)}\nidxfilesize={len(index)}\nsametypesequence=h\n"
    rows = [("idx", index), ("dict", text), ("syn", synonyms), ("ifo", about.encode())]
    return pd.DataFrame([(pkg, f"{pkg}.{end}", content) for end, content in rows], columns=["pkg_id", "name", "content"])


def word_lists(entries: DataFrame) -> DataFrame:
    """entries: pkg_id, entry_ord, headword, inflections, html -> the four files of each package."""
    index, synonyms = inverted_index(entries)
    words = index.select("pkg_id", F.lit(0).alias("kind"), F.col("headword").alias("word"), F.col("idx").cast("long").alias("place"), "offset", "size", F.col("idx").cast("long").alias("idx"), "html")
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("pkg_id").orderBy("key", "form", "idx"))
    forms = synonyms.select("pkg_id", F.lit(1).alias("kind"), F.col("form").alias("word"), order.cast("long").alias("place"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("size"), F.col("idx").cast("long").alias("idx"), F.lit("").alias("html"))
    return words.unionByName(forms).groupBy("pkg_id").applyInPandas(_bundle, FILES)


def read_index(index: bytes, text: bytes) -> list[tuple[str, str]]:
    """The words of an index file with their texts."""
    out, at = [], 0
    while at < len(index):
        end = index.index(b"\0", at)
        offset, size = struct.unpack(">II", index[end + 1 : end + 9])
        out.append((index[at:end].decode(), text[offset : offset + size].decode()))
        at = end + 9
    return out
