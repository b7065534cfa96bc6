"""Token counts by overlap resynchronisation.

Texts up to chunk_chars are encoded whole. A longer one is encoded in chunks that overlap,
with the offsets of its tokens. Two neighbours are spliced at a stable boundary inside their
overlap: a single space before a letter or digit, which always begins a new pre-token (see
encoder.py), where both encodings do begin a token. If the overlap holds none, it is widened,
if need be to the rest of the text. So the counts equal those of the whole text.

Defined results: a null or empty text has 0 bytes and 0 tokens; a null id gives a null id;
repeated rows give a row each; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .encoder import default_path, encoder, grouped

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 512
#: Boundaries so close to where a chunk begins or ends are not used.
MARGIN = 64


def stable(text: str, p: int) -> bool:
    return text[p] == " " and p + 1 < len(text) and text[p + 1].isalnum()


def count(text: str | None, enc, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, stats: dict | None = None) -> int:
    """Tokens of text, spliced from chunks. stats: counts the splices and the widenings."""
    if not text:
        return 0
    if len(text) <= chunk + overlap:
        return enc.count(text)
    total, begin, wide = 0, 0, overlap
    left_starts, skip = None, 0  # tokens of the current chunk before skip are counted already
    while True:
        end = begin + chunk + wide
        if left_starts is None:
            left_starts = enc.starts(text[begin:end])
        if end >= len(text):
            return total + len(left_starts) - skip
        right = begin + chunk
        right_starts = enc.starts(text[right : right + chunk + overlap])
        mine, theirs = {s + begin for s in left_starts[bisect_left(left_starts, chunk) :]}, {s + right for s in right_starts[: wide + 1]}
        both = [p for p in sorted(mine & theirs) if right + min(MARGIN, wide // 4) <= p < end - min(MARGIN, wide // 4) and stable(text, p)]
        if not both:  # widen the overlap, and encode the left chunk again with it
            wide, left_starts = wide * 2, None
            if stats is not None:
                stats["widened"] = stats.get("widened", 0) + 1
            continue
        p = both[0]
        total += bisect_left(left_starts, p - begin) - skip
        if stats is not None:
            stats["spliced"] = stats.get("spliced", 0) + 1
        skip = bisect_left(right_starts, p - right)
        begin, wide, left_starts = right, overlap, right_starts


def _count(batches, path: str, chunk: int, overlap: int):
    enc = encoder(path)
    for batch in batches:
        tokens, sizes = [], []
        for group in grouped(t or "" for t in common.texts_of(batch)):
            short = iter(enc.encode_all([t for t in group if len(t) <= chunk + overlap]))
            tokens += [len(next(short)) // 4 if len(t) <= chunk + overlap else count(t, enc, chunk, overlap) for t in group]
            sizes += [len(t.encode()) for t in group]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 1024, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row. tokenizer: a .json or a .model file."""
    work = partial(_count, path=tokenizer or default_path(), chunk=chunk_chars, overlap=overlap_chars)
    out = common.id_and_text(docs, id_col, text_col).mapInArrow(work, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", out.n_tokens > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.documents(spark, sf_dir))
