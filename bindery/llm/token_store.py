"""Token ids in Simple-8b words.

A 64-bit word holds a selector in its top 4 bits and 60 bits of ids, all of one width:
the widest id of a run decides, and the encoder takes the longest run that fits. Selector 15
is an escape: the ids wait in a list of raw 64-bit words, one for each escape word, for ids
of more than 60 bits.

File format: one row for each block, in the order of the shard. A block holds whole
documents, BLOCK_IDS ids or more but for the shard's last, with their doc_ids and lengths;
only its last word is padded. offsets hold the number of ids before every STRIDE-th word,
so a reader decodes any stretch of a block alone (unpack_part, read_range).
Texts are encoded where they are read, into a table of ids; only ids are shuffled. The order is by
doc_id, then a hash of the text, then the place in that table, so that shards can also
be cut within the rows of one id or of none.

The blocks are Parquet files in the shared folder, committed by Spark; shards are ranges of
doc_id and are in ascending order, as are the blocks in them and the documents in blocks.

Defined results: a null text is empty, so only the end id is written; repeated ids follow
one another; null ids come first; an empty table gives no blocks.
"""

from __future__ import annotations

import uuid
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .encoder import default_path, encoded, encoder

#: Ids in a word, and their width, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 0])
ESCAPE = 15
BLOCK_IDS = 1 << 16
STRIDE = 128
END_ID = 2
SCHEMA = "shard int, block int, n_ids long, doc_ids array<long>, lengths array<long>, words binary, escaped binary, offsets array<long>"


def _bits(ids: np.ndarray) -> np.ndarray:
    """The width of each id in bits."""
    if len(ids) and int(ids.max()) >> 52:
        return np.array([x.bit_length() for x in ids.tolist()], np.uint8)
    return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)


def _run_ends(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position: the selector of the word that would begin there, and the ids it holds.

    The widest of the next c ids is the wider of two runs of a power of two, which overlap; behind
    the last id all widths are 0, so at the end of all ids shorter runs do too."""
    n = len(ids)
    runs = [_bits(ids)]
    while 2 << len(runs) - 1 <= COUNTS[0]:
        half = 1 << len(runs) - 1
        wider = runs[-1].copy()
        np.maximum(wider[:-half], runs[-1][half:], out=wider[:-half])
        runs.append(wider)
    selector = np.full(n, ESCAPE, np.int8)
    for s in range(13, -1, -1):  # longer runs overwrite shorter ones
        c = int(COUNTS[s])
        level = c.bit_length() - 1
        widest, more = runs[level], c - (1 << level)
        if more:
            widest = widest.copy()
            np.maximum(widest[:-more], runs[level][more:], out=widest[:-more])
        selector[widest <= WIDTHS[s]] = s
    return selector, np.minimum(COUNTS[selector], n - np.arange(n))


def pack(ids: np.ndarray) -> tuple[bytes, bytes, list[int]]:
    """ids as words, the escaped ids, and the number of ids before every STRIDE-th word."""
    ids = np.ascontiguousarray(ids, np.uint64)
    if not len(ids):
        return b"", b"", []
    selector, held = _run_ends(ids)
    jumps, at, k, n = held.tolist(), [], 0, len(ids)
    while k < n:
        at.append(k)
        k += jumps[k]
    begin = np.array(at)
    chosen = selector[begin]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate((ids, np.zeros(COUNTS[0], np.uint64)))
    for s in np.unique(chosen):
        if s == ESCAPE:
            continue
        which = np.flatnonzero(chosen == s)
        cells = begin[which][:, None] + np.arange(COUNTS[s])
        values = padded[cells]
        values <<= (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
        words[which] |= np.bitwise_or.reduce(values, axis=1)
    return words.astype("<u8").tobytes(), ids[begin[chosen == ESCAPE]].astype("<u8").tobytes(), begin[::STRIDE].tolist()


def unpack(words: bytes, escaped: bytes, n: int) -> np.ndarray:
    """The n ids, each selector's words at once."""
    w = np.frombuffer(words, "<u8")
    chosen = (w >> np.uint64(60)).astype(np.int8)
    begin = np.concatenate(([0], np.cumsum(COUNTS[chosen])))
    out = np.empty(begin[-1], np.uint64)
    for s in np.unique(chosen):
        which = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            out[begin[which]] = np.frombuffer(escaped, "<u8")
            continue
        mask = (np.uint64(1) << np.uint64(int(WIDTHS[s]))) - np.uint64(1)
        values = (w[which][:, None] >> (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)) & mask
        out[begin[which][:, None] + np.arange(COUNTS[s])] = values
    return out[:n]


def unpack_part(words: bytes, escaped: bytes, offsets, first: int, last: int) -> np.ndarray:
    """The ids from first to last (exclusive) of a block, decoding only the strides that hold them."""
    offsets = np.asarray(offsets)
    if first >= last:
        return np.zeros(0, np.uint64)
    a, b = int(np.searchsorted(offsets, first, "right")) - 1, int(np.searchsorted(offsets, last, "left"))
    before = np.frombuffer(words, "<u8", min(a * STRIDE, len(words) // 8))
    skip = 8 * int((before >> np.uint64(60) == ESCAPE).sum())
    part = words[8 * a * STRIDE : 8 * b * STRIDE]
    held = np.frombuffer(part, "<u8") >> np.uint64(60)
    n_escapes = int((held == ESCAPE).sum())
    begin = int(offsets[a])
    return unpack(part, escaped[skip : skip + 8 * n_escapes], last - begin)[first - begin :]


def _encoded(batches, path: str, end_id: int):
    """doc_id, tie, text -> the ids of each text and the end id, in 16 bits each if they fit, and
    compressed: they are written and shuffled once each."""
    from pyspark import TaskContext

    codec, enc, place = pa.Codec("zstd", 1), encoder(path), TaskContext.get().partitionId() << 40
    for batch in batches:
        wide, sizes, out = [], [], []
        for ids in encoded(enc, common.texts_of(batch)):
            made = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
            wide.append(4 if made.max() >> 16 else 2)
            sizes.append(len(made))
            out.append(codec.compress(made.astype(f"<u{wide[-1]}").tobytes(), asbytes=True))
        places = pa.array(np.arange(place, place + len(out)), pa.int64())
        place += len(out)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), places, pa.array(wide, pa.int32()), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "tie", "place", "wide", "n", "ids"])


def _blocks(batches):
    from pyspark import TaskContext

    codec, shard, block = pa.Codec("zstd"), TaskContext.get().partitionId(), 0
    names, lengths, parts, held = [], [], [], 0

    def made():
        words, escaped, offsets = pack(np.concatenate(parts))
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([held], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([words], pa.binary()), pa.array([escaped], pa.binary()), pa.array([offsets], pa.list_(pa.int64()))],
            ["shard", "block", "n_ids", "doc_ids", "lengths", "words", "escaped", "offsets"],
        )

    for batch in batches:
        for doc_id, wide, n, ids in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("doc_id", "wide", "n", "ids"))):
            parts.append(np.frombuffer(codec.decompress(ids, n * wide), f"<u{wide}"))
            names.append(doc_id)
            lengths.append(n)
            held += lengths[-1]
            if held >= BLOCK_IDS:
                yield made()
                block, held = block + 1, 0
                names, lengths, parts = [], [], []
    if parts:
        yield made()


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of docs under path, in ascending order of their ids."""
    spark = docs.sparkSession
    rows = common.id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("tie"), "text")
    work = partial(_encoded, path=tokenizer or default_path(), end_id=end_id)
    ids = common.written(rows.mapInArrow(work, "doc_id long, tie long, place long, wide int, n long, ids binary"), "ids")
    order = ["doc_id", "tie", "place"]
    ranged = ids.repartitionByRange(shards or common.shuffle_width(spark), *order).sortWithinPartitions(*order)
    # A block is some 100 KB and is read whole, so its columns gain nothing from large row groups.
    ranged.mapInArrow(_blocks, SCHEMA).write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    common.dropped(ids)


def _documents(batches, with_ids: bool):
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["words"], row["escaped"], row["n_ids"])
            ends = np.cumsum(row["lengths"])
            raw = ids.astype("<u4").tobytes()
            cut = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), row["lengths"])]
            columns = [
                pa.array([row["shard"]] * len(cut), pa.int32()),
                pa.array([row["block"]] * len(cut), pa.int32()),
                pa.array(row["doc_ids"], pa.int64()),
                pa.array(ends - np.array(row["lengths"]), pa.int64()),
                pa.array(row["lengths"], pa.int64()),
                pa.array([zlib.crc32(x) for x in cut], pa.int64()),
            ]
            names = ["shard", "block", "doc_id", "within", "n_tokens", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(cut, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)


def _heads(spark: SparkSession, path: str) -> DataFrame:
    """shard, block, n_ids, ahead: the number of ids before each block.

    A sum in each shard, and a sum over shards; shards are as many as the writer's tasks, not as
    the documents."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    totals = {r.shard: r.n for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    before, base = 0, []
    for s in sorted(totals):
        base.append((s, before))
        before += totals[s]
    bases = spark.createDataFrame(base or [(-1, 0)], "shard int, base long")
    ahead = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = blocks.select("shard", "block", "n_ids").withColumn("ahead", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0))).join(F.broadcast(bases), "shard")
    return heads.select("shard", "block", "n_ids", (F.col("ahead") + F.col("base")).alias("ahead"))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, as little-endian 32-bit) from the files."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    schema = "shard int, block int, doc_id long, within long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    docs = blocks.mapInArrow(partial(_documents, with_ids=with_ids), schema)
    out = docs.join(_heads(spark, path).select("shard", "block", "ahead"), ["shard", "block"])
    return out.select("doc_id", (F.col("ahead") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def _stretches(batches, first: int, last: int):
    for batch in batches:
        for row in batch.to_pylist():
            a, b = max(0, first - row["ahead"]), min(row["n_ids"], last - row["ahead"])
            ids = unpack_part(row["words"], row["escaped"], row["offsets"], a, b)
            yield pa.RecordBatch.from_arrays([pa.array([row["ahead"] + a], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ids.astype("<u4").tobytes()], pa.binary())], ["start", "n", "ids"])


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """start, n, ids (little-endian 32-bit): the ids from place first to last (exclusive) of the whole store.

    A row for each block that holds some; only the strides in question are decoded."""
    heads = _heads(spark, path).where((F.col("ahead") < last) & (F.col("ahead") + F.col("n_ids") > first)).select("shard", "block", "ahead")
    blocks = spark.read.schema(SCHEMA).parquet(path).select("shard", "block", "n_ids", "words", "escaped", "offsets")
    return blocks.join(heads, ["shard", "block"]).mapInArrow(partial(_stretches, first=first, last=last), "start long, n long, ids binary")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_folder(spark)}/bindery-tokens-{uuid.uuid4().hex}"
    write_tokens(common.documents(spark, sf_dir), path)
    return read_tokens(spark, path)
