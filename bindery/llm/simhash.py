"""Near duplicates by SimHash fingerprints and pigeonring filtering.

The 64 bits form a ring of five segments. If two fingerprints differ in at most two bits,
some chain of consecutive segments keeps within the proportional budgets: after l segments
at most floor(2 l / 5) differences, which are 0, 0, 1, 1, 2. So two neighbouring segments
are equal, which gives five keys of some 26 bits, and the longer prefixes of the chain prune
candidates before the full Hamming check.

Copies share a fingerprint, so only distinct fingerprints are keyed. A key with more than
BUCKET of them is refined: the bits that the key leaves free form a ring of five again. After
three levels 14 bits are free, so no bucket exceeds 2**14 fingerprints and none is
cut off. Within a bucket a search from fingerprint to fingerprint emits links of a spanning
forest, fewer than fingerprints, and never all pairs.

Defined results: a null or empty text or one of white space alone has fingerprint zero and is
linked like any other; a row with a null id has a fingerprint and a null component, and
links nothing; repeated rows share a component; no rows give no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, near_copies
from .common import written
from .components import connected_components

SHINGLE = 3
DISTANCE = 2
SEGMENTS = 5
BUCKET = 4096
LEVELS = 3
SEED = 42
#: Texts of similar shingle sets mostly differ in more bits: those within FAR that share WINDOW bits of the ring are candidates.
WINDOW, APART, FAR = 16, 4, 12
#: Bits of fewer shingles are too often zero to tell texts apart at such a distance.
MANY = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned: bit k is 1 if it is set in over half the shingles' hashes."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = [words] if len(words) < shingle else zip(*(words[k:] for k in range(shingle)))
    return majority(np.array([digest(b" ".join(s), SEED) for s in shingles], "<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as an unsigned number."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):
        ones += np.unpackbits(np.ascontiguousarray(h[k : k + (1 << 14)], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _prints(texts, shingle: int) -> pa.Array:
    return pa.array([_signed(fingerprint(t, shingle)) for t in texts], pa.int64())


def _hashed(batches, shingle: int):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), _prints(common.texts_of(batch), shingle)], ["doc_id", "fp"])


def _ring(bits: list[int]) -> list[list[int]]:
    """Bit positions in SEGMENTS runs of nearly equal length."""
    cut = [len(bits) * k // SEGMENTS for k in range(SEGMENTS + 1)]
    return [bits[a:b] for a, b in zip(cut, cut[1:])]


def _mask(*segments: list[int]) -> int:
    return sum(1 << b for s in segments for b in s)


def paths(level: int) -> list[tuple[int, int, int, int]]:
    """(parent path, key mask, masks of the chains of three and four segments) of each key."""
    if level == 0:
        return [(-1, 0, 0, 0)]
    out = []
    for parent, (_, have, _, _) in enumerate(paths(level - 1)):
        ring = _ring([b for b in range(64) if not have >> b & 1])
        for k in range(SEGMENTS):
            chain = [ring[(k + j) % SEGMENTS] for j in range(4)]
            out.append((parent, have | _mask(*chain[:2]), _mask(*chain[:3]), _mask(*chain)))
    return out


def spanning_links(prints: np.ndarray, three: int, four: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the bucket's pairs that pass the chain and the Hamming check."""
    left, links = prints, []
    three, four = np.uint64(three), np.uint64(four)
    todo: list = []
    while len(left) or todo:
        if not todo:
            todo, left = [left[0]], left[1:]
            continue
        x = todo.pop()
        if not len(left):
            break
        d = left ^ x
        near = np.bitwise_count(d & three) <= 1
        near &= np.bitwise_count(d & four) <= 1
        if near.any():
            near[near] = np.bitwise_count(d[near]) <= DISTANCE
            found = left[near]
            links += [(int(x), int(y)) for y in found]
            todo.extend(found)
            left = left[~near]
    return links


def _buckets(batches, level: int):
    """Rows sorted by path and key, a bucket's rows together; a bucket may span batches."""
    masks = paths(level)
    held = None

    def links(path, prints):
        return spanning_links(prints, masks[path][2], masks[path][3])

    def batch_of(pairs):
        a = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

    for batch in batches:
        path, key, fp = (np.asarray(batch.column(k)) for k in range(3))
        if held is not None:
            path, key, fp = (np.concatenate(x) for x in zip(held, (path, key, fp)))
        edge = np.flatnonzero((path[1:] != path[:-1]) | (key[1:] != key[:-1])) + 1
        edge = np.concatenate(([0], edge))
        out = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            out += links(int(path[a]), fp[a:b].astype(np.int64).view(np.uint64))
        last = int(edge[-1])
        held = path[last:], key[last:], fp[last:]
        yield batch_of(out)
    if held is not None and len(held[0]):
        yield batch_of(links(int(held[0][0]), held[2].astype(np.int64).view(np.uint64)))


def hamming_links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """prints: distinct fp (long). Gives links a, b that connect all within DISTANCE bits."""
    spark, found = prints.sparkSession, None
    rows = prints.select(F.lit(0).alias("parent"), "fp")
    for level in range(1, LEVELS + 1):
        table = paths(level)
        keys = F.array(*[F.struct(F.lit(p[0]).alias("parent"), F.lit(k).alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(p[1]))).alias("key")) for k, p in enumerate(table)])
        keyed = rows.select("parent", "fp", F.explode(keys if level == 1 else F.filter(keys, lambda x: x.parent == F.col("parent"))).alias("x")).select("x.path", "x.key", "fp")
        sizes = keyed.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = written(keyed.join(sizes, ["path", "key"]), f"buckets{level}")
        small = sized if level == LEVELS else sized.where(F.col("n") <= bucket)
        links = small.select("path", "key", "fp").repartition(common.shuffle_width(spark), "path", "key").sortWithinPartitions("path", "key").mapInArrow(partial(_buckets, level=level), "a long, b long")
        found = links if found is None else found.unionByName(links)
        if level == LEVELS or not sized.where(F.col("n") > bucket).limit(1).count():
            return found
        rows = sized.where(F.col("n") > bucket).select(F.col("path").alias("parent"), "fp")
    return found


def _near(batches, most: int):
    """Rows key, fp sorted by both -> a link of each fingerprint with the first one of its key, of the last so many, within FAR bits."""
    held = None

    def of(key, fp):
        fp, at, first = fp.view(np.uint64), np.arange(1, len(fp)), np.full(len(fp), -1)
        for back in range(1, most + 1):
            at = at[at >= back]
            at = at[key[at] == key[at - back]]
            if not len(at):
                break
            near = at[np.bitwise_count(fp[at] ^ fp[at - back]) <= FAR]
            first[near] = near - back
        linked = np.flatnonzero(first >= 0)
        return pa.RecordBatch.from_arrays([pa.array(fp[x].view(np.int64)) for x in (linked, first[linked])], ["a", "b"])

    for batch in batches:
        rows = [np.asarray(x) for x in batch.columns]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        if cut:
            yield of(*[x[:cut] for x in rows])
        held = [x[cut:] for x in rows]
    if held is not None:
        yield of(*held)


def near_links(prints: DataFrame, most: int = BUCKET) -> DataFrame:
    """prints: distinct fp (long). Gives links a, b of fingerprints within FAR bits, a key for each APART-th place of the ring.

    All within three bits share a key, of others a part that falls with the distance: what is
    linked here are candidates, and another way must give the rest."""
    turned = [F.shiftrightunsigned("fp", k).bitwiseOR(F.shiftleft("fp", 64 - k)) if k else F.col("fp") for k in range(0, 64, APART)]
    keys = [(x.bitwiseAND(F.lit((1 << WINDOW) - 1)) + F.lit(k << WINDOW)).cast("int") for k, x in enumerate(turned)]
    keyed = prints.select(F.explode(F.array(*keys)).alias("key"), "fp").repartition(common.shuffle_width(prints.sparkSession), "key")
    return keyed.sortWithinPartitions("key", "fp").mapInArrow(partial(_near, most=most), "a long, b long")


def _components(hashed: DataFrame, bucket: int) -> DataFrame:
    """fp, root, component_id of every fingerprint that a row with an id has; root names the component."""
    nodes = written(hashed.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = connected_components(hamming_links(nodes.select("fp"), bucket)).withColumnRenamed("node", "fp")
    linked = roots.join(nodes, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(least, "root").select("fp", "root", "component_id")
    return nodes.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id"))


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id of each row."""
    hashed = written(common.id_and_text(docs, id_col, text_col).mapInArrow(partial(_hashed, shingle=shingle), "doc_id long, fp long"), "hashed")
    # A table of its own, so that the join reads two plain exchanges and Spark can split a hot fingerprint.
    named = hashed.join(written(_components(hashed, bucket), "components"), "fp", "left")
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = near_copies.SHINGLE, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of the smallest id of each component of near duplicates.

    Near duplicates are texts whose sets of five-word shingles have a similarity of 0.8 or more. The
    fingerprints of these shingles are linked as above, and those of larger sets within FAR bits if
    they share a run of bits (near_links); each component of them is a group whose links are
    confirmed on the sets. What the fingerprints leave apart goes through the groups of
    shared shingles (near_copies.py), and no such pair is lost.

    Rows of one id and set are one document, of which one row stays, the one with the least hash of
    its columns; if an id has several sets in a component, the smallest node stays. Rows without an
    id all stay."""

    def groups(prefixes: DataFrame) -> DataFrame:
        """grp, node: the nodes of each component of fingerprints."""
        nodes = written(prefixes.where("size > 0").select("node", "fp", "size").distinct(), "nodes")
        links = hamming_links(nodes.select("fp").distinct(), bucket)
        roots = connected_components(links.unionByName(near_links(nodes.where(F.col("size") >= MANY).select("fp").distinct(), bucket)))
        return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(F.coalesce("root", "fp").alias("grp"), "node")

    return near_copies.keep_one(docs, shingle, id_col, text_col, groups)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(common.documents(spark, sf_dir))
