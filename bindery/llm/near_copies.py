"""Near duplicates by an exact join of shingle sets: pairs of Jaccard similarity 4/5 or more.

A text is the set of its lower-case runs of five words; one of fewer words is one shingle. If
two sets are similar, the first n - ceil(4 n / 5) + 1 shingles of each, in an order that all
texts share, have one in common. So these prefixes are grouped by shingle, and texts that
share none are never compared. The order is by the number of texts of a sample that hold a
shingle, the rarest first, then by its hash; the sample settles the order alone, so it costs no
pair. So passages that many texts share are in the prefixes of few.

Groups that are known beforehand (those of fingerprints, see simhash.py) come first. What their
links connect is one part from then on, and only shingles that several parts share are grouped.

Prefixes that are longer by k shingles have more in common (least_shared), so a text with fewer
shared shingles in its longer prefix is similar to none and is left out, and so is one without
another of a size that a similar one can have. A text that must share c shingles needs the first
of its shared ones alone, without c - 1. Within a group, texts are paired by the shingles that their
longer prefixes share, and those without a partner are left out before any set is read, so that
groups of the same texts become one.

Equal sets are one node. Groups of the same nodes are one group, and a group all of whose
nodes have one same largest group is left to that one. The largest group of each node comes
first, and groups that its links connect already are left out. Within a group a search from
set to set emits links of a spanning forest, and each link is confirmed by counting the
shingles in common. No group is capped; one is held in the memory of its task.

Defined results: null and empty texts and those of white space alone are copies of each
other; rows with a null id link nothing; repeated rows are one document; no rows give no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import written
from .components import connected_components

SHINGLE = 5
#: The least similarity, NUM / DEN.
NUM, DEN = 4, 5
#: About so many texts settle the order of the shingles that two of them hold or more, the most frequent ones up to a bound.
SAMPLE = 16_384
ORDERED = 1 << 20
#: A filter of this size keeps most texts that are in no group from being shuffled.
SLOTS = 1 << 20
#: Groups above this size aren't chosen to stand for smaller ones.
LARGE = 1024
#: So many sets are compared with one at once, by lists of the sets that hold a shingle, read in steps of about so many rows.
MANY = 4
STEP = 1 << 20
BASE = 0xD6E8FEB86659FD93
_EMPTY = np.zeros(0, np.uint64)


def runs(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of words, repeats included."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower() if text else b"", np.uint8)
    words = common.word_hashes(data, *common.word_spans(data))
    return common.window_hashes(words, min(shingle, len(words)), BASE) if len(words) else _EMPTY


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of words."""
    return np.unique(runs(text, shingle))


def similar(a: int, b: int, both):
    """Whether sets of a and b shingles with so many in common reach the similarity."""
    return DEN * both >= NUM * (a + b - both)


def least_common(n):
    """Shingles that a set of n has in common with a similar one, at least; also the least size of that one."""
    return -(-NUM * n // DEN)


def prefix_length(n, common=1):
    return n - least_common(n) + common


def in_common(n):
    """So many shingles of the longer prefixes of two sets, n the smaller size, are the same."""
    return max(1, n // 20)


def least_shared(a, b):
    """Shingles that the longer prefixes of similar sets of a and b shingles have in common, at least.

    All that both have and that isn't in both prefixes is beyond the prefix of one of them."""
    least = -(-NUM * (a + b) // (NUM + DEN))
    beyond = [least_common(n) - np.maximum(1, n // 20) for n in (a, b)]
    return np.maximum(1, least - np.maximum(*beyond))


def _node(s: np.ndarray) -> int:
    return int(common.mixed(common.mixed(s).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(len(s))).view(np.int64)[0])


def _sets(batches, id_col: str, text_col: str, shingle: int):
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index(id_col))
        for k, text in enumerate(common.texts_of(batch, text_col)):
            yield ids[k].as_py(), shingles(text, shingle)


@common.lean
def _sampled(batches, shingle: int):
    for batch in batches:
        every = [s for _, s in _sets([batch], "doc_id", "text", shingle)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_EMPTY, *every]).view(np.int64))], ["h"])


def ordered(s: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sorted shingles by their number in the sample, then as they are. known: sorted shingles with numbers."""
    if not len(known):
        return s
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    return s[np.argsort(np.where(known[at] == s, counts[at], 0), kind="stable")]


@common.lean
def _prefixes(batches, shingle: int, known: np.ndarray, counts: np.ndarray):
    from .simhash import majority

    for batch in batches:
        nodes, prints, sizes, out = [], [], [], []
        for text in common.texts_of(batch):
            every = runs(text, shingle)
            s = np.unique(every)
            prints.append(majority(every))
            nodes.append(_node(s))
            first = ordered(s, known, counts)[: prefix_length(len(s), in_common(len(s)))] if len(s) else s
            sizes.append(len(s))
            out.append(first.view(np.int64))
        columns = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(out, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "node", "fp", "size", "prefix"])


@common.lean
def _full(batches, shingle: int, slots: np.ndarray):
    """Sets of the texts whose slot of SLOTS is set; further ones do no harm."""
    for batch in batches:
        batch = batch.filter(pa.array(slots[np.asarray(batch.column(2))]))
        nodes, out = [], []
        for _, s in _sets([batch], "doc_id", "text", shingle):
            nodes.append(_node(s))
            out.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.binary())], ["node", "shingles"])


@common.lean
def _in_slots(batches, slots: np.ndarray):
    """Rows node, shingles, slot whose slot is set, without it."""
    for batch in batches:
        yield batch.filter(pa.array(slots[np.asarray(batch.column(2))])).select(["node", "shingles"])


def _runs(batches, make):
    """Rows h, node, ... sorted by both: make(h, node, ..., start, size) of the distinct rows of whole runs of h."""
    held = None

    def of(rows):
        h, node = rows[0], rows[1]
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])])
        rows = [x[keep] for x in rows]
        start = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
        return make(*rows, start, np.diff(np.append(start, len(rows[0]))))

    for batch in batches:
        rows = [np.asarray(x) for x in batch.columns]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        if cut:
            yield of([x[:cut] for x in rows])
        held = [x[cut:] for x in rows]
    if held is not None:
        yield of(held)


@common.lean
def _shared(batches):
    def make(h, node, start, count):
        more = np.repeat(count > 1, count)
        return pa.RecordBatch.from_arrays([pa.array(x[more]) for x in (h, node)], ["h", "node"])

    return _runs(batches, make)


@common.lean
def _by_size(batches):
    """Rows h, size, node sorted so -> grp, n, node: the nodes of an h, cut where the next size is beyond what similar sets can have.

    A group is named after its n nodes, two or more."""
    held = None

    def of(h, size, node):
        cut = (h[1:] != h[:-1]) | (DEN * size[:-1].astype(np.int64) < NUM * size[1:].astype(np.int64))
        start = np.flatnonzero(np.concatenate([[True], cut]))
        count = np.diff(np.append(start, len(h)))
        name = np.add.reduceat(common.mixed(node.view(np.uint64)), start)
        more = np.repeat(count > 1, count)
        columns = np.repeat(name, count)[more].view(np.int64), np.repeat(count, count)[more], node[more]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["grp", "n", "node"])

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


def by_token(tokens: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The owners by token, and where those of each of n tokens begin."""
    order = np.argsort(tokens, kind="stable")
    return owner[order], np.searchsorted(tokens[order], np.arange(n + 1))


def held_with(tokens: np.ndarray, owner: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """How many of the tokens each of n owners has."""
    both, size = np.zeros(n, np.int64), begin[tokens + 1] - begin[tokens]
    for part in np.split(np.arange(len(tokens)), np.flatnonzero(np.diff(np.cumsum(size) // STEP)) + 1):
        if rows := int(size[part].sum()):
            first = np.cumsum(size[part]) - size[part]
            both += np.bincount(owner[np.repeat(begin[tokens[part]] - first, size[part]) + np.arange(rows)], minlength=n)
    return both


def partners(part: np.ndarray, size: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """A mask of the nodes with one of another part that may be similar, by the sizes and the shingles in both lists."""
    n, lengths = len(part), [len(x) for x in lists]
    distinct, place = np.unique(np.concatenate(lists), return_inverse=True)
    owner, begin = by_token(place, np.repeat(np.arange(n), lengths), len(distinct))
    found, ends = np.zeros(n, bool), np.cumsum(lengths)
    for x in range(n):
        if found[x]:
            continue
        both = held_with(place[ends[x] - lengths[x] : ends[x]], owner, begin, n)
        near = (both >= least_shared(size, size[x])) & (part != part[x]) & similar(size[x], size, np.minimum(size, size[x]))
        found[near] = True
        found[x] = near.any()
    return found


@common.lean
def _paired(batches):
    """Rows grp, node, part, size, shingles sorted by group -> the groups grp, node of those with partners; a group may span batches."""
    at, held = None, []

    def some():
        if len(held) < 2:
            return []
        node, part, size, lists = zip(*held)
        node = np.array(node)[partners(np.array(part), np.array(size, np.int64), list(lists))]
        name = int(common.mixed(node.view(np.uint64)).sum(dtype=np.uint64).view(np.int64))
        return [(name, n) for n in node.tolist()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], ["grp", "node"])

    for batch in batches:
        out = []
        for grp, *row, shingles in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
            if grp != at:
                out += some()
                at, held = grp, []
            held.append((*row, np.asarray(shingles.values)))
        yield batch_of(out)
    yield batch_of(some())


def spanning_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Places of links of a spanning forest of the similar pairs of distinct sets."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if similar(*map(int, sizes), both) else []
    every = np.concatenate(sets)
    _, place, count = np.unique(every, return_inverse=True, return_counts=True)
    ends = np.cumsum(sizes)
    ranked, of, shared = [], [], []
    for k, end in enumerate(ends.tolist()):
        p = place[end - sizes[k] : end]
        shared.append(p[count[p] > 1])
        p = p[np.lexsort((p, count[p]))][: prefix_length(int(sizes[k]))]
        p = p[count[p] > 1]
        ranked.append(p)
        of.append(np.full(len(p), k))

    owner, at = by_token(np.concatenate(ranked), np.concatenate(of), len(count))
    lists: dict[int, np.ndarray] = {}
    left, links = np.ones(len(sets), bool), []
    holders, n_held = None, 0

    def in_common_with(x: int, near: np.ndarray) -> np.ndarray:
        """Shingles that set x has in common with each of near, which are left."""
        nonlocal holders, n_held
        if len(near) < MANY:
            return np.array([np.isin(sets[y], sets[x], assume_unique=True).sum() for y in near.tolist()], np.int64)
        n_left = int(left.sum())
        if holders is None or 2 * n_left < n_held:  # lists of what is left alone, made anew as often as that halves
            some = np.flatnonzero(left)
            holders = by_token(np.concatenate([shared[k] for k in some.tolist()]), np.repeat(some, [len(shared[k]) for k in some.tolist()]), len(count))
            n_held = n_left
        both = held_with(shared[x], *holders, len(sets))
        return both[near]

    for begin in range(len(sets)):
        if not left[begin]:
            continue
        left[begin] = False
        todo = [begin]
        while todo:
            x = todo.pop()
            found = []
            for t in ranked[x].tolist():
                have = lists.get(t)
                if have is None:
                    have = owner[at[t] : at[t + 1]]
                have = lists[t] = have[left[have]]
                if len(have):
                    found.append(have)
            if not found:
                continue
            near = np.unique(np.concatenate(found))
            near = near[similar(sizes[x], sizes[near], np.minimum(sizes[x], sizes[near]))]
            if len(near):
                near = near[similar(sizes[x], sizes[near], in_common_with(x, near))]
                links += [(x, y) for y in near.tolist()]
                left[near] = False
                todo += near.tolist()
    return links


@common.lean
def _linked(batches):
    """Rows grp, node, shingles sorted by group -> links a, b; a group may span batches."""
    at, held = None, {}

    def links():
        nodes = list(held)
        return [(nodes[a], nodes[b]) for a, b in spanning_links([np.frombuffer(s, np.uint64) for s in held.values()])] if len(nodes) > 1 else []

    def batch_of(pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], ["a", "b"])

    for batch in batches:
        out = []
        for grp, node, s in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if grp != at:
                out += links()
                at, held = grp, {}
            held[node] = s
        yield batch_of(out)
    yield batch_of(links())


def _order(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that two texts of the sample hold or more, and by how many, the ORDERED most frequent ones."""
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(-(-n // SAMPLE) or 1)) == 0)
    held = some.mapInArrow(partial(_sampled, shingle=shingle), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    got = held.orderBy(F.desc("n"), "h").limit(ORDERED).toPandas()
    known = got["h"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(known)
    return known[by], got["n"].to_numpy(np.int64)[by]


def similar_links(docs: DataFrame, prefixes: DataFrame, nodes: DataFrame, shingle: int = SHINGLE, known: DataFrame | None = None) -> DataFrame:
    """docs: doc_id, text; prefixes: node, prefix; nodes: node, size, first (an id); known: groups grp, node that come first.

    Gives links a, b that connect all similar nodes."""
    width = common.shuffle_width(docs.sparkSession)
    # Two numbers a row, as this is the largest shuffle: a quarter of all shingles.
    by = prefixes.select(F.explode("prefix").alias("h"), "node").repartition(width, "h").sortWithinPartitions("h", "node")
    shared = written(by.mapInArrow(_shared, "h long, node long"), "shared")
    need = F.greatest(F.lit(1), F.expr("size div 20"))
    may = shared.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(nodes, "node").where(F.col("n") >= need).select("node")
    may = written(may, "may")
    first = nodes.select("node", F.col("first").alias("doc_id")).join(may, "node")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int").alias("slot")
    slots = np.zeros(SLOTS, bool)
    slots[first.select(slot).distinct().toPandas()["slot"].to_numpy(np.int64)] = True
    sets = docs.select("doc_id", "text", slot).mapInArrow(partial(_full, shingle=shingle, slots=slots), "node long, shingles binary")
    sets = written(sets.join(may, "node", "left_semi").dropDuplicates(["node"]), "sets")

    def linked(some):
        at = F.pmod("node", F.lit(SLOTS)).cast("int").alias("slot")
        slots = np.zeros(SLOTS, bool)
        slots[some.select(at).distinct().toPandas()["slot"].to_numpy(np.int64)] = True
        read = sets.select("node", "shingles", at).mapInArrow(partial(_in_slots, slots=slots), "node long, shingles binary")
        rows = some.join(read, "node").select("grp", "node", "shingles").repartition(width, "grp").sortWithinPartitions("grp")
        return written(rows.mapInArrow(_linked, "a long, b long"), "found")

    def apart(some: DataFrame, parts: DataFrame) -> DataFrame:
        """The groups whose nodes are of several parts."""
        named, part = some.join(parts, "node", "left"), F.coalesce("root", "node")
        split = named.groupBy("grp").agg(F.min(part).alias("low"), F.max(part).alias("high")).where("low <> high").select("grp")
        return some.join(split, "grp", "left_semi")

    def near_in_size(rows: DataFrame) -> DataFrame:
        """Of rows h, node, part, size those that have one of another part in their h, of a size that a similar set can have."""
        by = Window.partitionBy("h")
        up, down = (F.col("size"), F.col("node")), (F.desc("size"), F.desc("node"))
        for name, way in (("below", up), ("above", down)):
            of = by.orderBy(*way)
            rows = rows.withColumn("was", F.when(F.lag("part").over(of) != F.col("part"), F.lag("size").over(of)))
            rows = rows.withColumn(name, F.last("was", ignorenulls=True).over(of.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("was")
        near = (DEN * F.col("below") >= NUM * F.col("size")) | (DEN * F.col("size") >= NUM * F.col("above"))
        return rows.where(near).drop("below", "above")

    def largest(groups: DataFrame) -> DataFrame:
        """node, most: its largest group of grp, n, node."""
        most = groups.groupBy("node").agg(F.max(F.when(F.col("n") <= LARGE, F.struct("n", "grp"))).alias("most"))
        return most.select("node", F.col("most.grp").alias("most"))

    def across(parts: DataFrame) -> DataFrame:
        """Groups grp, node of the shingles that nodes of several parts share, without nodes that are similar to none of another part.

        A node that shares c shingles or more with each similar one leaves its last c - 1 out, in
        an order of all: the first one that two similar nodes share is before these for both."""
        of = nodes.join(parts, "node", "left").select("node", F.coalesce("root", "node").alias("part"), "size")
        named = shared.join(of, "node").select("h", "node", "part", "size")
        mixed = named.groupBy("h").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("h")
        rows = written(near_in_size(named.join(mixed, "h")), "across")
        done.append(rows)
        of = rows.groupBy("node").agg(F.first("part").alias("part"), F.first("size").alias("size"), F.collect_list("h").alias("hs")).withColumn("need", need)
        lists = written(of.where("size(hs) >= need"), "lists")
        done.append(lists)
        counted = lists.select("node", "size", "need", F.explode("hs").alias("h"))
        held = counted.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        own = Window.partitionBy("node")
        placed = counted.join(held, "h").withColumn("place", F.row_number().over(own.orderBy("n", "h"))).withColumn("m", F.count(F.lit(1)).over(own))
        sized = placed.where("place <= m - need + 1").select("h", "size", "node").repartition(width, "h").sortWithinPartitions("h", "size", "node")
        every = written(sized.mapInArrow(_by_size, "grp long, n long, node long").distinct(), "groups")
        most = largest(every)
        left = every.join(most, "node").groupBy("grp").agg(F.min("most").alias("low"), F.max("most").alias("high"), F.count("most").alias("m"), F.max("n").alias("n"))
        alone = left.where(~((F.col("m") == F.col("n")) & (F.col("low") == F.col("high")) & (F.col("low") != F.col("grp"))) | F.col("low").isNull()).select("grp")
        several = every.join(alone, "grp").join(lists, "node").select("grp", "node", "part", "size", "hs").repartition(width, "grp").sortWithinPartitions("grp")
        done.append(every)
        return several.mapInArrow(_paired, "grp long, node long").distinct()

    # The known groups first, as what they connect is one part from then on; then the largest group
    # of each node, of those across parts; then the groups that these links leave in several parts.
    found, done = [], [may, sets, shared]
    parts = nodes.select("node", F.col("node").alias("root")).limit(0)
    if known is not None:
        some = known.join(may, "node", "left_semi")
        several = some.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp")
        first = written(some.join(several, "grp", "left_semi"), "known")
        done.append(first)
        found.append(linked(first))
        parts = written(connected_components(found[0]), "parts")
    groups = written(across(parts), "pairs")
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    chosen = written(largest(groups.join(sizes, "grp")).select(F.col("most").alias("grp")).where("grp is not null").distinct(), "chosen")
    found.append(linked(groups.join(chosen, "grp", "left_semi")))
    both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    rest = written(apart(groups.join(chosen, "grp", "left_anti"), connected_components(both)), "rest")
    found.append(linked(rest))
    common.dropped(*done, groups, chosen, rest)
    return both.unionByName(found[-1])


def components(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", known=None) -> DataFrame:
    """doc_id, tie, node, root, component_id of the rows with an id; root names the component, component_id is its smallest id.

    tie is a hash of the row's columns; known makes groups grp, node of the nodes and their fingerprints."""
    of_row = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), of_row.alias("tie"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    schema = "doc_id long, tie long, node long, fp long, size int, prefix array<long>"
    known_shingles, counts = _order(read.select("doc_id", "text"), shingle)
    prefixes = written(read.mapInArrow(partial(_prefixes, shingle=shingle, known=known_shingles, counts=counts), schema), "prefixes")
    nodes = written(prefixes.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("size").alias("size")), "nodes")
    roots = connected_components(similar_links(read.select("doc_id", "text"), prefixes, nodes, shingle, known(prefixes) if known else None))
    least = roots.join(nodes, "node").groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(least, "root")
    every = nodes.join(named, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "first").alias("component_id"))
    # A table of its own, so that Spark can split a hot node's join.
    return prefixes.select("doc_id", "tie", "node").join(written(every, "components"), "node")


_ID, _TIE = "__bindery_id", "__bindery_tie"


def keep_one(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", known=None) -> DataFrame:
    """The rows of docs, with all their columns, of the smallest id of each component.

    Rows of one id and set are one document, of which the row with the least hash of its columns
    stays; if an id has several sets in a component, the smallest node stays. Rows without an id all stay."""
    first = components(docs, shingle, id_col, text_col, known).where("doc_id = component_id")
    one = first.groupBy("root", "component_id").agg(F.min(F.struct("node", "tie")).alias("row"))
    stay = written(one.select(F.col("component_id").alias(_ID), F.col("row.tie").alias(_TIE)), "stay")
    of_row = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    tied = docs.where(F.col(id_col).isNotNull()).select("*", F.col(id_col).cast("long").alias(_ID), of_row.alias(_TIE))
    kept = tied.join(stay, [_ID, _TIE], "left_semi").dropDuplicates([_ID, _TIE])
    return kept.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
