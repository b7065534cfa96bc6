"""Best-fit packing of tokenised documents by bin completion with branch and bound.

A sequence's filling depends on lengths alone, so the search runs on the histogram of lengths
(one count for each length up to the capacity, whatever the corpus), and a filling is used as
often as its lengths last. Around the largest length left, the undominated fillings are
enumerated from the least waste on, one at a time as the depth-first search asks for them: a
filling is dominated if lengths of it could be put together into one that is left, or if one that
is left is larger and fits too. A branch ends where its waste exceeds what the sequences
aimed at leave over. The incumbent is best-fit decreasing at first, and the search aims at one less.

The search over a whole table is cut after NODES nodes. Then ROUNDS searches over a few sequences of
the incumbent each follow, by the same bin completion: free space is a piece of its own, which grows
in one sequence from round to round, until that one is empty. Where the incumbent doesn't reach the
lower bound, solved() says so, and pack() logs it. Pieces then find their places by their
rank among the pieces of their length, from counts per task, so nothing is sorted or gathered.

A document is its ids and an end id. Only one longer than the capacity is cut: into
full pieces after a first one that may be shorter.

Defined results: a null or empty text is the end id alone; rows of equal or null ids are
packed each for itself; no rows give no pieces.
"""

from __future__ import annotations

import logging
import random
import zlib
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .encoder import default_path, encoded, encoder

CAPACITY = 1024
END_ID = 2
#: Nodes of the search over a whole table, and of one over a few sequences.
NODES = 3000
ROUND_NODES = 200
#: Searches over a few sequences, and how many sequences each has.
ROUNDS = 2500
FEW = (6, 8, 10, 16)

_log = logging.getLogger(__name__)

Pattern = tuple[int, tuple[int, ...]]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences needed at least: by volume, and with lengths over half a sequence for themselves (Martello and Toth)."""
    lengths = np.arange(len(counts))
    total, best = int((lengths * counts).sum()), 0
    best = -(-total // capacity)
    ahead, volume = np.concatenate((np.cumsum(counts[::-1])[::-1], [0])), np.concatenate((np.cumsum((lengths * counts)[::-1])[::-1], [0]))
    k, half = np.arange(capacity // 2 + 1), capacity // 2 + 1
    above = np.minimum(len(counts), capacity - k + 1)
    large = ahead[above]
    middle = ahead[min(half, len(counts))] - large
    small = volume[np.minimum(k, len(counts))] - volume[min(half, len(counts))]
    room = middle * capacity - (volume[min(half, len(counts))] - volume[above])
    return max(best, int((large + middle + np.maximum(0, -((room - small) // capacity))).max()))


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[Pattern]:
    open_: dict[int, list[list]] = defaultdict(list)  # room -> [lengths, how often]
    for length in range(len(counts) - 1, 0, -1):
        left = int(counts[length])
        for room in range(length, capacity):
            while left and open_[room]:
                pattern, times = open_[room].pop()
                m = min(times, left)
                if times > m:
                    open_[room].append([pattern, times - m])
                open_[room - length].append([(*pattern, length), m])
                left -= m
            if not left:
                break
        each = capacity // length
        if left // each:
            open_[capacity - each * length].append([(length,) * each, left // each])
        if left % each:
            open_[capacity - (left % each) * length].append([(length,) * (left % each), 1])
    return [(times, pattern) for group in open_.values() for pattern, times in group]


def fillings(have: list[int], largest: int, room: int, slack: int, steps: list[int]):
    """Undominated fillings beside a piece of the largest length, with waste up to slack, the least first.

    have: counts without that piece; they are changed and restored while the generator runs.
    steps[0] counts down the lengths tried."""
    lengths = [x for x in range(min(room, largest), 0, -1) if have[x]]
    if not lengths:
        if room <= slack:
            yield ()
        return
    # Bit t of reach[j] tells whether lengths[j:] can have the sum t.
    mask, sums, reach = (1 << room + 1) - 1, 1, [0] * len(lengths)
    for j in range(len(lengths) - 1, -1, -1):
        x, left, k = lengths[j], min(have[lengths[j]], room // lengths[j]), 1
        while left > 0:
            sums |= sums << min(k, left) * x & mask
            left -= k
            k *= 2
        reach[j] = sums
    there = sum(1 << x for x in lengths)

    def combine(target: int, j: int):
        if not target:
            yield ()
        for i in range(j, len(lengths) if target else j):
            x = lengths[i]
            if not reach[i] >> target & 1:
                return
            if x > target or not have[x] or not reach[i] >> target - x & 1:
                continue
            steps[0] -= 1
            have[x] -= 1
            for rest in combine(target - x, i):
                have[x] += 1
                yield (x, *rest)
                have[x] -= 1
            have[x] += 1

    for target in range(room, max(lengths[0], room - slack) - 1, -1):
        if reach[0] >> target & 1:
            for f in combine(target, 0):
                left, some, several = there, 1, 0  # sums of any pieces of f, and of two or more
                for x in f:
                    several |= several << x | (some & ~1) << x
                    some |= some << x
                for x in set(f):
                    if have[x] <= f.count(x):
                        left &= ~(1 << x)
                if not several & left and not any(some << d & left for d in range(1, room - target + 1)):
                    yield f


def search(counts, target: int, nodes: int, capacity: int = CAPACITY) -> tuple[list[Pattern] | None, bool]:
    """Fillings of at most target sequences, or None; and whether that is proven."""
    have = [int(n) for n in counts]
    steps, slack = [60 * nodes], target * capacity - sum(x * n for x, n in enumerate(have))
    if slack < 0:
        return None, True
    stack: list[list] = []  # largest length, its fillings, the filling in use and how often

    def opened() -> bool:
        top = stack[-1][0] if stack else capacity
        while top and not have[top]:
            top -= 1
        if top:
            stack.append([top, fillings(have, top, capacity - top, slack, steps), None, 0])
        return bool(top)

    def use(pattern: tuple[int, ...], times: int) -> None:
        nonlocal slack
        for x in pattern:
            have[x] -= times
        slack -= (capacity - sum(pattern)) * times

    if not opened():
        return [], True
    while stack:
        node = stack[-1]
        top, choices, pattern, times = node
        nodes -= 1
        if nodes < 0 or steps[0] < 0:
            return None, False
        if times > 1:  # the same filling once less, and another for the rest
            use(pattern, -1)
            node[3] -= 1
        else:
            if times:
                use(pattern, -1)
            node[2:] = None, 0
            have[top] -= 1
            f = next(choices, None)
            have[top] += 1
            if f is None:
                stack.pop()
                continue
            pattern = (top, *f)
            waste = capacity - sum(pattern)
            times = min([have[x] // pattern.count(x) for x in set(pattern)] + ([slack // waste] if waste else []))
            if times < 1:
                continue
            use(pattern, times)
            node[2:] = pattern, times
        if not opened():
            return [(n[3], n[2]) for n in stack], True
    return None, True


def _improved(best: list[Pattern], bound: int, capacity: int, rounds: int) -> list[Pattern]:
    """best, or fewer sequences: a few at a time are packed anew, so that free space gathers in one."""
    rng, pool = random.Random(0), Counter()
    for times, pattern in best:
        pool[tuple(pattern)] += times
    spare = min(pool, key=lambda p: (sum(p), p))
    for k in range(rounds):
        if sum(pool.values()) <= bound:
            break
        few = rng.choice(FEW)
        others = sorted(p for p, m in pool.items() if sum(p) < capacity and (p != spare or m > 1))
        some = rng.sample(others, min(len(others), few // 2))
        full = sorted(p for p in pool if sum(p) == capacity and len(p) > 1)
        some += rng.sample(full, min(len(full), few - 1 - len(some)))
        free = capacity - sum(spare)
        waste = sum(capacity - sum(p) for p in some)
        goal = min(capacity, free + (waste if k % 2 else max(1, waste // 2)))
        if not waste:
            continue
        counts = [0] * (capacity + 1)
        for x in (x for p in (spare, *some) for x in p):
            counts[x] += 1
        if goal < capacity:
            counts[goal] += 1
        found, _ = search(counts, len(some) + (goal < capacity), ROUND_NODES, capacity)
        if found is None:
            continue
        taken = Counter([spare, *some])
        often = min(pool[p] // m for p, m in taken.items())  # as often as these sequences are there
        made = [p for times, p in found for _ in range(times)]
        if goal < capacity:
            at = next(j for j, p in enumerate(made) if goal in p)
            kept = list(made.pop(at))
            kept.remove(goal)
            made += [tuple(kept)] if kept else []
        for p, m in taken.items():
            pool[p] -= m * often
        for p in made:
            pool[p] += often
        pool = +pool
        spare = min(pool, key=lambda p: (sum(p), p))
    return [(m, p) for p, m in pool.items()]


def solved(counts, capacity: int = CAPACITY, nodes: int = NODES, rounds: int = ROUNDS) -> tuple[list[Pattern], int, bool]:
    """(how often, lengths) of the fillings, the lower bound, and whether they are proven to be the fewest.

    Every counted length is used exactly."""
    counts = np.asarray(counts, np.int64)
    bound, best = lower_bound(counts, capacity), best_fit_decreasing(counts, capacity)
    proven = False
    while not proven:
        n = sum(m for m, _ in best)
        if n <= bound:
            return best, bound, True
        found, proven = search(counts, n - 1, nodes, capacity)
        if found is None:
            break
        best, proven = found, False
    if proven:
        return best, bound, True
    fewer = _improved(best, bound, capacity, rounds)
    return fewer, bound, sum(m for m, _ in fewer) <= bound


def solve(counts, capacity: int = CAPACITY, nodes: int = NODES) -> list[Pattern]:
    """The fillings of solved()."""
    return solved(counts, capacity, nodes)[0]


def _pieces(batches, path: str, end_id: int, capacity: int, with_ids: bool):
    from pyspark import TaskContext

    enc, task, ranks = encoder(path), TaskContext.get().partitionId(), defaultdict(int)
    end = end_id.to_bytes(4, "little")
    for batch in batches:
        out = []
        for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(enc, common.texts_of(batch))):
            raw = ids + end
            n = len(raw) // 4
            cut = [0, *range(n % capacity or capacity, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(cut, cut[1:])):
                ids = raw[4 * a : 4 * b]
                out.append((doc_id, k, a, b - a, zlib.crc32(ids), task, ranks[b - a], ids if with_ids else None))
                ranks[b - a] += 1
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()][: 7 + with_ids]
        columns = list(zip(*out)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", "ids"][: 7 + with_ids])


def _places(best: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank, the first sequence and the offset of each of its places."""
    made, next_rank, sequence = defaultdict(list), defaultdict(int), 0
    for times, pattern in best:
        offset = 0
        for length in pattern:
            made[length].append((next_rank[length], sequence, offset))
            next_rank[length] += times
            offset += length
        sequence += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in made.items()}


def _placed(batches, places: dict, columns: list[str]):
    for batch in batches:
        name = batch.schema.get_field_index
        length, rank = np.asarray(batch.column(name("length"))), np.asarray(batch.column(name("at")))
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for x in np.unique(length):
            which = np.flatnonzero(length == x)
            begin, first, shift = places[int(x)]
            slot = np.searchsorted(begin, rank[which], "right") - 1
            sequence[which] = first[slot] + rank[which] - begin[slot]
            offset[which] = shift[slot]
        yield pa.RecordBatch.from_arrays([*(batch.column(name(c)) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian 32-bit)."""
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids binary" * with_ids
    work = partial(_pieces, path=tokenizer or default_path(), end_id=end_id, capacity=capacity, with_ids=with_ids)
    pieces = common.written(common.id_and_text(docs, id_col, text_col).mapInArrow(work, kinds), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        counts[r.length] = r.n
    best, bound, proven = solved(counts, capacity)
    if not proven:
        _log.warning("%d sequences; no fewer than %d are possible", sum(m for m, _ in best), bound)
    places = _places(best)
    ahead = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("length", "task", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "task"]).withColumn("at", F.col("rank") + F.col("base"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(partial(_placed, places=places, columns=columns), schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
