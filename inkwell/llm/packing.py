"""Best-fit packing of token sequences by bin completion."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import tokens
from inkwell.llm.common import materialise, small, text_batches

CAPACITY = 4096
_encoders: dict = {}


def pieces(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False
) -> DataFrame:
    """Tokenize every whole text, append ``end_id`` and cut into pieces of at most ``capacity``.

    Columns ``doc_id``, ``piece`` (from 0), ``start`` (the document's ids before it), ``length``,
    ``ids_crc32`` (of its little-endian unsigned 32-bit ids) and, if asked for, ``ids``. Null and
    empty texts are the end id alone, one piece of length 1. Only longer documents are cut; the
    last piece may be shorter. A narrow map; repeated rows repeat.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches):
        if path not in _encoders:
            _encoders[path] = tokens.make_id_encoder(path)
        encode, end, step = _encoders[path], end_id.to_bytes(4, "little"), 4 * capacity
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = encode(text) + end
                for at in range(0, len(data), step):
                    part = data[at : at + step]
                    rows.append((doc, at // step, at // 4, len(part) // 4, zlib.crc32(part)) + ((np.frombuffer(part, "<u4").astype(np.int64),) if with_ids else ()))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            cols = list(zip(*rows)) or [[]] * (5 + with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return text_batches(src).mapInArrow(run, schema)


def undominated_fillings(largest: int, counts: dict[int, int], capacity: int, limit: int):
    """Fillings of a bin around its ``largest`` item: of all, the ``limit`` with the least waste.

    A filling is a tuple of (length, times) in descending length. One is dominated if another
    item still left would fit into its rest, so only maximal ones come. Sums that can be reached
    are bits of integers, one a length, so each waste is tried in turn and only fillings that
    have it are walked; of equal waste, those with fewer short items come first.
    """
    room = capacity - largest
    lengths = sorted((x for x, n in counts.items() if x <= room and n > (x == largest)), reverse=True)
    left = [counts[x] - (x == largest) for x in lengths]
    mask, reach = (1 << (room + 1)) - 1, [1]  # reach[j]: the sums of lengths[:j]
    for x, n in zip(lengths, left):
        sums, n, part = reach[-1], min(n, room // x), 1
        while n:
            part = min(part, n)
            sums |= sums << (part * x) & mask
            n, part = n - part, 2 * part
        reach.append(sums)

    def walk(i: int, need: int, chosen: tuple):
        if not need:
            yield chosen
            return
        first = bisect_left(reach, 1, 0, i, key=lambda sums: sums >> need & 1)
        for j in range(first, i + 1):  # lengths[j - 1] is the shortest in it; the longer ones come first
            x = lengths[j - 1]
            for k in range(1, min(left[j - 1], need // x) + 1):
                if reach[j - 1] >> (need - k * x) & 1:
                    yield from walk(j - 1, need - k * x, ((x, k), *chosen))

    def by_waste():
        j, forced, filled = len(lengths), (), 0  # what would fit into the waste is all in the bin
        for waste in range(room + 1):
            while j and lengths[j - 1] <= waste:
                j -= 1
                forced, filled = ((lengths[j], left[j]), *forced), filled + lengths[j] * left[j]
            need = room - waste - filled
            if need < 0:
                return
            if reach[j] >> need & 1:
                yield from walk(j, need, forced)

    return list(islice(by_waste(), limit))


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple]]:
    """Best-fit decreasing over a histogram: (times, filling) with filling of (length, times).

    Works on groups of like bins, so its time and result grow with the number of lengths, never
    with the number of items: a length splits at most one group and opens at most two, so there
    are at most 3 groups for each of the ``capacity`` lengths.
    """
    by_room: dict[int, list[list]] = {}  # room -> groups [times, filling]
    rooms: list[int] = []  # the keys of by_room, sorted

    def put(room: int, times: int, filling: tuple) -> None:
        if room not in by_room:
            by_room[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        by_room[room].append([times, filling])

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n and (at := bisect_left(rooms, length)) < len(rooms):
            room = rooms[at]
            groups = by_room[room]
            times, filling = groups.pop()
            if not groups:
                del by_room[room], rooms[at]
            fit = room // length  # best fit goes on filling the same bin: its room only shrinks
            if n >= times * fit:
                put(room - fit * length, times, filling + ((length, fit),))
                n -= times * fit
                continue
            full, rest = divmod(n, fit)
            if full:
                put(room - fit * length, full, filling + ((length, fit),))
            if rest:
                put(room - rest * length, 1, filling + ((length, rest),))
            if times - full - bool(rest):
                put(room, times - full - bool(rest), filling)
            n = 0
        if n:
            per = capacity // length
            full, rest = divmod(n, per)
            if full:
                put(capacity - per * length, full, ((length, per),))
            if rest:
                put(capacity - rest * length, 1, ((length, rest),))
    return [(times, filling) for groups in by_room.values() for times, filling in groups]


def best_fit_bins(counts: dict[int, int], capacity: int, enough: int) -> int:
    """The number of bins of ``best_fit``, or any number from ``enough`` on if it is that or more.

    Bins of equal room are alike for the number, so they are counted together.
    """
    by_room: dict[int, int] = {}
    rooms: list[int] = []  # the keys of by_room, sorted; rooms that no length fits into are left out
    bins, least = 0, min(counts, default=0)

    def put(room: int, times: int) -> None:
        if room < least or not times:
            return
        if room not in by_room:
            by_room[room] = times
            insort(rooms, room)
        else:
            by_room[room] += times

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n and (at := bisect_left(rooms, length)) < len(rooms):
            room = rooms.pop(at)
            times, fit = by_room.pop(room), room // length
            full = min(times, n // fit)
            put(room - fit * length, full)
            n -= full * fit
            if full < times:
                put(room - n * length, 1 if n else 0)
                put(room, times - full - (n > 0))
                n = 0
        if n:
            per = capacity // length
            full, rest = divmod(n, per)
            bins += full + (rest > 0)
            if bins >= enough:
                return bins
            put(capacity - per * length, full)
            put(capacity - rest * length, 1 if rest else 0)
    return bins


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing has fewer bins: the volume bound and, for every threshold, the bound that
    items above capacity - k stand alone and those over half share no bin."""
    if not counts:
        return 0
    lengths = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[x] for x in lengths.tolist()], dtype=np.int64)
    number, volume = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * lengths)])
    bound = -(-int(volume[-1]) // capacity)
    half = int(np.searchsorted(lengths, capacity // 2, side="right"))
    if half:
        big = np.searchsorted(lengths, capacity - lengths[:half], side="right")  # from here on: alone but for items under k
        alone, halves = number[-1] - number[big], number[big] - number[half]
        rest = np.maximum(0, volume[half] - volume[:half] - (halves * capacity - (volume[big] - volume[half])))
        bound = max(bound, int((alone + halves - (-rest // capacity)).max()))
    return bound


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, evaluations: int = 48_000, width: int = 24) -> list[tuple[int, tuple]]:
    """Pack a histogram of lengths: the best of best-fit and a branch-and-bound by bin completion.

    The best-fit packing is the incumbent; if it meets the lower bound it is optimal and no
    search is needed. Otherwise each node fills bins around the largest length left with one of
    the undominated fillings (the ``width`` with the least waste), as often as the counts allow,
    and is pruned when the bins so far and the lower bound of the rest reach the incumbent. Best
    fit completes every node, so each may give a new incumbent. The search goes depth first and
    ends at the lower bound, when all is tried, or after ``evaluations`` nodes (2000 times 24)
    without a new incumbent; the result is always whole. What is left is made again from the
    steps to a node, so only steps are held.
    """
    counts = {x: n for x, n in counts.items() if n}
    if not counts:
        return []
    best, bound = best_fit(counts, capacity), lower_bound(counts, capacity)
    fewest, budget = sum(t for t, _ in best), evaluations

    def take(left: dict[int, int], times: int, filling: tuple) -> None:
        for x, k in filling:
            left[x] -= times * k
            if not left[x]:
                del left[x]

    def steps(node: tuple | None):
        while node:
            yield node[:2]
            node = node[3]

    def children(node: tuple | None, left: dict[int, int]):
        if left:
            largest = max(left)
            for filling in reversed(undominated_fillings(largest, left, capacity, width)):
                need = dict(filling)
                need[largest] = need.get(largest, 0) + 1
                yield node, tuple(sorted(need.items(), reverse=True))

    left, at = dict(counts), None  # a node is (times, filling, bins so far, the node before)
    stack = [*children(at, left)]
    while stack and budget > 0 and fewest > bound:
        parent, filling = stack.pop()
        budget -= 1
        if parent is not at:
            left = dict(counts)
            for step in steps(parent):
                take(left, *step)
        times = min(left[x] // k for x, k in filling)
        take(left, times, filling)
        used = times + (parent[2] if parent else 0)
        at = (times, filling, used, parent)
        if used + lower_bound(left, capacity) >= fewest:
            continue
        total = used + best_fit_bins(left, capacity, fewest - used)
        if total < fewest:
            best, fewest, budget = [*steps(at), *best_fit(left, capacity)], total, evaluations
        stack.extend(children(at, left))
    return best


def slots(plan: list[tuple[int, tuple]]) -> list[tuple[int, int, int, int, int]]:
    """The plan as rows (length, first rank, times in a bin, first sequence, offset): the items of
    a length are handed out in rank order."""
    given: dict[int, int] = {}
    out, sequence = [], 0
    for times, filling in plan:
        offset = 0
        for length, k in filling:
            out.append((length, given.get(length, 0), k, sequence, offset))
            given[length] = given.get(length, 0) + times * k
            offset += length * k
        sequence += times
    return out


def ranked(items: DataFrame, spread: int) -> DataFrame:
    """``items`` (with a column ``length``) with ``rank``, from 0, among those of the same length.

    Ranks are counted within (length, one of ``spread`` hash classes) and offset by running
    counts of the classes, so a length that most items share is not one task's.
    """
    w = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(spread)).cast("int"))
    counts = items.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(
        F.col("length").alias("_l"), F.col("salt").alias("_s"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base")
    )
    base = small(materialise(base, "rank-base"))
    numbered = items.withColumn("_n", F.row_number().over(w) - 1)
    return (
        numbered.join(base, (F.col("length") == F.col("_l")) & (F.col("salt") == F.col("_s")))
        .withColumn("rank", F.col("_n") + F.col("_base"))
        .drop("_l", "_s", "_base", "_n", "salt")
    )


def pack(items: DataFrame, capacity: int = CAPACITY, **search) -> DataFrame:
    """Place pieces (``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, more) in sequences.

    Adds ``sequence_id`` and ``offset``; sequences are gapless from 0 and hold at most
    ``capacity`` ids. The driver sees only the histogram of lengths, at most ``capacity`` rows
    whatever the input; the plan has at most 3 groups a length and sqrt(2 capacity) lengths a
    group, about a million rows, broadcast as arrays. An empty table gives an empty result;
    repeated rows are items of their own.
    """
    items = materialise(items, "pieces")
    counts = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}
    rows = sorted(slots(bin_completion(counts, capacity, **search)))
    columns = [np.array(c, dtype=np.int64) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 5
    plan = items.sparkSession.sparkContext.broadcast(columns)
    spread = max(8, sum(counts.values()) // 20_000)
    placed = ranked(items, spread)
    names = placed.columns
    li, ri = names.index("length"), names.index("rank")
    schema = placed.drop("rank").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema

    def run(batches):
        length, first, times, sequence, offset = plan.value
        span = int(first.max()) + 2**40 if len(first) else 1
        key = length.astype(object) * span + first if span * (capacity + 1) >= 2**63 else length * span + first
        for b in batches:
            own, rank = b.column(li).to_numpy(zero_copy_only=False), b.column(ri).to_numpy(zero_copy_only=False)
            want = own.astype(object) * span + rank if key.dtype == object else own * span + rank
            at = np.searchsorted(key, want, side="right") - 1
            i = rank - first[at]
            where = [pa.array(sequence[at] + i // times[at]), pa.array(offset[at] + i % times[at] * own)]
            yield pa.RecordBatch.from_arrays([c for k, c in enumerate(b.columns) if k != ri] + where, names=[n for n in names if n != "rank"] + ["sequence_id", "offset"])

    return placed.mapInArrow(run, schema)
