"""SimHash near-deduplication with pigeonring candidate filtering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import materialise, small, text_batches
from inkwell.llm.graph import connected_components

SEED = 42
SEGMENTS = 8  # of 8 bits, on a ring
DISTANCE = 3
HELD = 8192  # fingerprints of a bucket that are compared in one task
_BLOCK = 1 << 16  # shingles voted at once: 4 MB whatever the text's length


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = SEED) -> int:
    """The 64-bit SimHash of a UTF-8 text: a bit is 1 if set in over half of the shingles' XXH64.

    A-Z are lower-cased; words are runs of anything but ASCII white space. Fewer words than a
    shingle: one shingle of the whole sequence. None (null, empty or blank text): 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, seed) for g in grams), dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``digest`` (64 bits of the text's hash), ``fp`` (the fingerprint's bits as a
    signed long) of every row; a narrow map."""

    def run(batches):
        for b in batches:
            texts = b.column(2).cast(pa.binary()).to_pylist()
            fps = np.fromiter((fingerprint(t, shingle, seed) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "digest", "fp"])

    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    return text_batches(src).mapInArrow(run, "doc_id long, digest long, fp long")


def _chain_keys() -> list:
    """The exact keys of the chains' first five segments, as longs.

    Over a ring of 8 segments that differ in 3 bits together, some start has every chain of l
    segments within floor(3 l / 8): none in the first two, one at most in the first five, two
    at most in the first seven. So two of the segments 3 to 5 agree besides the first two: four
    equal segments, 32 bits, for 8 starts and 3 places of the odd one out.
    """
    seg = [F.shiftrightunsigned(F.col("fp"), 8 * i).bitwiseAND(F.lit(255)) for i in range(SEGMENTS)]
    keys = []
    for start in range(SEGMENTS):
        for odd in range(2, 5):
            key = F.lit(start * 3 + odd - 2).cast("long")
            for at in (x for x in range(5) if x != odd):
                key = F.shiftleft(key, 8).bitwiseOR(seg[(start + at) % SEGMENTS])
            keys.append(key)
    return keys


def within_budgets(a: np.ndarray, b: np.ndarray, start: np.ndarray | int, distance: int = DISTANCE) -> np.ndarray:
    """Whether the chain from segment ``start`` keeps to its budgets at every length, the whole
    ring (the full Hamming check) included."""
    x = np.bitwise_xor(a, b)
    turn = np.asarray(start, dtype=np.uint64) * np.uint64(8)
    x = (x >> turn) | (x << ((np.uint64(64) - turn) & np.uint64(63))) if np.any(turn) else x
    ok = np.ones(x.shape, dtype=bool)
    for length in range(1, SEGMENTS + 1):
        mask = np.uint64((1 << (8 * length)) - 1)
        ok &= np.bitwise_count(x & mask) <= distance * length // SEGMENTS
    return ok


def _group_links(fps: np.ndarray, reps: np.ndarray, start: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the chain from ``start`` connects in one bucket: a forest, not
    all pairs. Each step compares one fingerprint with those not reached yet."""
    out = []
    left = np.arange(len(fps))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = within_budgets(fps[at], fps[left], start)
            found = left[hit]
            if len(found):
                out.append((np.full(len(found), reps[at]), reps[found]))
                queue.extend(found)
                left = left[~hit]
    return out


def _further(mask: int) -> list[int]:
    """``mask`` with one of four parts of its other bits more: of 3 differing bits, none is in one
    of the parts."""
    rest = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << int(i) for i in part) for part in np.array_split(rest, DISTANCE + 1)]


def _first_masks() -> dict[int, int]:
    """The exact bits of each of the 24 kinds of first keys."""
    out = {}
    for start in range(SEGMENTS):
        for odd in range(2, 5):
            segments = [(start + at) % SEGMENTS for at in range(5) if at != odd]
            out[start * 3 + odd - 2] = sum(255 << 8 * i for i in segments)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bucket_links(parse, held_rows: int):
    """Buckets arrive sorted; one that runs over batches is carried. ``parse`` gives a batch's
    grouping columns, fingerprints, starts and masks. Out come links (``start`` -1) and, of
    buckets of more than ``held_rows`` fingerprints, the rows themselves: ``u`` the fingerprint, ``v``
    the mask of its exact bits."""

    def batch(us, vs, starts):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(us).view(np.int64)), pa.array(np.concatenate(vs).view(np.int64)), pa.array(np.concatenate(starts).astype(np.int32))],
            names=["u", "v", "start"],
        )

    def buckets(edge, fps, starts, masks):
        lo, hi = np.r_[0, edge], np.r_[edge, len(fps)]
        size = hi - lo
        us, vs, kinds = [], [], []

        def put(u, v, kind):
            us.append(u)
            vs.append(v)
            kinds.append(kind)

        two = lo[size == 2]
        if len(two):
            ok = two[within_budgets(fps[two], fps[two + 1], starts[two].astype(np.uint64))]
            put(fps[ok], fps[ok + 1], np.full(len(ok), -1))
        for i in np.flatnonzero(size > 2):
            part = slice(lo[i], hi[i])
            if size[i] > held_rows:
                put(fps[part], masks[part], starts[part])
                continue
            for u, v in _group_links(fps[part], fps[part], int(starts[lo[i]])):
                put(u, v, np.full(len(u), -1))
        if us and sum(map(len, us)):
            yield batch(us, vs, kinds)

    def run(batches):
        held, flood = None, None  # flood: the bucket whose rows go out as they come
        for b in batches:
            if not b.num_rows:
                continue
            part = parse(b)
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part)]
            *keys, fps, starts, masks = part
            if flood is not None:
                other = np.flatnonzero(np.any([k != f for k, f in zip(keys, flood)], axis=0))
                at = int(other[0]) if len(other) else len(fps)
                if at:
                    yield batch([fps[:at]], [masks[:at]], [starts[:at]])
                    part = [x[at:] for x in part]
                    *keys, fps, starts, masks = part
                if not len(fps):
                    held = None
                    continue
                flood = None
            edge = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
            cut = int(edge[-1]) if len(edge) else 0  # the last bucket may go on
            if cut:
                yield from buckets(edge[:-1], fps[:cut], starts[:cut], masks[:cut])
            held = [x[cut:] for x in part]
            if len(held[0]) > held_rows:
                flood = [k[cut] for k in keys]
                yield batch([fps[cut:]], [masks[cut:]], [starts[cut:]])
                held = None
        if held is not None:
            *keys, fps, starts, masks = held
            yield from buckets(np.zeros(0, dtype=np.int64), fps, starts, masks)

    return run


def _parse_first(b: pa.RecordBatch) -> list[np.ndarray]:
    key, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
    kind = key >> 32
    return [key, fp.view(np.uint64), kind // 3, np.array([_first_masks()[i] for i in range(24)], dtype=np.uint64)[kind]]


def _parse_next(b: pa.RecordBatch) -> list[np.ndarray]:
    start, mask, bits, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
    return [start, mask, bits, fp.view(np.uint64), start, mask.view(np.uint64)]


def near_links(distinct: DataFrame, held_rows: int = HELD) -> DataFrame:
    """Links ``u``, ``v`` between fingerprints at 3 bits or fewer.

    ``distinct`` has each ``fp`` once. Links that the forest of a bucket implies are left out;
    components are those of all links. Each fingerprint goes to 24 buckets of 32 exact bits. A
    bucket of more than ``held_rows`` fingerprints is dealt out again over four keys of 40 exact
    bits, then 46, 50 and so on, one of which any of its links shares; the bits left bound the
    buckets. Tasks hold ``held_rows`` fingerprints of a bucket and a batch at most.
    """
    schema = "u long, v long, start int"
    keyed = distinct.select(F.explode(F.array(*_chain_keys())).alias("key"), "fp")
    keyed = keyed.repartition("key").sortWithinPartitions("key")
    found = materialise(keyed.mapInArrow(_bucket_links(_parse_first, held_rows), schema), "links")
    links, masks = found.where("start < 0"), set(_first_masks().values())
    while found.where("start >= 0").limit(1).count():
        following = {m: _further(m) for m in masks}
        table = F.create_map(*[x for m, f in following.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in f]))])
        rows = found.where("start >= 0").select("start", F.explode(table[F.col("v")]).alias("mask"), F.col("u").alias("fp"))
        rows = rows.select("start", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), "fp").distinct()
        rows = rows.repartition("start", "mask", "bits").sortWithinPartitions("start", "mask", "bits")
        found = materialise(rows.mapInArrow(_bucket_links(_parse_next, held_rows), schema), "links")
        links, masks = links.unionByName(found.where("start < 0")), {y for f in following.values() for y in f}
    return links.select("u", "v")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``digest``, ``fp``, ``group`` (the smallest fingerprint of its component) and
    ``component_id`` (its smallest ``doc_id``, null if none has one) of every row.

    Components are those of fingerprints, so rows that share an id but no text stay apart.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, shingle, seed), "fp")
    reps = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fp-rep")
    parts = connected_components(near_links(reps.select("fp")))
    grouped = materialise(reps.join(parts, reps["fp"] == parts["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("group")), "fp-group")
    least = grouped.groupBy(F.col("group").alias("_group")).agg(F.min("rep").alias("component_id"))
    labelled = grouped.join(least, F.col("group") == F.col("_group")).select(F.col("fp").alias("_fp"), "group", "component_id")
    labelled = materialise(labelled, "fp-label")
    return fps.join(labelled, fps["fp"] == labelled["_fp"]).select("doc_id", "digest", "fp", "group", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` of every row.

    Fingerprints link at 3 or fewer differing bits; ``component_id`` is the smallest ``doc_id``
    reachable. Null, empty and blank texts have fingerprint zero and link like any other.
    Repeated rows and copies collapse to one fingerprint before any pairing, so a large group of
    copies costs one node. A null ``doc_id`` keeps its row; its component is the smallest id
    reachable, null if there is none. Only the id and text columns are read, so others may have
    any name. An empty table gives an empty result.
    """
    groups = near_groups(docs, id_col, text_col, shingle, seed)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = SEED) -> DataFrame:
    """``docs`` with one row of each SimHash group: the one with the smallest id (rows without an
    id come last), of one id the text with the smallest hash, of rows alike in both the first by
    their other columns. Every group keeps a row, whatever ids repeat in it.

    Rows that go are found by id and text hash, an anti join that is broadcast if they are few;
    rows alike in both are collapsed by an aggregate, so a third of all rows may be alike.
    """
    groups = materialise(near_groups(docs, id_col, text_col, shingle, seed).select("doc_id", "digest", "group"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    first = groups.groupBy("group").agg(F.min(order).alias("f")).select(F.col("f.doc_id").alias("_id"), F.col("f.digest").alias("_digest"), F.lit(True).alias("stays"))
    # an id and text are of one group, so the first ones are found by them, not by a group that may hold a third of all rows
    pairs = groups.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    rows = pairs.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    rows = rows.select(F.col("doc_id").alias("_near_id"), F.col("digest").alias("_near_digest"), "n", F.coalesce("stays", F.lit(False)).alias("stays"))
    rows = materialise(rows.where("n > 1 or not stays"), "rows")
    # a row travels in one struct, so that none of its columns can clash with those made here
    names = docs.columns
    carried = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("own_id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("own_digest")
    )
    own = F.col("own_id").eqNullSafe(F.col("_near_id")) & (F.col("own_digest") == F.col("_near_digest"))
    rest = carried.join(small(rows), own, "left_anti").select("row")
    again = rows.where("stays and n > 1")
    if again.limit(1).count():
        alike = carried.join(small(again), own)
        comparable = not any("map<" in kind or "variant" in kind for _, kind in docs.dtypes)
        one = alike.groupBy("_near_id", "_near_digest").agg((F.min if comparable else F.first)("row").alias("row"))
        rest = rest.unionByName(one.select("row"))
    return rest.select(*[F.col("row").getField(c).alias(c) for c in names])
