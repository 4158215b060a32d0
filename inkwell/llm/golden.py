"""Golden records: one surviving record a cluster, by a segmented scan over ranges.

Records are range-partitioned by (cluster, RECENT) and numbered in that order, so a cluster of any
size spans as many partitions as it needs. Two folds run over the ranges. The first gives, of each
range, its first and its last cluster only: when the cluster was last updated and which segment
comes first. The driver scans these in order, which tells a range what holds for a cluster that
began before it. The second fold gives each cluster's record, and for clusters that span ranges a
summary a range, which the driver combines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import materialise

#: Sources by falling trust; any other source, and none, come after them, all alike.
TRUST = ("store", "crm", "partner", "web")
STALE_DAYS = 10
_NEVER = np.iinfo(np.int64).max
_FIELDS = {"name": ["name", "client_id"], "email": ["email", "client_id"], "segment": ["segment", "client_id"], "balance": ["balance_cents", "client_id"], "address": ["city", "nation_id", "client_id"]}
_TYPES = {"name": "string", "email": "string", "segment": "string", "balance_cents": "long", "city": "string", "nation_id": "int", "client_id": "long"}
_SUMMARY = "cluster long, pos long, n long, n_stale long, latest long, spans boolean, " + ", ".join(
    f"{f}_key long, " + ", ".join(f"{f}_{c} {_TYPES[c]}" for c in cols) for f, cols in _FIELDS.items()
)


def _solid(c: str) -> Column:
    """A string as it is, or null if it is empty or white space."""
    return F.when(F.col(c).rlike(r"[^\x20\x09-\x0D]"), F.col(c))


def _micros(c: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))


def ordered(records: DataFrame, trust: tuple[str, ...] = TRUST) -> DataFrame:
    """The records in the order (cluster, RECENT), written, with ``pos``, which rises in that order and
    is gapless within a range. Rows alike in RECENT come in the order of all their values' hash."""
    source = F.col("source")
    rank = F.coalesce(*[F.when(source == s, F.lit(i)) for i, s in enumerate(trust)], F.lit(len(trust)))
    amount = F.col("balance")
    finite = ~F.isnan(amount) & (F.abs(amount) < float("inf"))
    cols = "client_id master_id source updated_at name email city nation_id segment balance".split()
    ready = records.select(
        F.coalesce("master_id", "client_id").cast("long").alias("cluster"),
        F.coalesce(-_micros("updated_at"), F.lit(int(_NEVER))).alias("age"),
        rank.cast("long").alias("trust"),
        F.col("client_id").cast("long").alias("client_id"),
        _solid("name").alias("name"),
        _solid("email").alias("email"),
        _solid("city").alias("city"),
        F.col("nation_id").cast("int").alias("nation_id"),
        _solid("segment").alias("segment"),
        F.when(finite, F.floor(amount * 100 + 0.5)).cast("long").alias("balance_cents"),
        F.xxhash64(*cols).alias("same"),
    )
    order = [F.col("cluster").asc_nulls_first(), F.col("age"), F.col("trust"), F.col("client_id").asc_nulls_last(), F.col("same")]
    ranges = ready.repartitionByRange(*order).sortWithinPartitions(*order).drop("same")
    numbered = ranges.select(F.monotonically_increasing_id().alias("pos"), "*", F.length("name").cast("long").alias("name_length"))
    return materialise(numbered, "golden-order")


def _runs(batches):
    """Batches cut wherever ``pos``, their first column, isn't the next number; with each, whether a
    new run begins there. A file may be read in parts and in any order: each part is a run."""
    after = None
    for b in batches:
        pos = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(pos) != 1) + 1).tolist(), len(pos)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                yield b.slice(lo, hi - lo), pos[lo] != after
                after = pos[hi - 1] + 1


def _starts(cluster: pa.Array) -> np.ndarray:
    """Where clusters begin in a sorted column, null being one of them."""
    null, value = cluster.is_null().to_numpy(zero_copy_only=False), cluster.fill_null(0).to_numpy()
    return np.concatenate([[0], np.flatnonzero((value[1:] != value[:-1]) | (null[1:] != null[:-1])) + 1])


def _least(key: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each group the least key and the first row that has it; keys of ``_NEVER`` count as none."""
    least = np.minimum.reduceat(key, starts)
    has = key == np.repeat(least, np.diff([*starts, len(key)]))
    return least, np.minimum.reduceat(np.where(has, np.arange(len(key)), len(key)), starts)


def _known(column: pa.Array) -> np.ndarray:
    return column.is_valid().to_numpy(zero_copy_only=False)


def _edges(batches):
    """First fold, over (pos, cluster, age, segment): ``cluster``, ``pos``, ``latest``, ``segment`` of the
    first and the last cluster of each run. It holds one row between batches."""
    names = ["cluster", "pos", "latest", "segment"]
    first = last = None

    def out(rows):
        return pa.RecordBatch.from_pylist(rows, pa.schema([("cluster", pa.int64()), ("pos", pa.int64()), ("latest", pa.int64()), ("segment", pa.string())]))

    for b, new in _runs(batches):
        pos, cluster, age, segment = (b.column(i) for i in range(4))
        starts = _starts(cluster)
        _, at = _least(np.where(_known(segment), 0, _NEVER), starts)
        found = []
        for i in dict.fromkeys((0, len(starts) - 1)):
            j = int(starts[i])
            found.append(dict(zip(names, (cluster[j].as_py(), pos[j].as_py(), age[j].as_py(), segment[int(at[i])].as_py()))))
        if new:
            if first:
                yield out([first] if first is last else [first, last])
            first, last = found[0], found[-1]
            continue
        if found[0]["cluster"] == last["cluster"]:
            last["segment"] = found[0]["segment"] if last["segment"] is None else last["segment"]
        else:
            last = found[0]
        if len(found) > 1:
            last = found[1]
    if first:
        yield out([first] if first is last else [first, last])


def spanning(rows: DataFrame) -> dict:
    """Of the clusters that begin or go on in more than one run: ``(latest, segment)``. At most one a run,
    whatever the number of records; the driver scans the runs' edges in order."""
    edges = rows.select("pos", "cluster", "age", "segment").mapInArrow(_edges, "cluster long, pos long, latest long, segment string").collect()
    found, several = {}, set()
    for r in sorted(edges, key=lambda r: r["pos"]):
        if r["cluster"] in found:
            several.add(r["cluster"])
            latest, segment = found[r["cluster"]]
            found[r["cluster"]] = (latest, r["segment"] if segment is None else segment)
        else:
            found[r["cluster"]] = (r["latest"], r["segment"])
    return {c: found[c] for c in several}


def _merge(a: dict, b: dict) -> dict:
    """Two summaries of a cluster, ``a`` of the earlier records: each field from the lesser key, ``a`` if equal."""
    out = a | {"n": a["n"] + b["n"], "n_stale": a["n_stale"] + b["n_stale"]}
    for field, cols in _FIELDS.items():
        if b[f"{field}_key"] < a[f"{field}_key"]:
            out |= {k: b[k] for k in [f"{field}_key", *(f"{field}_{c}" for c in cols)]}
    return out


def _summaries(b: pa.RecordBatch, held: dict | None, across: dict, stale_after: int) -> pa.Table:
    """A summary of each cluster of a batch. ``held`` is that of a cluster which its first rows may go
    on with; ``across`` has what is known of clusters that span runs."""
    col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
    starts = _starts(col["cluster"])
    sizes = np.diff([*starts, b.num_rows])
    clusters = col["cluster"].take(pa.array(starts)).to_pylist()
    age, trust = col["age"].to_numpy(), col["trust"].to_numpy()
    segment_key, segment_at = _least(np.where(_known(col["segment"]), 0, _NEVER), starts)

    latest, chosen = age[starts], col["segment"].take(pa.array(segment_at)).to_pylist()
    for i, c in enumerate(clusters if across else clusters[:1]):
        if c in across:
            latest[i], chosen[i] = across[c]
        elif i == 0 and held and held["cluster"] == c:
            latest[i], chosen[i] = held["latest"], chosen[i] if held["segment_segment"] is None else held["segment_segment"]
    each = np.repeat(latest, sizes)
    stale = (age == _NEVER) | (np.where(age == _NEVER, 0, age) - np.where(each == _NEVER, 0, each) > stale_after)
    trusted = stale * 2**16 + trust
    same = pc.fill_null(pc.equal(col["segment"], pa.array(chosen, pa.string()).take(pa.array(np.repeat(np.arange(len(starts)), sizes)))), False)
    filled = _known(col["city"]).astype(np.int64) + _known(col["nation_id"])
    keys = {
        "name": np.where(_known(col["name"]), trusted - col["name_length"].fill_null(0).to_numpy() * 2**17, _NEVER),
        "email": np.where(_known(col["email"]), trusted, _NEVER),
        "balance": np.where(_known(col["balance_cents"]), 1 - same.to_numpy(zero_copy_only=False), _NEVER),
        "address": 2 - filled,
    }
    out = {
        "cluster": col["cluster"].take(pa.array(starts)),
        "pos": col["pos"].take(pa.array(starts)),
        "n": pa.array(sizes),
        "n_stale": pa.array(np.add.reduceat(stale.astype(np.int64), starts)),
        "latest": pa.array(latest),
        "spans": pa.array([c in across for c in clusters]),
    }
    for field, cols in _FIELDS.items():
        least, at = (segment_key, segment_at) if field == "segment" else _least(keys[field], starts)
        out[f"{field}_key"] = pa.array(least)
        for c in cols:
            out[f"{field}_{c}"] = col[c].take(pa.array(at, mask=least == _NEVER))
    return pa.table(out)


def _survivors(across: dict, stale_after: int):
    """Second fold: the summaries of all clusters of a run, one row held between batches."""

    def run(batches):
        held, schema = None, None
        for b, new in _runs(batches):
            if new and held:
                yield pa.RecordBatch.from_pylist([held], schema)
                held = None
            t = _summaries(b, held, across, stale_after)
            schema = t.schema
            head = t.slice(0, 1).to_pylist()[0]
            if held and held["cluster"] == head["cluster"]:
                head = _merge(held, head)
            elif held:
                yield pa.RecordBatch.from_pylist([held], schema)
            held = head
            if t.num_rows > 1:
                yield pa.RecordBatch.from_pylist([head], schema)
                yield from t.slice(1, t.num_rows - 2).to_batches()
                held = t.slice(t.num_rows - 1).to_pylist()[0]
        if held:
            yield pa.RecordBatch.from_pylist([held], schema)

    return run


def golden_records(records: DataFrame, trust: tuple[str, ...] = TRUST, stale_days: int = STALE_DAYS) -> DataFrame:
    """One row a cluster of ``records`` (client_id, master_id, source, updated_at, name, email, city,
    nation_id, segment, balance): ``cluster_id``, ``n_records``, ``n_stale``, the surviving values and
    whose they are.

    Strings of white space count as null, as do balances that are no finite number. A record is stale
    if it has no ``updated_at`` or one over ``stale_days`` days before its cluster's latest. RECENT is
    the latest first (null last), then trust, then the smaller client_id (null last); rows alike in all
    of these go by the hash of their values, equal rows count each. Records without master and client
    id are the cluster null. Other columns are not read; an empty table gives none.

    What reaches the driver is the two outer clusters of each run of the written ranges, however
    many records or clusters there are: runs are as many as shuffle partitions and file splits.
    """
    rows = ordered(records, trust)
    across = spanning(rows)
    own = materialise(rows.mapInArrow(_survivors(across, stale_days * 86_400_000_000), _SUMMARY), "golden")
    whole: dict = {}
    for r in sorted((r.asDict() for r in own.where("spans").collect()), key=lambda r: r["pos"]) if across else []:
        whole[r["cluster"]] = _merge(whole[r["cluster"]], r) if r["cluster"] in whole else r
    done = own.where("not spans")
    if whole:
        done = done.unionByName(records.sparkSession.createDataFrame([tuple(r[c] for c in own.columns) for r in whole.values()], own.schema))
    known = F.col("address_city").isNotNull() | F.col("address_nation_id").isNotNull()
    return done.select(
        F.col("cluster").alias("cluster_id"),
        F.col("n").alias("n_records"),
        "n_stale",
        F.col("name_name").alias("name"),
        F.col("email_email").alias("email"),
        F.col("segment_segment").alias("segment"),
        F.col("address_city").alias("city"),
        F.col("address_nation_id").alias("nation_id"),
        F.col("balance_balance_cents").alias("balance_cents"),
        *[F.col(f"{f}_client_id").alias(f"{f}_from") for f in ("name", "email", "segment", "balance")],
        F.when(known, F.col("address_client_id")).alias("address_from"),
    )
