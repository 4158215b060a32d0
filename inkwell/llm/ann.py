"""Approximate nearest neighbours with a vantage-point tree per shard, and one over the shards."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import materialise, small, unit_hash

LEAF = 128
_NO_ID = np.iinfo(np.int64).max


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products in double precision, summed in the order of the components, so equal
    vectors have equal products wherever they stand."""
    out = np.zeros((len(q), len(x)))
    for d in range(q.shape[1]):
        out += q[:, d, None] * x[None, :, d]
    return out


@dataclass
class Node:
    """A leaf holds ``rows``; an inner node a vantage row, the median distance and two halves."""

    rows: np.ndarray | None = None
    vantage: int = -1
    radius: float = 0.0
    inner: "Node | None" = None
    outer: "Node | None" = None


class VPTree:
    """A vantage-point tree over vectors lifted by one component to equal length.

    Lifted so, the Euclidean distance falls as the inner product rises, and the triangle
    inequality holds for largest-inner-product search too.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF, twins: np.ndarray | None = None):
        self.ids, self.x, self.twins = ids, x, twins
        square = (x * x).sum(axis=1)
        self.top = float(square.max()) if len(x) else 0.0
        self.lifted = np.column_stack([x, np.sqrt(np.maximum(self.top - square, 0.0))])
        self.root = self._build(np.arange(len(x)), leaf)

    def _build(self, rows: np.ndarray, leaf: int) -> Node:
        if len(rows) <= leaf:
            return Node(rows=rows)
        centre = self.lifted[rows].mean(axis=0)
        far = int(np.argmax(((self.lifted[rows] - centre) ** 2).sum(axis=1)))
        vantage, rest = rows[far], np.delete(rows, far)
        gap = np.sqrt(((self.lifted[rest] - self.lifted[vantage]) ** 2).sum(axis=1))
        order = np.argsort(gap, kind="stable")
        half = len(order) // 2  # by rank, so that ties don't unbalance the tree
        return Node(None, vantage, float(gap[order[half]]), self._build(rest[order[:half]], leaf), self._build(rest[order[half:]], leaf))

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, factor: float, floor: np.ndarray | None = None, q_twins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k nearest rows of each query but its own: those of its id or, where
        ``twins`` tell the rows of an id apart, of its id and twin. Rows below a query's ``floor``, the
        k-th score it has found elsewhere, may be left out.

        A half is skipped if the triangle inequality, with its lower bound multiplied by
        ``factor``, rules out anything nearer than the k-th found: 1 is exact, more skips more.
        """
        scores, ids = np.full((len(q), k), -np.inf), np.full((len(q), k), _NO_ID)
        q_square = (q * q).sum(axis=1)
        slack = 1e-7 * (np.sqrt(q_square) + np.sqrt(self.top))

        floor = np.full(len(q), -np.inf) if floor is None else floor

        def bound(at: np.ndarray) -> np.ndarray:
            return np.maximum(scores[at, -1], floor[at])

        def offer(at: np.ndarray, rows: np.ndarray, ip: np.ndarray) -> None:
            own = self.ids[rows][None, :] == q_ids[at][:, None]
            if self.twins is not None:
                own &= self.twins[rows][None, :] == q_twins[at][:, None]
            new = np.where(own, -np.inf, ip)
            better = (new >= bound(at)[:, None]).any(axis=1)
            at, new = at[better], new[better]
            if not len(at):
                return
            s = np.concatenate([scores[at], new], axis=1)
            i = np.concatenate([ids[at], np.broadcast_to(self.ids[rows], new.shape)], axis=1)
            i = np.where(np.isneginf(s), _NO_ID, i)
            order = np.lexsort((i, -s), axis=1)[:, :k]
            scores[at], ids[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

        def reach(at: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(q_square[at] + self.top - 2 * bound(at), 0.0)) + slack[at]

        def visit(node: Node, at: np.ndarray) -> None:
            if not len(at):
                return
            if node.rows is not None:
                if len(node.rows):
                    offer(at, node.rows, inner_products(q[at], self.x[node.rows]))
                return
            rows = np.array([node.vantage])
            ip = inner_products(q[at], self.x[rows])
            offer(at, rows, ip)
            gap = np.sqrt(np.maximum(q_square[at] + self.top - 2 * ip[:, 0], 0.0))
            inside = gap <= node.radius
            visit(node.inner, at[inside])
            visit(node.outer, at[~inside])
            near = inside & ~((node.radius - gap) * factor > reach(at))
            visit(node.outer, at[near])
            far = ~inside & ~((gap - node.radius) * factor > reach(at))
            visit(node.inner, at[far])

        for at in range(0, len(q), 1024):
            visit(self.root, np.arange(at, min(at + 1024, len(q))))
        return ids, scores


def usable(vec: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not all zero."""
    finite = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda c: c != 0), F.lit(False))


@dataclass
class Cut:
    """An inner node of the tree over shards: a lifted vantage vector and its median distance; a
    leaf has the number of its shard."""

    shard: int = -1
    vantage: np.ndarray | None = None
    radius: float = 0.0
    inner: "Cut | None" = None
    outer: "Cut | None" = None


class ShardTree:
    """A vantage-point tree whose leaves are shards, cut by a sample: it deals every vector to one
    shard and tells which shards a query can skip whole."""

    def __init__(self, sample: np.ndarray, top: float, shards: int):
        self.top, self.shards = top, 0
        self.root = self._cut(self.lift(sample), shards)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0.0))])

    def _cut(self, rows: np.ndarray, shards: int) -> Cut:
        if shards < 2 or len(rows) < 2:
            self.shards += 1
            return Cut(self.shards - 1)
        vantage = rows[int(np.argmax(((rows - rows.mean(axis=0)) ** 2).sum(axis=1)))]
        gap = np.sqrt(((rows - vantage) ** 2).sum(axis=1))
        radius = float(np.median(gap))
        inside = gap <= radius
        return Cut(-1, vantage, radius, self._cut(rows[inside], (shards + 1) // 2), self._cut(rows[~inside], shards // 2))

    def deal(self, x: np.ndarray) -> np.ndarray:
        """The shard of each vector."""
        lifted, out = self.lift(x), np.zeros(len(x), dtype=np.int32)

        def go(node: Cut, at: np.ndarray) -> None:
            if node.shard >= 0:
                out[at] = node.shard
            elif len(at):
                inside = np.sqrt(((lifted[at] - node.vantage) ** 2).sum(axis=1)) <= node.radius
                go(node.inner, at[inside])
                go(node.outer, at[~inside])

        go(self.root, np.arange(len(x)))
        return out

    def visits(self, q: np.ndarray, kth: np.ndarray, factor: float) -> list[list[int]]:
        """The shards that may hold something nearer than each query's k-th score so far."""
        square, out = (q * q).sum(axis=1), [[] for _ in q]
        reach = np.sqrt(np.maximum(square + self.top - 2 * kth, 0.0)) + 1e-7 * (np.sqrt(square) + np.sqrt(self.top))
        reach[np.isneginf(kth)] = np.inf

        def go(node: Cut, at: np.ndarray) -> None:
            if node.shard >= 0:
                for i in at:
                    out[i].append(node.shard)
            elif len(at):
                gap = np.sqrt(np.maximum(square[at] + self.top - 2 * (q[at] @ node.vantage[:-1]), 0.0))
                go(node.inner, at[~((gap - node.radius) * factor > reach[at])])
                go(node.outer, at[~((node.radius - gap) * factor > reach[at])])

        go(self.root, np.arange(len(q)))
        return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_length(b: pa.RecordBatch, dim: int, vec: int):
    """The rows of each vector length with their matrix."""
    lengths = b.column(dim).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), at, _matrix(b.column(vec).take(pa.array(at)))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    factor: float = 1.25,
    shard_rows: int = 4096,
    query_block: int = 16384,
    sample_rows: int = 20_000,
    sample_most: int = 200_000,
) -> DataFrame:
    """The k nearest rows by inner product of every row where ``is_query`` holds.

    Columns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (the product of the original
    vectors in double precision) and ``query_key`` (the hash of the query's vector), ties to the
    smaller id; all candidates if fewer than k. Rows without an id, null or zero vectors and those
    holding null or non-finite components take no part; vectors meet those of their own length.
    Rows alike in id and vector are one. Rows of one id with different vectors are rows of their
    own: each is a query with its own ranking, told by ``query_key``, and a candidate of the others.
    An empty table gives an empty result.

    Every row is indexed. A vantage-point tree cut by a sample deals rows to shards of about
    ``shard_rows``; a shard of more (many equal or near vectors) is split by hash. The sample has about
    ``sample_rows`` vectors, or 8 a shard up to ``sample_most``, which is enough for shards of that size
    among 25,000 * ``shard_rows`` vectors; beyond, shards grow.
    Of equal vectors, the k + 1 smallest ids are all that can be found, so the others are left out.
    A query first searches its own shard; the k-th score found there rules out other shards whole,
    by the same inequality and factor as within a shard: most of them where vectors of one length
    form clusters, hardly any among random ones, which no tree tells apart. Queries come to a shard in blocks of
    ``query_block``, which bounds a task's memory.
    """
    v = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    v = v.where(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id", "v").agg(F.max("q").alias("q"))
    v = materialise(v.withColumn("dim", F.size("v")).withColumn("twin", F.xxhash64("v")), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    stats = v.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("top")).collect()  # a row a vector length
    total = sum(r["n"] for r in stats)
    wanted = min(max(sample_rows, 8 * -(-total // shard_rows)), max(sample_rows, sample_most))
    drawn = v.where(unit_hash(7, F.col("id"), F.col("twin")) < min(1.0, wanted / max(1, total))).select("dim", "v").toArrow()
    lengths, trees = drawn.column("dim").to_numpy(), {}
    for r in stats:
        at = np.flatnonzero(lengths == r["dim"])
        own = _matrix(drawn.column("v").take(pa.array(at))) if len(at) else np.zeros((0, r["dim"]))
        trees[r["dim"]] = ShardTree(own, r["top"], max(1, min(-(-r["n"] // shard_rows), len(own) // 8)))
    forest = v.sparkSession.sparkContext.broadcast(trees)  # about sample_most vectors at most

    def deal(batches):
        for b in batches:
            shard = np.zeros(b.num_rows, dtype=np.int32)
            for d, at, x in _by_length(b, 3, 1):
                shard[at] = forest.value[d].deal(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard)], names=[*b.schema.names, "shard"])

    dealt = materialise(v.mapInArrow(deal, "id long, v array<double>, q boolean, dim int, twin long, shard int"), "dealt")
    equal = Window.partitionBy("dim", "shard", "v").orderBy("id")
    data = materialise(dealt.withColumn("n", F.row_number().over(equal)).where(F.col("n") <= k + 1).drop("n", "q"), "data")
    sizes = data.groupBy(F.col("dim").alias("_dim"), F.col("shard").alias("_shard")).agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))
    sizes = small(materialise(sizes, "sizes"))
    here = (F.col("dim") == F.col("_dim")) & (F.col("shard") == F.col("_shard"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "query_key": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q_ids, floor = right.column("id").to_numpy(), right.column("kth").to_numpy()
        tree = VPTree(left.column("id").to_numpy(), _matrix(left.column("v")), twins=left.column("twin").to_numpy())
        twins = right.column("twin").to_numpy()
        ids, scores = tree.search(q_ids, _matrix(right.column("v")), k, factor, floor, twins)
        found = ids != _NO_ID
        n = found.sum(axis=1)
        return pa.table([np.repeat(q_ids, n), np.repeat(twins, n), ids[found], scores[found]], names=["query_id", "query_key", "vec_id", "score"])

    def found_in(asked: DataFrame) -> DataFrame:
        """``asked`` (``id``, ``twin``, ``v``, ``dim``, ``shard``, ``kth``) searched in every part of its shards."""
        n = asked.groupBy("dim", "shard").agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks"))
        plan = small(materialise(n.join(sizes, here).select("_dim", "_shard", "parts", "blocks"), "blocks"))
        block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        part = F.pmod(F.xxhash64("id", "twin"), F.col("parts")).cast("int").alias("part")
        left = data.join(plan, here).select("dim", "shard", part, block, "id", "v", "twin")
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        right = asked.join(plan, here).select("dim", "shard", every, F.pmod(F.xxhash64("id", "twin", F.lit(1)), F.col("blocks")).cast("int").alias("block"), "id", "v", "twin", "kth")
        key = ["dim", "shard", "part", "block"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id long, query_key long, vec_id long, score double")

    def top(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    queries = dealt.where("q").drop("q")
    near = materialise(top(found_in(queries.withColumn("kth", F.lit(float("-inf"))))), "near")
    kth = near.where(F.col("rank") == k).select(F.col("query_id").alias("_id"), F.col("query_key").alias("_key"), F.col("score").alias("kth"))
    own_row = (F.col("id") == F.col("_id")) & (F.col("twin") == F.col("_key"))
    bounded = queries.join(kth, own_row, "left").select("id", "v", "dim", "shard", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"), "twin")

    def visit(batches):
        for b in batches:
            lists: list = [[] for _ in range(b.num_rows)]
            own, bound = b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False)
            for d, at, x in _by_length(b, 2, 1):
                for i, shards in zip(at, forest.value[d].visits(x, bound[at], factor)):
                    lists[i] = [s for s in shards if s != own[i]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, type=pa.list_(pa.int32()))], names=[*b.schema.names, "more"])

    routed = bounded.mapInArrow(visit, "id long, v array<double>, dim int, shard int, kth double, twin long, more array<int>")
    more = materialise(routed.select("id", "v", "dim", F.explode("more").alias("shard"), "kth", "twin"), "visits")
    return top(near.drop("rank").unionByName(found_in(more))).select("query_id", "rank", "vec_id", "score", "query_key")
