"""Landed pages of posts: read backward by a keyset cursor as a stream, or from a bisected start.

Pages lie as Parquet in ``page=<number>`` folders, or many in a ``pages_from=<number>`` folder in order; each holds posts
with a time (a long) and an id.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from inkwell.operators import ranking


#: Posts in a folder of many pages, about.
BLOCK_POSTS = 200_000
#: Pages whose keys are asked for ahead of the walk, by so many threads; pages that one task reads.
AHEAD, THREADS, A_TASK = 256, 16, 64


def land(posts: DataFrame, path: str, size: int, time: str = "created", id_col: str = "id", newest_first: bool = True, again: int = 0) -> None:
    """Write ``posts`` as pages of ``size``, by falling (time, id) in a folder each or rising in folders of many (see
    ``write_blocks``). Each page but the first repeats the ``again`` last posts of the one before, as a fetcher does that
    asks for what isn't newer than the oldest post it has."""
    rows = paged(posts, size, time, id_col, newest_first, again)
    if newest_first:
        write(rows, path)
    else:
        write_blocks(rows, path, max(1, BLOCK_POSTS // size))


def paged(posts: DataFrame, size: int, time: str = "created", id_col: str = "id", newest_first: bool = True, again: int = 0) -> DataFrame:
    """``posts`` with their ``page`` and the place ``_n_before``."""
    order = F.struct(-F.col(time), -F.col(id_col)) if newest_first else F.struct(time, id_col)
    numbered = ranking.running(posts.withColumn("_o", order).withColumn("_n", F.lit(1)), [], "_o", ["_n"]).drop("_o", "_n", "_n_total")
    page = F.floor(F.col("_n_before") / size).cast("int")
    last = F.col("_n_before") % size >= size - again
    return numbered.withColumn("page", F.explode(F.when(last, F.array(page, page + 1)).otherwise(F.array(page))))


def write(rows: DataFrame, path: str) -> None:
    """Add ``paged`` rows to the folders of their pages; a page is one file."""
    rows = rows.repartition("page").sortWithinPartitions("page", "_n_before").drop("_n_before")
    rows.write.mode("append").partitionBy("page").parquet(path)


def write_blocks(rows: DataFrame, path: str, pages: int) -> None:
    """Write ``paged`` rows to a folder for each ``pages`` of them, named by the first; there ``page`` is a column, and
    pages are in order."""
    rows = rows.withColumn("pages_from", (F.floor(F.col("page") / pages) * pages).cast("int")).repartition("pages_from")
    rows.sortWithinPartitions("pages_from", "_n_before").drop("_n_before").write.mode("append").partitionBy("pages_from").parquet(path)


def _between(spark: SparkSession, path: str) -> Callable[[int, int], DataFrame]:
    """What gives the rows of pages ``first`` to ``last``, of folders of many pages reading those that can hold them alone."""
    rows = spark.read.parquet(path)
    if "pages_from" not in rows.columns:
        return lambda first, last: rows.where(F.col("page").between(first, last))
    starts = sorted(r[0] for r in rows.select("pages_from").distinct().collect())  # a folder has some 200,000 posts

    def between(first: int, last: int) -> DataFrame:
        start = starts[max(0, bisect.bisect_right(starts, first) - 1)]
        return rows.where(F.col("pages_from").between(start, last) & F.col("page").between(first, last)).drop("pages_from")

    return between


class _Pages:
    """The pages under a path that pyarrow can open, and their keys."""

    def __init__(self, uri: str, time: str, id_col: str):
        self.uri, self.time, self.id = uri, time, id_col

    def _at(self, page: int | None = None):
        fs, path = pafs.FileSystem.from_uri(self.uri)
        return fs, path if page is None else f"{path}/page={page}"

    def rows(self, page: int, columns: list[str] | None = None) -> pa.Table:
        fs, path = self._at(page)
        return ds.dataset(path, filesystem=fs, format="parquet").to_table(columns=columns)

    def exists(self, page: int) -> bool:
        fs, path = self._at(page)
        return fs.get_file_info(path).type == pafs.FileType.Directory

    def oldest(self, page: int) -> tuple[int, int] | None:
        """The least (time, id) of a page; None if no post has both."""
        t = self.rows(page, [self.time, self.id]).drop_null()
        if not t.num_rows:
            return None
        least = pc.min(t[self.time])
        return least.as_py(), pc.min(t.filter(pc.equal(t[self.time], least))[self.id]).as_py()


class _Page(InputPartition):
    """Posts of ``page`` and those behind it, one a cursor, that are older than their page's cursor."""

    def __init__(self, page: int, cursors: list[tuple[int, int | None]]):
        super().__init__((page, cursors))


class _Backward(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.pages = _Pages(options["path"], options["time"], options["id"])
        self.before, self.names = int(options["before"]), names
        self.walked: list[tuple[int, int | None]] = [(self.before, None)]  # the cursor before each page, and after the last

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        """The first page that isn't landed yet, is empty or brings the cursor no further: the keys of
        the pages tell, so every run finds the same cursors."""
        for oldest in self._keys(len(self.walked) - 1):
            if oldest is None or not _older(oldest, self.walked[-1]) and oldest[0] < self.before:
                break
            self.walked.append(min(oldest, self.walked[-1], key=_order))
        return {"page": len(self.walked) - 1}

    def _keys(self, page: int) -> Iterator[tuple[int, int] | None]:
        """The oldest keys of ``page`` and those behind it, ``AHEAD`` pages asked at a time; None where none is landed."""
        ask = lambda p: self.pages.oldest(p) if self.pages.exists(p) else None
        with ThreadPoolExecutor(THREADS) as pool:
            while True:
                for oldest in pool.map(ask, range(page, page + AHEAD)):
                    yield oldest
                    if oldest is None:
                        return
                page += AHEAD

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        keys = self._keys(len(self.walked) - 1)
        while len(self.walked) <= end["page"]:  # a new run plans what an earlier one had begun
            self.walked.append(min(next(keys), self.walked[-1], key=_order))
        first, last = start["page"], end["page"]
        return [_Page(p, self.walked[p : min(p + A_TASK, last)]) for p in range(first, last, A_TASK)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        page, cursors = partition.value
        for i, (time, post) in enumerate(cursors):
            t = self.pages.rows(page + i)
            older = pc.less(t[self.pages.time], time)
            if post is not None:
                older = pc.or_(older, pc.and_(pc.equal(t[self.pages.time], time), pc.less(t[self.pages.id], post)))
            yield from t.filter(older).select(self.names).combine_chunks().to_batches()


def _order(key: tuple[int, int | None]) -> tuple:
    return key[0], key[1] is not None, key[1] or 0  # (time, None): before all posts of that time


def _older(a: tuple[int, int | None], b: tuple[int, int | None]) -> bool:
    return _order(a) < _order(b)


class BackwardPages(DataSource):
    """``spark.readStream.format("backward_pages")`` with ``path``, ``before``, ``time`` and ``id``."""

    @classmethod
    def name(cls) -> str:
        return "backward_pages"

    def schema(self) -> StructType:
        found = _Pages(self.options["path"], self.options["time"], self.options["id"])
        return from_arrow_schema(found.rows(0).schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Backward(dict(self.options), schema.names)


def read_backward(spark: SparkSession, path: str, before: int, out: str, checkpoint: str, time: str = "created", id_col: str = "id") -> DataFrame:
    """Posts older than ``before``, each once, page after page from the newest; returns all so far.

    A post that several pages repeat is taken from the first of them: behind a page only what is
    older than its oldest post, by time and then id, counts. So pages may overlap, and a page may
    end between posts of one time. Posts without time or id are left out. The walk stops at a page
    that is empty or brings nothing older; pages that land later are gone on with by the next run.
    """
    spark.dataSource.register(BackwardPages)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.format("backward_pages").option("before", before).option("time", time).option("id", id_col).load(path)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def bisected(n_pages: int, stamp: Callable[[int], int | None], target: int) -> int:
    """The first page whose ``stamp`` reaches ``target``, by halving; ``n_pages`` if none does.

    Pages rise in time; one without a stamp says nothing, so the nearest one before it is asked.
    """
    lo, hi = 0, n_pages
    while lo < hi:
        mid = (lo + hi) // 2
        probe, found = mid, stamp(mid)
        while found is None and probe > lo:
            probe -= 1
            found = stamp(probe)
        if found is not None and found >= target:
            hi = probe
        else:
            lo = mid + 1
    return lo


def upper_median(between: Callable[[int, int], DataFrame], time: str = "created") -> Callable[[int], int | None]:
    """The upper-middle time of a page, reading its folder alone; each page once."""
    known: dict[int, int | None] = {}

    def stamp(page: int) -> int | None:
        if page not in known:
            times = F.array_sort(F.collect_list(time))  # a page is small
            known[page] = between(page, page).select(time).agg(F.get(times, F.floor(F.size(times) / 2).cast("int"))).first()[0]
        return known[page]

    stamp.known = known
    return stamp


def in_range(spark: SparkSession, path: str, n_pages: int, since: int, until: int, time: str = "created") -> tuple[DataFrame, int]:
    """Posts with ``since`` <= time < ``until`` from rising pages, and how many pages were asked on the way.

    The middle of a page may be past a bound that its first posts are not, so one page before the
    bisected start is read as well; pages past the bisected end are not.
    """
    between = _between(spark, path)
    stamp = upper_median(between, time)
    first, last = bisected(n_pages, stamp, since), bisected(n_pages, stamp, until)
    rows = between(max(0, first - 1), last)
    return rows.where((F.col(time) >= since) & (F.col(time) < until)), len(stamp.known)
