"""Passages accumulated from a stream of turns, with state kept per conversation.

Turns may come in any order, in any number of batches and over restarts; what the stream has
written at any time equals what a batch job over the turns so far would give.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
_BOUNDED = "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"
_PARTITIONS = "spark.sql.shuffle.partitions"
_STATE = "next long, seen long, done int, size long, open array<string>, ahead array<struct<turn: long, text: string>>"


def lines_of(text: str | None) -> list[str]:
    """The non-blank lines of a text, stripped."""
    return [x for x in map(str.strip, (text or "").split("\n")) if x]


def whole_text(text: str | None) -> list[str]:
    """A text as one piece; none of an empty or a null one."""
    return [text] if text else []


class Accumulator:
    """Pieces gathered until their sizes reach ``target``; then a passage closes and the next begins,
    up to ``most`` passages. None closes without a target."""

    def __init__(self, size: Callable[[str], int], target: int | None, most: int | None, done: int = 0, held: int = 0, open: list[str] | None = None):
        self.size, self.target, self.most = size, target, most
        self.done, self.held, self.open = done, held, list(open or [])

    def copy(self) -> Accumulator:
        return Accumulator(self.size, self.target, self.most, self.done, self.held, self.open)

    @property
    def full(self) -> bool:
        return self.most is not None and self.done >= self.most

    def add(self, pieces: list[str]) -> Iterator[tuple[int, str]]:
        """(number, passage) of those that close."""
        for piece in pieces:
            if self.full:
                return
            self.open.append(piece)
            self.held += self.size(piece)
            if self.target is not None and self.held >= self.target:
                yield self.done, "\n".join(self.open)
                self.done, self.held, self.open = self.done + 1, 0, []

    def rest(self) -> Iterator[tuple[int, str]]:
        if self.open and not self.full:
            yield self.done, "\n".join(self.open)


class Thread:
    """A conversation: the next turn, the open passage, and turns that came ahead of a missing one."""

    def __init__(self, pieces, size, target, most, first_turn, head=None):
        self.pieces = pieces
        self.at, self.seen, done, held, opened, ahead = head or (first_turn, 0, 0, 0, [], [])
        self.acc, self.early, self.out = Accumulator(size, target, most, done, held, opened), dict(ahead), []

    def take(self, turn: int | None, text: str | None) -> None:
        if turn is None or turn < self.at or turn in self.early:
            return  # no place, or a turn sent again
        self.early[turn] = text
        self.seen += 1
        while self.at in self.early:
            self.out += [(*p, True) for p in self.acc.add(self.pieces(self.early.pop(self.at)))]
            self.at += 1

    def head(self) -> tuple:
        """What goes on with the next batch."""
        return self.at, self.seen, self.acc.done, self.acc.held, self.acc.open, sorted(self.early.items())

    def passages(self) -> list[tuple[int, str | None, bool]]:
        """Those that closed, then what is open, also by the turns that wait; a number of -1 for turns without text."""
        view, out = self.acc.copy(), list(self.out)
        for _, words in sorted(self.early.items()):
            out += [(*p, False) for p in view.add(self.pieces(words))]
        out += [(*p, False) for p in view.rest()]
        return out or [(-1, None, False)]


class Threads(StatefulProcessor):
    """Per conversation a state of its own.

    A closed passage is given once and leaves the state; what is still open, and what the turns
    ahead would give, comes anew with each batch that touches the conversation.
    """

    def __init__(self, pieces, size, target, most, first_turn, names):
        self.how, self.names = (pieces, size, target, most, first_turn), names

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one value a conversation: it is asked for once and given back once a batch, each of which is a call to the JVM
        self.state = handle.getValueState("state", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        _, order, text = self.names
        thread = Thread(*self.how, self.state.get())
        for row in rows:
            thread.take(row[order], row[text])
        self.state.update(thread.head())
        yield from self.given(key[0], thread)

    def given(self, key, thread: Thread) -> Iterator[Row]:
        for number, passage, closed in thread.passages():
            yield Row(**{self.names[0]: key, "number": number, "passage": passage, "closed": closed, "turns": thread.seen})

    def close(self) -> None:
        pass


class Shelves(Threads):
    """``Threads`` with one state for each bucket of conversations.

    Spark makes three calls to the JVM and an Arrow batch for each key of a state; here they are as many
    as there are buckets, not conversations. A bucket's states are one JSON text, read and written as a
    whole: a row of a state comes to Python with its schema, whose parsing costs more than all else.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("shelf", "heads string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        name, order, text = self.names
        heads = {k: head for k, *head in json.loads((self.state.get() or ("[]",))[0])}
        threads: dict = {}
        for row in rows:
            k = row[name]
            if k not in threads:
                threads[k] = Thread(*self.how, heads.get(k))
            threads[k].take(row[order], row[text])
        heads |= {k: thread.head() for k, thread in threads.items()}
        self.state.update((json.dumps([(k, *head) for k, head in heads.items()], ensure_ascii=False),))
        for k, thread in threads.items():
            yield from self.given(k, thread)


def accumulate(turns: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text", pieces=lines_of, size=len, target: int | None = None, most: int | None = None, first_turn: int = 0, buckets: int = 1024) -> DataFrame:
    """A streaming frame of ``key``, ``number``, ``passage``, ``closed`` and ``turns`` (seen so far), in update mode.

    The turns of a conversation are numbered from ``first_turn`` without gaps; one that comes early
    waits in the state. A turn that comes twice counts once, the first to come; rows without key or
    turn are left out. A conversation without text has the number -1 and no passage.

    Conversations are dealt to ``buckets`` by their key's hash, and those of a bucket share a state; a
    checkpoint stays with their number. With 0, and for keys that are neither integers nor plain
    strings, each has a state of its own, which suits batches that touch few of very many conversations.
    """
    kind = turns.schema[key].dataType.simpleString()
    some = turns.where(F.col(key).isNotNull()).select(key, F.col(order).cast("long").alias(order), text)
    how = (pieces, size, target, most, first_turn, (key, order, text))
    if buckets and kind in ("bigint", "int", "string"):
        bucket = next(x for x in ("bucket", "_bucket", "__bucket", "___bucket") if x not in some.columns)
        grouped, processor = some.withColumn(bucket, F.pmod(F.xxhash64(key), F.lit(buckets))).groupBy(bucket), Shelves(*how)
    else:
        grouped, processor = some.groupBy(key), Threads(*how)
    return grouped.transformWithState(processor, f"{key} {kind}, number int, passage string, closed boolean, turns long", "Update", "None")


def current(spark: SparkSession, out: str, key: str = "conv_id") -> DataFrame:
    """What the stream has written of each passage last."""
    rows = spark.read.parquet(out)
    value = F.struct("passage", "closed", "turns")
    last = rows.groupBy(key, "number").agg(F.max_by(value, "batch").alias("v"))
    return last.select(key, "number", "v.*")


def run_threads(spark: SparkSession, source: str, schema, out: str, checkpoint: str, files_per_batch: int = 4, key: str = "conv_id", **how) -> DataFrame:
    """Take in the files of ``source`` that no earlier run has read, and return all passages so far.

    State and progress are in ``checkpoint``: a run that ends anywhere is gone on with by the next. A
    batch that is replayed writes its folder again, so nothing is there twice.

    Each part of the state costs a store's opening and commit a batch, however little is in it, so a
    new checkpoint gets two parts a core at most; one that is there keeps its own number. Commits write
    what changed, and the stores of an executor share one bound of memory.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    parts = min(int(spark.conf.get(_PARTITIONS)), 2 * spark.sparkContext.defaultParallelism)
    own = {_PROVIDER: _ROCKS, _CHANGELOG: "true", _BOUNDED: "true", _PARTITIONS: str(parts)}  # the store that keeps several states a key
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        turns = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        query = accumulate(turns, key=key, **how).writeStream.outputMode("update").foreachBatch(write)
        query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return current(spark, out, key)
