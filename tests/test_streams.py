"""Streams with state against plain Python: order, repeats, restarts and failures."""

import random

import pytest

from inkwell.streaming import threads

SCHEMA = "conv_id long, turn long, text string, extra int"


def _plain(rows, target, most):
    by: dict = {}
    for conv, turn, text, _ in rows:
        if conv is not None and turn is not None:
            by.setdefault(conv, {}).setdefault(turn, text)
    out = {}
    for conv, turns in by.items():
        passages, held, size = [], [], 0
        for t in sorted(turns):
            for line in threads.lines_of(turns[t]):
                held.append(line)
                size += len(line)
                if target and size >= target:
                    passages.append("\n".join(held))
                    held, size = [], 0
        for i, p in enumerate([*passages, *(["\n".join(held)] if held else [])][:most]):
            out[conv, i] = p
    return out


def _rows(seed):
    r = random.Random(seed)
    rows = []
    for conv in range(12):
        for turn in range(r.randint(1, 9)):
            rows.append((conv, turn, r.choice([None, "", " \n ", "a line\n\n another é\n", "x" * r.randint(1, 30), "日本\r\nend"]), 1))
    rows += [(None, 0, "lost", 1), (3, None, "lost", 1), (99, 0, None, 1), (99, 2, "after a gap that stays", 1)]
    r.shuffle(rows)
    return rows


def _got(df):
    return {(r["conv_id"], r["number"]): r["passage"] for r in df.where("number >= 0").collect()}


@pytest.mark.parametrize(("target", "most"), [(25, 3), (None, None)])
def test_any_order_and_restarts(spark, tmp_path, target, most):
    rows = _rows(target or 0)
    where = {k: f"{tmp_path}/{k}" for k in ("in", "out", "ck")}
    for part in (rows[:20], rows[20:21], rows[21:] + rows[:10]):  # the last lot sends turns again
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(where["in"])
        df = threads.run_threads(spark, where["in"], SCHEMA, where["out"], where["ck"], files_per_batch=1, target=target, most=most)
    assert _got(df) == _plain(rows, target, most)
    assert df.select("conv_id", "number").distinct().count() == df.count()
    again = threads.run_threads(spark, where["in"], SCHEMA, where["out"], where["ck"], target=target, most=most)
    assert _got(again) == _got(df)  # nothing new, nothing changed


def test_a_batch_that_fails_is_taken_up_again(spark, tmp_path, monkeypatch):
    rows = _rows(7)
    where = {k: f"{tmp_path}/{k}" for k in ("in", "out", "ck")}
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(where["in"])
    calls = []

    def broken(frame, *a, **k):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real_write(frame, *a, **k)

    writer = type(spark.range(1).write)
    real_write = writer.parquet
    monkeypatch.setattr(writer, "parquet", broken)
    with pytest.raises(Exception, match="lost"):
        threads.run_threads(spark, where["in"], SCHEMA, where["out"], where["ck"], files_per_batch=1, target=25, most=3)
    monkeypatch.setattr(writer, "parquet", real_write)
    df = threads.run_threads(spark, where["in"], SCHEMA, where["out"], where["ck"], files_per_batch=1, target=25, most=3)
    assert _got(df) == _plain(rows, 25, 3)


def test_accumulator_closes_at_the_target_and_stops_at_the_cap():
    acc = threads.Accumulator(len, 5, 2)
    assert list(acc.add(["abc", "de", "f"])) == [(0, "abc\nde")]
    assert list(acc.rest()) == [(1, "f")]
    assert list(acc.add(["ghij", "k", "l"])) == [(1, "f\nghij")]
    assert list(acc.rest()) == [] and acc.full


class _State:
    """A state value that is kept outside, with the calls that reach it."""

    def __init__(self):
        self.value, self.calls = None, []

    def getValueState(self, name, schema):  # noqa: N802  as the handle names it
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value


def test_a_conversation_asks_for_its_state_once_a_batch():
    """However many turns wait; each was a call of its own before, and there were three besides."""
    state = _State()
    t = threads.Threads(threads.lines_of, len, 5, 3, 0, ("conv_id", "turn", "text"))
    t.init(state)
    rows = lambda *turns: iter([{"turn": n, "text": x} for n, x in turns])
    first = list(t.handleInputRows((7,), rows((3, "ddd"), (1, "bbb"), (2, "ccc"), (5, None)), None))
    assert [(r.number, r.passage, r.closed, r.turns) for r in first] == [(0, "bbb\nccc", False, 4), (1, "ddd", False, 4)]
    then = list(t.handleInputRows((7,), rows((0, "aaa"), (1, "again")), None))
    assert [(r.number, r.passage, r.closed) for r in then] == [(0, "aaa\nbbb", True), (1, "ccc\nddd", True)] and then[0].turns == 5
    assert state.calls == ["get", "update"] * 2


def test_conversations_of_a_bucket_share_one_state():
    """However many there are; each was asked for on its own before."""
    state, names = _State(), ("conv_id", "turn", "text")
    shelf, alone = threads.Shelves(threads.lines_of, len, 5, 3, 0, names), {}
    shelf.init(state)
    turns = [(c, t, x) for t, x in ((1, "bbb"), (3, None), (0, "aa\n é 日\n\0\"")) for c in [*range(40), "k 日"]]
    for batch in (turns[:50], turns[50:90], turns[90:] + turns[:5]):
        rows = [dict(zip(names, r)) for r in batch]
        got = sorted(map(tuple, shelf.handleInputRows((7,), iter(rows), None)), key=str)
        want = []
        for c in {r["conv_id"] for r in rows}:
            if c not in alone:
                alone[c] = threads.Threads(threads.lines_of, len, 5, 3, 0, names)
                alone[c].init(_State())
            want += map(tuple, alone[c].handleInputRows((c,), iter([r for r in rows if r["conv_id"] == c]), None))
        assert got == sorted(want, key=str)
    assert state.calls == ["get", "update"] * 3


@pytest.mark.parametrize("kind", ["string", "double"])
def test_a_state_has_no_more_parts_than_the_cores_need(spark, tmp_path, kind):
    """A part costs a store's opening and commit a batch. Strings share the states of buckets, doubles have their own."""
    rows = [r for r in _rows(3) if r[0] is not None]
    where = {k: f"{tmp_path}/{k}" for k in ("in", "out", "ck")}
    schema = SCHEMA.replace("conv_id long", f"conv_id {kind}")
    kinds = {"string": str, "double": float}
    own = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        for part in (rows[:30], rows[30:]):
            spark.createDataFrame([(kinds[kind](r[0]), *r[1:]) for r in part], schema).coalesce(1).write.mode("append").parquet(where["in"])
            df = threads.run_threads(spark, where["in"], schema, where["out"], where["ck"], target=25, most=3)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
        assert {(int(float(k)), n): p for (k, n), p in _got(df).items()} == _plain(rows, 25, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)
    parts = {r["numPartitions"] for r in spark.read.format("state-metadata").load(where["ck"]).collect()}
    assert parts == {2 * spark.sparkContext.defaultParallelism}
