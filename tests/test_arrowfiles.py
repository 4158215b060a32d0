"""Arrow files as a data source, against the same rows as Parquet."""

import pyarrow as pa
import pyarrow.ipc as ipc
import pytest

from inkwell.sources import arrowfiles


@pytest.mark.parametrize("stream", [False, True])
def test_same_rows_as_parquet(spark, sf_dir, tmp_path, stream):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    docs.write.parquet(f"{tmp_path}/p")
    uri = f"file://{tmp_path}/arrow"
    files = arrowfiles.write_arrow(docs, uri, batch_rows=17, stream=stream)
    assert files.groupBy().sum("n_rows").first()[0] == docs.count()
    got, want = arrowfiles.read_arrow(spark, uri), spark.read.parquet(f"{tmp_path}/p")
    assert got.schema.simpleString() == want.schema.simpleString()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert got.rdd.getNumPartitions() == (files.count() if stream else sum(-(-r.n_rows // 17) for r in files.collect()))


def test_only_asked_columns_are_read(spark, tmp_path):
    batch = pa.RecordBatch.from_pydict({"a": [1, None], "b": ["x", None], "c": [[1], None]})
    with ipc.new_file(f"{tmp_path}/one.arrow", batch.schema) as w:
        w.write_batch(batch)
    uri = f"file://{tmp_path}/one.arrow"
    df = arrowfiles.read_arrow(spark, uri, ["c", "a"])
    assert df.columns == ["c", "a"] and [tuple(r) for r in df.collect()] == [([1], 1), (None, None)]
    (part,) = arrowfiles._Reader(uri, ["c"]).partitions()
    (read,) = arrowfiles._Reader(uri, ["c"]).read(part)
    assert read.schema.names == ["c"]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        arrowfiles.files_of(f"file://{tmp_path}/none")


def test_empty_tasks_leave_no_file(spark, tmp_path):
    uri = f"file://{tmp_path}/arrow"
    files = arrowfiles.write_arrow(spark.range(3).repartition(8), uri)
    assert files.groupBy().sum("n_rows").first()[0] == 3 and not list((tmp_path / "arrow").glob(".draft*"))
    assert sorted(r.id for r in arrowfiles.read_arrow(spark, uri).collect()) == [0, 1, 2]
