"""How the lexical index lies on disk."""

import pyarrow.parquet as pq

from inkwell.llm import lexical


def test_a_shard_is_a_row_group(spark):
    """A writer and a reader hold a row group; one of all shards of a task took memory that grew with the input."""
    docs = spark.createDataFrame([(i, f"term{i} shared") for i in range(40)], "doc_id long, text string").coalesce(1)
    found = lexical.index(docs, shard_docs=4)
    files = {f.removeprefix("file://") for f in found.shards.inputFiles()}
    groups = [m.row_group(i).num_rows for m in (pq.read_metadata(f) for f in files) for i in range(m.num_row_groups)]
    assert groups == [1] * 10
    assert found.shards.count() == 10
