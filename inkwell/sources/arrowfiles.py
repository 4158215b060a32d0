"""Arrow IPC files as a data source: a partition a record batch, only the asked columns read."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

_ENDS = (".arrow", ".arrows")


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def files_of(uri: str) -> list[str]:
    """The Arrow files at ``uri``, a file or a folder, in the order of their names."""
    fs, path = _open(uri)
    if fs.get_file_info(path).type == pafs.FileType.File:
        return [uri]
    found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.path.endswith(_ENDS))
    if not found:
        raise FileNotFoundError(f"no Arrow files under {uri}")
    return [uri.rstrip("/") + f[len(path.rstrip("/")) :] for f in found]


def _is_file_format(f) -> bool:
    """Whether the file format's mark is there; the stream format has none."""
    head = f.read(6)
    f.seek(0)
    return head == b"ARROW1"


def schema_of(uri: str) -> pa.Schema:
    fs, path = _open(files_of(uri)[0])
    with fs.open_input_file(path) as f:
        return (ipc.open_file(f) if _is_file_format(f) else ipc.open_stream(f)).schema


class _Batch(InputPartition):
    """Record batch ``number`` of a file, or all of a stream's, which can only be read in order."""

    def __init__(self, uri: str, number: int | None):
        super().__init__((uri, number))


class _Reader(DataSourceReader):
    def __init__(self, uri: str, names: list[str]):
        self.uri, self.names = uri, names

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for uri in files_of(self.uri):
            fs, path = _open(uri)
            with fs.open_input_file(path) as f:
                if _is_file_format(f):
                    out += [_Batch(uri, i) for i in range(ipc.open_file(f).num_record_batches)]
                else:
                    out.append(_Batch(uri, None))
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:
            return
        uri, number = partition.value
        fs, path = _open(uri)
        with fs.open_input_file(path) as f:
            whole = (ipc.open_file(f) if number is not None else ipc.open_stream(f)).schema
            f.seek(0)
            options = ipc.IpcReadOptions(included_fields=sorted(whole.get_field_index(n) for n in self.names))
            if number is not None:
                yield ipc.open_file(f, options=options).get_batch(number).select(self.names)
            else:
                for batch in ipc.open_stream(f, options=options):
                    yield batch.select(self.names)


class ArrowFiles(DataSource):
    """``spark.read.format("arrow_files").load(uri)``; with a schema, only its columns are read."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def schema(self) -> StructType:
        return from_arrow_schema(schema_of(self.options["path"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema.names)


def read_arrow(spark: SparkSession, uri: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of Arrow files, in file or stream format; ``columns`` says which are read at all."""
    spark.dataSource.register(ArrowFiles)
    reader = spark.read.format("arrow_files")
    if columns is not None:
        whole = from_arrow_schema(schema_of(uri))
        reader = reader.schema(StructType([whole[c] for c in columns]))
    return reader.load(uri)


def write_arrow(df: DataFrame, uri: str, batch_rows: int = 1000, stream: bool = False) -> DataFrame:
    """Each task writes one file of record batches of at most ``batch_rows`` rows to the folder ``uri``, which
    all executors share; returns ``file`` and ``n_rows`` of the files with rows.

    A file gets its name once it is whole, so an attempt that dies leaves none.
    """
    end = _ENDS[stream]

    def run(batches):
        context = TaskContext.get()
        fs, folder = _open(uri)
        fs.create_dir(folder, recursive=True)
        name = f"{folder}/part-{context.partitionId():05d}{end}"
        draft, n, writer = f"{folder}/.draft-{context.partitionId():05d}-{context.taskAttemptId()}", 0, None
        with fs.open_output_stream(draft) as out:
            for b in batches:
                if writer is None:
                    writer = (ipc.new_stream if stream else ipc.new_file)(out, b.schema)
                for at in range(0, b.num_rows, batch_rows):
                    writer.write_batch(b.slice(at, batch_rows))
                n += b.num_rows
            if writer is not None:
                writer.close()
        if n:
            fs.move(draft, name)
            yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(name)]), pa.array([n], pa.int64())], names=["file", "n_rows"])
        else:
            fs.delete_file(draft)

    rows = df.mapInArrow(run, "file string, n_rows long").collect()  # a row a task
    return df.sparkSession.createDataFrame([tuple(r) for r in rows], "file string, n_rows long")
