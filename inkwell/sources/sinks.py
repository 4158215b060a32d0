"""Outputs: splits, snapshots with their digest, request results, score logs, reports."""

from __future__ import annotations

from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources import store

#: Names a snapshot's manifest sets itself.
RESERVED = {"source", "revision", "rows", "rows_sha256", "columns"}


def write_rows(rows: DataFrame, path: str, columns: list[str] | None = None, mode: str = "error", by: list[str] | None = None) -> None:
    """CSV with a header; nested columns as JSON, quotes doubled, line ends kept within quotes."""
    cols = columns or rows.columns
    nested = {f.name for f in rows.schema if f.dataType.typeName() in ("struct", "map", "array")}
    out = rows.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in cols])
    out.write.mode(mode).partitionBy(*(by or [])).option("header", True).option("escape", '"').csv(path)


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_splits(rows: DataFrame, path: str, columns: list[str]) -> dict[str, int]:
    """One folder of CSV a split; returns the splits' counts."""
    write_rows(rows, path, [*columns, "split"], "overwrite", ["split"])
    return {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}


def prompt_manifest(system: DataFrame, edits: DataFrame, mirrors: DataFrame) -> DataFrame:
    """``kind``, ``language``, ``prompt_id``, ``text`` of all prompts, for ids in rows to be resolved by."""
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), "language", "prompt_id", "text")
    return one(system, "system").unionByName(one(edits, "edit")).unionByName(one(mirrors, "mirror")).distinct()


def run_requests(plan: DataFrame, call, key: str = "ord", fatal: tuple = (PermissionError,)) -> DataFrame:
    """``plan`` with ``output``, what ``call`` (prompt to text) gives; rows whose call fails go, an error of ``fatal``
    ends the job. Keep the plan's order by its ``key``; write the result before using it twice."""
    at = plan.columns.index("prompt")

    def run(frames):
        for f in frames:
            out = []
            for prompt in f.iloc[:, at]:
                try:
                    out.append(call(prompt))
                except fatal:
                    raise
                except Exception:  # noqa: BLE001  a failed request is skipped, whatever it raised
                    out.append(None)
            yield f.assign(output=pd.Series(out, index=f.index, dtype=object))[lambda x: x["output"].notna()]

    schema = plan.withColumn("output", F.lit(None).cast("string")).schema
    return plan.mapInPandas(run, schema)


def write_snapshot(rows: DataFrame, path: str, source: str, revision: str, extra: dict | None = None, key: str = "row_id") -> dict:
    """CSV in the order of ``key`` and ``path.manifest`` with the rows' number and digest; returns the manifest."""
    clash = RESERVED & set(extra or {})
    if clash:
        raise ValueError(f"reserved manifest names: {sorted(clash)}")
    spark = rows.sparkSession
    write_rows(rows.orderBy(key), path, mode="overwrite")
    found = store.ordered_digest(rows, key, "rows_sha256").first()
    manifest = {"source": source, "revision": revision, "rows": found["n"], "rows_sha256": found["rows_sha256"], "columns": ",".join(rows.columns), **(extra or {})}
    spark.createDataFrame([{k: str(v) for k, v in manifest.items()}]).coalesce(1).write.mode("overwrite").json(f"{path}.manifest")
    return manifest


def append_scores(rows: DataFrame, score, path: str, meta: dict[str, str], key: str = "row_id") -> DataFrame:
    """Scores the rows that the log at ``path`` lacks, appends them with ``meta`` and returns the
    rows' scores. A log of other ``meta`` is refused; scores that are null or not finite fail."""
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    todo = rows
    if there:
        log = spark.read.parquet(path)
        differs = [F.coalesce(F.col(k) != v, F.lit(True)) if k in log.columns else F.lit(True) for k, v in meta.items()]
        other: Column = F.lit(False)
        for d in differs:
            other = other | d
        if not log.where(other).isEmpty():
            raise ValueError("the score log was written with other metadata")
        todo = rows.join(log.select(key), key, "left_anti")
    scored = score(todo).select(key, "score")
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    scored = scored.withColumn("score", F.when(bad, F.raise_error(F.lit("score is not finite")).cast("double")).otherwise(F.col("score")))
    scored.select("*", *[F.lit(v).alias(k) for k, v in meta.items()]).write.mode("append").parquet(path)
    return rows.select(key).join(spark.read.parquet(path).select(key, "score"), key)


def top_up(pool: DataFrame, done: DataFrame, keys: list[str], n: int, order: list) -> DataFrame:
    """``n`` rows of the pool whose keys are not done, by ``order``; the caller appends them."""
    return pool.join(done.select(*keys).distinct(), keys, "left_anti").orderBy(*order).limit(n)


def build_report(shipped: DataFrame, dropped: DataFrame, contaminated: DataFrame, register: str = "text_register") -> dict[str, DataFrame]:
    """The tables of a build's report, each a small frame."""
    human = F.col("text_type") == "human_written"
    return {
        "splits": shipped.groupBy("split").agg(F.count("*").alias("rows")),
        "classes": shipped.groupBy("language").pivot("text_type", ["human_written", "ai_generated", "ai_edited"]).count().fillna(0),
        "registers": shipped.where(human).groupBy("language", register).agg(F.count("*").alias("rows")),
        "drops": dropped.groupBy("drop_reason").agg(F.count("*").alias("rows")),
        "overlap": contaminated.agg(F.count("*").alias("rows"), F.max("n_shared").alias("max"), F.percentile_approx("n_shared", 0.5).alias("median")),
        "cost": shipped.where(~human).groupBy("model").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost")),
    }


#: Bytes of a file of ``write_named_csv``, about; a name with more has several files.
NAMED_BYTES = 64 << 20


def write_named_csv(rows: DataFrame, folder: str, name: str, size: int = NAMED_BYTES) -> None:
    """CSV with a header for each value of ``name``, a path under ``folder``: one file if its rows hold
    ``size`` bytes at most, else a folder of that name with files of about ``size`` bytes each. A file's rows go
    through one task, which streams them; equal rows share a file. Other columns are written as text, a null as nothing."""
    columns = [c for c in rows.columns if c != name]
    text = rows.select(F.coalesce(F.col(name), F.lit("None")).alias(name), *[F.col(c).cast("string").alias(c) for c in columns])
    sizes = text.groupBy(name).agg(F.sum(reduce(Column.__add__, [F.coalesce(F.octet_length(c), F.lit(0)) + 3 for c in columns])).alias("_bytes"))
    files = store.materialise(sizes.select(name, F.ceil(F.col("_bytes") / size).cast("int").alias("_files")))
    # rows are dealt by their content, so that a task that runs again deals them alike
    dealt = text.join(store.small(files), name).withColumn("_file", F.pmod(F.xxhash64(*columns), F.col("_files")).cast("int"))
    file = F.when(F.col("_files") == 1, F.col(name)).otherwise(F.format_string("%s/part-%05d.csv", name, "_file"))
    dealt = dealt.select(file.alias(name), *columns)

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        out = current = None

        def line(values) -> bytes:
            return (",".join("" if v is None else '"' + v.replace('"', '""') + '"' for v in values) + "\n").encode()

        for b in batches:
            for at, *values in zip(*[c.to_pylist() for c in b.columns]):
                if at != current:
                    if out:
                        out.close()
                    path = f"{root}/{at}"
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out, current = fs.open_output_stream(path), at
                    out.write((",".join(columns) + "\n").encode())
                out.write(line(values))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])
        if out:
            out.close()

    store.text_batches(dealt.repartition(name).sortWithinPartitions(name)).mapInArrow(run, "n long").agg(F.sum("n")).collect()
