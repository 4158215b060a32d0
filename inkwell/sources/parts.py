"""Results part by part: what a run has finished stays, what it left half done is made again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The folder of commits; Spark's readers pass over names that begin like this.
_DONE = "_done"
#: The column of a part's folder.
_PART = "part_of"
PARTS_MOST = 100_000


class Parts:
    """A table at ``path`` with a folder for each value of ``part`` and a list of those that are whole."""

    def __init__(self, spark: SparkSession, path: str, part: str):
        self.spark, self.path, self.part = spark, path.rstrip("/"), part

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def done(self) -> set[str]:
        fs = self._fs()
        return {s.getPath().getName() for s in fs.listStatus(self._at(_DONE))} if fs.exists(self._at(_DONE)) else set()

    def _name(self, value: str) -> str:
        return "".join(c if c.isalnum() or c in "-." else f"_{ord(c):x}_" for c in value)

    def run(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame], at_once: int = 8, most: int | None = None) -> int:
        """Compute the parts of ``rows`` that aren't done, ``at_once`` together, at most ``most``; returns how many.

        ``compute`` gives rows that keep the column ``part``. Parts are written over what an earlier run
        may have left of them and then committed, so each is there once and whole. The list of parts
        comes to the driver: at most ``PARTS_MOST`` are allowed.
        """
        found = [r[0] for r in rows.select(self._of(F.col(self.part)).alias(_PART)).distinct().limit(PARTS_MOST + 1).collect()]
        if len(found) > PARTS_MOST:
            raise ValueError(f"over {PARTS_MOST} parts")
        done = self.done()
        todo = sorted(v for v in found if self._name(v) not in done)[:most]
        for i in range(0, len(todo), at_once):
            own = todo[i : i + at_once]
            out = compute(rows.where(self._of(F.col(self.part)).isin(own)))
            out = out.withColumn(_PART, self._of(F.col(self.part))).repartition(_PART)
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_PART).parquet(self.path)
            for v in own:
                self._fs().create(self._at(_DONE, self._name(v)), True).close()
        return len(todo)

    @staticmethod
    def _of(value: Column) -> Column:
        """A folder's name: never empty, and another for null than for any string."""
        return F.coalesce(F.concat(F.lit("p-"), value.cast("string")), F.lit("none"))

    def read(self) -> DataFrame:
        """Rows of the parts that are whole."""
        known, rows = self.done(), self.spark.read.parquet(self.path)
        values = [r[0] for r in rows.select(_PART).distinct().collect()]
        return rows.where(F.col(_PART).isin([v for v in values if self._name(v) in known])).drop(_PART)


def whole_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of JSON lines files, without a file's torn line: what a writer that died left of its
    last one. More than one line of a file that isn't JSON is no torn line, and fails."""
    lines = spark.read.option("lineSep", "\n").text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema).alias("r"), F.col("_metadata.file_path").alias("file"), F.expr("try_parse_json(value) IS NULL").alias("torn"))
    torn = F.sum(F.when(F.col("torn"), 1).otherwise(0))
    bad = parsed.groupBy("file").agg(torn.alias("n")).where("n > 1").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['n']} lines of {bad[0]['file']} are no JSON")
    return parsed.where(~F.col("torn")).select("r.*")


def resume_lines(rows: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], path: str, schema: str) -> int:
    """Append the results of the rows whose ``key`` the JSON lines at ``path`` lack; returns how many were to do."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    todo = rows
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        todo = rows.join(whole_lines(spark, path, schema).select(key).distinct(), key, "left_anti")
    n = todo.count()
    if n:
        compute(todo).write.mode("append").json(path)
    return n


def counted_write(rows: DataFrame, path: str, counts: dict[str, dict]) -> list[tuple]:
    """Write ``rows`` and count them meanwhile: (value of each column of ``counts``, n) of those values, and
    (None, ..., n) for all other rows.

    ``counts`` names the columns and the values that are asked for, as {column: values}; the counts
    are metrics of the write itself, so the rows are made and read once.
    """
    columns = list(counts)
    cells: list[tuple] = [()]
    for c in columns:
        cells = [(*cell, v) for cell in cells for v in counts[c]]
    seen = Observation()
    tests = [F.count_if(_all(columns, cell)) for cell in cells]
    observed = rows.observe(seen, F.count(F.lit(1)).alias("all"), *[t.alias(f"c{i}") for i, t in enumerate(tests)])
    observed.write.parquet(path)
    got = seen.get
    known = [(*cell, got[f"c{i}"]) for i, cell in enumerate(cells)]
    rest = got["all"] - sum(n for *_, n in known)
    return [k for k in known if k[-1]] + ([(*[None] * len(columns), rest)] if rest else [])


def _all(columns: list[str], cell: tuple):
    out = F.lit(True)
    for c, v in zip(columns, cell):
        out = out & F.coalesce(F.col(c) == v, F.lit(False))
    return out
