"""Benchmark files as release rows: one schema, a hash for each row's identity."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from inkwell.operators.joins import one_to_one
from inkwell.sources import store
from inkwell.textfn import let, strip

#: The optional columns of a release row and their types.
FIELDS = {"language": "string", "label_binary": "int", "label_ternary": "int", "edit_target": "double", "domain": "string", "generator": "string"}


def _fail(when: Column, message: str, value: Column) -> Column:
    return F.when(when, F.raise_error(F.lit(message)).cast("string")).otherwise(value)


def release_rows(rows: DataFrame, benchmark: str, source_id: Column, variant: Column, text: Column, salt: Column | None = None, **fields) -> DataFrame:
    """Rows of the release schema; texts are stripped. A blank one is a row too, as is a null one
    (``refuse_blank`` ends a job that has any).

    ``row_id`` is the SHA-256 of benchmark, source id, variant, the text's SHA-256 and the salt,
    joined by NUL, a null as nothing. Language is ``en`` unless given.
    """
    clean = strip(text)
    extra = [fields.get(k, F.lit("en" if k == "language" else None)).cast(t).alias(k) for k, t in FIELDS.items()]
    out = rows.select(F.lit(benchmark).alias("benchmark"), source_id.cast("string").alias("source_id"), variant.alias("variant"), clean.alias("text"), (F.lit("") if salt is None else salt.cast("string")).alias("_salt"), *extra)
    out = out.withColumn("text_sha256", F.sha2("text", 256))
    parts = [F.coalesce(c, F.lit("")) for c in ("benchmark", "source_id", "variant", "text_sha256", "_salt")]
    return out.select(F.sha2(F.concat_ws("\0", *parts), 256).alias("row_id"), "text_sha256", "benchmark", "source_id", "variant", "text", *FIELDS)


def refuse_blank(rows: DataFrame) -> DataFrame:
    """Release rows, of which a null or blank text fails."""
    text = F.col("text")
    return rows.withColumn("text", F.when(text.isNull() | (text == ""), F.raise_error(F.concat(F.lit("empty text in "), "benchmark")).cast("string")).otherwise(text))


def polished(benchmark: str, edits: DataFrame, originals: DataFrame) -> DataFrame:
    """Originals as human rows and polished texts with their share of polishing as edit target."""
    human = release_rows(originals, benchmark, F.col("id"), F.lit("human"), F.col("generation"), label_ternary=F.lit(0), edit_target=F.lit(0.0), domain=F.col("domain"))
    percent = F.col("polishing_percent")
    degree = F.coalesce(F.nullif(F.col("polishing_degree").cast("string"), F.lit("")), percent.cast("string"), F.lit("None"))
    variant = F.concat_ws(":", F.lit("polished"), "polish_type", degree)
    ai = release_rows(edits, benchmark, F.col("id"), variant, F.col("generation"), label_ternary=F.lit(2), edit_target=percent / 100.0, domain=F.col("domain"), generator=F.col("polisher"))
    return human.unionByName(ai)


@F.pandas_udf(ArrayType(StringType()))
def literal_texts(value: pd.Series) -> pd.Series:
    """The texts of a Python literal: a string, a list of strings or of mappings to them; what is
    no such literal is a text itself. Blank ones go."""

    def one(v):
        if v is None:
            return []
        try:
            parsed = ast.literal_eval(v)
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            parsed = v
        if not isinstance(parsed, (list, tuple, dict)):
            return [v if not isinstance(parsed, str) else parsed] if v.strip() else []
        items = [parsed] if isinstance(parsed, dict) else parsed
        flat = [str(t) for i in items for t in (i.values() if isinstance(i, dict) else [i])]
        return [t for t in flat if t.strip()]

    return value.map(one)


def edit_texts(rows: DataFrame, name: str, bare: bool = False) -> Column:
    """The non-blank texts of a column that holds an array of strings or a Python literal. With ``bare`` an
    array's nulls stay, and a value of blank texts alone is one blank text, a null value one null."""
    value = F.col(f"`{name}`")
    if isinstance(rows.schema[name].dataType, StringType):
        store.text_batches(rows)
        found = literal_texts(value)
    else:
        found = F.coalesce(F.filter(value, lambda t: F.coalesce(strip(t) != "", F.lit(bare))), F.array().cast("array<string>"))
    return let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.when(value.isNotNull(), "")))) if bare else found


def with_variants(benchmark: str, rows: DataFrame, editors: dict[str, tuple[str, str]], bare: bool = False) -> DataFrame:
    """A source row as its human, generated and edited texts; ``editors`` maps a variant to
    (column, generator), each of whose texts (see ``edit_texts``) is a row ``variant:i``."""
    common = {"domain": F.col("category")}
    flat = rows.select("id", "category", "human_output", "model_output", "model", *[edit_texts(rows, c, bare).alias(f"_e{i}") for i, (c, _) in enumerate(editors.values())])
    entry = lambda v, t, b, n, g: F.struct(v.alias("variant"), t.alias("text"), F.lit(b).alias("b"), F.lit(n).alias("t"), g.cast("string").alias("generator"))
    fixed = F.array(entry(F.lit("human"), F.col("human_output"), 0, 0, F.lit(None)), entry(F.lit("generated"), F.col("model_output"), 1, 1, F.col("model")))

    def edits(at: int, variant: str, generator: str) -> Column:
        name = lambda i: F.concat(F.lit(f"{variant}:"), i.cast("string"))
        return F.transform(f"_e{at}", lambda t, i: entry(name(i), t, 1, 2, F.lit(generator)))

    more = [edits(i, v, g) for i, (v, (_, g)) in enumerate(editors.items())]
    each = flat.select("id", "category", F.explode(F.concat(fixed, *more)).alias("x")).select("id", "category", "x.*")
    return release_rows(each, benchmark, F.col("id"), F.col("variant"), F.col("text"), label_binary=F.col("b"), label_ternary=F.col("t"), generator=F.col("generator"), **common)


def prompted(benchmark: str, rows: DataFrame, order: str) -> DataFrame:
    """Rows whose source is their prompt, or their text without one; the row's place salts its identity."""
    label = F.col("label").cast("int")
    source = F.concat(F.coalesce("domain", F.lit("")), F.lit(":"), F.coalesce(F.sha2(F.coalesce("prompt", "text"), 256), F.lit("")))
    human = label == 0
    variant = _fail(~F.coalesce(label.isin(0, 1), F.lit(False)), "invalid label", F.when(human, "human").otherwise(F.concat(F.lit("generated:"), "model")))
    return release_rows(rows, benchmark, source, variant, F.col("text"), F.col(order), label_binary=label, domain=F.col("domain"), generator=F.when(~human, F.col("model")))


def three_way(benchmark: str, rows: DataFrame, labels: DataFrame, phase: str, language: str = "zh-CN") -> DataFrame:
    """Rows joined one to one with labels 0, 1, 2 by id as string."""
    named = lambda df, c: df.select(F.col("id").cast("string").alias("id"), c)
    both = one_to_one(named(rows, "text"), named(labels, "label"), ["id"])
    label = F.col("label").cast("int")
    variant = F.when(label == 0, "human").when(label == 1, "generated").when(label == 2, "refined")
    variant = _fail(variant.isNull(), "invalid label", variant)
    return release_rows(
        both, benchmark, F.concat_ws(":", F.lit(phase), "id"), variant, F.col("text"),
        language=F.lit(language), label_binary=(label != 0).cast("int"), label_ternary=label, domain=F.lit(phase),
    )


def files_by_domain(spark: SparkSession, folder: str, benchmark: str, prefix: str, language: str = "zh-CN") -> DataFrame:
    """CSV files ``folder/<domain>/<prefix>_<domain>_<generator>.csv``, or folders of that name with files
    ``part-<number>.csv``, with id, label (1 is human), text and original_id; name and labels must agree.
    A file is one task's, since its quoted line ends can't be told from others when it is cut. A value that is
    quoted nothing is an empty text, one that isn't quoted a null."""
    schema = "id string, label int, text string, original_id string"
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).option("enforceSchema", False)
    read = read.option("nullValue", "\0")  # Spark takes quoted nothing as null as well while that stands for null
    rows = read.csv(f"{folder}/*/*.csv").withColumn("_path", F.url_decode(F.col("_metadata.file_path")))
    rows = rows.withColumn("_path", F.regexp_replace("_path", r"(\.csv)/part-\d+\.csv$", "$1"))
    rows = rows.withColumn("domain", F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1))
    stem = F.regexp_extract("_path", r"([^/]+)\.csv$", 1)
    start = F.concat(F.lit(f"{prefix}_"), F.replace("domain", F.lit(" "), F.lit("_")), F.lit("_"))
    name = F.when(F.startswith(stem, start), F.substring(stem, F.length(start) + 1, F.length(stem)))
    rows = rows.withColumn("_by", _fail(name.isNull(), "unexpected file name", name))
    human = F.col("label") == 1
    variant = F.when(human, "human").otherwise(F.concat(F.lit("generated:"), "_by"))
    variant = _fail(human != (F.col("_by") == "human"), "file name and label differ", variant)
    source = F.concat_ws(":", "domain", F.when(human, F.col("id")).otherwise(F.coalesce(F.nullif("original_id", F.lit("")), "id")))
    return release_rows(
        rows, benchmark, source, variant, F.col("text"),
        language=F.lit(language), label_binary=(~human).cast("int"), domain=F.col("domain"), generator=F.when(~human, F.col("_by")),
    )
