"""Line deduplication by site-relative frequency, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import BROADCAST_ROWS, materialise, small

RATIO = 0.1
MIN_PAGES = 5
#: Most boilerplate lines of one site that are looked up in an array beside its pages.
ARRAY_LINES = 500


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\x0b\f\r]", "")) != "")


def host(url: Column) -> Column:
    """The host of a URL, lower-cased, without user, port and a leading ``www.``; null for null,
    the empty string where there is none."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.rtrim(F.lower(found), F.lit("."))


def _hashes(text: Column) -> Column:
    """The hashes of a page's lines, each once."""
    return F.array_distinct(F.transform(_lines(text), lambda x: F.xxhash64(x)))


def boilerplate(pages: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``site``, ``line`` (64-bit hash) of lines on more than ``ratio`` of a site's pages and on
    ``min_pages`` at least. A row is a page, null texts included; a line counts once a page. Counts
    are summed before they are shuffled."""
    totals = pages.groupBy(F.col(site_col).alias("site")).agg(F.count("*").alias("pages"))
    totals = small(materialise(totals, "pages")).withColumnRenamed("site", "_site")
    each = pages.select(F.col(site_col).alias("site"), F.explode(_hashes(F.col(text_col))).alias("line"))
    counts = each.groupBy("site", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    joined = counts.join(totals, F.col("site").eqNullSafe(F.col("_site")))
    return joined.where(F.col("n") > F.col("pages") * ratio).select("site", "line")


def drop_boilerplate(
    docs: DataFrame,
    id_col: str = "doc_id",
    site: str | Column = "source",
    text_col: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and the struct column ``lines``.

    ``site`` is a column or an expression, ``host(F.col("url"))`` where there are URLs. Lines are cut
    at \\n; blank lines are neither counted nor dropped. A page of nothing but
    boilerplate keeps its text whole: a page that is repeated as a whole is a matter of
    document deduplication. ``lines`` holds ``n_lines`` and ``n_dropped`` of the lines that are
    not blank. Null texts stay null with 0 lines; null sites are one site; repeated rows are
    pages of their own and get the same result; an empty table stays empty. Other columns pass
    through; one named ``lines`` is replaced. Where few lines are boilerplate (counted), they are
    broadcast as an array a site and no text is shuffled; else pages join their own dropped
    lines by a row key.
    """
    own_site, text = F.col(site) if isinstance(site, str) else site, F.col(text_col)
    names = [c for c in docs.columns if c != "lines"]
    # a row's other columns travel in one struct, so that none can clash with those made here
    rest = F.struct(F.lit(1), *[F.col(f"`{c}`") for c in names if c != text_col])
    rows = docs.select(rest.alias("row"), own_site.alias("own_site"), text.alias("text"), F.col(id_col).alias("id"))
    found = materialise(boilerplate(rows, "own_site", "text", ratio, min_pages), "boilerplate")
    sizes = found.groupBy("site").count()
    total, most = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    if total <= broadcast_rows and most <= ARRAY_LINES:
        own = found.groupBy("site").agg(F.collect_list("line").alias("dropped"))
        joined = rows.join(F.broadcast(own), F.col("own_site").eqNullSafe(F.col("site")), "left")
    else:
        # 128 bits of hash stand for a page
        keyed = rows.withColumn("key", F.struct(F.xxhash64("id", "own_site", "text").alias("a"), F.xxhash64(F.lit(1), "id", "own_site", "text").alias("b")))
        each = keyed.select("key", "own_site", F.explode(_hashes(F.col("text"))).alias("own_line"))
        hits = each.join(found, (F.col("own_line") == F.col("line")) & F.col("own_site").eqNullSafe(F.col("site")))
        own = hits.select(F.col("key").alias("own_key"), "line").distinct().groupBy("own_key").agg(F.collect_list("line").alias("dropped"))
        joined = keyed.join(own, F.col("key") == F.col("own_key"), "left")
    text, dropped = F.col("text"), F.coalesce("dropped", F.array().cast("array<bigint>"))
    every = F.when(text.isNull(), 0).otherwise(F.size(_lines(text)))
    is_bad = lambda x: F.array_contains(dropped, F.xxhash64(x))
    bad = F.when(text.isNotNull() & (F.size(dropped) > 0), F.size(F.filter(_lines(text), is_bad))).otherwise(0)
    keep = F.filter(F.split(text, "\n"), lambda x: (F.trim(F.regexp_replace(x, r"[\t\x0b\f\r]", "")) == "") | ~is_bad(x))
    joined = joined.withColumn("n", every).withColumn("n_bad", bad)
    cut = (F.col("n_bad") > 0) & (F.col("n_bad") < F.col("n"))
    counts = F.struct(F.col("n").cast("long").alias("n_lines"), F.when(cut, F.col("n_bad")).otherwise(0).cast("long").alias("n_dropped"))
    new = F.when(cut, F.array_join(keep, "\n")).otherwise(text)
    return joined.select(*[new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names], counts.alias("lines"))
