"""Passages cut from longer works, and text taken out of HTML pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from inkwell.textfn import let, strip


def chunks(text: Column, size_of, target: int, most: int | None = None) -> Column:
    """The passages of whole non-blank lines (the first ``most``, if given), each closed once its lines' sizes
    (``size_of`` a line) reach ``target``; a shorter rest is a passage too. Null of a null text.

    Sizes are Spark's; where passages end depends on all lines before, which one pass over a text's
    lines tells."""

    @F.pandas_udf("array<string>")
    def gathered(lines: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for own, n in zip(lines, sizes):
            if own is None:
                out.append(None)
                continue
            passages, held, size = [], [], 0
            for line, k in zip(own, n):
                held.append(line)
                size += k
                if size >= target:
                    passages.append("\n".join(held))
                    held, size = [], 0
            out.append([*passages, *(["\n".join(held)] if held else [])][:most])
        return pd.Series(out, dtype=object)

    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    both = let(lines, lambda x: F.struct(x.alias("lines"), F.transform(x, lambda y: size_of(y).cast("int")).alias("sizes")))
    return gathered(both["lines"], both["sizes"])


class _Text(HTMLParser):
    """Title and the text of paragraphs and headings; scripts, styles and navigation are skipped."""

    SKIP = {"script", "style", "nav", "footer", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.parts, self.skip, self.tag = [], [], 0, ""

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        self.tag = tag
        if tag in ("p", "br", "div", "h1", "h2", "li"):
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in self.SKIP and self.skip > 0
        self.tag = ""

    def handle_data(self, data):
        if self.tag == "title":
            self.title.append(data)
        elif not self.skip:
            self.parts.append(data)


@F.pandas_udf(StructType([StructField("title", StringType()), StructField("body", StringType())]))
def page_text(html: pd.Series) -> pd.DataFrame:
    """Title and body of a page; null of a null page."""
    rows = []
    for page in html:
        if page is None:
            rows.append((None, None))
            continue
        p = _Text()
        p.feed(page)
        p.close()
        lines = (" ".join(x.split()) for x in "".join(p.parts).split("\n"))
        rows.append(("".join(p.title).strip(), "\n".join(x for x in lines if x)))
    return pd.DataFrame(rows, columns=["title", "body"])
