"""Queries that SQL can't express, over whole tables against plain Python."""

import html
import re

from inkwell.plans.catalog import QUERIES

STEPS = [
    (r"```.*?```", "", re.S), (r"`[^`]*`", "", 0), (r"!\[.*?\]\(.*?\)", "", 0), (r"\[([^\]]+)\]\(.*?\)", r"\1", 0), (r"(\*\*|__)(.*?)\1", r"\2", 0), (r"(\*|_)(.*?)\1", r"\2", 0),
    (r"#+ ", "", 0), (r"^>.*$", "", re.M), (r"^(\s*[-*+]|\d+\.)\s+", "", re.M), (r"^\s*[-*_]{3,}\s*$", "", re.M), (r"\|.*?\|", "", 0), (r"<.*?>", "", 0),
]


def _plain(text):
    for pattern, to, flags in STEPS:
        text = re.sub(pattern, to, text, flags=flags)
    text = html.unescape(text)
    text = re.sub(r"[\n\t\r]", " ", text.replace("^M", " ")).replace(" ,", ",")
    return re.sub(" +", " ", text)


def test_detector_text(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.plain for r in QUERIES["detector_text"](spark, sf_dir).collect()}
    assert got == {i: None if t is None else _plain(t) for i, t in texts.items()}


def _page(page):
    """By patterns, where the query parses."""
    title = re.search(r"(?is)<title[^>]*>(.*?)</title>", page)
    body = re.sub(r"(?is)<title[^>]*>.*?</title>|<!--.*?-->|<!doctype[^>]*>", "", page)
    body = re.sub(r"(?is)<(script|style|nav|footer|noscript)\b.*?</\1\s*>", "", body)
    body = re.sub(r"(?i)<(p|br|div|h1|h2|li)\b[^>]*>", "\n", body)
    lines = (" ".join(x.split()) for x in html.unescape(re.sub(r"(?s)<[^>]*>", "", body)).split("\n"))
    return html.unescape(title[1]).strip() if title else "", "\n".join(x for x in lines if x)


def test_html_extract(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: (r.title, r.body) for r in QUERIES["html_extract"](spark, sf_dir).collect()}
    assert got.keys() == pages.keys() and sum(bool(b) for _, b in got.values()) > len(got) / 2
    assert got == {i: (None, None) if p is None else _page(p) for i, p in pages.items()}
