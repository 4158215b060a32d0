"""Quality rules: repetition statistics and zstandard compression bands."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import text_batches

#: From so many UTF-8 bytes on, whole texts must compress to between these shares of their size.
#: Prose shrinks with length, since later words repeat earlier ones; bands follow that.
WHOLE_BANDS = ((0, 0.40, 1.05), (512, 0.36, 0.88), (1024, 0.33, 0.80), (2048, 0.29, 0.76), (4096, 0.25, 0.74), (8192, 0.22, 0.73), (16384, 0.17, 0.72), (65536, 0.10, 0.72))
#: The same for chunks, by the chunk's size.
CHUNK_BANDS = ((0, 0.30, 1.10), (512, 0.28, 0.90), (1024, 0.25, 0.82), (2048, 0.22, 0.78))
CHUNK = 2048
#: Share of the chunks that may be out of their band.
CHUNK_SHARE = 0.34
LEVEL = 3
_SYMBOLS = regex.compile(rb"[#*$%&|<>]+")
_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, n_chunks long, n_chunks_out long, base_failed boolean, kept boolean"


def repeat_words(words: list) -> int:
    """Words in 3-word windows that are found twice or more, the first included."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    hit = np.fromiter((counts[w] > 1 for w in windows), dtype=bool, count=len(windows))
    mark = np.zeros(len(words), dtype=bool)
    for i in range(3):
        mark[i : i + len(hit)] |= hit
    return int(mark.sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def in_band(ratio: float, size: int, bands) -> bool:
    _, low, high = bands[bisect_right(bands, (size, 9.0, 9.0)) - 1]
    return low <= ratio <= high


def measure(data: bytes | None, coder: zstandard.ZstdCompressor) -> tuple:
    """The statistics and the verdict of one UTF-8 text, in the order of ``_COLUMNS``."""
    data = data or b""
    words = data.split()  # bytes split at ASCII white space only
    n = len(words)
    chars = sum(map(len, words)) if data.isascii() else len(b"".join(words).decode())
    symbols = sum(map(len, _SYMBOLS.findall(data)))
    repeats = repeat_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    if not data:
        return 0, 0, 0, 0, 0, None, 0, 0, True, False
    ratio = len(coder.compress(data)) / len(data)
    chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
    if len(chunks) > 1 and len(chunks[-1]) < CHUNK // 4:
        chunks[-2:] = [chunks[-2] + chunks[-1]]  # a short tail counts with the chunk before it
    out = sum(not in_band(len(coder.compress(c)) / len(c), len(c), CHUNK_BANDS) for c in chunks)
    good = in_band(ratio, len(data), WHOLE_BANDS) and out <= CHUNK_SHARE * len(chunks)
    return n, chars, symbols, duplicate_lines(data), repeats, ratio, len(chunks), out, failed, not failed and good


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and, for every whole text, word statistics, compression ratios and ``kept``.

    ``kept`` is false where ``base_failed`` (under 50 words, or over half of them in repeated
    3-word windows); else it holds if the whole text's zstandard ratio lies in the band of its
    length and at most ``CHUNK_SHARE`` of its fixed chunks leave theirs: too low is repetitive,
    too high incompressible. Null and empty texts: zeros, a null ratio, failed. A narrow map, so
    repeated rows repeat; only the id and text columns are read.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = [pa.int64()] * 5 + [pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    names = ["doc_id", *(c.split()[0] for c in _COLUMNS.split(", "))]

    def run(batches):
        coder = zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            rows = [measure(t, coder) for t in b.column(1).cast(pa.binary()).to_pylist()]
            cols = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, type=k) for c, k in zip(cols, kinds))], names=names)

    return text_batches(src).mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, {_COLUMNS}")
