"""Stripping of odd and of long texts."""

import itertools
import time

from pyspark.sql import functions as F

from inkwell.textfn import strip

SPACES = ["\t", "\n", "\x0b", "\x0c", "\r", " ", "\x85", "\xa0", " ", " ", " ", " ", " ", " ", "　"]


def test_white_space_goes_at_the_ends_only(spark):
    ends = ["", *SPACES, "\r\n", " \n\n"]
    inner = ["", "x", "a b", "a \n\n b", "😀", "a" + " " * 50 + "b"]
    texts = [a + m + b for a, m, b in itertools.product(ends, inner, ends)]
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(strip(F.col("t"))).collect()
    assert [r[0] for r in got] == [*(t.strip() for t in texts), None]


def test_a_long_run_of_white_space_is_read_once(spark):
    """Its time was the square of the run's length before, some minutes here."""
    run = "a" + " " * 400_000 + "b"
    began = time.monotonic()
    got = spark.createDataFrame([(run,), (run + "\n",)], "t string").select(strip(F.col("t"))).collect()
    assert [r[0] for r in got] == [run, run] and time.monotonic() - began < 30
