"""The pre-tests of the generators: every text with a match of a pattern passes the pattern's test."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.llm import pii

PARTS = ["10", "1", "255", "0", " ", " . ", ".", "[.", ".]", "(.)", "[.]", ") ", "a", "@", " at ", "(at)", "[at]", " AT ", " dot ", "(dot)", "x.y", "b@c.de", "-", "+", "(", ")", "/", "_", "=", "4111", "111", "12345678", "é", "\n", "Zz9"]
#: A match with fewer digits is no card, and holds none of the shapes that are proposed of numbers.
DIGITS = {"base card": 12, "candidate number": 9}
KINDS = [*((f"base {k}", v) for k, v in pii.BASE.items()), *((f"candidate {k}", v) for k, v in pii.CANDIDATES.items())]


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(5)
    made = ["".join(r.choices(PARTS, k=r.randint(1, 16))) for _ in range(20_000)]
    digits = ["".join(r.choices("0123456789 .()[]-+", k=r.randint(5, 40))) for _ in range(20_000)]
    fixed = ["10 . 20 . 30 . 40", "10.20[.30.40", "1.2.3.4", "a at b dot cd", "a@b.c", "x" * 12]
    return spark.createDataFrame([(t,) for t in made + digits + fixed], "t string").repartition(4).cache()


@pytest.mark.parametrize(("name", "rule"), KINDS, ids=[k for k, _ in KINDS])
def test_no_match_without_its_test(texts, name, rule):
    test, pattern = rule
    t = F.col("t")
    longest = F.array_max(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m: F.length(F.regexp_replace(m, "[^0-9]", ""))))
    found = texts.where(t.rlike(pattern) & (longest >= DIGITS.get(name, 0)))
    assert found.count() > 5
    assert [r.t for r in found.where(~t.rlike(test)).limit(3).collect()] == []
