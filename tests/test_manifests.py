"""Model manifests by hand: eligibility and faults, repeats and nulls among them."""

import pytest

from inkwell.operators import filters

MODELS = [
    ("m1", "a" * 40, "binary", "hub", 512, 8, ["en"], [], ["b2"], []),
    ("m2", "b" * 39, "graded", "hub", 0, None, ["zh"], ["b1"], None, ["b9"]),
    ("m3", "c" * 40, "other", "none", 64, 0, ["fr"], None, None, None),
    ("m3", "d" * 40, "graded", "hub", 64, 1, ["en", "zh"], None, None, None),
]
SCHEMA = "id string, revision string, kind string, adapter string, max_length int, batch_size int, languages array<string>, include_benchmarks array<string>, exclude_benchmarks array<string>, trained_on_benchmarks array<string>"


@pytest.fixture()
def manifests(spark):
    return spark.createDataFrame(MODELS, SCHEMA), spark.createDataFrame([("b1", ["en"]), ("b2", ["multilingual"]), ("b3", ["zh"])], "id string, languages array<string>")


def test_eligible(manifests):
    got = sorted(tuple(r) for r in filters.eligible_models(*manifests).collect())
    assert got == [("m1", "b1"), ("m2", "b1"), ("m2", "b2"), ("m2", "b3"), ("m3", "b1"), ("m3", "b2"), ("m3", "b2"), ("m3", "b3")]


def test_faults(manifests):
    got = sorted(tuple(r) for r in filters.manifest_faults(*manifests, ["hub"]).collect())
    assert got == [("m2", "max_length is not positive"), ("m2", "revision is no commit"), ("m2", "unknown benchmark"), ("m3", "batch_size is not positive"),
                   ("m3", "model id repeats"), ("m3", "unknown adapter"), ("m3", "unknown kind")]
