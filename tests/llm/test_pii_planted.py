"""Recall and precision of added spans on disguised ones planted in the corpus's own texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkwell.llm import pii

FIRST, LAST, HOSTS = ["maria", "j.smith", "petra-k", "omar_98", "liwei"], ["lopez", "brandt", "duval", "nowak", "ito"], ["fastmail", "uni-example", "corp", "webhost", "posteo"]


def _card(r):
    body = "5" + "".join(r.choice("0123456789") for _ in range(14))
    odd = sum(int(c) * 2 - 9 * (int(c) > 4) for c in body[::2]) + sum(int(c) for c in body[1::2])
    return body + str(-odd % 10)


def planted(r):
    """(kind, text, whether it is personal): forms that the base patterns miss, and near misses."""
    digit = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    who, host = f"{r.choice(FIRST)}.{r.choice(LAST)}", r.choice(HOSTS)
    four = lambda c, s: s.join(c[i : i + 4] for i in range(0, 16, 4))
    wrong = lambda c: c[:-1] + str((int(c[-1]) + r.randint(1, 9)) % 10)
    return r.choice([
        ("email", f"{who}{r.choice([' (at) ', '[at]', ' [at] ', '(at)'])}{host}{r.choice([' dot ', '[dot]', ' [dot] ', '.'])}{r.choice(['com', 'net', 'de'])}", True),
        ("email", f"{who} at {host}, {r.choice(HOSTS)}", False),
        ("ip", r.choice(["[.]", "(.)"]).join(str(r.randint(1, 254)) for _ in range(4)), True),
        ("ip", "[.]".join(str(r.randint(300, 999)) for _ in range(4)), False),
        ("card", four(_card(r), r.choice([".", "  ", " - "])), True),
        ("card", four(wrong(_card(r)), r.choice([".", "  ", " - "])), False),
        ("phone", r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(digit(3), digit(3), digit(4)), True),
        ("phone", f"{digit(2)}-{digit(4)}-{digit(2)}-{digit(4)}", False),
        ("secret", f'{r.choice(["auth_token", "api_key", "db_password", "client_secret"])} = "{some("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", r.randint(20, 40))}"', True),
        ("secret", f'{r.choice(["commit", "digest", "etag"])} {some("0123456789abcdef", 40)}', False),
    ])


@pytest.fixture(scope="module")
def measured(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    r, rows, want = random.Random(77), [], {}
    for d in docs.where("text is not null").orderBy("doc_id").collect():
        kind, span, personal = planted(r)
        at = d.text.find(" ", len(d.text) // 2)
        at = len(d.text) if at < 0 else at
        rows.append((d.doc_id, f"{d.text[:at]} {span} {d.text[at + 1:]}"))
        want[d.doc_id] = (kind, at + 1, at + 1 + len(span), personal)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = pii.find_pii(frame.union(frame.where("false")))
    hits, said = Counter(), Counter()
    for x in found.select("doc_id", F.col("base"), F.col("added")).collect():
        kind, lo, hi, personal = want[x.doc_id]
        said[kind, personal] += 1
        hits[kind, personal] += any(s["start"] < hi and lo < s["end"] for s in [*x.base, *x.added])
    return hits, said


def test_recall_and_false_alarms_by_kind(measured):
    hits, said = measured
    rates = {k: (round(hits[k, True] / said[k, True], 2), round(hits[k, False] / said[k, False], 2)) for k in pii.ALL_KINDS}
    assert all(found >= (0.85 if k == "email" else 0.95) for k, (found, _) in rates.items()), rates
    assert all(wrong <= (0.25 if k == "phone" else 0.05) for k, (_, wrong) in rates.items()), rates
