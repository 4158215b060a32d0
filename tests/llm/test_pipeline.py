"""Each stage of the pipeline against plain Python: nulls, empties, ties, repeats, clashing columns."""

import zlib
from collections import Counter, defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import langid, packing, tokens
from inkwell.llm.queries import vocabulary
from tests.llm.test_simhash_mixing import brute_fingerprint, water_fill
from tests.llm.test_text_operators import brute_lines

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def rows(spark, odd_rows, prose):
    menu = [(100 + i, f"Home\n{prose(200 + i, 40)}\nImprint" if i % 3 else "Home\nImprint", "en", ("s", None)[i % 2], i, "clash", "y", 7) for i in range(40)]
    again = [(4, prose(60, 90), "en", "b", 1, "f", "l", 1), (None, prose(61, 90), "de", "c", 1, "f", "l", 2), (None, prose(61, 90), "de", "c", 1, "f", "l", 2)]
    return odd_rows + menu + menu[:2] + again


@pytest.fixture()
def docs(spark, odd, rows):
    return spark.createDataFrame(rows, odd.schema)


def stage(spark, name, docs):
    out = STAGES[name](spark, docs, "/nowhere")
    if name != "best_fit_packing":
        assert out.columns == docs.columns
    return Counter(tuple(r) for r in out.collect())


def test_language_stage(spark, docs, rows):
    model = langid.fit(docs.where(langid.fold() != 0))
    coders = [
        zstandard.ZstdCompressor(level=model.level, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        for _, d in model.dictionaries
    ]

    def stays(text):
        data = langid.letters(text or "").strip().encode()
        if not data:
            return False
        parts = [data[i : i + model.chunk] for i in range(0, len(data), model.chunk)]
        best, second = sorted(sum(len(c.compress(p)) for p in parts) for c in coders)[:2]
        return not langid.narrow(best, second, len(data), model)

    got = stage(spark, "language_id", docs)
    assert got == Counter(r for r in rows if stays(r[1])) and len(model.dictionaries) > 2


def test_line_stage(spark, docs, rows):
    got = stage(spark, "line_dedup", docs)
    assert sorted((r[0] or -1, r[1] or "") for r in got.elements()) == [x[:2] for x in brute_lines(rows)]
    before = Counter((r[0], r[1], r[4]) for r in rows)
    for r in got:
        assert (r[0], r[1], r[4]) in before or r[4] == len(r[1])


def test_near_dedup_stage(spark, docs, rows):
    got = stage(spark, "near_dedup", docs)
    prints = {r: brute_fingerprint(r[1]) for r in set(rows)}
    group = {f: f for f in prints.values()}
    changed = True
    while changed:
        changed = False
        for f in group:
            least = min(group[g] for g in group if (f ^ g).bit_count() <= 3)
            changed |= least != group[f]
            group[f] = least
    best = {}
    for r, f in prints.items():
        key = (r[0] is None, r[0] or 0)
        best[group[f]] = min(best.get(group[f], key), key)
    assert len(got) == sum(got.values()) == len(best)  # one row a group
    assert set(got) <= set(rows)
    for r in got:
        assert best[group[prints[r]]] == (r[0] is None, r[0] or 0)


def test_mixing_stage(spark, docs, rows):
    got, given = stage(spark, "source_mixing", docs), Counter(rows)
    words = lambda r: len((r[1] or "").encode().split())
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r)
        largest[r[3]] = max(largest[r[3]], words(r))
    for r, n in got.items():
        assert n <= 3 * given[r]
        taken[r[3]] += n * words(r)
    want = water_fill(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert got == stage(spark, "source_mixing", docs)


def test_packing_stage(spark, docs, rows):
    library = tokens.load(vocabulary("word_bpe_49k.json"))
    out = STAGES["best_fit_packing"](spark, docs, "/nowhere").collect()
    want = Counter()
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for i in range(0, len(ids), 4096):
            part = ids[i : i + 4096]
            want[r[0], i // 4096, i, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 4096
    assert len(bins) == packing.lower_bound(Counter(r.length for r in out))


@pytest.mark.parametrize("name", STAGES)
def test_stages_of_nothing(spark, empty, name):
    assert not stage(spark, name, empty)


def test_run(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    pieces = out.collect()
    assert pieces and 1 not in {r.doc_id for r in pieces}  # the null text goes with the first stage
    assert out.where(F.col("start") == 0).count() <= 3 * docs.count()


NAMES = ["n", "stays", "_near_id", "_near_digest", "own_id", "lines", "langid", "held_out", "row", "a.b", "mix", "digest", "group", "size", "none", "lang_pred"]


@pytest.mark.parametrize("name", STAGES)
def test_stages_pass_columns_of_any_name(spark, name, prose):
    base = [(i, prose(i % 7, 80), "en", "ab"[i % 2], 5) for i in range(1, 13)] + [(1, prose(1, 80), "en", "b", 5), (None, None, None, None, None)]
    rows = [(*r, *[f"{c}{i}" for c in NAMES]) for i, r in enumerate(base)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *[f"`{c}` string" for c in NAMES]]))
    out = STAGES[name](spark, docs, "/nowhere")
    got = out.collect()
    assert got
    if name != "best_fit_packing":
        assert out.columns == docs.columns and {tuple(r)[5:] for r in got} <= {r[5:] for r in rows}
