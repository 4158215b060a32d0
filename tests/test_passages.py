"""Passages of whole texts."""

import pandas as pd

from inkwell.plans.catalog import QUERIES


def test_passages_hold_the_whole_text(spark, tmp_path):
    """Of a text of 50 passages the first 20 were given before."""
    lines = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(101)]
    pd.DataFrame({"doc_id": [1, 2], "text": ["\n\n".join(lines), "short"]}).to_parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["passage_chunks"](spark, str(tmp_path)).orderBy("doc_id", "piece").collect()
    assert [(r.doc_id, r.piece) for r in got] == [(1, i) for i in range(51)] + [(2, 0)]
    assert "\n".join(r.passage for r in got if r.doc_id == 1) == "\n".join(lines)
