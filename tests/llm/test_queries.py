"""Every registered query of the folder on the smallest tables, against its DuckDB text where it has one."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import compare, connect  # noqa: E402

import corpus_pipeline  # noqa: E402
from candorframe.llm import minhash  # noqa: E402
from candorframe.llm.common import stage  # noqa: E402
from candorframe.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert compare(df, connect(sf), ORACLES[name]) == ""
    else:
        assert df.columns and df.count() > 0


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, sf), name)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and now <= ids, name
        if name != "best_fit_packing":
            assert docs.columns == columns
            ids = now
    assert now == ids
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "secret_scan", "target_mixing", "best_fit_packing"]


def test_pipeline_near_copies_from_80_percent(spark):
    """Pairs of texts of n words that differ in their last k: similarity (n - 4 - k) / (n - 4 + k)."""
    rows = []
    for k, group in ((10, 0), (9, 1), (8, 2), (12, 3)):  # 0.80, 0.818, 0.837 and 0.765
        for pair in range(20):
            w = [f"w{group}x{pair}x{i}" for i in range(94)]
            at = 1_000 * group + 2 * pair
            rows += [(at, " ".join(w)), (at + 1, " ".join(w[: 94 - k] + [f"{x}y" for x in w[94 - k :]]))]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()}
    assert kept == {i for i, _ in rows if i % 2 == 0 or i >= 3_000}
    assert minhash.banding(85) == 6 and minhash.banding(80) == 5
