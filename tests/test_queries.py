"""Every registered query of the core: against its DuckDB twin, else that it gives a stable number of rows."""

from __future__ import annotations

import pytest

from pairforge.plans import load
from pairforge.registry import CORE

load()


@pytest.mark.parametrize("name", CORE.oracles)
def test_equals_duckdb(name, check):
    check(CORE.runs[name], CORE.oracles[name])


@pytest.mark.parametrize("name", [n for n in CORE.runs if n not in CORE.oracles])
def test_gives_rows(name, spark, sf):
    assert CORE.runs[name](spark, sf).count() > 0


def test_recall_of_lists(spark, sf):
    assert CORE.runs["knn_ivf_recall"](spark, sf).first().recall >= 0.9


def test_negatives_are_topped_up(spark, sf):
    """All ten of every record; medium ones of the source and another query, as many as there are; none is the positive."""
    records = [r for r in spark.read.parquet(f"{sf}/normalised.parquet").collect() if r.query is not None]
    texts = lambda r: [x for x in (r.pos or []) + (r.neg or []) if x is not None]
    got = {r.rec_id: r for r in CORE.runs["easy_medium_hard_topped"](spark, sf).collect()}
    every = {x for r in records for x in texts(r)}
    assert set(got) == {r.rec_id for r in records if r.pos}
    for r in records:
        if r.pos:
            positive, g = next((x for x in r.pos if x is not None), None), got[r.rec_id]
            may = {x for o in records if (o.source or "") == (r.source or "") and o.query != r.query for x in texts(o)} - {positive}
            assert len(g.easy + g.medium + g.hard) == 10 and len(g.medium) == len(set(g.medium)) == min(3, len(may))
            assert set(g.medium) <= may and set(g.easy) <= every - {positive} and g.hard == [x for x in r.neg or [] if x is not None][:2]


def test_negatives_of_a_hot_query(spark):
    from pairforge.operators.mining import topped_negatives

    data = [(i, "hot" if i < 90 else f"q{i}", [f"p{i % 95}"], None, "a") for i in range(100)] + [(100, "x", ["p0"], [None, "n"], None)]
    rows = spark.createDataFrame(data, "rec_id BIGINT, query STRING, pos ARRAY<STRING>, neg ARRAY<STRING>, source STRING")
    for r in topped_negatives(rows, 1, 3, 2, 7).collect():
        own = f"p{r.rec_id % 95}" if r.rec_id < 100 else "p0"
        assert len(r.easy + r.medium + r.hard) == 6 and own not in r.easy + r.medium
        assert len(r.medium) == (3 if r.rec_id < 100 else 0) and r.hard == (["n"] if r.rec_id == 100 else [])
        if r.rec_id < 90:
            assert set(r.medium) <= {f"p{i % 95}" for i in range(90, 100)}


def test_batches_of_an_evaluation_are_whole(spark, sf, tmp_path):
    """Every document, in batches of 32 and a rest; full batches as in batch_pad."""
    for n in (100, 5):
        docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(n)
        docs.write.parquet(str(tmp_path / f"{n}" / "documents.parquet"))
        got = CORE.runs["batch_pad_all"](spark, str(tmp_path / f"{n}")).collect()
        ids = sorted(r.doc_id for r in docs.collect())
        assert {r.doc_id: r.batch_id for r in got} == {d: i // 32 for i, d in enumerate(ids)} and len(got) == len(ids)
        full = {tuple(r) for r in CORE.runs["batch_pad"](spark, str(tmp_path / f"{n}")).collect()}
        assert {tuple(r) for r in got if r.batch_id < len(ids) // 32} == full
        for b in {r.batch_id for r in got}:
            assert len({(r.n_ids, r.n_eos) for r in got if r.batch_id == b}) == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_import_llm():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "pairforge"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "pairforge.llm" not in p.read_text(), p
