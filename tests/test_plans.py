"""Physical-plan properties of the registered queries: no cartesian products or nested-loop
joins, Python only in the message parser, filters and column pruning reaching the scan."""

import contextlib
import io

import pytest

from conftest import SF001

SLOW = {"logreg_metrics"}


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    from mailsift.plans.catalogue import queries
    return {n: plan_of(fn(spark, SF001)) for n, fn in queries().items() if n not in SLOW}


def test_no_cross_products(plans):
    bad = {n for n, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p}
    assert not bad


def test_python_only_in_message_parser(plans):
    py = {n for n, p in plans.items()
          if any(k in p for k in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"))}
    assert py == {"mime_ingest", "packed_ingest"}


def test_filter_and_projection_reach_the_scan(plans):
    p = plans["drop_source"]
    assert "Not(EqualTo(source,src3))" in p or "Not(In(source" in p
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in p
    c = plans["class_counts"]
    assert "ReadSchema: struct<doc_id:bigint,toxic:int>" in c
    assert "ReadSchema: struct<doc_id:bigint>" in c


def test_cleaning_runs_once_per_row(plans):
    # the URL mask appears once in the flagship plan: no duplicated regex chain
    p = plans["prepare_corpus_counts"]
    assert p.count("https?://") <= 2  # the expression and its output attribute description
