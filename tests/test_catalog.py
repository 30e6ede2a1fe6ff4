"""A sample of the registered queries against their SQL; RXLAKE_ALL_QUERIES=1 runs all of them."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from testbed.check import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ["resolve", "check_pairs", "substitutes_for_product", "ingest_interactions", "brand_validation", "suggest_confusable", "stream_check", "stream_upsert", "coverage_stats", "product_components"]
CHOSEN = sorted(queries()) if os.environ.get("RXLAKE_ALL_QUERIES") else SAMPLE


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, name):
    ok, note = compare(queries()[name](spark, SF), connect(SF), oracle_sql()[name])
    assert ok, note


def test_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", ["substitutes_for_molecule", "substitution_baseline", "eval_substitution"])
def test_reads_stored_profile(spark, name):
    """The products, their molecules and the drug strings are derived once, not in every branch of the plan."""
    files = queries()[name](spark, SF).inputFiles()
    assert files and not any(f.endswith(("/part.parquet", "/lineitem.parquet")) or "/part.parquet/" in f for f in files)


def test_stages_of_a_run_are_planned_apart(spark):
    """One plan with the broadcasts of all stages did not fit the driver."""
    run = queries()["eval_run"](spark, "/root/testdata/sf0.001")
    assert len({r["stage"] for r in run.collect()}) == 3
    assert "Join" not in run._jdf.queryExecution().optimizedPlan().toString()
