"""Every registered query runs, and equals its SQL where it has one."""

import pytest
from oracle import compare

from kinetrace.plans import library, motion, registry

assert library and motion


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert compare(spark, name, registry.QUERIES[name], registry.SQL[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_round_trips_hold(spark, sf):
    assert registry.QUERIES["bag_roundtrip"](spark, sf).where("not bytes_equal").count() == 0
    assert registry.QUERIES["corruption_matrix"](spark, sf).where("status <> 'PASS'").count() == 0
    assert registry.QUERIES["packet_verify"](spark, sf).where("not ok").count() == 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_published_quality_figures(spark, sf):
    """The figures that are known for these seeded corpora come out again."""
    sweep = {r["threshold"]: r for r in registry.QUERIES["anomaly_corpus_sweep"](spark, sf).collect()}
    assert (sweep[3.22]["fpr"], sweep[3.22]["recall"]) == (0.05, 0.9) and (sweep[3.0]["fpr"], sweep[3.0]["recall"]) == (0.19, 0.9)
    assert min(t for t, r in sweep.items() if r["fpr"] <= 0.05 and r["recall"] >= 0.9) == 3.22
    quality = {r["feature"]: r["accuracy"] for r in registry.QUERIES["token_quality"](spark, sf).collect()}
    assert {k: round(v, 4) for k, v in quality.items()} == {"direction": 0.8077, "grid": 0.3333, "spectrum": 0.7051}
    assert registry.QUERIES["primitive_precision"](spark, sf).first()["precision"] == 1.0
