"""Layers written once: the catalog answers counts and checks without reading a table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from heartwood.operators import quality
from heartwood.plans import catalog
from heartwood.plans import queries as registry
from heartwood.plans.tables import LAYERS


@pytest.fixture(scope="module")
def stored(tables, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layers"))
    return catalog.write_layers(tables, path, quality.DATA_CHECKS, registry.app_tables), path


def test_the_catalog_holds_every_layer(stored, spark):
    written, path = stored
    found = {(r.layer, r.table_name): r for r in catalog.read_catalog(spark, path).collect()}
    assert {name for layer, name in found if layer in LAYERS} == {name for names in LAYERS.values() for name in names}
    assert [name for layer, name in found if layer == "APP"] == ["role_region_mapping", "ai_quality_log", "nba_email_log"]
    for (_, name), row in found.items():
        assert row.row_count == written[name].count()
    assert found["CLEAN", "clean_interactions"].refresh_mode == "INCREMENTAL" and found["RAW", "raw_claims"].refresh_mode is None


def test_checks_read_the_catalog_only(stored, tables, spark):
    _, path = stored
    checks = catalog.stored_checks(catalog.read_catalog(spark, path), quality.DATA_CHECKS, quality.CATALOG_CHECKS, registry.registries())
    plan = checks._jdf.queryExecution().executedPlan().toString()
    assert "catalog" in plan and not any(f"{name}.parquet" in plan for name in ("events", "lineitem", "orders", "customer"))
    assert sorted(checks.collect()) == sorted(registry.check_suite(tables).collect())


def test_a_check_fails_where_the_catalog_says_so(stored, spark):
    _, path = stored
    without = catalog.read_catalog(spark, path).withColumn("row_count", F.lit(0).cast("bigint")).filter("layer <> 'RAW'")
    checks = catalog.stored_checks(without, quality.DATA_CHECKS, quality.CATALOG_CHECKS, registry.registries() | {"searches": 0})
    status = {r.test_name: r.status for r in checks.collect()}
    assert status["All layers populated"] == "FAIL" and status["Search"] == "FAIL" and status["Semantic view"] == "PASS"


def test_later_tables_start_from_written_ones(stored):
    written, path = stored
    plan = written["churn_risk"]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and path.split("/")[-1] in plan
