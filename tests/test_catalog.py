from __future__ import annotations

import oracle
import pytest

from terravane.plans import catalog, files, learning  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    oracle.check(spark, name, catalog.QUERIES[name], catalog.ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_refined_areas_hold_every_point_once(spark, sf_dir):
    from pyspark.sql import functions as F

    from terravane.plans import views

    out = catalog.QUERIES["adaptive_refine"](spark, sf_dir)
    points = views.posts(spark, sf_dir).count()
    assert out.agg(F.sum("n")).first()[0] == points
    assert out.where("n >= 50 and (north - south >= 0.001 or east - west >= 0.001)").count() == 0
