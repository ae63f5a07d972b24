"""Every registered query against its SQL on the smallest tables."""

import pytest

from pointloom.plans import catalog

from . import oracles

SF = "/root/testdata/sf0.001"
#: Their SQL looks for neighbours in boxes that are wide enough from here on.
DENSE = {"i7_remove_statistical_outliers": "/root/testdata/sf0.01", "i16_init_extent": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name):
    sf = DENSE.get(name, SF)
    assert oracles.compare(spark, oracles.connect(sf), sf, name, catalog.QUERIES, catalog.ORACLES) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and all(r[c] is not None for r in rows[:100] for c in df.columns if c != "component")
