"""Text queries against their SQL."""

import pytest

from pointloom.llm import queries
from tests import oracles


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf, name):
    assert oracles.compare(spark, oracles.connect(sf), sf, name, queries.QUERIES, queries.ORACLES) == ""
