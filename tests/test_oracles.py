"""Every registered query against its SQL, on the smallest tables."""

import pytest

from textloom import operators, registry  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(name, same):
    same(registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(name, spark):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
