"""The registered queries against their SQL twins."""

import pytest
from harness import compare

from kairoframe.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, name):
    assert compare(spark, registry.QUERIES[name], registry.ORACLES[name]) == ""
