import os

import pytest

import __spark_entry__
from symlake.plans import analogs, catalog
from tests.oracle import DATA, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
#: Filters over sym_parts must keep some rows and leave some.
FILTERS = ["loc_bucket", "glob_prefix", "glob_infix", "glob_alternation", "default_union", "method_suffix", "drop_dependency_anti", "incidents"]


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_is_like_its_sql(spark, name):
    rows, extra, missing = differences(catalog.QUERIES[name](spark, DATA), catalog.ORACLES[name])
    assert (extra, missing) == (0, 0)
    if name in FILTERS:
        assert 0 < rows < analogs.sym_parts(spark, DATA).count()


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and "line_number" in out.columns
    assert catalog.ORACLES.keys() == catalog.QUERIES.keys()


def test_conditions_reach_the_scan(spark, tmp_path):
    from symlake.model import Location
    from symlake.operators.symbols import query
    from symlake.sources.scan import write_symbols

    write_symbols(analogs.sym_parts(spark, DATA), str(tmp_path / "s"))
    plan = query(spark.read.parquet(str(tmp_path / "s")), "com.brand1*", Location.CLASS)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(location" in plan and "location#" in plan
