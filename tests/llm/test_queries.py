import os

import pytest

from symlake.llm import catalog
from tests.oracle import DATA, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", catalog.oracle_sql())
def test_query_is_like_its_sql(spark, name):
    assert differences(catalog.queries()[name](spark, DATA), catalog.oracle_sql()[name])[1:] == (0, 0)


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in catalog.oracle_sql()])
def test_query_runs_on_all_rows(spark, name):
    out = catalog.queries()[name](spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = out.select("doc_id").distinct()
    assert ids.count() == docs.count() if name != "pipeline" else 0 < ids.count() < docs.count()
