import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from compare import DATA, check  # noqa: E402

from skein.plans import catalog  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, name):
    check(spark, catalog.QUERIES[name], catalog.SQL.get(name))


def test_names_of_sql_are_queries():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
