"""The formats' own cases beside the rows that they state."""

from __future__ import annotations

import duckdb
import pytest
from formats import CASES
from test_queries import same_rows


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    case, sql = CASES[name]
    cursor = duckdb.connect().execute(sql)
    wanted_names = [d[0] for d in cursor.description]
    df = case(spark, None)
    found = [tuple(r) for r in df.collect()]
    same_rows(found, df.columns, cursor.fetchall(), wanted_names)
    assert found
