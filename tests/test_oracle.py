"""Every query with SQL gives the SQL's rows."""

from __future__ import annotations

import pytest

from cairngraph import registry
from compare import rows, tables

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    relation = tables(FOLDER).sql(ORACLES[name])
    assert got == rows(list(relation.columns), relation.fetchall())
    assert got[1] or name in {"passage_containment", "multilingual_conflict", "homonyms"}, "an empty result proves little"
