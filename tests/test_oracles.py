"""Every query with an oracle gives the oracle's rows."""

import duckdb
import pytest

from millrace.plans import details, queries, stages  # noqa: F401

SMALL, WIDE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def folder(name):
    """The smallest series is too thin for rows with history, so fitted models take the next size."""
    sql = queries.ORACLES.get(name, "")
    return WIDE if "fit AS (" in sql or name in ("i2_isolation_forest", "i6_forest_held_out", "i20_single_row_prediction") else SMALL


@pytest.fixture(scope="module")
def connections():
    made = {}
    for sf in (SMALL, WIDE):
        made[sf] = duckdb.connect()
        for t in TABLES:
            made[sf].execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return made


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(str([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, connections, name):
    sf = folder(name)
    df = queries.QUERIES[name](spark, sf)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = connections[sf].execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == _rows(names, cur.fetchall())


def test_queries_without_oracle(spark):
    for name in sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"i8_lsa_embeddings", "i9_hybrid_retrieval"}):
        assert queries.QUERIES[name](spark, folder(name)).count() > 0
