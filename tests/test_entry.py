import os

import pytest

import __spark_entry__ as entry_module

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_statement_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", ["sent_filter_counts", "block_candidates", "jaccard_pairs", "edit_pairs", "paper_metadata", "unaligned_renumber", "block_metrics"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    mine = entry_module.queries()[name](spark, SMALL)
    theirs = con.execute(entry_module.oracle_sql()[name])
    cols = sorted(mine.columns)
    at = [[d[0] for d in theirs.description].index(c) for c in cols]
    want = sorted(repr(tuple(r[k] for k in at)) for r in theirs.fetchall())
    assert sorted(repr(tuple(r)) for r in mine.select(*cols).collect()) == want
