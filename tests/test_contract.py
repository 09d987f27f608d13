"""Driver contract: entry smoke, registry/oracle coverage, a DuckDB comparison sample at sf0.001, streaming = batch."""

import duckdb
import pytest

import __spark_entry__ as entry
from cantoria.sources.tables import TABLES
from tests.conftest import SMALL


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"decada", "zona", "canciones"}
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) >= 80


def _norm(v):
    return "∅" if v is None else (repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v))


@pytest.mark.parametrize("name", ["density_zones", "stanza_rollup", "keyword_in_context", "verse_to_stanza",
                                  "entropy_bootstrap", "roc_auc", "similarity_topk", "tfidf", "incremental_ingest"])
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    sdf = entry.queries()[name](spark, SMALL)
    cols = sorted(sdf.columns)
    a = sorted(tuple(_norm(r[c]) for c in cols) for r in sdf.collect())
    res = con.sql(entry.oracle_sql()[name])
    idx = [res.columns.index(c) for c in cols]
    b = sorted(tuple(_norm(r[i]) for i in idx) for r in res.fetchall())
    assert a == b
