"""Every query that has SQL gives the rows that DuckDB gives on the smallest data."""

import glob
import math
import os

import duckdb
import pytest

from clausespark.plans import registry

registry.load()
DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SOME = sorted(registry.oracle_sql())


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, con, name):
    df = registry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    q = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in q.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in q.fetchall()), key=repr)
    assert sorted(names) == cols and got == want


def test_rows_only(spark):
    """The queries without SQL: chunks hold every text, and rebuilt vectors have one row for each clause's chunk."""
    from pyspark.sql import functions as F

    from clausespark.functions import text as T

    without = set(registry.queries()) - set(registry.oracle_sql())
    assert without == {"a7_rebuild_vectors"}, without
    got = {}
    for r in registry.queries()["b9_chunks"](spark, DIR).collect():
        got.setdefault(r.doc_id, {})[r.chunk_index] = r.chunk
    plain = {r.doc_id: r.t for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", T.plain_text("text").alias("t")).collect()}
    for i, t in plain.items():
        ends = {0}  # where the chunks so far may end: texts that repeat themselves allow several places
        for k in range(len(got.get(i, {}))):
            c = got[i][k]
            assert len(c) <= 512
            ends = {e - o + len(c) for e in ends for o in range(min(e, 51) + 1) if t.startswith(c, e - o)}
        assert len(t) in ends, i
    for name in sorted(without - {"b9_chunks"}):
        df = registry.queries()[name](spark, DIR)
        assert df.count() > 0 and df.where(F.col(df.columns[0]).isNull()).count() == 0


def test_oracle_sql_is_text():
    import __spark_entry__ as entry

    assert all(isinstance(v, str) and k in entry.queries() for k, v in entry.oracle_sql().items())
