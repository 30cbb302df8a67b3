"""Every core query runs over its tables and, where there is SQL, equals DuckDB."""
import decimal
import os

import pytest

from helixframe.plans.registry import collect

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE = collect()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def norm(v):
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    if name in ORACLE:
        rel = duck.sql(ORACLE[name])
        cols = sorted(rel.columns)
        assert sorted(df.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert sorted(tuple(norm(r[c]) for c in cols) for r in got) == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def test_oracle_names_are_queries():
    assert set(ORACLE) <= set(QUERIES)


def test_shifted_matrix_covers_whole_reads(spark):
    n = [QUERIES[q](spark, DATA).groupBy().sum("n").first()[0] for q in ("A8_consensus_matrix", "A8_consensus_shift_whole")]
    assert n[0] == n[1]


def test_bands_with_ambiguous_flanks(spark):
    got = QUERIES["P21_dictionary_bands_flanks"](spark, DATA).collect()
    assert any(set(r["head"] + r["tail"]) - set("ACGT") for r in got)
    assert not any(set(r["band"]) - set("ACGT") for r in got)


def test_the_stream_loses_no_valid_record(spark, duck):
    """Every record that is valid by itself is found among the broken ones around it; what is found besides lies inside broken texts."""
    from helixframe.plans.records import VALID_BY_BLOCK

    got = {tuple(r)[:3]: r["n_valid"] for r in QUERIES["p1_stream"](spark, DATA).collect()}
    want = {tuple(r)[:3]: r[3] for r in duck.sql(VALID_BY_BLOCK).fetchall()}
    assert set(got) == set(want) and all(got[k] >= n for k, n in want.items())
    assert sum(got.values()) - sum(want.values()) <= QUERIES["p1_recovered"](spark, DATA).count()
