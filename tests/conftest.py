import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from matchloom.session import local_session

    return local_session(4, partitions=4, memory="4g")


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


def compare(spark, sf_dir, query, sql):
    """Rows of a query and of its SQL, as sorted text; list order counts, column order does not."""
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")

    def rows(t):
        cols = sorted(t.column_names)
        flat = lambda v: round(v, 6) if isinstance(v, float) else tuple(map(flat, v)) if isinstance(v, list) else v
        return sorted(repr([flat(r[c]) for c in cols]) for r in t.to_pylist()), cols

    assert rows(query(spark, sf_dir).toArrow()) == rows(con.sql(sql).to_arrow_table())
