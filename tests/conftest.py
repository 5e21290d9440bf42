import glob
import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from facetspark.session import session

    tmp = tmp_path_factory.mktemp("spark")
    s = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": str(tmp / "warehouse"), "spark.checkpoint.dir": f"file://{tmp}/shared", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{src}')")
    return con


def same(a, b) -> bool:
    """Do two pandas frames hold the same rows, in any order?"""
    if sorted(a.columns) != sorted(b.columns) or len(a) != len(b):
        return False

    def rows(x):
        x = x[sorted(x.columns)].astype(object)
        x = x.where(x.notna(), None)
        return sorted(tuple(repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in x.itertuples(index=False))

    return rows(a) == rows(b)
