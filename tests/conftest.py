import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from furrow.session import get_spark

    folder = tmp_path_factory.mktemp("spark")
    session = get_spark(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": f"file://{folder}/shared",
            "spark.sql.warehouse.dir": f"{folder}/warehouse",
            "spark.local.dir": f"{folder}/local",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def comparable(value):
    if isinstance(value, float):
        return repr(value)
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def assert_same(df, con, sql):
    """Equal rows in any order, columns by name."""
    cols = sorted(df.columns)
    mine = sorted(tuple(comparable(r[c]) for c in cols) for r in df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(comparable(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert mine == theirs
