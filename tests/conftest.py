import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    """The smallest driver tables."""
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("no test tables here")
    return str(path)


@pytest.fixture(scope="session")
def compare(spark):
    """compare(queries, oracles, data): names whose rows differ between Spark and DuckDB."""
    import collections
    import glob

    import duckdb

    def cell(v):
        if isinstance(v, float):
            return "nan" if v != v else repr(round(v, 6) + 0.0)
        return repr(v)

    def run(queries, oracles, where):
        c = duckdb.connect()
        c.sql("SET timezone='UTC'")
        for f in glob.glob(f"{where}/*.parquet"):
            c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        wrong = []
        for name, sql in oracles.items():
            df = queries[name](spark, where)
            cols = sorted(df.columns)
            got = collections.Counter(tuple(map(cell, r)) for r in df.select(*cols).collect())
            listed = ",".join(f'"{x}"' for x in cols)
            want = collections.Counter(tuple(map(cell, r)) for r in c.sql(f"SELECT {listed} FROM ({sql})").fetchall())
            if got != want or sorted(c.sql(sql).columns) != cols:
                wrong.append(name)
        return wrong

    return run
