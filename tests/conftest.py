import glob
import os

import pytest
from pyspark.sql import SparkSession

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")])
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL over the smallest tables."""

    def cell(v):
        return round(v, 6) if isinstance(v, float) else v

    def check(query, sql):
        df = query(spark, SMALL)
        names = sorted(df.columns)
        mine = sorted((tuple(cell(r[n]) for n in names) for r in df.collect()), key=repr)
        found = duck.execute(sql)
        at = [d[0] for d in found.description]
        assert sorted(at) == names
        theirs = sorted((tuple(cell(dict(zip(at, row))[n]) for n in names) for row in found.fetchall()), key=repr)
        assert mine == theirs

    return check


RECORD = "id string, namespace string, values array<float>, text_content string, metadata string"


@pytest.fixture(scope="session")
def records(spark):
    """Records from (id, values, metadata as JSON text, text) with optional namespace."""

    def make(*rows):
        full = [(r[0], r[4] if len(r) > 4 else "", None if r[1] is None else [float(x) for x in r[1]], r[3] if len(r) > 3 else None, r[2] if len(r) > 2 else None) for r in rows]
        return spark.createDataFrame(full, RECORD)

    return make
