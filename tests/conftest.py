import pytest

from marquee.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, app="marquee-tests", shuffle=2, parallelism=2)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    yield session
    session.stop()


@pytest.fixture
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def table(spark):
    """Rows and a DDL schema to a DataFrame."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture
def evaluate(spark):
    """Evaluate one expression per input row and return the plain values."""

    def run(expression, rows, schema):
        df = spark.createDataFrame([tuple(r) + (i,) for i, r in enumerate(rows)], schema + ", _i int")
        out = df.coalesce(1).select("_i", expression.alias("v")).collect()
        return [r["v"] for r in sorted(out, key=lambda r: r["_i"])]

    return run
