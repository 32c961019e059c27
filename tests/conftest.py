import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def one(spark):
    """Value of an expression over literal inputs."""
    from pyspark.sql import functions as F

    def value(build, *texts):
        names = [f"c{i}" for i in range(len(texts))]
        ddl = ", ".join(f"{n} string" for n in names) or "x int"
        df = spark.createDataFrame([texts or (1,)], ddl)
        return df.select(build(*[F.col(n) for n in names]).alias("v")).first()["v"]

    return value


@pytest.fixture(scope="session")
def many(spark):
    """Values of an expression, one per input text."""
    from pyspark.sql import functions as F

    def values(build, texts, ddl="string"):
        df = spark.createDataFrame(list(enumerate(texts)), f"i int, c {ddl}")
        rows = df.select("i", build(F.col("c")).alias("v")).collect()
        return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]

    return values
