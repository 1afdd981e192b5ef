import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rareflow.session import clear_scratch, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("rareflow-tests", cpus="4", partitions=4,
                            scratch=str(tmp_path_factory.mktemp("scratch")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_scratch(session)
    session.stop()


@pytest.fixture()
def numbered(spark):
    """2,000 rows with a unique key, a rare class and some numbers."""
    from pyspark.sql import functions as F

    return spark.range(2000).select(
        F.concat(F.lit("k"), F.col("id")).alias("row_key"), F.col("id"),
        (F.col("id") % 7 == 0).cast("int").alias("target"),
        (F.pmod(F.col("id") * 37, F.lit(101)) / 10.0).alias("x"))
