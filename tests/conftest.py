import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("fieldspark-tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).config("spark.driver.memory", "4g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def daily(days, asset="A-1", start="2026-01-01", base=100.0, slope=0.5):
    """(asset_id, timestamp, production, source, source_type) rows of one asset."""
    from datetime import datetime, timedelta

    first = datetime.fromisoformat(start)
    return [(asset, first + timedelta(days=i), max(base - slope * i, 1.0), "feed", "SYNTHETIC") for i in range(days)]


TELEMETRY_DDL = "asset_id string, timestamp timestamp, production double, source string, source_type string"
