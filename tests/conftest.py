import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def broadcast_joins(spark, monkeypatch):
    """A function that gives the plans, run since the test began, of joins that broadcast a side; no side counts as small."""
    from assertia.plans import tables

    monkeypatch.setattr(tables, "FEW", -1, raising=False)
    sc, store = spark.sparkContext._jsc.sc(), spark._jsparkSession.sharedState().statusStore()

    def plans():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = store.executionsList()
        return {x.executionId(): x.physicalPlanDescription() for x in (found.apply(i) for i in range(found.size()))}

    before = plans()
    return lambda: [p for k, p in plans().items() if k not in before and "BroadcastHashJoin" in p]
