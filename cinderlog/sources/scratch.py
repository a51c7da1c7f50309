"""A folder that all executors share, for stores and streams that a query sets up by itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from cinderlog.sources import events
from cinderlog.sources.store import Store


def scratch(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/cinderlog-scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_STORES: dict[tuple[str, str], Store] = {}


def stored_events(spark: SparkSession, sf_dir: str) -> Store:
    """A store of the events with both rollups, set up once for an application and a table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        store = Store(spark, scratch(spark, "events"))
        store.load("bulk", events.logs(spark, sf_dir))
        store.rebuild()
        _STORES[key] = store
    return _STORES[key]
