"""Python data sources made known to a session."""

from __future__ import annotations

import threading
import weakref

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource

_lock = threading.Lock()
_known: weakref.WeakKeyDictionary[SparkSession, set[str]] = weakref.WeakKeyDictionary()


def known(spark: SparkSession, source: type[DataSource]) -> None:
    """Register source, once in a session: of two threads that register a name at the same time, Spark may refuse one."""
    with _lock:
        names = _known.setdefault(spark, set())
        if source.name() not in names:
            spark.dataSource.register(source)
            names.add(source.name())
