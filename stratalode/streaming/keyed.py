"""What the operators with state of their own share."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session whose streams keep state in RocksDB, on disk; the caller's settings stay as they are.

    partitions: of the state, as many as there are shuffle partitions if not
    given; a stream keeps those that it began with.
    """
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(key, spark.conf.get(key))
    if partitions is not None:
        session.conf.set("spark.sql.shuffle.partitions", str(partitions))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return session
