"""A stream over what is there now, run to its end."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it has a temporary folder, a cluster is refused."""
    if folder := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="quillmark-streams-"))
    return _LOCAL[0]


def replay(stream: DataFrame) -> DataFrame:
    """The rows that ``stream`` (in append mode) gives for all input there is now, as a table in the shared folder; state is kept by RocksDB."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        query = stream.writeStream.format("parquet").option("checkpointLocation", folder + "/state").trigger(availableNow=True).start(folder + "/rows")
        query.awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return spark.read.schema(stream.schema).parquet(folder + "/rows")
