"""Insert and rebuild as a stream: each micro-batch's codes are appended to the index's code table, once a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.hashing import hash_codes


def append_codes(points: DataFrame, folder: str, checkpoint: str, family, source) -> StreamingQuery:
    """Streams rows (id, vec) into folder as rows (table_id, id, h, batch). A batch that is repeated replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        hash_codes(batch.select("id", "vec"), family, source).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_codes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", folder).parquet(folder)
