"""Running a row-wise operator over a growing folder. Only operators without aggregation fit; batch code is reused as is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_stateless(spark: SparkSession, source: str, schema, operator: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Process the files that are there and stop; a later call takes up where this one ended."""
    made = operator(spark.readStream.schema(schema).parquet(source))
    query = made.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
