"""Refresh of the catalogue from arriving files.

The catalogue is refreshed in batches; as a stream this is a file source that is drained and stopped, each
micro-batch being compared with the live state.  There is no event time in the data, hence no watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from cairn.operators.snapshot import next_state
from cairn.sources.files import VersionedTable


def refresh(spark: SparkSession, incoming: str, schema: StructType, table: VersionedTable, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Bring the table up to date with all files in `incoming` that have not been seen, and stop."""

    def apply(batch: DataFrame, _: int) -> None:
        new = prepare(batch)
        table.write(next_state(new, table.read(), new.columns))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
