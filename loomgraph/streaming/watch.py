"""Keeping a store up to date with a stream of files.

A file source reports a path once, so it tells that something has arrived, not what has changed or gone. Every
micro-batch therefore compares what is there now with what is known, by content hash, and indexes the difference. The
trigger's interval is the debounce: changes within it make one batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loomgraph.plans.index import Indexed, index_files
from loomgraph.sources.files import read_files
from loomgraph.sources.languages import Registry
from loomgraph.store import Store


def file_stream(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """Files below ``root`` as they arrive."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(root)


def watch(
    spark: SparkSession,
    store: Store,
    root: str,
    registry: Registry,
    checkpoint: str,
    debounce: str | None = "500 milliseconds",
    then: Callable[[Indexed], None] | None = None,
) -> StreamingQuery:
    """Index ``root`` whenever files arrive; without ``debounce`` only what is there now, and then stop."""

    def batch(arrived: DataFrame, number: int) -> None:
        if arrived.select("path").isEmpty():
            return
        done = index_files(store, read_files(arrived.sparkSession, root), registry)
        if then is not None:
            then(done)

    writer = file_stream(spark, root).select("path", "modificationTime").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=debounce) if debounce else writer.trigger(availableNow=True)).start()
