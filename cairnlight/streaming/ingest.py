"""Incremental extraction: new source files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import sinks, tree


def source_stream(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.rs").option("maxFilesPerTrigger", files_per_trigger).load(root)


def ingest(files: DataFrame, project_id: str, out: str, checkpoint: str, options: tree.ExtractOptions = tree.ExtractOptions()) -> StreamingQuery:
    """Parse each batch of new files and append its rows to the tables in ``out``.

    A batch is parsed once; its rows are kept while the tables are written.
    """

    def write(batch: DataFrame, _: int) -> None:
        parsed = tree.parse(batch.selectExpr("path AS relative_path", "content"), project_id, options).persist()
        try:
            sinks.store(tree.tables(parsed), out)
        finally:
            parsed.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
