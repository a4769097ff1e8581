"""Files that are dropped into a folder become chunks: a binary file stream, imported batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tesserae.store import Store

BINARY_FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def watch(store: Store, folder: str, checkpoint: str, glob: str = "*", available_now: bool = True, max_files: int = 1000, **options: object) -> StreamingQuery:
    """Imports what is in `folder` and what comes, each file once. The checkpoint remembers the files that are done; the
    number of a batch becomes visible together with its chunks, so a batch that is run again, for whatever reason, is
    known by it and left out."""
    stream = store.spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).load(folder)

    def batch(files: DataFrame, number: int) -> None:
        if not files.isEmpty():
            store.import_binary(files, mark=f"{checkpoint}#{number}", **options)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
