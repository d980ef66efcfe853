"""A watched folder: new statement files are imported as they arrive.

Imports are idempotent by content, so a batch that is replayed after a failure
adds nothing, and no state is needed beyond the ledger itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, LongType, StringType, StructType, TimestampType

from statwright.sources.statements import SUFFIXES, load_override, named
from statwright.store import Store

FILES = StructType().add("path", StringType()).add("modificationTime", TimestampType()).add("length", LongType()).add("content", BinaryType())


def watch(spark: SparkSession, folder: str, store: Store, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Imports what is there and stops (``availableNow``); run it again, or on a schedule, for what has come since.

    A batch of files is one import and one commit. Many small batches cost a folder
    each; ``Store`` joins these from time to time.
    """

    def one(batch: DataFrame, _: int) -> None:
        store.import_files(named(batch), override=load_override(spark, folder))

    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", SUFFIXES).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
