"""Continuous ingest: new files of a folder become upserts, one per micro-batch.

The upserts are idempotent, so a batch that is replayed after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking
from ..service import Engine
from ..sources.readers import identified, parsed

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(engine: Engine, folder: str, checkpoint: str, available_now: bool = False, files_per_batch: int = 1000) -> StreamingQuery:
    """Ingest files as they appear; files that cannot be read or hold no usable text are listed in ``<root>/_rejected``."""
    stream = engine.spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(folder)
    files = identified(stream.select("path", "content"))  # the same ids as a batch read of these files

    def upsert(batch: DataFrame, batch_id: int) -> None:
        units = engine.staged(parsed(batch), "stream")
        read = units.where(F.col("error").isNull())
        good = read.join(chunking.chunk_documents(read, engine.config).select("doc_id"), "doc_id", "left_semi").select(units.columns)
        bare = read.join(good.select("doc_id"), "doc_id", "left_anti").select("source_uri", F.lit("No usable text").alias("error"))
        rejected = units.where(F.col("error").isNotNull()).select("source_uri", "error").unionByName(bare)
        rejected.write.mode("overwrite").parquet(f"{engine.store.root}/_rejected/batch={batch_id}")
        if not good.isEmpty():
            engine.ingest(good)
        engine.unstage(units)

    writer = stream_writer(files, upsert, checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_writer(files: DataFrame, upsert, checkpoint: str):
    return files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
