"""New PDF files to a growing table of blocks. Documents are independent, so a batch needs no state from others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.sources import pdf_source


def pdf_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, content) of the files that arrive in a folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select(F.col("path").alias("doc_id"), "content")


def stream_blocks(spark: SparkSession, folder: str, target: str, checkpoint: str, password: str | None = None, once: bool = False) -> StreamingQuery:
    """Appends the blocks of each new file to the Parquet table target, by batch: a batch that is run again overwrites its own part."""

    def append(batch: DataFrame, number: int) -> None:
        parsed = pdf_source.parse_pdfs(batch, password).persist()
        pdf_source.blocks_of(parsed).write.mode("overwrite").parquet(f"{target}/batch={number}")
        parsed.unpersist()

    writer = pdf_stream(spark, folder).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
