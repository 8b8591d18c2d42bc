"""Streams: response chunks put together, records de-duplicated across micro-batches, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stemforge.functions import text as T
from stemforge.functions.modeljson import parse_responses


def assemble(chunks: DataFrame) -> DataFrame:
    """batch_no and text of responses whose chunks (batch_no, seq, text, at) have come, whole or not: unfinished ones are salvaged later."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return chunks.groupBy("batch_no").agg(F.array_join(parts, "").alias("text"))


def questions_of(responses: DataFrame) -> DataFrame:
    parsed = parse_responses(responses)
    return parsed.select("batch_no", F.explode("questions").alias("q")).select("batch_no", "q.*")


def unique_records(records: DataFrame, at: str = "at", late: str = "10 minutes") -> DataFrame:
    """Records of a stream without repeats of a fingerprint within the watermark."""
    return records.withColumn("fingerprint", T.fingerprint(F.col("question"), F.col("options"))).withWatermark(at, late).dropDuplicatesWithinWatermark(["fingerprint"])


def rates(events: DataFrame, at: str = "ts", key: str = "user_id", width: str = "60 seconds", step: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    """Events of a key in sliding windows; an extra on plain Structured Streaming."""
    return events.withWatermark(at, late).groupBy(F.window(at, width, step), key).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, at: str = "ts", key: str = "user_id", gap: str = "45 seconds", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n"))


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "fingerprint") -> StreamingQuery:
    """Adds the records of each micro-batch that the table at `path` does not hold yet; a repeated batch adds nothing."""

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            new = new.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti")
        new.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
