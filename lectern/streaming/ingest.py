"""Incremental synthesis: each micro-batch of keyed chunks goes to the engine only where the cache lacks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.operators import output, speech


def resume(spark: SparkSession, keyed: DataFrame, cache_path: str, engine=output.stand_in) -> int:
    """Synthesise what the cache at ``cache_path`` lacks and append it; the number of new entries."""
    there = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        cache = spark.read.schema("key string, audio binary").parquet(cache_path)
    else:  # only a missing path is an empty cache
        cache = spark.createDataFrame([], "key string, audio binary")
    todo = speech.misses(keyed, cache).cache()
    n = todo.count()
    if n:
        output.synthesize(todo, engine).write.mode("append").parquet(cache_path)
    todo.unpersist()
    return n


def stream_chunks(chunks: DataFrame, cache_path: str, checkpoint: str, voice: str, engine=output.stand_in):
    """A streaming query over chunk rows (doc_id, text): file source in, cache out."""

    def batch(df: DataFrame, _: int) -> None:
        resume(df.sparkSession, speech.chunk_keys(df, voice), cache_path, engine)

    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
