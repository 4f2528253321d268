"""Streaming: the per-record operators on ``readStream``.

Tokenisation (T1-T11), analysis (F1-F3), hashing (F12) and prediction with
a fitted model are stateless per record, so they run unchanged on a stream
of JSON-lines files. Fitted state (a vocabulary table, model weights) is
static and joined or broadcast into each micro-batch; the per-document
steps that group by document (norms) run inside ``foreachBatch``, where a
micro-batch is an ordinary DataFrame. The sink is idempotent per batch id
(overwrite of the batch's own folder), so a replayed batch after a failure
writes the same files again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import concat_text, core_tokenize, keyword_string
from quire.sources.papers import PAPER_SCHEMA


def tokenized_stream(spark: SparkSession, source_dir: str, max_files: int = 100) -> DataFrame:
    """JSON-lines files arriving in ``source_dir`` -> tokenised one-text rows."""
    raw = (spark.readStream.schema(PAPER_SCHEMA).option("maxFilesPerTrigger", max_files)
           .json(source_dir))
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("title").alias("raw_title"),
        concat_text(keyword_string("keywords"), core_tokenize("title"),
                    core_tokenize("abstract")).alias("text"),
        F.col("plength").cast("double").alias("label"))


def score_batches(stream: DataFrame, score_batch, sink_dir: str, checkpoint_dir: str,
                  available_now: bool = True):
    """Run ``score_batch(batch_df) -> DataFrame`` on every micro-batch and
    write the result under ``sink_dir/batch=<id>``."""
    def handle(batch: DataFrame, batch_id: int):
        score_batch(batch).write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
