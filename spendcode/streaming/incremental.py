"""Incremental enrich: new purchase-line files are enriched as they arrive.

The enrich chain is row-wise apart from the response store, so each micro-batch runs the
batch job in ``foreachBatch``.  Exactly-once output: every micro-batch overwrites its own
``batch_id`` partition of the output table, so a replayed batch (after a driver or
executor failure) rewrites the same partition instead of appending twice; the response
store makes the replay free of new model calls.  Stream progress is kept under the
session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendcode.operators.responses import ResponseStore, Responder
from spendcode.plans.enrich import Settings, enrich
from spendcode.session import shared_dir

LINE_SCHEMA = T.StructType([
    T.StructField("ordinal", T.LongType()),
    T.StructField("procurement_description", T.StringType()),
    T.StructField("account", T.StringType()),
])


def start_incremental_enrich(spark: SparkSession, source_path: str, output_path: str,
                             store_path: str, settings: Settings = Settings(),
                             responder: Responder | None = None, schema: T.StructType = LINE_SCHEMA,
                             name: str = "incremental-enrich", available_now: bool = True):
    """Start the stream; returns the ``StreamingQuery``."""
    lines = spark.readStream.schema(schema).parquet(source_path)
    store = ResponseStore(spark, store_path)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        run = enrich(batch, settings, store=store, responder=responder)
        try:
            (run.result().withColumn("batch_id", F.lit(batch_id))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch_id").parquet(output_path))
        finally:
            run.release()

    writer = (lines.writeStream.foreachBatch(run_batch).queryName(name)
              .option("checkpointLocation", shared_dir(spark, f"streams/{name}")))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
