"""Streaming forms: online EM over micro-batches, and windowed counts of an event stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from latentia.operators import em as E
from latentia.operators.params import Params, from_table, step_size, to_table
from latentia.session import ship, work_dir

SYMBOLS = ("click", "error", "purchase", "signup", "view")


def events(spark: SparkSession, folder: str, pattern: str, files: int = 1) -> DataFrame:
    """A stream over the files of a folder; the schema is that of the same files read as a batch."""
    ship(spark)
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def sequences(df: DataFrame) -> DataFrame:
    """``sent_id, x``: one sequence of event types per user, in order of time; unknown types are skipped."""
    sym = F.array_position(F.array(*[F.lit(s) for s in SYMBOLS]), F.col("event_type")) - 1
    held = F.array_sort(F.collect_list(F.struct("ts", "event_id", sym.cast("long").alias("s"))))
    return df.where(F.col("event_type").isin(*SYMBOLS)).groupBy(F.col("user_id").alias("sent_id")).agg(F.transform(held, lambda x: x["s"]).alias("x"))


def train_stream(spark: SparkSession, folder: str, pattern: str, p: Params, a: float = 4, alpha: float = 0.5, at: str | None = None, files: int = 1) -> tuple[Params, list[float]]:
    """Each micro-batch is one online step over the sequences it completes, in event order per user.

    ``at``: a folder that outlives the application, for the stream's checkpoint and for (parameters, log-likelihood) of
    each batch. A step starts from what the batch before it wrote and a batch that is already written changes nothing,
    so a stream can be stopped anywhere and started again, also elsewhere; ``p`` only serves the first batch.
    """
    at = at or f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    context = spark.sparkContext
    fs = context._jvm.org.apache.hadoop.fs.Path(at).getFileSystem(context._jsc.hadoopConfiguration())
    done = lambda i: fs.exists(context._jvm.org.apache.hadoop.fs.Path(f"{at}/state/{i}/ll/_SUCCESS"))

    def apply(batch: DataFrame, batch_id: int) -> None:
        if done(batch_id):
            return
        before = from_table(spark.read.parquet(f"{at}/state/{batch_id - 1}/params")) if batch_id else p
        new, ll = E.step(sequences(batch), before)
        to_table(spark, E.blended(before, new, step_size(batch_id, a, alpha))).coalesce(1).write.mode("overwrite").parquet(f"{at}/state/{batch_id}/params")
        spark.createDataFrame([(float(ll),)], "ll double").coalesce(1).write.mode("overwrite").parquet(f"{at}/state/{batch_id}/ll")  # last: the batch is done

    run = events(spark, folder, pattern, files).writeStream.foreachBatch(apply).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    lls: list[float] = []
    while done(len(lls)):
        lls.append(spark.read.parquet(f"{at}/state/{len(lls)}/ll").first().ll)
    return (from_table(spark.read.parquet(f"{at}/state/{len(lls) - 1}/params")) if lls else p), lls


def hourly_counts(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``event_type, window_start, n, total`` with a watermark; complete windows of the drained stream."""
    counts = (
        events(spark, folder, pattern).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    )
    base = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        # update mode: later batches replace a window's row
        batch.select("event_type", F.col("w.start").alias("window_start"), "n", "total", F.lit(batch_id).alias("b")).write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    run = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    last = rows.groupBy("event_type", "window_start").agg(F.max_by(F.struct("n", "total"), "b").alias("r"))
    return last.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "r.n", F.round("r.total", 4).alias("total"))
