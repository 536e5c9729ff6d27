"""File-stream jobs.

The reference processes one file per storm per 6-hour cycle; here new files
are picked up by Structured Streaming. Sinks are parquet folders under the
shared checkpoint location with their own stream checkpoints, so a restarted
or failed executor resumes from the last committed batch.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gale.sources.diagnostics import ingest_case_diagnostics
from gale.sources.results import shared_path


def stream_ingest_cases(spark: SparkSession, src: str, predictors: list[str], *, with_age: list[str] | None = None,
                        transform: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 64) -> DataFrame:
    """Case-record files arriving in ``src`` -> hourly rows, or what ``transform``
    makes of them (a chain per case, like :func:`gale.operators.features.case_features`:
    a record and so a case lies in one file). Rows are not stored in between: a
    transform that reads its rows more than once stores them itself. Spark's file stream finds new files and
    remembers them; each micro-batch reads its files with the record source and
    overwrites its own ``batch=<id>`` folder, so a batch run again after a failure
    leaves no row twice. Runs until the files present are processed
    (``availableNow``) and returns the sink."""
    out, ck = shared_path(spark, "r1-out"), shared_path(spark, "r1-ckpt")

    def rows(paths: list[str]) -> DataFrame:
        hourly = ingest_case_diagnostics(spark, paths, predictors, with_age=with_age)
        return transform(hourly) if transform else hourly

    def sink(batch: DataFrame, batch_id: int) -> None:
        paths = [r["path"] for r in batch.select("path").collect()]  # at most files_per_batch
        if paths:
            rows(paths).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    files = spark.readStream.format("binaryFile") \
        .schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch) \
        .option("recursiveFileLookup", "true").load(src).select("path")  # contents are not read here
    q = (files.writeStream.option("checkpointLocation", ck).foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()
    schema = rows([]).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/batch=-1")  # the table exists without any batch too
    return spark.read.schema(schema).parquet(out).drop("batch")


@contextmanager
def _rocksdb(spark: SparkSession):
    """State in RocksDB: on local disk with changelogs in the checkpoint, not in the executors' heap."""
    keys = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _run(query) -> None:
    """Until the files present are processed; a row that a state operator dropped is an error."""
    query.awaitTermination()
    lost = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    if lost:
        raise RuntimeError(f"{lost} rows behind the watermark")


def route_late(spark: SparkSession, src: str, schema, ts: str, delay: str, work: str, follow: Callable[[str], None], *,
               files_per_batch: int | None = None, glob: str | None = None) -> None:
    """Files in the order of their arrival, ``files_per_batch`` at a time (None: all that
    are present), split in accepted and late rows; ``follow(accepted)`` runs after each.

    A row is late if it is ``delay`` or more older than the newest row of all earlier
    micro-batches, which is what the watermark of a state operator in ``follow``
    would drop unseen: here such rows are kept, with the batch that brought them.
    Null times are late. A micro-batch writes its own ``batch=<id>`` folders once: one
    that runs again after a failure finds them, so nothing is there twice."""
    accepted, late, clock = (f"{work}/{x}" for x in ("accepted", "late", "clock"))
    stamp = F.col(ts).cast("timestamp")

    def sink(batch: DataFrame, batch_id: int) -> None:
        name = f"batch={batch_id:09d}"
        if not _there(spark, f"{late}/{name}/_SUCCESS"):
            batch = batch.persist()
            try:
                batch.agg(F.max(stamp).alias("newest"), F.lit(batch_id).cast("long").alias("id")) \
                    .write.mode("overwrite").parquet(f"{clock}/{name}")
                seen = spark.read.schema("newest timestamp, id long").parquet(clock) \
                    .where(F.col("id") < batch_id).agg(F.max("newest")).first()[0]  # one row a batch
                old = stamp.isNull() if seen is None else stamp.isNull() | (stamp <= F.lit(seen) - F.expr(f"INTERVAL {delay}"))
                batch.where(~old).write.mode("overwrite").parquet(f"{accepted}/{name}")
                batch.where(old).write.mode("overwrite").parquet(f"{late}/{name}")
            finally:
                batch.unpersist()
        follow(accepted)

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    q = reader.parquet(src).writeStream.option("checkpointLocation", f"{work}/route-ckpt").foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()
    for folder in (accepted, late):  # the tables exist without any batch too
        if not _there(spark, folder):
            spark.createDataFrame([], schema).write.parquet(f"{folder}/batch={0:09d}")
    follow(accepted)


def _there(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def late_rows(spark: SparkSession, work: str, schema) -> DataFrame:
    """The late rows of a job's work folder, with the batch that brought them."""
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{work}/late")


def stream_cycle_counts(spark: SparkSession, src: str, schema, *, glob: str | None = None,
                        ts: str = "ts", key: str = "event_type", value: str = "value",
                        window_hours: int = 6, watermark: str, files_per_batch: int | None = None, work: str | None = None) -> DataFrame:
    """Per (``window_hours`` tumbling window of wall-clock time, key)
    count and mean of ``value``. The window start is the event's wall-clock
    hour rounded down to a multiple of ``window_hours`` (independent of the
    session time zone); the watermark is on that grouping column, so state
    for a window (in RocksDB) is dropped once it is complete. Each micro-batch's updated
    windows are written with the batch id; the current table keeps the last
    update per window (max_by over batch id), so nothing is collected on the
    driver. Files come in the order of their arrival, ``files_per_batch`` a batch; rows
    more than ``watermark`` behind go to the late table (:func:`late_rows`) and are
    not counted. ``work`` names the job's folder: called again with it, the job goes on
    where it stopped."""
    schema = _struct(schema)
    work = work or shared_path(spark, "r3")
    out, ck = f"{work}/out", f"{work}/ckpt"
    slot = (F.date_trunc("hour", F.col(ts)) - F.make_dt_interval(F.lit(0), F.hour(ts) % window_hours))

    def counted(rows: DataFrame) -> DataFrame:
        # watermarks need TIMESTAMP; a window starts up to its width before its rows
        s = rows.withColumn("_slot", slot.cast("timestamp_ntz").cast("timestamp")).withWatermark("_slot", f"{watermark} {window_hours} hours")
        return s.groupBy("_slot", key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.select(F.col("_slot").cast("timestamp_ntz").alias("window_start"), key, "n", "total")
         .write.mode("overwrite").parquet(f"{out}/batch={batch_id}"))

    def follow(accepted: str) -> None:
        rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(accepted)
        with _rocksdb(spark):
            _run(counted(rows).writeStream.outputMode("update").option("checkpointLocation", ck).foreachBatch(sink)
                 .trigger(availableNow=True).start())

    route_late(spark, src, schema, ts, watermark, work, follow, files_per_batch=files_per_batch, glob=glob)
    shape = counted(spark.createDataFrame([], schema)).select(F.col("_slot").cast("timestamp_ntz").alias("window_start"), key, "n", "total").schema
    spark.createDataFrame([], shape).write.mode("overwrite").parquet(f"{out}/batch=-1")  # the table exists without any batch too
    upd = spark.read.schema(StructType([*shape.fields, StructField("batch", LongType())])).parquet(out)
    last = upd.groupBy("window_start", key).agg(F.max_by(F.struct("n", "total"), "batch").alias("v"))
    return last.select("window_start", key, F.col("v.n").alias("n"),
                       (F.col("v.total") / F.col("v.n")).alias("mean_value"))


def stream_verify_24h(spark: SparkSession, src: str, schema, *, storm: str = "storm_id",
                      ts: str = "DATE_full", value: str = "VMAX", hours: int = 24,
                      watermark: str, files_per_batch: int | None = None, work: str | None = None) -> DataFrame:
    """R2: verify a case when the same storm's value ``hours`` later arrives:
    a stream-stream inner join on (storm, time + hours) with watermarks on
    both sides, so join state (in RocksDB) is dropped once a case can no longer match.
    Files come in the order of their arrival, ``files_per_batch`` a batch; rows more than
    ``watermark`` (at least ``hours``) behind go to the late table (:func:`late_rows`)
    and take no part. ``work`` names the job's folder: called again with it, the job
    goes on where it stopped."""
    schema = _struct(schema)
    work = work or shared_path(spark, "r2")
    out, ck = f"{work}/out", f"{work}/ckpt"

    def joined(rows: DataFrame) -> DataFrame:
        def side(alias):
            return rows.select(F.col(storm).alias(f"{alias}_storm"), F.col(ts).cast("timestamp").alias(f"{alias}_t"),
                               F.col(value).alias(f"{alias}_v")).withWatermark(f"{alias}_t", watermark)
        a, b = side("a"), side("b")
        lag = F.expr(f"INTERVAL {hours} HOURS")
        cond = ((F.col("a_storm") == F.col("b_storm")) & (F.col("b_t") >= F.col("a_t") + lag)
                & (F.col("b_t") <= F.col("a_t") + lag))
        return a.join(b, cond, "inner").select(
            F.col("a_storm").alias(storm), F.col("a_t").cast("timestamp_ntz").alias(ts),
            (F.col("b_v") - F.col("a_v")).alias("d_V"))

    def follow(accepted: str) -> None:
        rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(accepted)
        with _rocksdb(spark):
            _run(joined(rows).writeStream.format("parquet").option("checkpointLocation", ck).outputMode("append")
                 .trigger(availableNow=True).start(out))

    route_late(spark, src, schema, ts, watermark, work, follow, files_per_batch=files_per_batch)
    return spark.read.schema(joined(spark.createDataFrame([], schema)).schema).parquet(out)


def _struct(schema) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
