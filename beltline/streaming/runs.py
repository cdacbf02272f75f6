"""Running a streaming transformation over a folder of files until it is drained."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, run_dir
from .ordered import END_US, TIME, Ordered, keyed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """State stores that spill to disk and carry several state variables per key."""
    configure(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def subject_filter(df: DataFrame, pattern: str, subject: str = "subject") -> DataFrame:
    """Subscribe by wildcard subject: ``*`` is one token, a trailing ``>`` the rest."""
    from ..operators.messages import subject_regex

    return df.filter(F.rlike(F.col(subject), subject_regex(F.lit(pattern))))


def stream_files(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream over the table ``folder/name``, one file or a folder of part files.

    The size of a micro-batch is bounded by its files: ``spark.beltline.filesPerBatch``, 100 where it is unset.
    """
    spark = stateful_session(spark)
    files_per_batch = spark.conf.get("spark.beltline.filesPerBatch", "100")
    path = f"{folder}/{name}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    return source.option("pathGlobFilter", name).parquet(folder) if single else source.parquet(path)


def drain(spark: SparkSession, name: str, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything available now into files in the shared folder and read them back."""
    base = run_dir(spark, name)
    out = f"{base}/out"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option(
        "checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def newest(rows: DataFrame, keys, version: str) -> DataFrame:
    """The row of the highest version for each key."""
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), version).alias("r")).select(*keys, "r.*")


def batch_writer(out: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: batches land in folders named by batch id, so a replayed batch overwrites itself (exactly once)."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return write


def drain_upserts(spark: SparkSession, name: str, stream: DataFrame, keys, version: str) -> DataFrame:
    """Update-mode streams: every batch appends its changed rows and the newest version per key is the table."""
    base = run_dir(spark, name)
    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint").foreachBatch(
        batch_writer(f"{base}/out")).trigger(availableNow=True).start()
    q.awaitTermination()
    return newest(spark.read.schema(stream.schema).parquet(f"{base}/out/batch=*"), keys, version)


def drain_ordered(spark: SparkSession, name: str, rows: DataFrame, processor: Ordered, delay: str = "10 minutes", progress: list | None = None) -> DataFrame:
    """Everything that ``processor`` puts out for the stream ``rows``, to its end.

    What is there now is processed first; then a mark beyond all event times lets the watermark release what
    still waits, and idle keys go. ``progress`` collects the engine's figures of each micro-batch.
    """
    base = run_dir(spark, name)
    spark.createDataFrame([], rows.schema).write.parquet(f"{base}/marks")
    stream = keyed(rows, processor, delay, marks=spark.readStream.schema(rows.schema).parquet(f"{base}/marks"))

    q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint").foreachBatch(batch_writer(f"{base}/out")).start()
    try:
        q.processAllAvailable()
        mark = [F.lit(END_US if f.name == TIME else None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
        spark.range(1).select(*mark).write.mode("append").parquet(f"{base}/marks")
        q.processAllAvailable()
    finally:
        q.stop()
    if progress is not None:
        progress.extend(q.recentProgress)
    return spark.read.schema(stream.schema).parquet(f"{base}/out/batch=*")


def sink_tables(folder: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: appends each table of a routed batch under ``folder/<table>/batch=<id>``."""

    def write(df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            for name in ("scores", "labels", "captures", "model_events"):
                df.filter(F.col("target") == name).drop("target").write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
        finally:
            df.unpersist()

    return write
