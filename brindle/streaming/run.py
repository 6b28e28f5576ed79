"""Streams from a table's files to a written result.

Results and progress go below one path, by default a new one in the shared
checkpoint folder, and never to memory on the driver. A stream that is run again
with the same path goes on after the files it has taken in. A run's files stay until
``forget`` is called with its path.

A batch takes in a bounded number of files, in the order of their age. Rows that come
after the watermark of the batch before theirs has passed their window are late and
not counted; files in the order of their events have none, and then the result is that of
one batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from brindle.session import STREAM_DEFAULTS, remove_path, scratch_path
from brindle.sources import SCHEMAS


#: Files that one batch takes in; bounds what its state gains before windows are closed.
FILES_PER_TRIGGER = 200


def read_stream(spark: SparkSession, folder: str, table: str, at: str, late_by: str,
                files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """A table's files as a stream in event time ``at``, with a watermark ``late_by`` behind.

    The stream has a session of its own, with the settings of ``spark`` and, where those
    say nothing, STREAM_DEFAULTS; so streams started side by side do not meet in them.
    """
    own = spark.newSession()
    given = spark.conf.getAll
    for key, value in (STREAM_DEFAULTS | given).items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    reader = own.readStream.schema(SCHEMAS[table]).option("maxFilesPerTrigger", files_per_trigger)
    # braces make it a pattern, which may be a file or a folder of files
    stream = reader.parquet(f"{folder.rstrip('/')}/{{{table}}}.parquet")
    # a watermark needs an instant; the tables keep local times
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late_by)


def _finish(writer: DataStreamWriter, path: str) -> None:
    """Take in all the files there are, then stop."""
    (writer.option("checkpointLocation", f"{path}/progress")
     .trigger(availableNow=True).start().awaitTermination())


def run_append(result: DataFrame, path: str | None = None) -> DataFrame:
    """Write each row once, when the watermark has closed its window; read it all back."""
    spark = result.sparkSession
    path = path or scratch_path(spark, "stream")
    rows = f"{path}/rows"
    _finish(result.writeStream.outputMode("append").format("parquet").option("path", rows), path)
    return spark.read.schema(result.schema).parquet(rows)


def run_complete(result: DataFrame, path: str | None = None) -> DataFrame:
    """Write the whole result after each batch, and read the last one back.

    A batch's rows go to a folder of their own, which is named as done when it is whole;
    so a reader, also after a crash, finds a whole result or the one before. Results before
    these two are removed.
    """
    spark = result.sparkSession
    path = path or scratch_path(spark, "stream")
    done = f"{path}/done"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows-{number}")
        batch.sparkSession.range(number, number + 1).coalesce(1).write.mode("append").parquet(done)
        if number > 1:
            remove_path(spark, f"{path}/rows-{number - 2}")

    _finish(result.writeStream.outputMode("complete").foreachBatch(write), path)
    last = spark.read.schema("id long").parquet(done).agg(F.max("id")).first()[0]
    return spark.read.schema(result.schema).parquet(f"{path}/rows-{last}")


def forget(spark: SparkSession, path: str) -> None:
    """Remove a run's results and progress."""
    remove_path(spark, path)
