"""Alerts from a stream of daily drops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.operators import rank
from panelspark.schema import ALERT_QUANTILE, ALERTS_PER_DAY, DISK_KEY
from panelspark.session import materialize

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("manufacturer", T.StringType()),
        T.StructField("model", T.IntegerType()),
        T.StructField("serial_number", T.StringType()),
        T.StructField("dt", T.DateType()),
    ]
)


#: What is known of a day after a batch; the newest version of a day holds.
STATE_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("prob", T.DoubleType()),
        T.StructField("ties", T.LongType()),
        T.StructField("model", T.IntegerType()),
        T.StructField("serial_number", T.StringType()),
        T.StructField("dt", T.DateType()),
        T.StructField("batch", T.LongType()),
    ]
)


class _Folder:
    """Names below a folder, through the file system of its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = path
        self.files = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def numbers(self, below: str, prefix: str = "batch=") -> list[int]:
        """The n of each ``below/<prefix>n``, ascending."""
        folder = self._at(f"{self.path}/{below}")
        if not self.files.exists(folder):
            return []
        names = [f.getPath().getName() for f in self.files.listStatus(folder)]
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))

    def mark(self, name: str) -> None:
        self.files.create(self._at(f"{self.path}/{name}"), True).close()

    def drop(self, name: str) -> None:
        self.files.delete(self._at(f"{self.path}/{name}"), True)


def _state(spark: SparkSession, out: str, names: list[str]) -> DataFrame:
    reader = spark.read.schema(STATE_SCHEMA).option("basePath", f"{out}/state")
    return reader.parquet(*[f"{out}/state/{n}" for n in names]) if names else spark.createDataFrame([], STATE_SCHEMA)


def _alert_batch(batch: DataFrame, batch_id: int, score: Callable[[DataFrame], DataFrame], out: str, quantile: float, per_day: int) -> None:
    """Bring the state of the days that a batch has rows of up to date, and the alerts that now hold on them.

    A day's state is a summary of a few rows (see :func:`rank.summarize_days`), kept in versions by batch. A
    batch reads its own rows and the last version before it of the days that it touches, nothing else,
    and writes their next version, with overwrite: run again after a failure it gives the same. A day that
    gets more rows later is ranked anew, so the result does not depend on how days are spread over files.
    Versions that no repeated batch can ask for any more are removed.
    """
    spark, folder = batch.sparkSession, _Folder(batch.sparkSession, out)
    fresh = rank.summarize_days(score(batch).select(*DISK_KEY, "dt", "prob"), per_day)
    fresh = materialize(fresh, "days")
    days = [r["dt"] for r in fresh.filter("kind = 'all'").select("dt").collect()]  # calendar days of one batch
    versions = {d: [n for n in folder.numbers(f"state/dt={d}") if n < batch_id] for d in days}
    known = _state(spark, out, [f"dt={d}/batch={v[-1]}" for d, v in versions.items() if v])
    merged = materialize(rank.merge_day_summaries([known.filter("kind <> 'alert'").select(*fresh.columns), fresh], per_day), "days")
    alerts = rank.alerts_of_summary(merged, quantile).select("dt", F.lit("alert").alias("kind"), "prob", *DISK_KEY)
    kept = merged.unionByName(alerts, True).withColumn("batch", F.lit(batch_id).cast("long")).select(*STATE_SCHEMA.names)
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch").parquet(f"{out}/state")
    folder.mark(f"done/batch={batch_id}")
    for day, old in versions.items():
        for n in old[:-1]:
            folder.drop(f"state/dt={day}/batch={n}")


def read_alerts(spark: SparkSession, out: str) -> DataFrame:
    """The alerts that hold after the last finished batch: disks at their first alert."""
    folder = _Folder(spark, out)
    done = folder.numbers("done")
    if not done or not folder.files.exists(folder._at(f"{out}/state")):
        return spark.createDataFrame([], ALERT_SCHEMA)
    state = spark.read.schema(STATE_SCHEMA).parquet(f"{out}/state").filter(F.col("batch") <= done[-1])
    last = state.filter("kind = 'all'").groupBy("dt").agg(F.max("batch").alias("batch"))
    return rank.submission(state.filter("kind = 'alert'").join(last, ["dt", "batch"])).select(*ALERT_SCHEMA.names)


def stream_daily_alerts(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    out: str,
    checkpoint: str,
    score: Callable[[DataFrame], DataFrame],
    quantile: float = ALERT_QUANTILE,
    per_day: int = ALERTS_PER_DAY,
    files_per_batch: int = 100,
    file_format: str = "csv",
):
    """Score each new file, rank its days with what is known of them and write the alerts that hold
    (see :func:`read_alerts`).

    A day may come in any number of files and batches. ``score`` maps the rows read to
    ``serial_number, model, dt, prob`` and runs once a batch. Processes what is there and stops;
    restarting with the same checkpoint goes on with new files.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if file_format == "csv":
        reader = reader.option("header", True)

    def run(batch: DataFrame, batch_id: int) -> None:
        _alert_batch(batch, batch_id, score, out, quantile, per_day)

    return (
        reader.format(file_format)
        .load(source)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
