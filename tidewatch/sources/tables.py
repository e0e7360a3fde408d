"""Versioned parquet tables written by micro-batches.

A micro-batch writes its rows under its own batch number. If it is replayed after a failure, it
overwrites exactly what it wrote before, so the table ends up the same: exactly-once by idempotent
writes, with plain parquet. The current rows are the newest version per key.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import fresh_path

HOUR = "yyyyMMddHH"
PIECE, PIECE_HOURS = 200_000, 32  # rows and hours that a task writes
MOST_LISTED = dt.timedelta(days=30)  # longer spans are pruned by a filter, not listed hour by hour


@dataclass
class Marks:
    """A number that every batch leaves behind. The last two are kept, in turn, so that reading and
    writing one costs the same however old the stream is, and a batch that is replayed, or that
    stopped while it wrote its own, finds its predecessor's."""
    path: str

    def put(self, spark: SparkSession, batch_id: int, value: int) -> None:
        (spark.createDataFrame([(batch_id, value)], "batch long, value long").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/slot{batch_id % 2}"))

    def last(self, spark: SparkSession, before: int | None = None) -> tuple[int, int] | None:
        """Batch and number of the newest mark, or of the newest one of an earlier batch."""
        found = []
        for slot in (0, 1):  # apart, since one may be amid its overwriting
            try:
                found += spark.read.schema("batch long, value long").parquet(
                    f"{self.path}/slot{slot}").collect()
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        seen = [tuple(r) for r in found if before is None or r["batch"] < before]
        return max(seen, default=None)


@dataclass
class BatchTable:
    """Rows by ``keys``; ``time`` is the column the directories are cut by (one per hour).

    With a ``manifest``, readers see the batches that it names and no later ones.
    """
    path: str
    keys: tuple[str, ...]
    time: str = "window_end"
    manifest: Marks | None = None

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Rows are cut by hour and key into pieces of about ``PIECE`` rows or ``PIECE_HOURS`` hours,
        so that a batch writes a file per hour and piece, not per hour and task: streams run without
        the adaptive execution that would gather small pieces. A crowded hour is shared out over
        several of them."""
        cached = rows.is_cached
        if not cached:
            rows.persist()  # counted, sampled for the cuts, written
        try:
            hour = F.date_format(self.time, HOUR)
            n, hours = rows.agg(F.count("*"), F.count_distinct(hour)).first()
            pieces = max(n // PIECE, hours // PIECE_HOURS) + 1
            (rows.withColumns({"_hour": hour, "_batch": F.lit(batch_id).cast("long")})
             .repartitionByRange(pieces, "_hour", *self.keys)
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("_hour", "_batch").parquet(self.path))
        finally:
            if not cached:
                rows.unpersist()

    def versions(self, spark: SparkSession, upto: int | None = None,
                 between: tuple[dt.datetime, dt.datetime] | None = None) -> DataFrame | None:
        """All versions of the rows; None while nothing has been written.

        ``upto`` hides later batches (a replay must see what the first try saw). ``between`` limits
        the hours listed and read, so a long-running job does not touch its whole past.
        """
        if self.manifest is not None:
            newest = self.manifest.last(spark)
            if newest is None:
                return None
            upto = newest[0] if upto is None else min(upto, newest[0])
        path = self.path
        if between is not None and between[1] - between[0] < MOST_LISTED:
            hours = pd.date_range(between[0].replace(minute=0, second=0, microsecond=0),
                                  between[1], freq="h")
            path += "/_hour={" + ",".join(f"{h:%Y%m%d%H}" for h in hours) + "}"
        try:
            rows = spark.read.option("basePath", self.path).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        if between is not None:
            rows = rows.filter(F.col("_hour").cast("string").between(*(f"{b:%Y%m%d%H}" for b in between)))
        rows = rows.withColumns({"_hour": F.col("_hour").cast("string"),
                                 "_batch": F.col("_batch").cast("long")})
        if upto is not None:
            rows = rows.filter(F.col("_batch") <= upto)
        return rows

    def newest(self, rows: DataFrame, *dealt: str) -> DataFrame:
        """The newest version per key (of each value of ``dealt``, if the rows are shuffled by it)."""
        kept = [c for c in rows.columns if c not in ("_hour", "_batch")]
        return (rows.groupBy(*self.keys, *dealt)
                .agg(F.max_by(F.struct(*kept), "_batch").alias("_r")).select("_r.*"))

    def read(self, spark: SparkSession) -> DataFrame:
        rows = self.versions(spark)
        if rows is None:
            raise FileNotFoundError(self.path)
        return self.newest(rows)


class JointTables:
    """Tables whose rows of a batch become visible together.

    All outputs are written under the batch's number, then the manifest names it. A stop in between
    leaves the batch in no table, and its replay overwrites what had been written.
    """

    def __init__(self, root: str, **keys: tuple[str, ...]):
        self.manifest = Marks(f"{root}/manifest")
        self.tables = {name: BatchTable(f"{root}/{name}", k, manifest=self.manifest)
                       for name, k in keys.items()}

    def write(self, batch_id: int, **rows: DataFrame) -> None:
        for name, df in rows.items():
            self.tables[name].write(df, batch_id)
        self.manifest.put(df.sparkSession, batch_id, batch_id)


class RecordTable(BatchTable):
    """Keyed records (``key``, ``window_end``, ``expires_at``, ...) with a compacted past.

    Hours that no batch writes to any more are folded into a base of one record per key, without the
    expired ones. Readers take the newest base and the hours after it, so a read costs what lives,
    not what was ever written. A new base stands beside the old one until its mark is set; the old
    base and the folded hours go one compaction later, so readers that began before still find them.
    """

    @property
    def base(self) -> Marks:
        """Number of the newest base, and the first hour that is not in it."""
        return Marks(f"{self.path}-base/mark")

    def _base_rows(self, spark: SparkSession, number: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}-base/number={number}").withColumns(
            {"_hour": F.col("_hour").cast("string"), "_batch": F.col("_batch").cast("long")})

    def versions(self, spark: SparkSession, upto: int | None = None,
                 between: tuple[dt.datetime, dt.datetime] | None = None) -> DataFrame | None:
        mark = self.base.last(spark)
        try:
            rows = super().versions(spark, upto, between)
        except AnalysisException as e:
            if mark is None or e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            rows = None  # all hours are folded
        if mark is None:
            return rows
        base = self._base_rows(spark, mark[0])
        return base if rows is None else base.unionByName(rows.filter(F.col("_hour") >= str(mark[1])))

    def current(self, rows: DataFrame) -> DataFrame:
        """Newest window, then newest batch per key: the clock may have been set back."""
        return (rows.groupBy("key")
                .agg(F.max_by(F.struct(*rows.columns), F.struct("window_end", "_batch")).alias("r"))
                .select("r.*"))

    def compact(self, spark: SparkSession, closed: dt.datetime, as_of: Column) -> None:
        """Folds the hours before that of ``closed`` (the stream writes to none of them any more),
        without records that have expired at ``as_of``."""
        mark, cut = self.base.last(spark), int(f"{closed:%Y%m%d%H}")
        if mark is not None and mark[1] >= cut:
            return
        rows = self.versions(spark)
        if rows is None:
            return
        number = mark[0] + 1 if mark else 0
        (self.current(rows.filter(F.col("_hour") < str(cut))).filter(F.col("expires_at") > as_of)
         .hint("rebalance").write.mode("overwrite").parquet(f"{self.path}-base/number={number}"))
        self.base.put(spark, number, cut)
        if mark is not None:
            remove(spark, f"{self.path}-base", lambda name: name.startswith("number=")
                   and int(name.split("=")[1]) < mark[0])
            remove(spark, self.path, lambda name: name.startswith("_hour=")
                   and int(name.split("=")[1]) < mark[1])


def remove(spark: SparkSession, folder: str, what: Callable[[str], bool]) -> None:
    """Deletes the sub-folders of ``folder`` whose names ``what`` picks."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(path):
        for status in files.listStatus(path):
            if what(status.getPath().getName()):
                files.delete(status.getPath(), True)


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """Writes a costly intermediate result to the shared folder and reads it back.

    For inputs that are read more than once, such as mentions about to be cut into ranges: the
    sampling pass would otherwise enrich every article a second time.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def span_of(rows: DataFrame, time: str) -> tuple[dt.datetime, dt.datetime] | None:
    """Smallest and largest time in UTC, two values; None without rows."""
    low, high = rows.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    if low is None:
        return None
    epoch = dt.datetime(1970, 1, 1)
    return epoch + dt.timedelta(microseconds=low), epoch + dt.timedelta(microseconds=high)


def write_jdbc(rows: DataFrame, url: str, table: str = "risk_alerts", **options: str) -> None:
    """Appends alert history rows to a database table (needs the driver on the class path)."""
    rows.write.format("jdbc").mode("append").options(url=url, dbtable=table, **options).save()


def show_stream(df: DataFrame):
    """Debug print; the caller starts it."""
    return df.writeStream.format("console").option("truncate", "false")
