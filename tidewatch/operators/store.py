"""Keyed records with expiry: feature rows under a timed and a ``latest`` key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.codecs import format_iso, latest_key, store_key
from tidewatch.operators.features import latest_features

TTL_DAYS = 7


def record_value(df: DataFrame, version: str, ingest_ts: Column) -> Column:
    """Feature row plus ``_ver`` and ``_ingest_ts`` as JSON."""
    fields = [format_iso(F.col(c)).alias(c) if c == "window_end" else F.col(c) for c in df.columns]
    return F.to_json(F.struct(*fields, F.lit(version).alias("_ver"),
                              format_iso(ingest_ts).alias("_ingest_ts")))


def keyed_records(features: DataFrame, prefix: str = "feat", version: str = "v1",
                  ingest_ts: Column | None = None, latest_only: bool = False,
                  ttl_days: int = TTL_DAYS, timed_only: bool = False) -> DataFrame:
    """(key, value, window_end, ingest_ts, expires_at): two records per feature row, one pass."""
    now = F.current_timestamp() if ingest_ts is None else ingest_ts
    latest = latest_key(prefix, F.col("ticker"))
    timed = store_key(prefix, F.col("ticker"), F.col("window_end"))
    keys = [latest] if latest_only else [timed] if timed_only else [timed, latest]
    return (features.withColumns({"_value": record_value(features, version, now), "_now": now})
            .select(F.explode(F.array(*keys)).alias("key"), F.col("_value").alias("value"),
                    "window_end", F.col("_now").alias("ingest_ts"),
                    (F.col("_now") + F.make_dt_interval(F.lit(ttl_days))).alias("expires_at")))


def window_records(windows: DataFrame, prefix: str = "feat", version: str = "v1") -> DataFrame:
    """The records of windows of which there is one per ticker and ``window_end``, one per key.

    Timed keys differ as the windows do, so only the ``latest`` ones compete, and of those only the
    newest window of a ticker can win.
    """
    latest = keyed_records(latest_features(windows), prefix, version, latest_only=True)
    return keyed_records(windows, prefix, version, timed_only=True).unionByName(last_write_wins(latest))


def last_write_wins(records: DataFrame, *tiebreak: str) -> DataFrame:
    """One record per key: newest window, then newest write. Combines map-side."""
    order = F.struct("window_end", "ingest_ts", *tiebreak)
    row = F.struct(*records.columns)
    return records.groupBy("key").agg(F.max_by(row, order).alias("_r")).select("_r.*")


def upsert(stored: DataFrame, records: DataFrame) -> DataFrame:
    """The store after writing ``records``."""
    return last_write_wins(stored.unionByName(records))


def live(records: DataFrame, as_of: Column) -> DataFrame:
    """Records whose time to live has not passed."""
    return records.filter(F.col("expires_at") > as_of)


def lookup(records: DataFrame, key: str) -> DataFrame:
    return records.filter(F.col("key") == key)


def scan(records: DataFrame, pattern: str) -> DataFrame:
    """Records by key pattern, ``*`` standing for anything."""
    like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
    return records.filter(F.col("key").like(like))


# ---- stored tables for point reads ----

BUCKETS = 64


def _kind(key: Column) -> Column:
    """``latest`` or ``timed``."""
    return F.when(F.endswith(key, F.lit(":latest")), "latest").otherwise("timed")


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def write_store(records: DataFrame, path: str) -> None:
    """Writes keyed records by key kind and key hash, so that a point read opens one folder."""
    (records.withColumns({"_kind": _kind(F.col("key")), "_bucket": _bucket(F.col("key"))})
     .hint("rebalance", "_kind", "_bucket")
     .write.partitionBy("_kind", "_bucket").parquet(path))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookup_stored(spark: SparkSession, path: str, key: str) -> DataFrame:
    """One record by key; reads the key's own folder only."""
    at = F.lit(key)
    own = (F.col("_kind") == _kind(at)) & (F.col("_bucket") == _bucket(at))
    return read_store(spark, path).filter(own & (F.col("key") == key)).drop("_kind", "_bucket")


def scan_stored(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Records by key pattern (``*`` for any run); a pattern that ends in ``:latest`` reads the
    folders of those records only."""
    rows = scan(read_store(spark, path), pattern)
    if pattern.endswith(":latest"):
        rows = rows.filter(F.col("_kind") == "latest")
    return rows.drop("_kind", "_bucket")
