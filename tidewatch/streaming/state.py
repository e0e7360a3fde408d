"""Keyed state in the state store: lifetime features and the alert cooldown.

Both are ``transformWithState`` processors, so a micro-batch loads and writes the state of the
tickers it has rows of, and nothing that it does not touch: its cost does not grow with the age of
the stream. State is kept with its schema (Avro), so later versions may add fields. Several versions
of the same batch start from the same state, so a replay gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.alerts import NEVER, greedy_cooldown
from tidewatch.operators.features import clean_mentions, seconds
from tidewatch.session import configure

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.encodingFormat": "avro",
}
PARTITIONS, PER_CORE = "spark.sql.shuffle.partitions", 2
RUNNING = ("news_id string, ticker string, window_end timestamp, neg_news_count_24h int, "
           "pos_news_count_24h int, sentiment_ewm_7d double")
DECIDED = ("ticker string, window_end timestamp, risk_score_5m double, threshold double, "
           "status string, reason string")


def with_state(df: DataFrame) -> DataFrame:
    configure(df.sparkSession)
    for key, value in STATE_CONF.items():
        df.sparkSession.conf.set(key, value)
    return df


def by_cores(writer: DataStreamWriter, spark: SparkSession) -> DataStreamWriter:
    """Has the stream begin with two state partitions per core, if the session has more (its checkpoint
    keeps their number). In every batch each partition starts Python and opens its state, whether it
    has rows or not, and tickers are few."""
    start = writer.start

    def start_by_cores(*args, **options):
        before = spark.conf.get(PARTITIONS)
        spark.conf.set(PARTITIONS, str(min(int(before), PER_CORE * spark.sparkContext.defaultParallelism)))
        try:
            return start(*args, **options)  # takes a copy of the session's settings
        finally:
            spark.conf.set(PARTITIONS, before)

    writer.start = start_by_cores
    return writer


# ---- lifetime features ----

def in_order(batch: pd.DataFrame) -> pd.DataFrame:
    """Rows by event_ts, then news_id. Ids are compared where times are equal, which is cheaper than
    ranking all of them."""
    batch = batch.iloc[np.argsort(batch["event_ts"].to_numpy(), kind="stable")]
    same = np.diff(batch["event_ts"].to_numpy()) == np.timedelta64(0)
    tied = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
    if len(tied):  # rows of one time lie together, so they change places among themselves
        order = np.arange(len(batch))
        ranks = pd.DataFrame({"at": batch["event_ts"].to_numpy()[tied], "id": batch["news_id"].to_numpy()[tied]})
        order[tied] = tied[ranks.sort_values(["at", "id"], kind="stable").index.to_numpy()]
        batch = batch.iloc[order]
    return batch


class RunningState(StatefulProcessor):
    """Two counts and the mean of a ticker."""

    def __init__(self, alpha: float, seed: str):
        self.alpha, self.seed = alpha, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.so_far = handle.getValueState("so_far", "neg long, pos long, ewm double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = in_order(pd.concat(list(rows), ignore_index=True))
        x = batch["sentiment"].to_numpy()
        start = (0, 0, float(x[0]) if self.seed == "first" else 0.0)
        neg0, pos0, ewm0 = self.so_far.get() if self.so_far.exists() else start
        keep = 1.0 - self.alpha
        ewm = list(accumulate(x.tolist(), lambda e, v: self.alpha * v + keep * e, initial=ewm0))[1:]
        neg, pos = neg0 + np.cumsum(x < 0), pos0 + np.cumsum(x > 0)
        self.so_far.update((int(neg[-1]), int(pos[-1]), float(ewm[-1])))
        yield pd.DataFrame({
            "news_id": batch["news_id"].to_numpy(), "ticker": key[0],
            "window_end": batch["event_ts"].to_numpy(), "neg_news_count_24h": neg.astype("int32"),
            "pos_news_count_24h": pos.astype("int32"), "sentiment_ewm_7d": ewm})

    def close(self) -> None:
        pass


def running_features_stream(mentions: DataFrame, alpha: float = 0.1, seed: str = "zero"
                            ) -> DataFrame:
    """Lifetime counts and exponentially weighted sentiment after every mention.

    Mentions are folded batch after batch, in time order inside a batch. A ticker's rows of one batch
    meet in one task; the source's trigger limits bound them.
    """
    rows = clean_mentions(with_state(mentions)).select(
        "ticker", "event_ts", F.col("news_id").cast("string").alias("news_id"),
        F.col("sentiment").cast("double").alias("sentiment"))
    return rows.groupBy("ticker").transformWithStateInPandas(
        RunningState(alpha, seed), RUNNING, "Append", "None")


# ---- cooldown ----

WAITING = {"at": "<i8", "risk": "<f8", "threshold": "<f8", "ok": "?"}  # numpy types of a chunk's columns
CHUNK = 10_000


class CooldownState(StatefulProcessor):
    """Rows wait until the watermark has passed them, so that they are decided in time order however
    they arrive; ``blocked`` is the microsecond until which a ticker is blocked, and goes by a timer
    once no row can fall before it.

    Rows wait in chunks, a column as the bytes of one array (a missing number as NaN): a row that
    waits costs bytes, not a state entry of its own, and all that are due are decided as arrays.
    """

    def __init__(self, cooldown_micros: int):
        self.span = cooldown_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocked = handle.getValueState("blocked", "until long")
        self.waiting = handle.getListState("waiting_chunks", ", ".join(f"{c} binary" for c in WAITING))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:  # as many as Spark sends at once
            new = [part[c].to_numpy(dtype=kind) for c, kind in zip(
                ("at", "risk_score_5m", "threshold", "ok"), WAITING.values())]
            if len(part):
                self.waiting.appendValue(tuple(c.tobytes() for c in new))
                first = min(int(new[0].min()), first if first is not None else int(new[0].max()))
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        until = self.blocked.get()[0] if self.blocked.exists() else None
        chunks = list(self.waiting.get()) if self.waiting.exists() else []
        columns = [np.concatenate([np.frombuffer(chunk[k], dtype=kind) for chunk in chunks] or [np.empty(0, kind)])
                   for k, kind in enumerate(WAITING.values())]
        due = columns[0] <= passed
        rest = [c[~due] for c in columns]
        if due.any():
            n = len(rest[0])
            if n:
                self.waiting.put([tuple(c[k:k + CHUNK].tobytes() for c in rest) for k in range(0, n, CHUNK)])
            else:
                self.waiting.clear()
            at, risk, limit, ok = (c[due] for c in columns)
            known = ~np.isnan(risk)
            order = np.lexsort((ok, np.where(known, risk, 0.0), known, at))
            at, risk, limit, ok = at[order], risk[order], limit[order], ok[order]
            status, reason, blocked = greedy_cooldown(at, risk > limit, ok, NEVER if until is None else until, self.span)
            if blocked != NEVER:
                until = blocked
                self.blocked.update((until,))
            for k in range(0, len(at), CHUNK):
                piece = slice(k, k + CHUNK)
                yield pd.DataFrame({
                    "ticker": key[0], "window_end": pd.to_datetime(at[piece], unit="us"),
                    "risk_score_5m": risk[piece], "threshold": limit[piece],
                    "status": status[piece], "reason": reason[piece]})
        if until is not None and until <= passed:
            self.blocked.clear()
            until = None
        if len(rest[0]) or until is not None:  # look again when the next row, or else the block, is passed
            moment = int(rest[0].min()) if len(rest[0]) else until
            self.handle.registerTimer(max(-(-moment // 1000), passed // 1000 + 1))

    def close(self) -> None:
        pass


def cooldown_stream(rated: DataFrame, cooldown_minutes: int = 30, delay: str = "7 minutes",
                    delivered: Column | None = None) -> DataFrame:
    """Alert decisions over (ticker, window_end, risk_score_5m, threshold), in any order up to
    ``delay`` late. A row is decided once the newest window is ``delay`` ahead of it; rows that come
    later still are dropped, as late rows are everywhere. Times count to the microsecond; rows of one
    time are taken by risk.

    ``delivered`` tells whether a row's notification arrived; one that did not is failed and starts
    no cooldown. Rows without a ticker or a time are left out.
    """
    ok = F.lit(True) if delivered is None else F.coalesce(delivered, F.lit(False))
    rows = (with_state(rated).filter(F.col("ticker").isNotNull() & F.col("window_end").isNotNull())
            .withColumn("ok", ok)
            .select("ticker", "window_end", F.unix_micros("window_end").alias("at"),
                    F.col("risk_score_5m").cast("double").alias("risk_score_5m"),
                    F.col("threshold").cast("double").alias("threshold"), "ok"))
    return rows.withWatermark("window_end", f"{seconds(delay)} seconds").groupBy(
        "ticker").transformWithStateInPandas(
            CooldownState(cooldown_minutes * 60_000_000), DECIDED, "Append", "EventTime")
