"""The standard and the shock job as streaming queries.

Every job is: source -> columns -> one keyed, watermarked aggregation -> ``foreachBatch`` into
batch-numbered tables. A window takes late rows until its end + delay + lateness (7 minutes) has been
passed by the newest event, which is the boundary of bounded out-of-orderness plus allowed lateness.

Jobs keep slices of a few seconds in their state, not windows: a mention is one row there, and is
spread over the windows that hold it only when those are put together, by the alert job once they are
closed. Shock alerts keep a closed window's own slices, which leave the state with it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewatch.functions.scoring import shock_risk
from tidewatch.operators import alerts, enrich, ingest, shocks, store
from tidewatch.operators.features import clean_mentions, combine_partials, seconds
from tidewatch.operators.ordered import ewm_partials_grouped
from tidewatch.session import configure
from tidewatch.sources.tables import BatchTable, JointTables, Marks, RecordTable, span_of
from tidewatch.streaming.state import STATE_CONF, by_cores, cooldown_stream, running_features_stream

DELAY, LATENESS = "2 minutes", "5 minutes"
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.encodingFormat": "unsaferow",
}


def watermarked(df: DataFrame, time: str = "event_ts", delay: str = DELAY,
                lateness: str = LATENESS) -> DataFrame:
    configure(df.sparkSession)
    for key, value in STREAM_CONF.items():
        df.sparkSession.conf.set(key, value)
    return df.withWatermark(time, f"{seconds(delay) + seconds(lateness)} seconds")


def mention_stream(records: DataFrame, enricher: str = "full") -> DataFrame:
    """Raw records -> mention events; broken records fall out (see ``quarantine_job``)."""
    return enrich.to_mention_events(enrich.ENRICHERS[enricher](ingest.parse_news(records)))


def shock_stream(records: DataFrame, threshold: float = -0.5, enricher: str = "full") -> DataFrame:
    """Raw records -> shock events. The cheap prefilter runs before the enrichment."""
    kept = shocks.shock_prefilter(ingest.parse_news(records))
    return enrich.to_shock_events(enrich.ENRICHERS[enricher](kept), threshold)


# ---- slices ----

SLICE = 10  # seconds; a hot ticker's state is cut by them, and a late mention refolds one of them


def _closed_slices(rows: DataFrame, window: str, slide: str) -> tuple[DataFrame, list[Column]]:
    """For append mode: every window has slices of its own."""
    return watermarked(rows), [F.window("event_ts", window, slide).alias("w"),
                               F.floor(F.unix_seconds("event_ts") / SLICE).alias("slice")]


def _open_slices(rows: DataFrame, window: str) -> tuple[DataFrame, list[Column]]:
    """For update mode: a slice stays until the last window that holds it is closed."""
    lateness = f"{seconds(LATENESS) + seconds(window) - SLICE} seconds"
    return watermarked(rows, lateness=lateness), [F.window("event_ts", f"{SLICE} seconds").alias("w")]


def _mentions(mentions: DataFrame) -> DataFrame:
    return clean_mentions(mentions)


def _shocks(events: DataFrame) -> DataFrame:
    return clean_mentions(events).filter(F.col("headline").isNotNull())


def _shock_partials(rows: DataFrame, groups: list[Column], headlines: int) -> DataFrame:
    """Count, worst sentiment and first headlines per ticker and group."""
    heads = F.array_sort(F.collect_list(F.struct(
        "event_ts", F.col("news_id").cast("string").alias("news_id"), "headline")))
    return rows.groupBy("ticker", *groups).agg(
        F.count("*").alias("n"), F.min("sentiment").alias("worst"),
        F.slice(heads, 1, headlines).alias("heads"), F.max("event_ts").alias("last_ts"))


def _named(slices: DataFrame) -> DataFrame:
    return slices.withColumn("slice", F.col("w.start")).drop("w")


def feature_slices(mentions: DataFrame, window: str = "5 minutes", alpha: float = 0.1) -> DataFrame:
    """Mergeable partials per (ticker, slice), for update mode."""
    rows, groups = _open_slices(_mentions(mentions), window)
    return _named(ewm_partials_grouped(rows, alpha, *groups))


def shock_slices(events: DataFrame, window: str = "5 minutes", headlines: int = 3) -> DataFrame:
    rows, groups = _open_slices(_shocks(events), window)
    return _named(_shock_partials(rows, groups, headlines))


def count_slices(rows: DataFrame, window: str = "5 minutes") -> DataFrame:
    rows, groups = _open_slices(rows, window)
    return _named(rows.groupBy("ticker", *groups).agg(
        F.count("*").alias("n"), F.max("event_ts").alias("last_ts")))


def closed_shocks(events: DataFrame, window: str = "5 minutes", slide: str = "1 minute",
                  headlines: int = 3) -> DataFrame:
    rows, groups = _closed_slices(_shocks(events), window, slide)
    return _shock_partials(rows, groups, headlines).withColumn("window_end", F.col("w.end")).drop("w")


def combine_shock_partials(partials: DataFrame, headlines: int = 3, dealt: tuple[str, ...] = ()
                           ) -> DataFrame:
    """``dealt``: columns that tell where the rows lie, see ``combine_partials``."""
    first = F.slice(F.array_sort(F.flatten(F.collect_list("heads"))), 1, headlines)
    return (partials.groupBy("ticker", "window_end", *dealt)
            .agg(F.sum("n").cast("int").alias("shock_count_5m"),
                 F.least(F.lit(0.0), F.min("worst")).alias("worst_sentiment_5m"),
                 F.transform(first, lambda h: h["headline"]).alias("shock_headlines"))
            .select("ticker", "window_end", "shock_count_5m", "worst_sentiment_5m",
                    shock_risk(F.col("shock_count_5m")).alias("risk_score_5m"),
                    "shock_headlines"))


def combine_counts(partials: DataFrame, dealt: tuple[str, ...] = ()) -> DataFrame:
    return (partials.groupBy("ticker", "window_end", *dealt).agg(F.sum("n").alias("mentions"))
            .drop(*dealt))


def passed_by(newest: int) -> int:
    """The millisecond up to which windows are closed when the newest event is at that microsecond: the
    watermark of windows."""
    return newest // 1000 - (seconds(DELAY) + seconds(LATENESS)) * 1000


class SliceWindows:
    """Slices are dealt out by ticker and stretch of time and meet there, so that one shuffle of them,
    before they are spread over their windows, serves all that follows."""

    def __init__(self, window: str, slide: str):
        self.window, self.slide = window, slide
        self.stretch = max(3600, seconds(window))  # so a window ends in its slices' stretch or the next

    def dealt(self, slices: DataFrame) -> DataFrame:
        """Each slice in the one or two stretches that the windows holding it end in, ``_stretch``."""
        begin = F.unix_seconds("slice")
        ends = [F.floor(at / self.stretch) for at in (begin, begin + seconds(self.window))]
        return (slices.select("*", F.explode(F.array_distinct(F.array(*ends))).alias("_stretch"))
                .repartition("ticker", "_stretch"))

    def spread(self, dealt: DataFrame) -> DataFrame:
        """Each slice once for every window that holds it and ends in the stretch. (``F.window`` would
        have the rows shuffled again: what it makes counts as dealt anyhow.)"""
        begin, slide = F.unix_seconds("slice"), seconds(self.slide)
        last = F.floor(begin / slide) * slide + seconds(self.window)
        first = last - F.floor((last - begin - 1) / slide) * slide
        ends = F.when(last > begin, F.sequence(first, last, F.lit(slide).cast("long")))
        return (dealt.select("*", F.explode(ends).alias("_end"))
                .filter(F.floor(F.col("_end") / self.stretch) == F.col("_stretch"))
                .withColumn("window_end", F.timestamp_seconds("_end")).drop("_end"))


class WindowTables(SliceWindows):
    """``foreachBatch`` target: refined slices in, refined windows out, both upserted.

    ``partials`` keeps the slices, ``windows`` the finished rows, ``records`` the keyed records. Of
    the windows that hold a refined slice those are put together anew that were open when the batch
    began; closed ones stay as they are. ``clock`` keeps the newest event of each batch, from which
    the next one tells which windows are open.
    """

    def __init__(self, root: str, combine: Callable[[DataFrame, tuple[str, ...]], DataFrame],
                 prefix: str | None = "feat",
                 version: str = "v1", window: str = "5 minutes", slide: str = "1 minute"):
        super().__init__(window, slide)
        self.partials = BatchTable(f"{root}/partials", ("ticker", "slice"), "slice")
        self.windows = BatchTable(f"{root}/windows", ("ticker", "window_end"))
        self.records = RecordTable(f"{root}/records", ("key",))
        self.clock = Marks(f"{root}/clock")
        self.combine, self.prefix, self.version = combine, prefix, version

    def still_open(self, newest: int | None) -> Column:
        if newest is None:
            return F.lit(True)
        return F.unix_millis("window_end") > passed_by(newest)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            before = self.clock.last(spark, batch_id)
            seen = [n for n in (before and before[1], batch.agg(
                F.max(F.unix_micros("last_ts"))).first()[0]) if n is not None]
            self._refine(batch, batch_id, self.still_open(before and before[1]))
            if seen:
                self.clock.put(spark, batch_id, max(seen))
        finally:
            batch.unpersist()

    def _refine(self, batch: DataFrame, batch_id: int, still_open: Column) -> None:
        span = span_of(batch, "slice")
        if span is None:
            return
        spark, reach = batch.sparkSession, dt.timedelta(seconds=seconds(self.window))
        around = span[0] - reach, span[1] + reach
        earlier = self.partials.versions(spark, batch_id - 1, around)
        alone = earlier is None or earlier.isEmpty()
        self.partials.write(batch, batch_id)
        if alone:
            touched = self.spread(self.dealt(batch)).filter(still_open)
        else:
            versions = self.dealt(self.partials.versions(spark, batch_id, around)
                                  .withColumn("_refined", F.col("_batch") == batch_id))
            slices = self.partials.newest(versions, "_stretch")
            windows = Window.partitionBy("ticker", "_stretch", "window_end")
            touched = (self.spread(slices).filter(still_open)
                       .withColumn("_hit", F.max("_refined").over(windows)).filter("_hit"))
        windows = self.combine(touched, ("_stretch",)).persist()
        try:
            self.windows.write(windows, batch_id)
            if self.prefix is not None:
                self.records.write(store.window_records(windows, self.prefix, self.version), batch_id)
        finally:
            windows.unpersist()

    def live_records(self, spark, now: Column | None = None) -> DataFrame:
        """The keyed records as they stand and have not expired."""
        newest = self.records.current(self.records.versions(spark)).drop("_hour", "_batch")
        return store.live(newest, F.current_timestamp() if now is None else now)

    def compact(self, spark, now: Column | None = None) -> None:
        """Folds the records of closed hours into one per key and drops expired ones. Call it beside
        the stream, every few hours."""
        newest = self.clock.last(spark)
        if newest is not None:
            passed = newest[1] - (seconds(DELAY) + seconds(LATENESS)) * 1_000_000
            closed = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=passed)
            self.records.compact(spark, closed, F.current_timestamp() if now is None else now)


def feature_tables(root: str, alpha: float = 0.1, window: str = "5 minutes", slide: str = "1 minute"
                   ) -> WindowTables:
    return WindowTables(root, lambda p, dealt: combine_partials(p, alpha, dealt), window=window, slide=slide)


def shock_tables(root: str, headlines: int = 3, window: str = "5 minutes", slide: str = "1 minute"
                 ) -> WindowTables:
    return WindowTables(root, lambda p, dealt: combine_shock_partials(p, headlines, dealt), "shock",
                        "v1_shock", window, slide)


class RunningTables:
    """``foreachBatch`` target for the rows that ``running_features_stream`` makes."""

    def __init__(self, root: str):
        self.features = BatchTable(f"{root}/running", ("news_id", "ticker"))

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        self.features.write(rows, batch_id)


def alert_outputs(root: str) -> JointTables:
    """Alert history and outbox, of which no reader sees one without the other."""
    return JointTables(root, history=("ticker", "window_end"), outbox=("ticker", "window_end"))


class AlertTables(SliceWindows):
    """``foreachBatch`` target for refined slices (update mode): alert history and outbox.

    A batch first decides on the windows that have been closed since the last one, from the slices
    as the batches before left them: its own rows are late for these windows. Then it writes its own
    slices. ``clock`` keeps the newest event, ``closed`` the millisecond up to which windows are decided.

    Windows are closed in time order, so the last sent alert of every ticker, read from the history,
    is all the state of the cooldown that a batch needs. ``delivered`` tells by ticker, window_end and
    risk whether a notification arrived; one that did not is recorded as failed and starts no cooldown.
    """

    def __init__(self, root: str, thresholds=None, default_threshold: float = 0.7,
                 cooldown_minutes: int = 30, alpha: float = 0.1, delivered: Column | None = None,
                 window: str = "5 minutes", slide: str = "1 minute"):
        super().__init__(window, slide)
        self.alpha = alpha
        self.delivered = delivered
        self.slices = BatchTable(f"{root}/slices", ("ticker", "slice"), "slice")
        self.clock, self.closed = Marks(f"{root}/clock"), Marks(f"{root}/closed")
        self.joint = alert_outputs(root)
        self.history, self.outbox = self.joint.tables["history"], self.joint.tables["outbox"]
        self.thresholds, self.default = thresholds, default_threshold
        self.cooldown = cooldown_minutes

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()  # else each pass below runs the stateful plan again
        try:
            before, closed = self.clock.last(spark, batch_id), self.closed.last(spark, batch_id)
            if before is not None:
                passed = passed_by(before[1])
                if closed is None or passed > closed[1]:
                    self._close(spark, batch_id, closed and closed[1], passed)
                self.closed.put(spark, batch_id, passed)
            newest = batch.agg(F.max(F.unix_micros("last_ts"))).first()[0]
            if newest is not None:
                self.slices.write(batch, batch_id)
            seen = [n for n in (before and before[1], newest) if n is not None]
            if seen:
                self.clock.put(spark, batch_id, max(seen))
        finally:
            batch.unpersist()

    def rated(self, slices: DataFrame, after: int | None, passed: int) -> DataFrame:
        """The windows that end after the one millisecond and up to the other, with risk and threshold."""
        begin, end = F.unix_millis("slice"), F.unix_millis("window_end")
        slices = slices.filter(begin < passed)
        due = end <= passed
        if after is not None:
            slices = slices.filter(begin + seconds(self.window) * 1000 > after)
            due = due & (end > after)
        slices = self.slices.newest(self.dealt(slices), "_stretch")
        windows = combine_partials(self.spread(slices).filter(due), self.alpha, ("_stretch",))
        return alerts.lookup_threshold(windows, self.thresholds, self.default)

    def _close(self, spark, batch_id: int, after: int | None, passed: int) -> None:
        epoch, ms = dt.datetime(1970, 1, 1), dt.timedelta(milliseconds=1)
        since = None if after is None else epoch + after * ms
        slices = self.slices.versions(spark, batch_id - 1, since and (
            since - dt.timedelta(seconds=seconds(self.window)), epoch + passed * ms))
        if slices is None:
            return
        rows = self.rated(slices, after, passed).select(
            "ticker", "window_end", "risk_score_5m", "threshold", F.lit(False).alias("earlier")).persist()
        past = since and self.history.versions(spark, batch_id - 1, (
            since - dt.timedelta(minutes=self.cooldown), epoch + passed * ms))
        with_past = rows
        if past is not None:
            last = past.filter("notification_sent").groupBy("ticker").agg(F.max("window_end").alias("window_end"))
            with_past = rows.unionByName(last.select(
                "ticker", "window_end", F.lit(1.0).alias("risk_score_5m"),
                F.lit(0.0).alias("threshold"), F.lit(True).alias("earlier")))
        arrived = F.lit(True) if self.delivered is None else self.delivered
        decisions = alerts.alert_decisions(with_past, delivered=F.col("earlier") | arrived,
                                           cooldown_minutes=self.cooldown)
        decisions = decisions.filter(~F.col("earlier")).drop("earlier").persist()
        try:
            self.joint.write(batch_id, history=alerts.alert_history(decisions),
                             outbox=alerts.outbox(decisions))
        finally:
            decisions.unpersist()
            rows.unpersist()


class DecisionTables:
    """``foreachBatch`` target for decided rows (``cooldown_stream``): history and outbox."""

    def __init__(self, root: str):
        self.joint = alert_outputs(root)
        self.history, self.outbox = self.joint.tables["history"], self.joint.tables["outbox"]

    def __call__(self, decisions: DataFrame, batch_id: int) -> None:
        decisions = decisions.persist()
        try:
            self.joint.write(batch_id, history=alerts.alert_history(decisions),
                             outbox=alerts.outbox(decisions))
        finally:
            decisions.unpersist()


# ---- jobs ----

def _writer(df: DataFrame, target: Callable[[DataFrame, int], None], checkpoint: str, mode: str,
            trigger: dict | None, conf: dict[str, str] = STREAM_CONF) -> DataStreamWriter:
    """``conf`` is set when the stream is started, as other jobs may have been set up meanwhile."""
    writer = (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
              .foreachBatch(target).trigger(**(trigger or {"processingTime": "10 seconds"})))
    start = writer.start

    def start_with_conf(*args, **options):
        for key, value in conf.items():
            df.sparkSession.conf.set(key, value)
        return start(*args, **options)

    writer.start = start_with_conf
    return writer


def feature_job(mentions: DataFrame, root: str, checkpoint: str, trigger: dict | None = None,
                **params) -> tuple[DataStreamWriter, WindowTables]:
    """The standard job: mentions -> refined feature windows and keyed records."""
    tables = feature_tables(root, **params)
    slices = feature_slices(mentions, tables.window, params.get("alpha", 0.1))
    return _writer(slices, tables, checkpoint, "update", trigger), tables


def shock_job(events: DataFrame, root: str, checkpoint: str, trigger: dict | None = None,
              **params) -> tuple[DataStreamWriter, WindowTables]:
    """The shock job: shock events -> refined shock windows and keyed records."""
    tables = shock_tables(root, **params)
    slices = shock_slices(events, tables.window, params.get("headlines", 3))
    return _writer(slices, tables, checkpoint, "update", trigger), tables


def count_job(rows: DataFrame, root: str, checkpoint: str, trigger: dict | None = None,
              window: str = "5 minutes", slide: str = "1 minute"
              ) -> tuple[DataStreamWriter, WindowTables]:
    """Rows (ticker, event_ts) -> refined counts per sliding window."""
    tables = WindowTables(root, combine_counts, None, window=window, slide=slide)
    return _writer(count_slices(rows, window), tables, checkpoint, "update", trigger), tables


def alert_job(mentions: DataFrame, root: str, checkpoint: str, trigger: dict | None = None,
              thresholds=None, default_threshold: float = 0.7, cooldown_minutes: int = 30,
              delivered: Column | None = None) -> tuple[DataStreamWriter, AlertTables]:
    """Closed windows -> alert history and outbox."""
    tables = AlertTables(root, thresholds, default_threshold, cooldown_minutes, delivered=delivered)
    slices = feature_slices(mentions, tables.window, tables.alpha)
    return _writer(slices, tables, checkpoint, "update", trigger), tables


class ShockAlertTables:
    """``foreachBatch`` target for the slices of closed shock windows: alerts under a cooldown."""

    def __init__(self, root: str, min_count: int = 3, cooldown_minutes: int = 30, headlines: int = 3):
        self.alerts = BatchTable(f"{root}/shock-alerts", ("ticker", "window_end"))
        self.min_count, self.cooldown, self.headlines = min_count, cooldown_minutes, headlines

    def __call__(self, slices: DataFrame, batch_id: int) -> None:
        slices = slices.persist()
        try:
            span = span_of(slices, "window_end")
            if span is None:
                return
            windows = combine_shock_partials(slices, self.headlines).withColumn(
                "earlier", F.lit(False))
            since = span[0] - dt.timedelta(minutes=self.cooldown)
            past = self.alerts.versions(slices.sparkSession, batch_id - 1, (since, span[1]))
            if past is not None:  # the last alert of every ticker enters the scan as an open cooldown
                last = past.groupBy("ticker").agg(F.max("window_end").alias("window_end"))
                windows = windows.unionByName(last.withColumns({
                    "shock_count_5m": F.lit(self.min_count), "earlier": F.lit(True)}),
                    allowMissingColumns=True)
            rows = windows.filter(F.col("shock_count_5m") >= self.min_count).withColumn(
                "threshold", F.lit(-1.0)).withColumn("risk_score_5m", F.coalesce(
                    "risk_score_5m", F.lit(1.0)))
            decided = alerts.alert_decisions(rows, cooldown_minutes=self.cooldown)
            fired = decided.filter((F.col("status") == "sent") & ~F.col("earlier"))
            self.alerts.write(fired.drop("status", "reason", "threshold", "earlier"), batch_id)
        finally:
            slices.unpersist()


def shock_alert_job(events: DataFrame, root: str, checkpoint: str, trigger: dict | None = None,
                    min_count: int = 3, cooldown_minutes: int = 30, **params
                    ) -> tuple[DataStreamWriter, ShockAlertTables]:
    """Closed shock windows -> shock alerts."""
    tables = ShockAlertTables(root, min_count, cooldown_minutes, params.get("headlines", 3))
    return _writer(closed_shocks(events, **params), tables, checkpoint, "append", trigger), tables


def quarantine_job(records: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
                   ) -> DataStreamWriter:
    """The records that ``parse_news`` leaves out, as they came, into a parquet folder."""
    return (ingest.rejected_news(records).writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "10 seconds"})))


def running_job(mentions: DataFrame, root: str, checkpoint: str, trigger: dict | None = None,
                alpha: float = 0.1, seed: str = "zero") -> tuple[DataStreamWriter, RunningTables]:
    """Mentions -> lifetime features, from keyed state."""
    tables = RunningTables(root)
    writer = _writer(running_features_stream(mentions, alpha, seed), tables, checkpoint, "append",
                     trigger, STATE_CONF)
    return by_cores(writer, mentions.sparkSession), tables


def cooldown_job(rated: DataFrame, root: str, checkpoint: str, trigger: dict | None = None,
                 cooldown_minutes: int = 30, delivered: Column | None = None, delay: str = "7 minutes"
                 ) -> tuple[DataStreamWriter, DecisionTables]:
    """Finished windows (ticker, window_end, risk_score_5m, threshold), up to ``delay`` out of order
    -> alert history and outbox, from keyed state."""
    tables = DecisionTables(root)
    decided = cooldown_stream(rated, cooldown_minutes, delay, delivered)
    writer = _writer(decided, tables, checkpoint, "append", trigger, STATE_CONF)
    return by_cores(writer, rated.sparkSession), tables


def fan_out(*targets: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One stream into several targets, computed once per batch."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for target in targets:
                target(batch, batch_id)
        finally:
            batch.unpersist()
    return run
