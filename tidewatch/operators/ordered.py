"""Order-dependent folds that do not need one task per key.

An exponentially weighted mean, a running count or a cooldown is a fold over a key's rows in time
order. Hash-partitioning by key would put a hot key (a third of all rows, say) into one task.
Instead the rows are *range*-partitioned by (key, order), which cuts a hot key into contiguous
pieces:

- ``ewm_partials`` needs only one pass, because pieces of a window merge exactly;
- ``ordered_scan`` (one output per input row) needs the state at the start of every piece. The
  sorted pieces are checkpointed (shared folder, so they survive lost executors), each piece
  reports a summary of its first and last key, the summaries (at most two rows per partition) are
  chained per key, and the second pass starts every piece from its carried-in state.

The Python parts see Arrow batches and work on whole arrays; Spark does the partitioning, the
sorting and the joining.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import shared_dir


def range_sorted(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows cut into contiguous, sorted pieces of about equal size, hot keys included."""
    columns = [F.col(c) for c in (*keys, *order)]
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


def _starts(*columns: pa.Array) -> np.ndarray:
    """Positions where any of the columns changes value (the first row included)."""
    n = len(columns[0])
    change = np.zeros(n, dtype=bool)
    if n:
        change[0] = True
    for col in columns:
        if n > 1:
            differs = pc.not_equal(col.slice(1), col.slice(0, n - 1))
            change[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.flatnonzero(change)


# ---------------------------------------------------------------------------------------------
# mergeable partial aggregates of an exponentially weighted mean

PARTIAL_SCHEMA = ("ticker string, bucket timestamp, first_ts timestamp, first_id string, "
                  "n long, first_x double, tail double, neg long, pos long")
_PARTIAL_ARROW = pa.schema([
    ("ticker", pa.string()), ("bucket", pa.timestamp("us", tz="UTC")),
    ("first_ts", pa.timestamp("us", tz="UTC")), ("first_id", pa.string()), ("n", pa.int64()),
    ("first_x", pa.float64()), ("tail", pa.float64()), ("neg", pa.int64()), ("pos", pa.int64())])


def _partials_of(batch: pa.RecordBatch, alpha: float) -> list[dict]:
    """One partial per run of equal (ticker, bucket) in a sorted batch."""
    ticker, bucket = batch.column("ticker"), batch.column("bucket")
    starts = _starts(ticker, bucket)
    x = batch.column("sentiment").to_numpy(zero_copy_only=False)
    ends = np.append(starts[1:], len(x))
    counts = ends - starts
    age = np.repeat(ends, counts) - 1 - np.arange(len(x))  # rows after this one in its run
    weights = alpha * np.power(1.0 - alpha, age)
    at = pa.array(starts)
    cols = {
        "ticker": ticker.take(at).to_pylist(),
        "bucket": bucket.take(at).cast(pa.int64()).to_pylist(),
        "first_ts": batch.column("event_ts").take(at).cast(pa.int64()).to_pylist(),
        "first_id": batch.column("news_id").take(at).to_pylist(),
        "n": counts.tolist(),
        "first_x": x[starts].tolist(),
        "tail": np.add.reduceat(x * weights, starts).tolist(),
        "neg": np.add.reduceat((x < 0).astype(np.int64), starts).tolist(),
        "pos": np.add.reduceat((x > 0).astype(np.int64), starts).tolist(),
    }
    names = list(cols)
    return [dict(zip(names, row)) for row in zip(*cols.values())]


def _merged(a: dict, b: dict, alpha: float) -> dict:
    return {**a, "n": a["n"] + b["n"], "tail": (1.0 - alpha) ** b["n"] * a["tail"] + b["tail"],
            "neg": a["neg"] + b["neg"], "pos": a["pos"] + b["pos"]}


def ewm_partials(mentions: DataFrame, bucket_seconds: int, alpha: float) -> DataFrame:
    """Partial aggregates of (ticker, event_ts, news_id, sentiment) per ticker and time bucket.

    ``tail`` is the sum of alpha * (1-alpha)^(rows after) * x, so appending a partial to a mean e
    gives (1-alpha)^n * e + tail. A bucket that spans several pieces yields one row per piece.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = _partials_of(batch, alpha)
            if pending is not None:
                same = (pending["ticker"], pending["bucket"]) == (rows[0]["ticker"], rows[0]["bucket"])
                rows = [_merged(pending, rows[0], alpha), *rows[1:]] if same else [pending, *rows]
            pending = rows.pop()
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_PARTIAL_ARROW)
        if pending is not None:
            yield pa.RecordBatch.from_pylist([pending], schema=_PARTIAL_ARROW)

    bucket = F.window("event_ts", f"{bucket_seconds} seconds")["start"]
    rows = mentions.select("ticker", "event_ts", F.col("news_id").cast("string").alias("news_id"),
                           F.col("sentiment").cast("double").alias("sentiment"))
    pieces = range_sorted(rows, ["ticker"], ["event_ts", "news_id"]).withColumn("bucket", bucket)
    return pieces.mapInArrow(run, PARTIAL_SCHEMA)


def ewm_partials_grouped(mentions: DataFrame, alpha: float, *groups) -> DataFrame:
    """The same partials by plain grouping, for groups of bounded size (streaming slices)."""
    ordered = F.array_sort(F.collect_list(
        F.struct("event_ts", F.col("news_id").cast("string").alias("news_id"),
                 F.col("sentiment").cast("double").alias("x"))))
    one = F.element_at("xs", 1)
    return (mentions.groupBy("ticker", *groups)
            .agg(ordered.alias("xs"), F.count_if(F.col("sentiment") < 0).alias("neg"),
                 F.count_if(F.col("sentiment") > 0).alias("pos"))
            .withColumns({
                "first_ts": one["event_ts"], "first_id": one["news_id"], "first_x": one["x"],
                "last_ts": F.element_at("xs", -1)["event_ts"],
                "n": F.size("xs").cast("long"),
                "tail": F.aggregate("xs", F.lit(0.0),
                                    lambda e, r: e * (1.0 - alpha) + r["x"] * alpha)})
            .drop("xs"))


def fold_partials(partials, alpha: float):
    """Exponentially weighted mean, seeded with its first value, of collected partials."""
    first = F.element_at(partials, 1)["first_x"]
    return F.aggregate(partials, first,
                       lambda e, p: e * F.pow(F.lit(1.0 - alpha), p["n"]) + p["tail"])


def ewm_fold(values, alpha: float, seed: str = "first"):
    """Plain fold over an ordered array of numbers; the literal definition."""
    start = F.element_at(values, 1) if seed == "first" else F.lit(0.0)
    return F.aggregate(values, start, lambda e, x: F.lit(alpha) * x + F.lit(1.0 - alpha) * e)


# ---------------------------------------------------------------------------------------------
# ordered scans


def split_sorted(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``range_sorted`` with the piece number in ``_piece``, materialised in the shared folder.

    The cut points come from sampling, so the two passes of a scan must see the very same pieces:
    hence the checkpoint, which also frees the scan from recomputing its input.
    """
    shared_dir(df.sparkSession)
    return range_sorted(df, keys, order).withColumn("_piece", F.spark_partition_id()).checkpoint()


def ordered_scan(pieces: DataFrame, key: str, *, summary_columns: list[str],
                 summary_schema: str, state_schema: str,
                 summarize: Callable[[list[pd.DataFrame]], dict],
                 advance: Callable[[dict | None, dict], dict],
                 emit: Callable[[pd.DataFrame, dict | None], tuple[pd.DataFrame, dict]],
                 output_schema: str) -> DataFrame:
    """Scan the rows of every key in order, whatever their number.

    summarize: the rows of one key inside one piece (only ``summary_columns``) -> its summary
    advance:   state before the stretch, its summary -> state after it
    emit:      rows of one key, state before them -> output rows, state after them
    States and summaries are dicts matching the two schemas; the state before a key's first row is
    None.
    """
    summary_cols = [c.strip().split(" ")[0] for c in summary_schema.split(",")]
    state_cols = [c.strip().split(" ")[0] for c in state_schema.split(",")]

    def runs(pdf: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame]]:
        values = pdf[key].to_numpy()
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(pdf)]):
            yield values[a], pdf.iloc[a:b]

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Summaries of the first and the last key of a piece; only those reach into others."""
        name, held, piece, first = None, [], None, True
        for pdf in batches:
            for value, rows in runs(pdf):
                if held and value != name:
                    if first:
                        yield pd.DataFrame([{"_piece": piece, key: name, **summarize(held)}])
                        first = False
                    held = []
                name, piece = value, int(rows["_piece"].iloc[0])
                held.append(rows)
        if held:
            yield pd.DataFrame([{"_piece": piece, key: name, **summarize(held)}])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = None, []
        for row in pdf.sort_values("_piece").to_dict("records"):
            if state is not None:
                out.append({"_piece": row["_piece"], key: row[key], **state})
            state = advance(state, {c: row[c] for c in summary_cols})
        return pd.DataFrame(out, columns=["_piece", key, *state_cols])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = object(), None  # unlike any key, null included
        for pdf in batches:
            done = []
            for value, rows in runs(pdf):
                if value != name:
                    head = rows.iloc[0]
                    carried = bool(head["_carried"])
                    name = value
                    state = {c: head[f"_s_{c}"] for c in state_cols} if carried else None
                out, state = emit(rows, state)
                done.append(out)
            if done:
                yield pd.concat(done, ignore_index=True)

    narrow = pieces.select("_piece", key, *summary_columns)
    summaries = narrow.mapInPandas(edges, f"_piece int, {key} string, {summary_schema}")
    carries = (summaries.groupBy(key)
               .applyInPandas(chain, f"_piece int, {key} string, {state_schema}")
               .select(F.col("_piece").alias("_c_piece"), F.col(key).alias("_c_key"),
                       F.lit(True).alias("_carried"),
                       *[F.col(c).alias(f"_s_{c}") for c in state_cols]))
    # at most two rows per piece, whatever the data: always small enough to broadcast
    same = (F.col("_piece") == F.col("_c_piece")) & F.col(key).eqNullSafe(F.col("_c_key"))
    started = (pieces.join(F.broadcast(carries), same, "left").drop("_c_piece", "_c_key")
               .withColumn("_carried", F.coalesce("_carried", F.lit(False))))
    return started.mapInPandas(scan, output_schema)
