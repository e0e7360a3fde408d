"""Micro-batches of articles before a costly call: so many rows or so many milliseconds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.features import seconds
from tidewatch.streaming.state import with_state

MAX_ROWS, MAX_MILLIS = 10, 1000


def cut(times: list[int], max_rows: int, max_micros: int, until: int) -> list[int]:
    """Sizes of the groups of sorted ``times`` that are complete when the clock shows ``until``.

    A group is opened by its first row and complete with ``max_rows`` rows, or ``max_micros`` after
    its first row, whichever comes first.
    """
    sizes, k = [], 0
    while k < len(times):
        end = k
        while end < len(times) and end - k < max_rows and times[end] < times[k] + max_micros:
            end += 1
        if end - k < max_rows and times[k] + max_micros > until:
            break  # rows may still come
        sizes.append(end - k)
        k = end
    return sizes


class Batcher(StatefulProcessor):
    """Rows of a lane wait until the watermark has passed them, are grouped in time order and leave
    as whole groups; a timer drains a group that does not fill up."""

    def __init__(self, max_rows: int, max_micros: int, row: str, names: list[str]):
        self.max_rows, self.max_micros, self.row, self.names = max_rows, max_micros, row, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at long, {self.row}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        self.waiting.appendList([(int(r[0]), *r[1:]) for r in new[["at", *self.names]].itertuples(
            index=False, name=None)])
        self.handle.registerTimer(-(-int(new["at"].min()) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], str(r[1:]))) \
            if self.waiting.exists() else []
        due = [r for r in rows if r[0] <= passed]
        if rows:  # look again when the watermark has moved on
            self.handle.registerTimer(passed // 1000 + 1)
        groups, k = [], 0
        for size in cut([r[0] for r in due], self.max_rows, self.max_micros, passed):
            groups.append(due[k:k + size])
            k += size
        if groups:
            rest = rows[k:]
            self.waiting.put(rest) if rest else self.waiting.clear()
            numbers, last = [], None
            for g in groups:  # groups that begin at one time are told apart by a number
                numbers.append(numbers[-1] + 1 if last == g[0][0] else 0)
                last = g[0][0]
            yield pd.DataFrame({
                **{f"key{i}": v for i, v in enumerate(key)},
                "first_at": pd.to_datetime([g[0][0] for g in groups], unit="us"), "number": numbers,
                "rows": [[dict(zip(self.names, r[1:])) for r in g] for g in groups]})

    def close(self) -> None:
        pass


def micro_batches(rows: DataFrame, lane: list[str], time: str, max_rows: int = MAX_ROWS,
                  max_millis: int = MAX_MILLIS, delay: str = "1 second") -> DataFrame:
    """Rows grouped per lane (a topic's partition, say) in the order of ``time``: the lane's columns,
    ``first_at``, ``number`` and the array ``rows`` of the other columns.

    A group holds up to ``max_rows`` rows that came within ``max_millis`` of its first. It leaves once
    the newest row is ``delay`` ahead of its end, so the groups do not depend on how the source cut
    its micro-batches. What is left when a source ends is drained by a row that is far ahead.
    """
    names = [c for c in rows.columns if c not in (*lane, time)]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    row = ", ".join(f"{c} {kinds[c]}" for c in names)
    lanes = ", ".join(f"key{i} {kinds[c]}" for i, c in enumerate(lane))
    inner = ", ".join(f"{c}: {kinds[c]}" for c in names)
    groups = (with_state(rows).filter(F.col(time).isNotNull()).withColumn("at", F.unix_micros(time))
              .withWatermark(time, f"{seconds(delay)} seconds").groupBy(*lane)
              .transformWithStateInPandas(
                  Batcher(max_rows, max_millis * 1000, row, names),
                  f"{lanes}, first_at timestamp, number int, rows array<struct<{inner}>>",
                  "Append", "EventTime"))
    return groups.withColumnsRenamed({f"key{i}": c for i, c in enumerate(lane)})
