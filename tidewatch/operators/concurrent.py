"""Enrichment by a service: many calls at once, each with a deadline, answers in any order."""

from __future__ import annotations

import asyncio
import queue
import threading
from collections.abc import Awaitable, Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

CAPACITY, TIMEOUT, ROWS_OUT = 200, 5.0, 500
MENTIONS = ArrayType(StructType([StructField("ticker", StringType()), StructField("role", StringType()),
                                 StructField("sentiment", DoubleType())]))
Client = Callable[[dict], Awaitable[list[dict]]]


class InFlight:
    """At most ``capacity`` calls at a time, in an event loop that runs beside the task.

    A call that passes its deadline is cancelled, so a service that hangs holds no place for longer.
    """

    def __init__(self, call: Client, capacity: int, timeout: float):
        self.call, self.timeout = call, timeout
        self.places = threading.BoundedSemaphore(capacity)
        self.answers: queue.SimpleQueue = queue.SimpleQueue()
        self.out = 0
        self.loop = asyncio.new_event_loop()
        threading.Thread(target=self.loop.run_forever, daemon=True).start()

    async def _one(self, row: dict) -> None:
        companies, outcome = None, "answered"
        try:
            companies = await asyncio.wait_for(self.call(row), self.timeout)
        except TimeoutError:
            outcome = "timeout"
        except Exception:  # noqa: BLE001  one article's failure is not the job's
            outcome = "failed"
        finally:
            self.answers.put((row, companies, outcome))
            self.places.release()

    def send(self, row: dict) -> None:
        self.places.acquire()
        self.out += 1
        asyncio.run_coroutine_threadsafe(self._one(row), self.loop)

    def ready(self, wait: bool) -> Iterator[tuple]:
        """Answers that have come; with ``wait``, those of all calls on their way."""
        while self.out:
            try:
                answer = self.answers.get(wait)
            except queue.Empty:
                return
            self.out -= 1
            yield answer

    def close(self) -> None:
        self.loop.call_soon_threadsafe(self.loop.stop)


def unordered_enrich(news: DataFrame, connect: Callable[[], Client], capacity: int = CAPACITY,
                     timeout: float = TIMEOUT) -> DataFrame:
    """Adds ``companies`` (the service's answer; empty where it came too late or not at all) and
    ``outcome`` (answered, timeout, failed) to every article. Rows leave in the order of the answers.

    ``connect`` is called once per task, on the executor, and returns a coroutine function of an
    article as a dict; what it holds open serves all calls of the task. Calls are per task, so a
    cluster has up to ``capacity`` times its cores on their way. Nothing is kept but the calls on
    their way and up to ``ROWS_OUT`` answers.
    """
    schema = StructType([*news.schema.fields, StructField("companies", MENTIONS),
                         StructField("outcome", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calls, done = InFlight(connect(), capacity, timeout), []

        def packed() -> pa.RecordBatch:
            rows = [{**row, "companies": companies or [], "outcome": outcome}
                    for row, companies, outcome in done]
            done.clear()
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        try:
            for batch in batches:
                for row in batch.to_pylist():
                    calls.send(row)
                    done += calls.ready(wait=False)
                    if len(done) >= ROWS_OUT:
                        yield packed()
            done += calls.ready(wait=True)
            if done:
                yield packed()
        finally:
            calls.close()

    return news.mapInArrow(run, schema)
