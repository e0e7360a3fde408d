"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def id_checksum(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


ROWS_PER_BATCH = 1_000  # rows handed to Python at once; texts may be long


def small_batches(docs: DataFrame) -> None:
    """Sets the session's Arrow batches to ``ROWS_PER_BATCH`` rows if they are larger."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ROWS_PER_BATCH:
        conf.set(name, str(ROWS_PER_BATCH))


def core(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name cannot clash with an operator's."""
    small_batches(docs)
    return docs.select(*[docs[c] for c in columns])


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
         "binary": pa.binary()}


def record_batch(schema: str, rows: list[tuple], kept: dict[str, pa.Array] | None = None
                 ) -> pa.RecordBatch:
    """Rows of Python values under ``schema`` ("name kind, ..."), after the ``kept`` columns.

    Arrow, not pandas, so that an id next to a null id stays an integer.
    """
    fields = [f.split() for f in schema.split(", ")]
    columns = dict(kept or {})
    for k, (name, kind) in enumerate(fields):
        columns[name] = pa.array([r[k] for r in rows], ARROW[kind])
    return pa.RecordBatch.from_pydict(columns)


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def per_text(docs: DataFrame, columns: list[str], schema: str,
             build: Callable[[], Callable[[list[str]], list[tuple]]]) -> DataFrame:
    """Applies a function of texts (null: empty) to every row, in Arrow batches.

    ``columns`` are kept, ``schema`` names what the function returns for each text. ``build`` makes
    the function once per task. Only the text and the kept columns reach Python.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = build()
        for batch in batches:
            rows = score([t or "" for t in batch.column("text").to_pylist()])
            yield record_batch(schema, rows, {c: batch.column(c) for c in columns})

    kept = ", ".join(f"{c} {kind_of(docs, c)}" for c in columns)
    return core(docs, *columns, "text").mapInArrow(run, f"{kept}, {schema}")


def each(one: Callable[[str], tuple]) -> Callable[[list[str]], list[tuple]]:
    """A function of one text as one of many."""
    return lambda texts: [one(t) for t in texts]


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, usable: Column,
                   per_class: int) -> tuple[list[str], list]:
    """A bounded sample of labelled texts: at most ``per_class`` documents of each label, by hash
    order.

    The only thing that is bounded by a row count, and only for fitting. Ids are picked on the
    narrow columns; a label per id is the greatest one given. A label's ids are dealt into shares of
    which up to 1,000 rows are taken each: so far Spark limits the groups inside every task before the
    shuffle, and a label that holds most rows stays small. Of rows that share an id, one text counts.
    Labels and ids without a value are not used.
    """
    shares = -(-per_class // 1000)
    marked = (labels.where(usable & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
              .groupBy("doc_id").agg(F.max(label).alias("label")))
    marked = marked.withColumn("share", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(shares)))
    order = Window.partitionBy("label", "share").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = (marked.withColumn("nth", F.row_number().over(order))
              .where(F.col("nth") <= per_class // shares).select("doc_id", "label"))
    texts = (core(docs, "doc_id", "text").where(F.col("text").isNotNull())
             .join(F.broadcast(picked), "doc_id")
             .groupBy("doc_id").agg(F.max("label").alias("label"), F.max("text").alias("text")))
    rows = sorted(texts.collect())
    return [r["text"] for r in rows], [r["label"] for r in rows]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


HEAVY_SHARE = 1_000


def join_by_size(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str,
                 how: str = "left") -> DataFrame:
    """Left (or inner) join of ``rows`` with ``groups``, which has one row per key and counts the
    key's rows.

    Keys with more than a thousandth of all rows are fewer than a thousand, whatever the data: those
    are broadcast and their rows stay where they are. All other rows are shuffled by key, and no key
    among them is large. Both inputs should be written tables, as they are read more than once. The
    size column is left out.
    """
    key = [key] if isinstance(key, str) else key
    limit = rows.count() // HEAVY_SHARE
    heavy = groups.where(F.col(size) > limit).drop(size)
    light = groups.where(F.col(size) <= limit).drop(size)
    hot = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(*key)), key, "left_anti")
    return hot.unionByName(rest.join(light, key, how))
