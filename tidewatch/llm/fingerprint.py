"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

Leaves are runs of up to five words inside a paragraph; a paragraph is a line with its line end; a
section is a run of paragraphs that ends at a blank line or at a paragraph whose digest is divisible
by eight, so that an edit moves no distant border. Each node digests its children's digests. Equal
roots mean equal texts; going down only where digests differ finds the edited places, and the share
of equal leaves is the likeness of two texts.

Nulls count as empty texts; an empty text has a root and no sections, and is like only itself.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import core, kind_of, record_batch

PIECE = re.compile(r"\s*(?:\S+\s*){1,5}|\s+")
CUT = 8  # a section ends at one in so many paragraphs
Line = tuple[str, tuple[str, ...]]  # digest of a paragraph, digests of its pieces


def paragraph(line: str) -> Line:
    pieces = tuple(f"{xxhash.xxh32_intdigest(p.encode('utf-8', 'surrogatepass')):08x}"[:6]
                   for p in PIECE.findall(line))
    return xxhash.xxh3_128_hexdigest(line.encode("utf-8", "surrogatepass")), pieces


class Tree:
    """The tree of one text. ``near`` are trees whose paragraphs need not be digested again."""

    def __init__(self, text: str, *near: Tree):
        self.lines: dict[str, Line] = {}
        sections: list[list[Line]] = [[]]
        for line in text.splitlines(keepends=True) if text else []:
            node = self.lines.get(line)
            if node is None:
                node = next((t.lines[line] for t in near if line in t.lines), None) or paragraph(line)
                self.lines[line] = node
            sections[-1].append(node)
            if not line.strip() or int(node[0][-8:], 16) % CUT == 0:
                sections.append([])
        if not sections[-1]:
            sections.pop()
        self.sections = [(hashlib.blake2b("".join(p for p, _ in s).encode(), digest_size=16)
                          .hexdigest(), s) for s in sections]
        self.root = hashlib.sha256("".join(d for d, _ in self.sections).encode()).hexdigest()

    @cached_property
    def pieces(self) -> Counter:
        return Counter(x for _, s in self.sections for _, p in s for x in p)

    def encoded(self) -> str:
        """root/section:paragraph=pieces;... with shortened inner digests."""
        return "/".join([self.root, *[f"{d[:8]}:" + ";".join(f"{p[:8]}=" + "".join(x) for p, x in s)
                                      for d, s in self.sections]])


def likeness(a: Tree, b: Tree) -> float:
    """1 for equal roots, else the share of leaves in common: 2 * common / all."""
    if a.root == b.root:
        return 1.0
    x, y = a.pieces, b.pieces
    total = x.total() + y.total()
    return 2 * (x & y).total() / total if total else 0.0


def changed(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Places (section, paragraph) of ``a`` that ``b`` does not have, found along differing branches."""
    if a.root == b.root:
        return []
    sections = {d for d, _ in b.sections}
    lines = {p for _, s in b.sections for p, _ in s}
    return [(i, j) for i, (d, s) in enumerate(a.sections) if d not in sections
            for j, (p, _) in enumerate(s) if p not in lines]


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the first as many characters of the next text."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def chained(docs: DataFrame, rows_per_range: int = 20_000) -> DataFrame:
    """Every row in the partition of its id range, ids falling, with the row that follows its range.

    Ranges are cut on the ids alone: a narrow pass range-partitions them and takes the greatest id
    of every range. The full rows are then shuffled once; the rows holding the greatest ids, one
    per range, go to the range before as well (``_own`` false), the very first one to the last
    range. There are sixteen ranges per shuffle partition, which evens out what the partitions get, or
    one per ``rows_per_range`` rows if that is more; the driver holds one id per range. Rows of one id, and rows without one, share a range.
    """
    ids = core(docs, "doc_id").where(F.col("doc_id").isNotNull()).distinct()
    rows = ids.count()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(-(-rows // 200), max(16 * parts, -(-rows // rows_per_range))))
    tops = (ids.repartitionByRange(n, F.col("doc_id").desc())
            .groupBy(F.spark_partition_id().alias("p")).agg(F.max("doc_id").alias("top")))
    bounds = sorted(r["top"] for r in tops.collect())
    last = max(0, len(bounds) - 1)

    @F.pandas_udf("part int, head boolean")
    def place(ids: pd.Series, some: pd.Series) -> pd.DataFrame:
        """Number of the id's range, the greatest ids first, and whether the id leads the range."""
        values, some = ids.to_numpy(), some.to_numpy(dtype=bool)
        part = np.full(len(ids), last)
        head = np.zeros(len(ids), dtype=bool)
        if len(bounds):
            tops = np.asarray(bounds, dtype=values.dtype)
            k = np.minimum(np.searchsorted(tops, values), last)
            part[some] = last - k[some]
            head[some] = (tops[k] == values)[some]
        return pd.DataFrame({"part": part.astype("int32"), "head": head})

    kind = docs.schema["doc_id"].dataType
    known = F.coalesce("doc_id", F.lit("" if kind.typeName() == "string" else 0).cast(kind))
    placed = core(docs, "doc_id", "text").withColumn(
        "_p", place(known, F.col("doc_id").isNotNull()))
    own = F.struct(F.col("_p.part").alias("part"), F.lit(True).alias("own"))
    copy = F.struct(F.when(F.col("_p.part") == 0, last).otherwise(F.col("_p.part") - 1)
                    .cast("int").alias("part"), F.lit(False).alias("own"))
    spread = placed.select("doc_id", "text", F.explode(
        F.when(F.col("_p.head"), F.array(own, copy)).otherwise(F.array(own))).alias("_at"))
    return (spread.select(F.col("_at.part").alias("_range"), F.col("_at.own").alias("_own"),
                          "doc_id", "text")
            .repartition(max(1, min(n, max(parts, n // 16))), "_range")
            .sortWithinPartitions("_range", F.col("_own").desc(), F.col("doc_id").desc_nulls_last(),
                                  F.xxhash64("text")))


def _row(doc_id, text: str, tree: Tree, after: str, after_tree: Tree) -> tuple:
    new = edited(text, after)
    new_tree = tree if new == text else Tree(new, tree, after_tree)
    return (doc_id, len(text),
            hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
            tree.encoded(), new_tree.encoded(), likeness(tree, new_tree), likeness(tree, after_tree))


COLUMNS = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with the likenesses to it and to the next.

    The next document is the one with the next smaller doc_id; the smallest is followed by the
    greatest, and rows without an id come last, in the order of their texts' hashes. A single
    document follows itself.
    """
    def told(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return record_batch(COLUMNS, [r[1:] for r in rows],
                            {"doc_id": pa.array([r[0] for r in rows], kind)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = first = kind = None  # held: (range, doc_id, text, tree) that waits for its follower
        for batch in batches:
            out = []
            kind = batch.schema.field("doc_id").type
            for part, own, doc_id, text in zip(*(batch.column(c).to_pylist() for c in (
                    "_range", "_own", "doc_id", "text"))):
                text = "" if text is None else text
                now = (part, doc_id, text, None) if held is None and not own else \
                    (part, doc_id, text, Tree(text))
                if held and held[0] == part:
                    out.append(_row(*held[1:], now[2], now[3]))
                elif held:
                    out.append(_row(*held[1:], first[2], first[3]))
                if own and (first is None or first[0] != part):
                    first = now
                held = now if own else None
            yield told(out, kind)
        if held:
            yield told([_row(*held[1:], first[2], first[3])], kind)

    return chained(docs).mapInArrow(run, f"doc_id {kind_of(docs, 'doc_id')}, {COLUMNS}")
