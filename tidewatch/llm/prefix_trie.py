"""Prefix trie of conversations, rolled up in depth bands.

Every conversation starts with the first h turns of another one (see ``rebuilt``). A distinct
sequence of first turns is a node. A prefix is named by a hash: the digests of its turns, each taken
with its place, are summed, so prefix hashes are prefix sums, and a conversation of any length spans
many tasks. Nodes are groups of equal prefixes, counted before the shuffle.

Sums over subtrees: a node passes its figures only to its ancestors inside its band of ``height``
levels, a list of at most ``height`` names. Nodes at the top of a band then hold their band's sum;
they form a tree that is ``height`` times as shallow and is rolled up in the same way, and the
completed totals of band tops go to their ancestors in the band above. So rounds grow with the
logarithm of the depth, and no row is copied more than ``height`` times.

Turns are ordered by turn (null first), ties by the digest of role and text; null role or text
counts as empty. Rows without a conv_id belong to no conversation and are left out. Rows that repeat
are turns of their own. A table without conversations has no nodes. Texts are hashed and counted
where they are read. Columns beyond the four named are not looked at.

The hash of a node's ends is sequential by nature: ids are packed into blocks in range-sorted
pieces; a node that lies inside a piece is hashed there, and the blocks of one that reaches over
pieces are streamed through one hash in order, a block at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import core, join_by_size
from tidewatch.llm.mixing import prefix_sums
from tidewatch.sources.tables import staged

HEIGHT = 16
BLOCK = 1 << 20  # bytes of packed ids
PARTS = ["p1", "p2", "p3", "p4"]  # a turn's digest as four 32-bit numbers; sums of 2 ** 31 fit a long
SUMS = {p: f"s{p[1]}" for p in PARTS}
NO_ENDS = hashlib.sha256(b"").hexdigest()


def digest(role: Column, text: Column) -> Column:
    """Names a turn; the role's length keeps role and text apart."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest and number of words of every original turn."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = core(conversations, "conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest(role, text).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    return prefix_sums(rows.withColumn("one", F.lit(1)), ["conv_id"], ["turn", "digest"],
                       {"one": "pos"}).drop("one", "turn")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), digest, words of every rebuilt turn, and a row of depth 0 without a
    digest for each conversation; ``last`` marks where a conversation ends.

    Conversation c takes the first h turns of c - c % 20 (all, if fewer), h = crc32(c) % 4, and then
    its own turns after its first h. No turn is lent to more than 39 conversations.
    """
    rows = staged(turns(conversations), "turns")
    c = F.col("conv_id")
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("own")).select(
        "conv_id", "own", (c - c % 20).alias("base"),
        (F.crc32(c.cast("string").cast("binary")) % 4).alias("h"))
    heads = rows.where(F.col("pos") < 3).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("heads"))
    lent = F.coalesce(F.slice("heads", 1, F.col("h").cast("int")), F.array())
    plans = (convs.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
             .select("conv_id", "h", "own", lent.alias("lent"))
             .withColumn("length", F.size("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    plans = staged(plans, "plans")
    zero, empty = F.lit(0).cast("long"), F.lit(None).cast("string")
    root = F.struct(zero.alias("depth"), empty.alias("digest"), zero.alias("words"))
    front = plans.select("conv_id", "length", F.inline(F.concat(
        F.array(root), F.transform("lent", lambda t: F.struct(
            (t["pos"] + 1).alias("depth"), t["digest"].alias("digest"), t["words"].alias("words"))))))
    # the plan is one row per conversation; a long conversation's turns meet it where they lie
    own = join_by_size(rows, plans.withColumnRenamed("own", "n"), "conv_id", "n").where(
        F.col("pos") >= F.col("h")).select(
            "conv_id", "length", (F.size("lent") + F.col("pos") - F.col("h") + 1).alias("depth"),
            "digest", "words")
    both = front.unionByName(own)
    return both.select("conv_id", F.col("depth").cast("long").alias("depth"), "digest", "words",
                       (F.col("depth") == F.col("length")).alias("last"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, words, last, and the names ``node`` and ``parent`` of the prefixes that end at
    a turn and before it."""
    at = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "digest").cast("binary"), 256)
    hexes = [F.conv(F.substring("at", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = (turns.withColumn("at", at)
            .withColumns({p: F.when(F.col("depth") == 0, 0).otherwise(h) for p, h in zip(PARTS, hexes)})
            .drop("at", "digest"))

    def name(depth: Column, sums: list[Column]) -> Column:
        return F.md5(F.concat_ws(":", depth.cast("string"), *[s.cast("string") for s in sums]).cast("binary"))

    summed = prefix_sums(rows, ["conv_id"], ["depth"], SUMS)
    return summed.select(
        "conv_id", "depth", "words", "last",
        name(F.col("depth"), [F.col(s) + F.col(p) for p, s in SUMS.items()]).alias("node"),
        F.when(F.col("depth") > 0, name(F.col("depth") - 1, [F.col(s) for s in SUMS.values()]))
        .alias("parent"))


def chains(paths: DataFrame, step: int, height: int) -> DataFrame:
    """For every node whose depth is a multiple of ``step``, the names from the top of its band down
    to itself; a band's lowest nodes are the tops of the next. depth counts in steps."""
    at = (F.col("depth") / step).cast("long")
    rows = paths.where(F.col("depth") % step == 0).select("conv_id", "node", at.alias("depth"))
    top = (F.col("depth") % height == 0)
    band = F.ceil(F.col("depth") / height).cast("long") - 1
    placed = rows.withColumn("band", F.explode(F.when(top, F.array(band, band + 1)).otherwise(F.array(band))))
    one_band = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (placed.withColumn("chain", F.collect_list("node").over(one_band))
            .where(F.col("band") == band)  # not the copies that only open the next band
            .groupBy("node").agg(F.first("depth").alias("depth"), F.first("chain").alias("chain")))


def subtree_sums(paths: DataFrame, values: DataFrame, names: list[str], deepest: int,
                 height: int = HEIGHT, step: int = 1) -> DataFrame:
    """Sums of the ``names`` columns of ``values`` (one row per node) over the subtree of every node
    whose depth is a multiple of ``step``: node and the sums."""
    linked = staged(chains(paths, step, height).join(values, "node"), "chains")
    sums = [F.sum(n).alias(n) for n in names]
    if deepest // step <= height:  # one band holds the whole tree
        return (linked.select(F.explode("chain").alias("node"), *names).groupBy("node").agg(*sums))
    is_top = F.col("depth") % height == 0
    up = F.when(is_top, F.array("node")).otherwise(F.col("chain"))
    inside = staged(linked.select(F.explode(up).alias("node"), *names).groupBy("node").agg(*sums), "bands")
    tops = linked.where(is_top).select("node", "depth", "chain")
    done = staged(subtree_sums(paths, inside.join(tops.select("node"), "node"), names, deepest, height,
                               step * height), "tops")
    below = (done.join(tops.where(F.col("depth") > 0), "node")
             .select(F.explode(F.slice("chain", 2, F.size("chain") - 2)).alias("node"), *names)
             .groupBy("node").agg(*sums))
    rest = inside.join(tops.select("node"), "node", "left_anti")
    both = rest.unionByName(below).groupBy("node").agg(*sums)
    return both.unionByName(done)


def ends_hashes(ends: DataFrame, block: int = BLOCK) -> DataFrame:
    """node and ends_sha256, the hash of the comma-joined ascending ids, of rows (node, conv_id)."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a node's ids; the first and the last node of a piece may reach into others."""
        def out(node, piece, seq, data, whole):
            return pa.RecordBatch.from_pydict({
                "node": [node], "piece": pa.array([piece], pa.int32()), "seq": pa.array([seq], pa.int64()),
                "ids": pa.array([data], pa.binary()), "whole": [whole]})

        node, piece, seq, held, size, first = None, 0, 0, [], 0, True
        for batch in batches:
            pieces = batch.column("piece").to_pylist()
            for name, conv, k in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), pieces):
                if name != node:
                    if node is not None:
                        yield out(node, piece, seq, ",".join(held).encode(), not first and seq == 0)
                        first = False
                    node, piece, seq, held, size = name, k, 0, [], 0
                elif size >= block:
                    yield out(node, piece, seq, ",".join(held).encode(), False)
                    seq, held, size = seq + 1, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
        if node is not None:
            yield out(node, piece, seq, ",".join(held).encode(), False)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(node, sha):
            return pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [sha.hexdigest()]})

        node, sha = None, None
        for batch in batches:
            for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids")):
                if name == node:
                    sha.update(b",")
                else:
                    if node is not None:
                        yield out(node, sha)
                    node, sha = name, hashlib.sha256()
                sha.update(ids.as_py())
        if node is not None:
            yield out(node, sha)

    ranged = (ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
              .withColumn("piece", F.spark_partition_id()))
    blocks = staged(ranged.mapInArrow(packed, "node string, piece int, seq long, ids binary, whole boolean"),
                    "ends")
    inside = blocks.where("whole").select("node", F.sha2("ids", 256).alias("ends_sha256"))
    across = (blocks.where("not whole").select("node", "piece", "seq", "ids").repartition("node")
              .sortWithinPartitions("node", "piece", "seq").select("node", "ids")
              .mapInArrow(streamed, "node string, ends_sha256 string"))
    return inside.unionByName(across)


def prefix_trie(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256, all numbers long."""
    paths = staged(prefixes(rebuilt(conversations)), "paths")
    nodes = paths.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"),
        F.first("words").alias("words"), F.count("*").alias("n_convs"))
    nodes = staged(nodes, "nodes")
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(
        F.count("*").alias("n_children"))
    nodes = staged(nodes.join(children, "node", "left").fillna(0, ["n_children"]), "nodes")
    values = nodes.select("node", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
                          ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    deepest = paths.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(paths, values, ["n_leaves", "saved_tokens"], deepest, height)
    ends = ends_hashes(paths.where("last").select("node", "conv_id"))
    above = nodes.where(F.col("n_children") > 0).select(
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    return (join_by_size(nodes.withColumnRenamed("n_children", "n"), above, "parent", "n_children")
            .withColumnRenamed("n", "n_children")
            .join(sums, "node").join(ends, "node", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))


CRC32 = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(
      range(1, length({0}) + 1), lambda i: [ascii({0}[i]), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""

SQL = rf"""
WITH told AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos FROM told),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC32.format("(conv_id::VARCHAR)")} % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
lent AS (
  SELECT c.conv_id, t.pos + 1 AS depth, t.digest, t.words
  FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos < c.h),
rebuilt AS (
  SELECT * FROM lent
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + 1 + (SELECT count(*) FROM lent WHERE lent.conv_id = c.conv_id) AS depth, t.digest, t.words
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h
  UNION ALL
  SELECT conv_id, 0, '', 0 FROM convs),
paths AS (
  SELECT conv_id, depth, words, string_agg(digest, ',') OVER upto AS node,
         CASE WHEN depth > 0 THEN string_agg(digest, ',') OVER before END AS parent,
         depth = max(depth) OVER (PARTITION BY conv_id) AS last
  FROM rebuilt
  WINDOW upto AS (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         before AS (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
grouped AS (
  SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(words) AS words,
         count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM paths GROUP BY node, depth),
nodes AS (
  SELECT *, (SELECT count(*) FROM grouped k WHERE k.parent = g.node AND k.depth = g.depth + 1) AS n_children,
         (SELECT p.conv_id FROM grouped p WHERE p.node = g.parent AND p.depth = g.depth - 1) AS parent_conv_id
  FROM grouped g),
sums AS (
  SELECT a.node, a.depth, sum(CASE WHEN n.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves,
         sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens
  FROM nodes n JOIN paths a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.node, a.depth)
SELECT n.conv_id, n.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM nodes n JOIN sums s ON n.node = s.node AND n.depth = s.depth
"""
