"""Near-duplicate groups by an inverted join over MinHash signature coordinates.

1. Documents with equal sets of word shingles form a class; only classes go on. A class's signature
   has ``COORDS`` coordinates, the minima of its shingles under as many hash functions.
2. Classes are posted under coordinate-value pairs. Two sets of the wanted similarity agree in at
   least ``T`` coordinates but for one case in ``1 / MISS``; so they share one of the first
   ``COORDS - T + 1`` pairs of each in any common order. The order is by frequency, rare pairs first,
   so the long posting lists are skipped: a class is posted under its rarest pairs only.
3. A posting list is led by the class whose pairs are the most frequent, the middle of its
   neighbourhood. A leader's lists merge into one group, cut into blocks of ``BLOCK`` members with
   the leader in each. A block first counts the collisions of its classes' whole signatures; only
   classes with ``T`` or more in some pair go on. Their texts are fetched, and the pairs confirmed on
   the full shingle sets, leaving out pairs that confirmed links already join.
4. In groups of several blocks, classes not joined to the leader are compared with all other blocks
   in the same way. All pairs of a posting list are thus decided, but no list is ever one task's and
   only links that join are emitted, at most one less than a block's members.
5. Components by the smallest label and pointer jumping, distributed, until nothing changes.

The frequency order uses one counter array of fixed size; it decides speed, not results.

Texts without words, and null texts, have empty sets and are linked with nothing. Documents with
fewer than five words have one shingle, the whole sequence. Rows without a doc_id may join groups but
give them no name: their component_id is null if nothing else is in the group. Rows that repeat an id
are handled each by its own text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import core, each, per_text
from tidewatch.sources.tables import staged

WORDS = 5  # words in a shingle
COORDS = 64
MISS = 1e-6  # chance that a pair at the very threshold has fewer equal coordinates
BLOCK = 500
COUNTERS = 1 << 16
ROWS_OUT = 5_000  # rows that a task gathers before it hands them on
_seeds = np.random.default_rng(11)
MULTIPLY = _seeds.integers(0, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _seeds.integers(0, 1 << 63, COORDS, dtype=np.uint64)
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                0x85EBCA77C2B2AE63], dtype=np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, kept for words met again; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, known: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's word runs; A-Z in lower case, ASCII white space."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(h))
    n = len(h) - width + 1
    total = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        total = (total ^ h[k:k + n]) * ODD[k % len(ODD)]
        total ^= total >> np.uint64(29)
    return np.unique(total)


def signature(found: np.ndarray) -> np.ndarray:
    """Minimum of every hash function over the shingles."""
    low = np.full(COORDS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(found), 2048):
        part = found[at:at + 2048]
        low = np.minimum(low, ((part[:, None] * MULTIPLY + ADD) >> np.uint64(32)).min(axis=0)
                         .astype(np.uint32))
    return low


def least_matches(similarity: float, miss: float = MISS) -> int:
    """The largest T with P(Binomial(COORDS, similarity) < T) <= miss."""
    below = 0.0
    for t in range(COORDS + 1):
        below += math.comb(COORDS, t) * similarity ** t * (1 - similarity) ** (COORDS - t)
        if below > miss:
            return t
    return COORDS


def signed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Every row's doc_id and text hash, set size, class (hash of the set; null if empty) and
    signature."""
    def build():
        known = WordHashes()

        def one(text: str) -> tuple:
            found = shingles(text, known, words)
            return (len(found), _name(found), signature(found).tobytes()) if len(found) else (
                0, None, None)
        return each(one)
    return per_text(core(docs, "doc_id", "text").withColumn("text_key", F.xxhash64("text")),
                    ["doc_id", "text_key"], "n_shingles long, class long, sig binary", build)


def _name(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def _slots(sigs: np.ndarray) -> np.ndarray:
    """A 64-bit token for every coordinate-value pair."""
    place = np.arange(sigs.shape[1], dtype=np.uint64) << np.uint64(32)
    return (sigs.astype(np.uint64) | place) * np.uint64(0x9E3779B97F4A7C15)


def frequencies(classes: DataFrame) -> np.ndarray:
    """How many classes hold a token, by hash into ``COUNTERS`` counters."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for pdf in batches:
            if len(pdf):
                sigs = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint32).reshape(-1, COORDS)
                total += np.bincount((_slots(sigs) >> np.uint64(48)).ravel().astype(np.int64),
                                     minlength=COUNTERS)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"slot": used, "n": total[used]})
    rows = (classes.select("sig").mapInPandas(run, "slot long, n long")
            .groupBy("slot").agg(F.sum("n").alias("n")).collect())  # COUNTERS rows at most
    total = np.zeros(COUNTERS, dtype=np.int64)
    for r in rows:
        total[r["slot"]] = r["n"]
    return total


def postings(classes: DataFrame, matches: int) -> DataFrame:
    """token, class and weight: every class under its rarest tokens, as many as the prefix needs."""
    often = frequencies(classes)
    prefix = COORDS - matches + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            sigs = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint32).reshape(-1, COORDS)
            tokens = _slots(sigs)
            counts = often[(tokens >> np.uint64(48)).astype(np.int64)]
            order = np.lexsort((tokens, counts))[:, :prefix]
            first = np.take_along_axis(tokens, order, axis=1)
            yield pd.DataFrame({"token": first.ravel().view(np.int64),
                                "class": np.repeat(pdf["class"].to_numpy(), prefix),
                                "weight": np.repeat(counts.sum(axis=1), prefix)})
    return classes.select("class", "sig").mapInPandas(run, "token long, class long, weight long")


def groups(posted: DataFrame) -> DataFrame:
    """leader and member: the lists of two or more classes, merged by their leaders."""
    leaders = (posted.groupBy("token")
               .agg(F.max(F.struct("weight", "class")).alias("top"), F.count("*").alias("n"))
               .where(F.col("n") > 1).select("token", F.col("top.class").alias("leader")))
    return (posted.join(leaders, "token")
            .select("leader", F.col("class").alias("member")).distinct())


def likely(sigs: np.ndarray, free: np.ndarray, matches: int) -> list[tuple[int, int]]:
    """Pairs with enough equal coordinates, one of them free; those with the most come first."""
    pairs, equal = [], []
    for a in range(len(sigs) - 1):
        agree = (sigs[a + 1:] == sigs[a]).sum(axis=1)
        for k in np.flatnonzero((agree >= matches) & (free[a + 1:] | free[a])):
            pairs.append((a, a + 1 + int(k)))
            equal.append(int(agree[k]))
    return [pairs[k] for k in np.argsort(-np.array(equal, dtype=int), kind="stable")]


class Block:
    """Classes of one task's group with their sets and signatures, and the links found."""

    def __init__(self, matches: int, similarity: float):
        self.matches, self.similarity = matches, similarity
        self.names: list[int] = []
        self.sets: list[np.ndarray] = []
        self.sigs: list[np.ndarray] = []
        self.parent: list[int] = []

    def add(self, name: int, found: np.ndarray) -> None:
        self.names.append(name)
        self.sets.append(found)
        self.sigs.append(signature(found))
        self.parent.append(len(self.parent))

    def top(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def linked(self, a: int, b: int) -> bool:
        """Confirms on the full sets."""
        x, y = self.sets[a], self.sets[b]
        if min(len(x), len(y)) < self.similarity * max(len(x), len(y)) - 1e-9:
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= self.similarity * (len(x) + len(y) - both) - 1e-9

    def join(self, free: np.ndarray) -> list[tuple[int, int]]:
        """Links that join something, likeliest pairs first; one class of each pair must be free."""
        found = []
        for a, b in likely(np.stack(self.sigs), free, self.matches):
            i, j = self.top(a), self.top(b)
            if i != j and self.linked(a, b):
                self.parent[max(i, j)] = min(i, j)
                found.append((self.names[a], self.names[b]))
        return found


def _blocks(batches: Iterator[pd.DataFrame], what: str) -> Iterator[tuple[int, int, dict]]:
    """Leader, block and members (class: [``what``, free]) of each block, from sorted rows."""
    last, members = None, {}
    for pdf in batches:
        for leader, block, name, value, free in zip(*(pdf[c] for c in (
                "leader", "block", "member", what, "free"))):
            if (leader, block) != last:
                if members:
                    yield *last, members
                last, members = (leader, block), {}
            # a class that is both in the free and in the other block is free
            members.setdefault(name, [value, False])[1] |= bool(free)
    if members:
        yield *last, members


def _by_block(rows: DataFrame, values: DataFrame) -> DataFrame:
    """The members with their values, each block's rows together in one task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.join(values, rows["member"] == values["class"]).drop("class")
            .repartition(n, "leader", "block").sortWithinPartitions("leader", "block"))


def screened(rows: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """The members of every block that have enough equal coordinates with another one.

    ``rows`` has leader, block, member and free; pairs of two members that are not free do not count.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for leader, block, members in _blocks(batches, "sig"):
            sigs = np.frombuffer(b"".join(v for v, _ in members.values()), np.uint32)
            free = np.array([f for _, f in members.values()])
            live = {k for pair in likely(sigs.reshape(-1, COORDS), free, matches) for k in pair}
            names = list(members)
            out += [(leader, block, names[k], free[k]) for k in sorted(live)]
            if len(out) > ROWS_OUT:
                yield pd.DataFrame(out, columns=["leader", "block", "member", "free"])
                out = []
        yield pd.DataFrame(out, columns=["leader", "block", "member", "free"])
    return (_by_block(rows, classes.select("class", "sig"))
            .mapInPandas(run, "leader long, block long, member long, free boolean"))


def compare(rows: DataFrame, texts: DataFrame, matches: int, similarity: float, words: int
            ) -> DataFrame:
    """Confirmed links of the screened rows, block by block: leader, a, b. A row (leader, class,
    null) is added for each member that a block's links join to its leader."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, out = WordHashes(), []
        for leader, _, members in _blocks(batches, "text"):
            block = Block(matches, similarity)
            for name, (text, _) in members.items():
                block.add(int(name), shingles(text, known, words))
            free = np.array([f for _, f in members.values()])
            out += [(leader, a, b) for a, b in block.join(free)]
            if leader in members:
                top = block.top(list(members).index(leader))
                out += [(leader, n, None) for k, n in enumerate(block.names) if block.top(k) == top]
            if len(out) > ROWS_OUT:
                yield pd.DataFrame(out, columns=["leader", "a", "b"], dtype=object)
                out = []
        yield pd.DataFrame(out, columns=["leader", "a", "b"], dtype=object)
    return _by_block(rows, texts).mapInPandas(run, "leader long, a long, b long")


def texts_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """class and text of the wanted classes: one document's text for each."""
    first = (wanted.distinct().join(classes, "class")
             .select("class", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")))
    source = core(docs, "doc_id", "text").withColumn("_own", F.xxhash64("text"))
    same = (F.col("_own") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return staged(source.join(first, same).select("class", "text"), "texts")


def links(docs: DataFrame, classes: DataFrame, members: DataFrame, matches: int, similarity: float,
          words: int) -> DataFrame:
    """Confirmed links that join the classes of every group: a, b."""
    sizes = members.groupBy("leader").agg(F.count("*").alias("n"))
    dealt = (members.join(sizes, "leader")
             .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long")))
    own = F.pmod(F.xxhash64("member"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    first = dealt.select("leader", "member", F.lit(True).alias("free"),
                         F.explode(F.when(F.col("leader") == F.col("member"), every)
                                   .otherwise(F.array(own))).alias("block"))
    live = staged(screened(first, classes, matches), "live")
    large = dealt.where(F.col("blocks") > 1)
    texts = texts_of(docs, classes, live.select(F.col("member").alias("class")).union(
        large.select("member")))
    found = staged(compare(live, texts, matches, similarity, words), "block-links")
    joined = found.where(F.col("b").isNull()).select("leader", F.col("a").alias("member"))
    # what its leader did not join meets all blocks of the group: one row per block of either side
    apart = large.join(joined, ["leader", "member"], "left_anti").select("leader", "member")
    loose = apart.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("loose"))
    wide = large.join(loose, "leader")
    cell = F.col("x") * F.col("blocks") + F.col("y")
    others = wide.select("leader", "member", "blocks", own.alias("y"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("loose") - 1)).alias("x")).select(
        "leader", "member", F.lit(False).alias("free"), cell.alias("block"))
    free = (apart.join(wide, ["leader", "member"])
            .select("leader", "member", "blocks",
                    F.pmod(F.xxhash64(F.lit(3), "member"), F.col("loose")).alias("x"),
                    F.explode(every).alias("y"))
            .select("leader", "member", F.lit(True).alias("free"), cell.alias("block")))
    second = compare(screened(free.unionByName(others), classes, matches), texts, matches,
                     similarity, words)
    return found.unionByName(second).where(F.col("b").isNotNull()).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node with a link.

    Each round takes the smallest root among the neighbours and then the root's own root, so that
    distances halve; labels are written to the shared folder after each round.
    """
    edges = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = staged(edges.select(F.col("a").alias("node")).distinct()
                    .withColumn("root", F.col("node")), "labels")
    while True:
        near = (edges.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low")))
        step = staged(labels.join(near, "node").select(
            "node", F.least("root", "low").alias("root"), F.col("root").alias("was")), "step")
        tops = step.select(F.col("node").alias("root"), F.col("root").alias("over"))
        labels = staged(step.join(tops, "root").select(
            "node", F.col("over").alias("root"), "was"), "labels")
        if labels.where(F.col("root") != F.col("was")).isEmpty():
            return labels.select("node", "root")
        labels = labels.drop("was")


def decided(docs: DataFrame, similarity: float, words: int) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, component_id and kept of every row."""
    matches = least_matches(similarity)
    rows = staged(signed(docs, words), "signed")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "sig")
    classes = staged(rows.where(F.col("class").isNotNull()).groupBy("class")
                     .agg(F.min(best).alias("m"))
                     .select("class", "m.doc_id", "m.text_key", "m.sig"), "classes")
    members = staged(groups(postings(classes, matches)), "groups")
    roots = components(links(docs, classes, members, matches, similarity, words))
    named = (classes.select("class", "doc_id").join(roots, F.col("class") == F.col("node"), "left")
             .select("class", "doc_id", F.coalesce("root", "class").alias("root")))
    names = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    groups_of = named.join(names, "root").select("class", "component_id")
    full = rows.where(F.col("class").isNotNull()).join(groups_of, "class").select(
        "doc_id", "text_key", "n_shingles", "component_id")
    empty = rows.where(F.col("class").isNull()).select(
        "doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the group) and kept of every row."""
    return decided(docs, similarity, words).drop("text_key")


def keep_one(docs: DataFrame, similarity: float = 0.8, words: int = WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, without those that are not their group's first document.

    Rows that repeat an id and its text are one document: they stay or go together. So do rows
    without an id, which go only if their group has an id.
    """
    gone = decided(docs, similarity, words).where(~F.col("kept")).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"])
                     & (F.xxhash64(docs["text"]) == gone["_key"]), "left_anti")
