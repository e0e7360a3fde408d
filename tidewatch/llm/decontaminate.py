"""Benchmark decontamination by the q-gram lemma.

A place in a text that matches a benchmark item of m characters within k edits shares at least
``m - q + 1 - k * q`` of the item's q-grams, all on diagonals (place in text minus place in item) at
most k apart. Shared q-grams are counted in overlapping diagonal bands; bands that reach the bound
give regions, which a banded alignment verifies: the item must match there within k edits.

Both sides are compared as letters and digits in lower case, with one space for each run of anything
else, so that case, punctuation and white space hide nothing; places are those of the original text.
k is ``edit_rate`` of the item's length, but
never so much that the bound falls under one q-gram. Items of fewer than ``SHORT`` characters must
match without an edit and as whole words: by the same bands with k = 0, or, if they are shorter than
a q-gram, by their words. ``min_chars`` leaves shorter items out, for filters that one common word
should not empty; without it none is left out but items without a letter or digit.

Nulls count as empty texts, and texts and items without a match give no row. Repeated rows give
a row each. Of an item's overlapping matches in a text, the one with the fewest edits counts. An
empty table on either side gives no rows, and a filter keeps all. A very long text is looked up part
by part, each part's q-grams with those that reach into the next. Columns beyond ids and texts are
not looked at.

The benchmark is split into blocks of bounded size by the hash of the item; each block's q-gram index
is built on the driver, sent with the tasks, and meets every document in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.llm.common import code_points, core, kind_of, record_batch, small_batches

Q = 8  # characters in a q-gram
EDIT_RATE = 0.08
SHORT = 50
FILTER_CHARS = 20  # what a filter looks for at least
BLOCK_CHARS = 4_000_000  # characters of benchmark text in one index
PART = 1 << 16  # characters of a text looked up at once
FACTOR = np.uint32(0x9E3779B1)
TABLE_BITS = 20
# characters beyond the first 65,536 count as letters
WORD = np.array([chr(k).isalnum() for k in range(0xFFFF)] + [True])


def plain(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points that are compared, and the place of each in the text."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals grow in lower case; keep the places
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    codes = code_points(low)
    word = WORD[np.minimum(codes, len(WORD) - 1)]
    after_word = np.append(False, word[:-1])
    place = np.flatnonzero(word | after_word)
    return np.where(word, codes, np.uint32(32))[place], place


def grams(codes: np.ndarray) -> np.ndarray:
    """Hash of the q-gram at every place; doubling makes runs of 2, 4 and 8 characters."""
    h = codes.astype(np.uint32, copy=False)
    width = 1
    while width < Q:
        if len(h) <= width:
            return np.zeros(0, np.uint32)
        mixed = h[:-width] * FACTOR
        mixed += h[width:]
        mixed ^= mixed >> np.uint32(15)
        h = mixed
        width *= 2
    return h * FACTOR


def budget(length: int, edit_rate: float = EDIT_RATE) -> int:
    return 0 if length < SHORT else max(0, min(int(length * edit_rate), (length - Q) // Q))


def align(item: np.ndarray, text: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """Fewest edits, start and end of a match of the whole item inside ``text``; None if over k.

    A match without edits is looked for first. Otherwise
    The item's rows are computed one after the other, each whole row at once: deletions from the text
    along the row are a running minimum of cost minus place. ``text`` is a region of item length
    plus the band's width, so every row is the band.
    """
    n = len(text)
    at = text.tobytes().find(item.tobytes())
    if at >= 0 and at % item.itemsize == 0:
        return 0, at // item.itemsize, at // item.itemsize + len(item)
    place = np.arange(n + 1)
    cost = np.zeros(n + 1, dtype=np.int64)
    start = place.copy()
    for c in item:
        step = cost[:-1] + (text != c)
        up = cost + 1
        new, begin = up.copy(), start.copy()
        better = step < new[1:]
        new[1:][better] = step[better]
        begin[1:][better] = start[:-1][better]
        lead = new - place
        low = np.minimum.accumulate(lead)
        source = np.maximum.accumulate(np.where(lead == low, place, 0))
        cost, start = low + place, begin[source]
    end = int(cost.argmin())
    edits = int(cost[end])
    return (edits, int(start[end]), end) if edits <= k else None


@dataclass
class Index:
    """Q-grams of a block of items: sorted hashes with the item and place of each."""

    names: list
    items: list[np.ndarray]
    budgets: np.ndarray
    need: np.ndarray  # q-grams that a match shares at least
    hashes: np.ndarray  # distinct, sorted
    starts: np.ndarray  # where the entries of each hash begin
    owner: np.ndarray
    place: np.ndarray
    table: np.ndarray  # which hash prefixes occur at all
    words: dict[tuple[str, ...], list]  # items shorter than a q-gram, by their words

    def matches(self, text: str) -> list[tuple]:
        """Item, start, end and edits of every match, overlapping ones of an item reduced to one."""
        if not (self.names or self.words):
            return []
        codes, origin = plain(text)
        found = [*self._by_words(codes), *self._by_grams(codes)]
        return [(name, int(origin[a]), int(origin[b - 1]) + 1, n)
                for name, a, b, n in sorted(found, key=lambda r: (r[1], str(r[0])))]

    def _by_words(self, codes: np.ndarray) -> Iterator[tuple]:
        if not self.words:
            return
        edges = np.diff(np.concatenate([[0], (codes != 32).astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()
        tokens = [codes[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(starts, ends)]
        for n in sorted({len(w) for w in self.words}):
            done: dict = {}  # where the last match of an item ended
            for k, run in enumerate(zip(*[tokens[j:] for j in range(n)])):
                for name in self.words.get(run, ()):
                    if done.get(name, 0) <= starts[k]:
                        done[name] = ends[k + n - 1]
                        yield name, starts[k], done[name], 0

    def _by_grams(self, codes: np.ndarray) -> list[tuple]:
        if not self.names or len(codes) < Q:
            return []
        where, gram = [], []
        for at in range(0, len(codes) - Q + 1, PART):
            h = grams(codes[at:at + PART + Q - 1])
            hit = np.flatnonzero(self.table[h >> np.uint32(32 - TABLE_BITS)])
            if len(hit):
                where.append(hit + at)
                gram.append(h[hit])
        if not where:
            return []
        where, gram = np.concatenate(where), np.concatenate(gram)
        at = np.minimum(np.searchsorted(self.hashes, gram), len(self.hashes) - 1)
        real = self.hashes[at] == gram
        at, where = at[real], where[real]
        count = self.starts[at + 1] - self.starts[at]
        entry = np.repeat(self.starts[at] - np.cumsum(count) + count, count) + np.arange(count.sum())
        return self._regions(codes, self.owner[entry], self.place[entry],
                             np.repeat(where, count) - self.place[entry])

    def _regions(self, codes, owner, place, diagonal) -> list[tuple]:
        """Bands of 2k + 2 diagonals, each sharing half with the next, so that any k + 1 neighbours
        are inside one. A band's hits are counted first; where they reach the bound, the distinct
        places in the item are counted, since a q-gram that the text repeats counts once."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        band = np.floor_divide(diagonal, self.budgets[owner] + 1) + (1 << 31)
        key = (owner << 32) | band
        keys, counts = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        for b in keys[counts >= self.need[keys >> 32]].tolist():
            item = b >> 32
            if len(np.unique(place[(key == b) | (key == b + 1)])) < self.need[item]:
                continue
            k = int(self.budgets[item])
            first = ((b & 0xFFFFFFFF) - (1 << 31)) * (k + 1)  # the band's lowest diagonal
            a = max(0, first - k)
            z = min(len(codes), first + 2 * (k + 1) + len(self.items[item]) + k)
            m = align(self.items[item], codes[a:z], k)
            if m and (len(self.items[item]) >= SHORT or whole(codes, a + m[1], a + m[2])):
                found.setdefault(item, []).append((m[0], a + m[1], a + m[2]))
        out = []
        for item, hits in found.items():
            taken: list[tuple[int, int, int]] = []
            for h in sorted(set(hits)):
                if all(h[2] <= t[1] or h[1] >= t[2] for t in taken):
                    taken.append(h)
            out += [(self.names[item], s, e, n) for n, s, e in taken]
        return out


def whole(codes: np.ndarray, start: int, end: int) -> bool:
    """Does the stretch begin and end with words?"""
    return (start == 0 or codes[start - 1] == 32) and (end == len(codes) or codes[end] == 32)


def build(rows: list[tuple], edit_rate: float = EDIT_RATE, min_chars: int = 1) -> Index:
    names, items = [], []
    words: dict[tuple[str, ...], list] = {}
    for name, text in rows:
        codes = plain(text.strip())[0] if text is not None else ()
        if len(codes) and codes[-1] == 32:
            codes = codes[:-1]
        if len(codes) < max(min_chars, 1):
            continue
        if len(codes) < Q:
            short = codes.tobytes().decode("utf-32-le", "surrogatepass")
            words.setdefault(tuple(short.split(" ")), []).append(name)
        else:
            names.append(name)
            items.append(codes)
    hashes = [grams(i) for i in items]
    owner = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
    place = np.concatenate([np.arange(len(h)) for h in hashes]) if items else np.zeros(0, int)
    flat = np.concatenate(hashes) if items else np.zeros(0, np.uint32)
    order = np.argsort(flat, kind="stable")
    table = np.zeros(1 << TABLE_BITS, dtype=bool)
    table[flat >> np.uint32(32 - TABLE_BITS)] = True
    distinct = np.unique(flat)
    starts = np.append(np.searchsorted(flat[order], distinct), len(flat))
    budgets = np.array([budget(len(i), edit_rate) for i in items], dtype=np.int64)
    need = np.array([len(i) - Q + 1 for i in items], dtype=np.int64) - budgets * Q
    return Index(names, items, budgets, need, distinct, starts, owner[order].astype(np.int64),
                 place[order].astype(np.int64), table, words)


def indexes(benchmark: DataFrame, edit_rate: float = EDIT_RATE, min_chars: int = 1,
            block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """One index after the other, each of about ``block_chars`` characters of items.

    Rows of the benchmark without an id or text are left out; of repeated rows one counts.
    """
    items = (core(benchmark, "item_id", "text").where(F.col("text").isNotNull())
             .where(F.col("item_id").isNotNull()).distinct())
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        yield build(sorted(map(tuple, items.where(number == k).collect()), key=str), edit_rate,
                    min_chars)


def contaminated(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE,
                 min_chars: int = 1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, start, end, edits and similarity of every benchmark passage in the texts."""
    kind, own = kind_of(benchmark, "item_id"), kind_of(docs, "doc_id")
    item_kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    rest = "start long, end long, edits long, similarity double"
    found = None
    for index in indexes(benchmark, edit_rate, min_chars, block_chars):
        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
                out = [(k, *m, 1 - m[3] / max(1, m[2] - m[1]))
                       for k, t in enumerate(texts) if t for m in index.matches(t)]
                yield record_batch(rest, [r[2:] for r in out], {
                    "doc_id": ids.take(pa.array([r[0] for r in out], pa.int64())),
                    "item_id": pa.array([r[1] for r in out], item_kind)})
        rows = core(docs, "doc_id", "text").mapInArrow(run, f"doc_id {own}, item_id {kind}, {rest}")
        found = rows if found is None else found.unionByName(rows)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE,
               min_chars: int = FILTER_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark passage; no shuffle."""
    def clean(index: Index):
        @F.pandas_udf("boolean")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([not (t and index.matches(t)) for t in texts], dtype=bool)
        return run

    small_batches(docs)
    for index in indexes(benchmark, edit_rate, min_chars, block_chars):
        docs = docs.where(clean(index)(docs["text"]))
    return docs
