"""Token ids of all documents in length-delimited binary records, with a separate offset index.

A record file is a run of frames: the payload's length (8 bytes), a masked checksum of those bytes
(4), the payload, a masked checksum of it (4) and the end mark 0x0A. Numbers are little-endian, a
checksum is a CRC-32 turned right by 15 bits plus a constant, so that data which holds checksums of
itself does not pass by chance. The payload is one document: 1 if it has an id, the id (8 bytes), the
bytes per token id (2 where all fit, else 4), the token ids.

Documents are range-partitioned and sorted by id; every task cuts its range into shards of about
``shard_bytes`` and Spark's committer writes them, one file each, so a lost executor leaves no half
a file and any file system that Spark knows will do. The index is made from the written files by
reading their frames; it has shard, offset and length of each record, which is all that is needed to
fetch records in another order, shard by shard (``fetch``). A shard and the largest document bound
what a task holds.

Null texts are encoded as empty ones, null ids come first, rows that share an id are sorted by the
hash of their text. An empty table gives an empty index. Texts of any length are encoded whole, word
by piece: no rule of the tokenizer crosses white space, so pieces of words are looked up in a bounded
memory of those met before, in this task or an earlier one of its Python worker. Columns beyond id and text are not looked at.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import core
from tidewatch.llm.mixing import prefix_sums
from tidewatch.session import fresh_path

END_OF_TEXT = 2
SHARD_BYTES = 32 << 20
END = b"\n"
HEAD, TAIL, DOC = "<QI", "<I", "<BqB"
HEAD_SIZE, TAIL_SIZE, DOC_SIZE = map(struct.calcsize, (HEAD, TAIL, DOC))
# texts are cut as UTF-8 bytes; kinds of these
SPACE, LETTER, DIGIT, SIGN = range(4)
KIND = np.full(256, SIGN, np.uint8)
KIND[[*range(9, 14), 32]] = SPACE
KIND[[*range(97, 123), *range(128, 256)]] = LETTER
KIND[48:58] = DIGIT
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# "odd" is what the tokenizer's rules are not told of here: all but visible ASCII, white space and Latin letters
# whose lower case is one letter; and what may begin a special token. By two bytes.
ODD = np.zeros((256, 256), bool)
ODD[[*range(9), *range(14, 32), 127, 0xC2, *range(0xC6, 256)]] = True
ODD[[0xC3, 0xC3, 0xC4, 0xC5, 60], [0x97, 0xB7, 0xB0, 0x89, 124]] = True
ODD = ODD.ravel()
PLAIN = re.compile("[\n\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f]*")
# after an apostrophe that begins a run of signs
CLIPPED = {letter: 2 for letter in b"stmd"} | {pair: 3 for pair in (b"re", b"ve", b"ll")}
# the letters by which a byte-level model knows the bytes
SIGNS = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = dict(zip([b for b in range(256) if b not in SIGNS], map(chr, range(256, 512))))
KNOWN_WORDS = 400_000  # entries of a memory
GROUP_CHARS = 1 << 21  # of texts that are encoded at once
INDEX = "shard string, seq long, offset long, length long, doc_id long, n_tokens long, ids_crc32 long"


# ---- frames ----

def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17 & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack(TAIL, masked(length)), payload, struct.pack(TAIL, masked(payload)), END))


def frames(data: bytes, where: str = "") -> Iterator[tuple[int, bytes]]:
    """Offset and payload of every record; a damaged one raises ValueError."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if len(data) - at < HEAD_SIZE:
            raise ValueError(f"record cut short at {where}:{at}")
        length, check = struct.unpack_from(HEAD, data, at)
        start = at + HEAD_SIZE
        if check != masked(bytes(view[at:at + 8])):
            raise ValueError(f"damaged length at {where}:{at}")
        payload, end = bytes(view[start:start + length]), start + length
        if len(data) < end + TAIL_SIZE + len(END):
            raise ValueError(f"record cut short at {where}:{at}")
        if struct.unpack_from(TAIL, data, end)[0] != masked(payload) or view[end + TAIL_SIZE:end + TAIL_SIZE + 1] != END:
            raise ValueError(f"damaged record at {where}:{at}")
        yield at, payload
        at = end + TAIL_SIZE + len(END)


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return struct.pack(DOC, doc_id is not None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    known, doc_id, width = struct.unpack_from(DOC, payload)
    return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", offset=DOC_SIZE)


# ---- tokens ----

def cut_pieces(blob: bytes) -> tuple[np.ndarray, pa.Array]:
    """The tokenizer's pieces of a text that ends in three line ends: where they start, and themselves
    with ASCII letters in lower case. A word with anything odd in it is one piece, as it is."""
    raw = np.frombuffer(blob, np.uint8)
    low = LOWER[raw]
    kind = KIND[low]
    cut = kind == DIGIT
    cut[0] = True
    cut[1:] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(low == 39)
    at = at[cut[at]]
    for ends, size in CLIPPED.items():
        one = isinstance(ends, int)
        hit = low[at + 1] == (ends if one else ends[0])
        hit = at[hit if one else hit & (low[at + 2] == ends[1])]
        cut[hit + 1], cut[hit + size] = False, True
    odd = np.flatnonzero(ODD[raw[:-1].astype(np.uint16) << 8 | raw[1:]])
    word = kind != SPACE
    if len(odd):
        begins = np.flatnonzero(cut & word & np.concatenate(([True], ~word[:-1])))
        spaces = np.flatnonzero(cut & ~word)
        begins = begins[np.unique(np.searchsorted(begins, odd, "right") - 1)]
        edges = np.zeros(len(raw), np.int8)
        edges[begins] += 1
        edges[spaces[np.searchsorted(spaces, begins)]] -= 1
        inside = np.cumsum(edges, dtype=np.int8).astype(bool)
        cut &= ~inside
        cut[begins] = True
        low = np.where(inside, raw, low)
    starts = np.flatnonzero(cut & word)
    letters = low[word]
    offsets = np.append((np.cumsum(word) - 1)[starts], len(letters))
    return starts, pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters))


class Memory:
    """Ids of pieces met before, in two halves: a full newer half becomes the older one, and what was
    not met again by then is forgotten."""

    def __init__(self) -> None:
        self.newer: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.older: dict[str, bytes] = {}

    def missing(self, words: list[str]) -> list[str]:
        """Those of some distinct pieces that are not known; all others are in the newer half then."""
        new = [w for w in words if w not in self.newer]
        if len(self.newer) + len(new) > KNOWN_WORDS // 2:
            self.older, self.newer = self.newer, {}
            new = words
        self.newer.update((w, self.older[w]) for w in new if w in self.older)
        return [w for w in new if w not in self.older]


def encoder(definition: str, end: int | None) -> Callable[[list[str]], list[np.ndarray]]:
    """A function of texts to token ids. ``definition`` is the tokenizer's own JSON text.

    Equal to encoding each text at once: this kind of tokenizer has no token over white space, and
    takes words in lower case apart at the edges of letters, digits and signs. Texts are cut into such
    pieces, whose distinct ones Arrow numbers; those met before are looked up and the model encodes the
    others. Odd words are left whole and encoded many at a time, and tokens go to where their offset lies.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is one
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_str(definition)
    model = tokenizer.model
    known = Memory()

    def learn_odd(words: list[str]) -> None:
        for k in range(0, len(words), 1000):
            part = words[k:k + 1000]
            starts = np.cumsum([0, *(len(w) + 1 for w in part)])
            got = tokenizer.encode("\n".join(part), add_special_tokens=False)
            at = np.array([a for a, _ in got.offsets], dtype=np.int64)
            ids = np.array(got.ids, dtype="<u4").tobytes()
            cuts = (4 * np.searchsorted(at, starts)).tolist()
            for w, a, b in zip(part, cuts, cuts[1:]):
                known.newer[w] = ids[a:b]

    def learn(new: list[str]) -> None:
        if not (PLAIN.fullmatch(lines := "\n".join(new)) and "<|" not in lines):
            odd = {p for p in new if not PLAIN.fullmatch(p) or "<|" in p}
            learn_odd(list(odd))
            new = [p for p in new if p not in odd]
        for p in new:  # the model takes bytes as letters; those of ASCII stand for themselves
            seen = p if p.isascii() else p.lower().encode().decode("latin-1").translate(LETTERS)
            known.newer[p] = array("I", [t.id for t in model.tokenize(seen)]).tobytes()

    def encode(texts: list[str]) -> list[np.ndarray]:
        data = [text.encode() for text in texts]
        starts, parts = cut_pieces(b"\n".join([*data, b"\n\n\n"]))
        numbered = parts.dictionary_encode()
        pieces = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
        learn(known.missing(pieces))
        found = list(map(known.newer.__getitem__, pieces))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        places, order = np.cumsum(sizes) - sizes, numbered.indices.to_numpy()
        counts = sizes[order]
        stops = np.cumsum(counts)
        # a piece's ids lie together in the table of distinct pieces
        shift = np.repeat(places[order] - stops + counts, counts)
        ids = np.frombuffer(b"".join(found), dtype="<u4")[shift + np.arange(len(shift))]
        borders = np.cumsum([0, *(len(text) + 1 for text in data)])
        cuts = np.concatenate(([0], stops))[np.searchsorted(starts, borders)]
        if end is not None:
            ids, cuts = np.insert(ids, cuts[1:], end), cuts + np.arange(len(cuts))
        return [ids[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]

    return encode


def grouped(texts: Iterable[str], chars: int = GROUP_CHARS) -> Iterator[list[str]]:
    """Texts in lists of about so many characters, whose new words are learned together."""
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some


# ---- writing ----

def write_records(docs: DataFrame, path: str, tokenizer_path: str, end: int | None = END_OF_TEXT,
                  shard_bytes: int = SHARD_BYTES) -> None:
    """Encodes ``docs`` (doc_id, text) into record files below ``path``/data and writes their index
    into ``path``/index."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:  # a few megabytes, whatever the table
        shared = spark.sparkContext.broadcast({"definition": f.read()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value  # one per Python worker, which thus keeps its encoder from task to task
        if "encode" not in mine:
            mine["encode"] = encoder(mine.pop("definition"), end)
        encode = mine["encode"]
        number, filled, seq = 0, 0, 0
        for batch in batches:
            piece = batch.column("piece").to_pylist()
            shards, seqs, out = [], [], []
            texts, ids = batch.column("text"), batch.column("doc_id").to_pylist()
            tokens = (t for some in grouped(text.as_py() or "" for text in texts) for t in encode(some))
            for k, (doc_id, token_ids) in enumerate(zip(ids, tokens)):
                data = frame(pack(doc_id, token_ids))
                if filled and filled + len(data) > shard_bytes:
                    number, filled = number + 1, 0
                shards.append(f"s{piece[k]:07d}-{number:05d}")
                seqs.append(seq)
                out.append(data)
                filled, seq = filled + len(data), seq + 1
            yield pa.RecordBatch.from_pydict({
                "shard": shards, "seq": pa.array(seqs, pa.int64()), "value": pa.array(out, pa.binary())})

    rows = core(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                                               F.xxhash64("text").alias("tie"))
    sort = ["doc_id", "tie", "text"]
    ranged = (rows.repartitionByRange("doc_id", "tie").sortWithinPartitions(*sort)
              .select("doc_id", "text", F.spark_partition_id().alias("piece")))
    framed = ranged.mapInArrow(run, "shard string, seq long, value binary")
    # the text writer puts out a value's bytes as they are, and the end mark after each
    bare = F.expr("substring(value, 1, octet_length(value) - 1)").cast("string").alias("value")
    (framed.sortWithinPartitions("shard", "seq").select("shard", bare)
     .write.partitionBy("shard").option("lineSep", END.decode()).text(f"{path}/data"))
    _index(spark, path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """shard and content of every record file."""
    return spark.read.format("binaryFile").load(f"{path}/data").select(
        F.regexp_extract("path", "/shard=([^/]+)/", 1).alias("shard"), "content")


def _index(spark: SparkSession, path: str) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content")):
                rows, data = [], content.as_py()
                for seq, (offset, payload) in enumerate(frames(data, shard)):
                    doc_id, ids = unpack(payload)
                    rows.append((shard, seq, offset, len(payload), doc_id, len(ids),
                                 zlib.crc32(ids.astype("<u4").tobytes())))
                columns = zip(*rows) if rows else [[]] * 7
                kinds = [pa.string(), *[pa.int64()] * 6]
                names = [c.split()[0] for c in INDEX.split(", ")]
                yield pa.RecordBatch.from_pydict(
                    {n: pa.array(list(c), k) for n, c, k in zip(names, columns, kinds)})

    _files(spark, path).mapInArrow(run, INDEX).write.parquet(f"{path}/index")


# ---- reading ----

def index_of(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, with ``start``, the number of token ids of all records before it."""
    rows = spark.read.schema(INDEX).parquet(f"{path}/index")
    return prefix_sums(rows, [], ["shard", "seq"], {"n_tokens": "start"})


def fetch(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id and ids (int array) of the records that ``wanted`` (rows of the index, and a number
    ``place`` for each) names, or of all. A file is read once for all its records, which are cut out
    by offset and length; sort by ``place`` for a shuffled epoch."""
    rows = spark.read.schema(INDEX).parquet(f"{path}/index").withColumn("place", F.lit(None).cast("long")) \
        if wanted is None else wanted
    per_shard = rows.groupBy("shard").agg(F.collect_list(F.struct("offset", "length", "place")).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, cuts in zip(batch.column("content"), batch.column("w").to_pylist()):
                data, out = content.as_py(), []
                for cut in cuts:
                    end = cut["offset"] + HEAD_SIZE + cut["length"] + TAIL_SIZE + len(END)
                    _, payload = next(frames(data[cut["offset"]:end]))
                    doc_id, ids = unpack(payload)
                    out.append((doc_id, ids.astype(np.int32), cut["place"]))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([r[0] for r in out], pa.int64()),
                    "ids": pa.array([r[1] for r in out], pa.list_(pa.int32())),
                    "place": pa.array([r[2] for r in out], pa.int64())})

    return _files(spark, path).join(per_shard, "shard").mapInArrow(
        run, "doc_id long, ids array<int>, place long")


def shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """All records in a random order that the seed fixes: doc_id, ids, place, sorted by place."""
    wanted = spark.read.schema(INDEX).parquet(f"{path}/index").withColumn(
        "place", F.xxhash64(F.lit(seed), "shard", "seq"))
    return fetch(spark, path, wanted).orderBy("place")


def token_records(docs: DataFrame, tokenizer_path: str, end: int | None = END_OF_TEXT,
                  path: str | None = None) -> DataFrame:
    """Writes ``docs`` as records and returns, from the files, doc_id, start, n_tokens and
    ids_crc32 (of the ids as little-endian 32-bit integers) of every document."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "records")
    write_records(docs, path, tokenizer_path, end)
    return index_of(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
