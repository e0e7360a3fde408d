import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidewatch.llm import audit, prefix_trie, records
from tidewatch.session import fresh_path

TURN = "conv_id long, turn long, role string, text string, node string, depth string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ---- prefix trie ----

def plain_trie(rows):
    """The nodes by dictionaries: list of the eight result values."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [(r[3], r[4]) for r in sorted(t)] for c, t in own.items()}
    members = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        turns = own.get(c - int(np.fmod(c, 20)), [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, d == len(turns)))
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        kids = children[node]
        sums = [below(k) for k in kids]
        words = len(WORDS.findall(node[-1][1])) if node else 0
        return (sum(s[0] for s in sums) if kids else 1,
                sum(s[1] for s in sums) + (len(members[node]) - 1) * words)

    out = []
    for node, who in members.items():
        leaves, saved = below(node)
        ends = ",".join(str(c) for c, last in who if last)
        out.append((who[0][0], len(node), members[node[:-1]][0][0] if node else None, len(who),
                    len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(seed, n, deepest):
    rnd, rows = random.Random(seed), []
    for c in range(n):
        conv = c if rnd.random() < 0.6 else c - c % 20 + rnd.choice([0, 3])
        for t in range(rnd.randint(1, deepest)):
            rows.append((conv, t, rnd.choice(["user", "bot"]), rnd.choice(["a b", "c", "d e f"])))
    return rows


def trie_of(spark, rows, **params):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], TURN)
    return sorted(map(tuple, prefix_trie.prefix_trie(df, **params).collect()), key=str)


@pytest.mark.parametrize("height, deepest", [(2, 9), (3, 14), (16, 6)])
def test_trie_equals_plain_version(spark, height, deepest):
    rows = talk(height, 60, deepest)
    assert trie_of(spark, rows, height=height) == plain_trie(rows)


def test_trie_odd_rows(spark):
    rows = [(None, 0, "user", "nobody's"), (1, None, None, None), (1, 0, "user", "same"), (1, 0, "user", "same"),
            (1, 0, "use", "rsame"), (2, 5, None, ""), (2, 1, "", None), (40, 0, "user", "w " * 50_000),
            (41, 0, "user", "w " * 50_000), (-3, 0, "user", "below zero"), (0, 0, "user", "first"),
            (2 ** 60, 0, "\U0001F600", "large id"), *[(7, t, "user", "deep") for t in range(40)],
            *[(c, 0, "user", "copy") for c in range(100, 160)]]
    assert trie_of(spark, rows, height=4) == plain_trie(rows)


def test_trie_of_no_conversations(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 1, "user", "x")]) == []


def test_a_node_of_many_ends_reaches_over_pieces_and_blocks(spark):
    ends = spark.range(0, 5000, numPartitions=7).selectExpr("'hot' AS node", "id AS conv_id").unionByName(
        spark.createDataFrame([("a", 3), ("a", -2), ("z", 9)], "node string, conv_id long"))
    got = {r["node"]: r["ends_sha256"] for r in prefix_trie.ends_hashes(ends, block=300).collect()}
    want = {"hot": ",".join(map(str, range(5000))), "a": "-2,3", "z": "9"}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


# ---- token records ----

def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary())


def test_words_looked_up_equal_texts_encoded_at_once(tokenizer, monkeypatch):
    monkeypatch.setattr(records, "KNOWN_WORDS", 50)  # the memory is emptied many times
    with open(vocabulary(), encoding="utf-8") as f:
        encode = records.encoder(f.read(), None)
    rnd = random.Random(5)
    pool = [chr(c) for c in [*range(1, 0x180), *range(0x300, 0x340), 0x1100, 0x1161, 0x11A8, 0x85, 0x2028, 0x3000,
                             0x1F600, 0xFB01, 0x130, 0x3A3, 0x2126]] + [" ", "\n", "\t"] * 40 + ["<|endoftext|>", "'s"]
    for _ in range(1500):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 50)))
        assert encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_records_round_trip_in_shards(spark, docs, tokenizer):
    rnd = random.Random(3)
    rows = [(k, " ".join(rnd.choice(["alpha", "Beta", "gamma9", "\U0001F600"]) for _ in range(rnd.randint(0, 60))))
            for k in rnd.sample(range(10_000), 150)]
    rows += [(None, "no id"), (None, None), (5_000_000_000, "x" * 100_000), (17, "same"), (17, "same"), (18, None)]
    path = fresh_path(spark, "records")
    records.write_records(docs(rows), path, vocabulary(), shard_bytes=2_000)
    got = records.index_of(spark, path).orderBy("shard", "seq").collect()
    assert len({r["shard"] for r in got}) > 5
    key = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert key == sorted((i is not None, i or 0) for i, _ in rows)
    ids = {(i, t): [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    seen = sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str)
    assert seen == sorted(((i, len(ids[i, t]), zlib.crc32(np.array(ids[i, t], "<u4").tobytes())) for i, t in rows), key=str)
    whole = sorted(((r["doc_id"], r["ids"]) for r in records.fetch(spark, path).collect()), key=str)
    assert whole == sorted(((i, ids[i, t]) for i, t in rows), key=str)


def test_records_in_shuffled_order_and_by_index(spark, docs):
    path = fresh_path(spark, "records")
    records.write_records(docs([(k, f"text number {k}") for k in range(80)]), path, vocabulary(), shard_bytes=500)
    first, again, other = ([r["doc_id"] for r in records.shuffled(spark, path, s).collect()] for s in (1, 1, 2))
    assert first == again != other and sorted(first) == list(range(80)) != first
    wanted = records.index_of(spark, path).where("doc_id IN (3, 70)").selectExpr("*", "doc_id AS place")
    assert sorted(r["doc_id"] for r in records.fetch(spark, path, wanted).collect()) == [3, 70]


def test_records_of_an_empty_table(spark, docs):
    assert records.token_records(docs([]).where("false"), vocabulary()).count() == 0


def test_damaged_records_are_noticed():
    good = records.frame(b"payload") + records.frame(b"")
    assert [p for _, p in records.frames(good)] == [b"payload", b""]
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 0x40
        with pytest.raises(ValueError):
            list(records.frames(bytes(bad)))
    with pytest.raises(ValueError):
        list(records.frames(good[:-1]))


def test_wide_token_ids_take_four_bytes():
    for ids in ([], [1, 65_535], [1, 65_536]):
        assert records.unpack(records.pack(None, np.array(ids, np.uint32)))[1].tolist() == ids


# ---- filter audit ----

def plain_audit(rows, labelled):
    fails, order = [], "ABCDE"
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, text, lang in rows:
        text = text or ""
        words = WORDS.findall(text)
        bad = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
               "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
               "E": i is not None and i > first[text]}
        marks = [x for x in labelled if x[0] == i and i is not None]
        fails.append((lang or "", {f for f in order if bad[f]}, any(m[1] == 1 for m in marks), any(m[2] == 1 for m in marks)))
    out = []
    for part in sorted({f[0] for f in fails}):
        own = [f for f in fails if f[0] == part]
        shapley = defaultdict(int)
        found = []
        for perm in itertools.permutations(order):
            for step, letter in enumerate(perm):
                before = set(perm[:step])
                gone = [f for f in own if letter in f[1] and not f[1] & before]
                shapley[letter] += len(gone)
                found.append((part, "".join(perm), step + 1, sum(not f[1] & (before | {letter}) for f in own), len(gone),
                              sum(letter in f[1] and bool(f[1] & before) for f in own), sum(f[1] == {letter} for f in own),
                              sum(f[2] for f in gone), sum(f[3] for f in gone), letter))
        out += [(*f[:-1], shapley[f[-1]]) for f in found]
    return sorted(out)


def test_audit_equals_plain_version(docs, labels):
    rnd = random.Random(9)
    texts = [None, "", "short", "UPPER CASE", " ".join(str(k) for k in range(120)), "word " * 150, "a # b",
             " ".join("AB%d|" % k for k in range(101)), "X" * 5000, " nbsp is no space "]
    rows = [(k, rnd.choice(texts), rnd.choice(["en", "fr", "", None])) for k in range(90)]
    rows += [(3, "UPPER CASE", "en"), (3, "UPPER CASE", "en"), (None, "short", "fr"), (None, "short", "de")]
    marks = [(k, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for k in rnd.sample(range(95), 60)]
    marks += [(3, 1, 0), (3, 0, 1), (None, 1, 1), (10_000, 1, 1)]
    table = docs([(i, t, lang, "s") for i, t, lang in rows])
    assert sorted(map(tuple, audit.filter_audit(table, labels(marks)).collect())) == plain_audit(rows, marks)


def test_audit_of_empty_tables(docs, labels):
    assert audit.filter_audit(docs([]).where("false"), labels([])).count() == 0
    assert audit.filter_audit(docs([(1, "x")]), labels([])).count() == 600


def test_long_text_with_many_distinct_words(docs, labels):
    text = " ".join(f"w{k}" for k in range(400_000))
    got = audit.filter_audit(docs([(1, text)]), labels([])).where("step = 1").selectExpr("max(removed)").first()[0]
    assert got == 0


def test_new_words_of_several_texts_are_learned_together():
    from tidewatch.llm import records
    assert list(records.grouped(["ab", "", "cdef", "g"], 4)) == [["ab", "", "cdef"], ["g"]]
    assert list(records.grouped([])) == []


def test_the_memory_of_words_is_bounded_and_keeps_those_met_again(tokenizer, monkeypatch):
    monkeypatch.setattr(records, "KNOWN_WORDS", 40)
    memory = records.Memory()
    assert memory.missing(["often"]) == ["often"]
    memory.newer["often"] = b"1234"
    for k in range(200):
        assert memory.missing(["often", f"w{k}"]) == [f"w{k}"]  # the frequent word is never learned again
        memory.newer[f"w{k}"] = b""
        assert len(memory.newer) + len(memory.older) <= 40
    with open(vocabulary(), encoding="utf-8") as f:
        encode = records.encoder(f.read(), 2)
    for k in range(30):
        texts = ["It's I'LL ain't!'s 'tis we'revery d'été 'v 12's''s x'", f" Ça va, naïve{k} x\n\tı{k} ", "", " ", f"Ça l'été <|endoftext|> {k}"]
        texts += ["3×4 A\u0301b H\u0331 İx <|ENDOFTEXT|> a\x1cb c\xa0d Ünd/ÉTÉ", "日本語 中文's «Quote»—it’s \U0001F600's", "'"]
        want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert [ids.tolist() for ids in encode(texts)] == want
    assert encode([]) == []
