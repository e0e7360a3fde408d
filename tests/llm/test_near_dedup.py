import itertools
import random
import re

import numpy as np
import pytest

from tests.llm.conftest import ODD_ROWS
from tidewatch.llm import near_dedup as nd


def brute(rows, similarity=0.8):
    """Components by comparing every pair of sets."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= similarity * len(x | y) - 1e-9:
            i, j = sorted((top(a), top(b)))
            root[j] = i
    return {i: (len(sets[i]), top(i)) for i in sets}


def varied(seed=1, copies=60):
    """A text with many copies that differ more or less, unrelated texts, and short ones."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for k in range(copies):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((k * 3, " ".join(t)))
    rows += [(1000 + k, " ".join(rng.choice(words) for _ in range(80))) for k in range(30)]
    rows += [(2000, "only four words here"), (2001, "Only FOUR words here"), (2002, "only four words")]
    return rows


@pytest.mark.parametrize("block", [500, 8])
def test_groups_equal_all_pairs(docs, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)  # small blocks: groups span several
    rows = varied()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(docs(rows)).collect()}
    assert got == brute(rows)


def test_leader_with_apart_pairs_in_other_blocks(docs, monkeypatch):
    """Pairs that are no leader's neighbours are found across blocks."""
    monkeypatch.setattr(nd, "BLOCK", 4)
    rows = varied(seed=5, copies=40)
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(docs(rows), 0.9).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 0.9).items()}


def test_odd_rows(docs, spark):
    got = nd.near_duplicates(docs(ODD_ROWS)).collect()
    assert len(got) == len(ODD_ROWS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)]
    assert by[None] == [(1, None, True)] and by[2 ** 62 + 1] == [(1, 2 ** 62 + 1, True)]
    assert by[4] == [(1, 4, True)] * 2
    assert by[5] == [(1, 5, True)]
    assert nd.near_duplicates(docs([])).count() == 0


def test_keep_one_keeps_columns_and_first(docs):
    rows = varied()
    table = docs(rows)
    kept = nd.keep_one(table)
    assert kept.columns == table.columns
    want = {c for _, c in brute(rows).values()}
    assert {r.doc_id for r in kept.collect()} == want


def test_least_matches_bounds_the_miss():
    rng = np.random.default_rng(0)
    t = nd.least_matches(0.85)
    assert (rng.binomial(nd.COORDS, 0.85, 200_000) < t).mean() < 1e-4
    assert nd.least_matches(0.8) < t < 0.85 * nd.COORDS


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in nd.components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
