"""Operators over whole tables, and the pipeline."""

import random
import re
import time

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from tests.llm.conftest import ODD_ROWS
from tidewatch.llm import decontaminate, line_dedup, mixing


def sql_rows(sql, rows):
    frame = pd.DataFrame([(i, t, *(rest[1:2] if rest else ("s1",))) for i, t, *rest in rows],
                         columns=["doc_id", "text", "source"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    db = duckdb.connect()
    db.register("frame", frame)
    db.sql("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, "
           "source::VARCHAR AS source FROM frame")
    rel = db.sql(sql)
    return sorted((repr(r) for r in rel.fetchall())), rel.columns


def spark_rows(df, columns):
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


# ---- line dedup ----

def lined(seed=3, n=120):
    rng = random.Random(seed)
    lines = [f"shared line {k}" for k in range(12)] + ["", "  ", " padded shared line 3 ", "shared line 3 "]
    rows = []
    for k in range(n):
        own = [rng.choice(lines) if rng.random() < 0.5 else f"own {rng.random()}" for _ in range(rng.randint(0, 9))]
        source = rng.choice(["a"] * 6 + ["b", "c", "d", "e", None])
        rows.append((k, "\n".join(own) if k % 17 else None, "en", source))
    return rows


@pytest.mark.parametrize("min_sites", [3, 5])
def test_lines_against_sql(docs, min_sites):
    rows = lined()
    sql = line_dedup.SQL.replace(f">= {line_dedup.MIN_SITES}", f">= {min_sites}")
    want, columns = sql_rows(sql, rows)
    got = line_dedup.line_dedup(docs(rows), min_sites)
    assert spark_rows(got, columns) == want


def test_a_text_of_many_lines_is_split_once(docs):
    n = 200_000
    rows = [(k, "\n".join(["boilerplate here", *(f"{k} own {j}" for j in range(n))]), "en", f"s{k}") for k in range(3)]
    start = time.time()
    got = line_dedup.line_dedup(docs(rows)).where("doc_id = 2").collect()[0]
    assert (got.n_lines, got.n_removed, got.text.count("\n")) == (n + 1, 1, n - 1)
    assert time.time() - start < 90  # quadratic work would take hours


def test_lines_far_from_the_threshold_are_decided_by_sketch(docs):
    rows = [(k, f"common\nown {k}", "en", f"site{k}") for k in range(200)] + [
        (1000 + k, "rare\nown", "en", "one") for k in range(50)]
    got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.line_dedup(docs(rows)).collect()}
    assert got[0] == (0, "common\nown 0") and got[7] == (1, "own 7")
    assert got[1001] == (0, "rare\nown")


def test_line_dedup_keeps_columns_and_odd_rows(docs):
    table = docs(ODD_ROWS)
    out = line_dedup.cleaned(table)
    assert out.columns == table.columns and out.count() == len(ODD_ROWS)
    assert out.where("text IS NULL").count() == 1
    assert line_dedup.line_dedup(docs([])).count() == 0


def test_line_dedup_runs_no_python(docs):
    plan = line_dedup.line_dedup(docs(lined()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- mixing ----

def sourced(seed=6, n=300):
    rng = random.Random(seed)
    names = ["hot"] * 8 + ["a", "b", "B", "ä", None, "small"]
    return [(k, " ".join(["w"] * rng.randint(0, 40)), "en", "tiny" if k == 5 else rng.choice(names))
            for k in range(n)]


def test_mixing_against_sql(docs):
    rows = sourced()
    want, columns = sql_rows(mixing.SQL, rows)
    assert spark_rows(mixing.mixed(docs(rows)), columns) == want


def test_mix_meets_its_targets(docs):
    got = mixing.mixed(docs(sourced())).toPandas()
    rows = {r[0]: r[3] for r in sourced()}
    got["source"] = got["doc_id"].map(rows).fillna("(null)")
    sums = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"),
                                     size=("source_size", "first"), own=("size", "sum"))
    assert (sums["taken"] == sums["target"].astype(int)).all()
    assert (sums["size"] == sums["own"]).all() and (sums["target"] <= 2 * sums["size"]).all()
    assert (got["taken"] <= 2 * got["size"]).all()
    assert abs(sums["target"].sum() - 1.5 * got["size"].sum()) < 1e-6


def test_mixing_odd_rows(docs):
    assert mixing.mixed(docs(ODD_ROWS)).count() == len(ODD_ROWS)
    none = mixing.mixed(docs([(1, None), (2, "")])).collect()
    assert [(r.size, r.target, r.taken) for r in none] == [(0, 0.0, 0)] * 2
    assert mixing.mixed(docs([])).count() == 0
    table = docs(sourced()).withColumnRenamed("score", "taken")
    out = mixing.with_portions(table)
    assert out.columns == [*table.columns, "size", "source_size", "target", "_taken"]
    assert out.where("_taken > 0").count() == out.count()


# ---- decontamination ----

def distance(item, text):
    """Fewest edits of the whole item against any part of the text."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        row = [i]
        for j, d in enumerate(text, 1):
            row.append(min(before[j - 1] + (c != d), before[j] + 1, row[-1] + 1))
        before = row
    return min(before)


def test_leaks_against_all_alignments(docs, spark):
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    items = [(k, " ".join(rng.choice(words) for _ in range(14))) for k in range(6)]
    rows = []
    for k in range(60):
        i, t = rng.choice(items)
        t = list(t)
        for _ in range(rng.randint(0, 10)):
            p = rng.randrange(len(t))
            t[p:p + 1] = rng.choice([[], ["x"], [t[p], "y"]])
        rows.append((k, "Some words\nbefore. " + "".join(t).upper().replace(" ", "\n", 2) + " and after."))
    rows.append((100, "nothing of the kind " * 30))
    bench = spark.createDataFrame(items + items[:1] + [(None, "x" * 80), (90, None), (91, "short")],
                                  "item_id long, text string")
    for block in (decontaminate.BLOCK_CHARS, 100):  # one block, and many
        got = {}
        for r in decontaminate.contaminated(docs(rows), bench, block_chars=block).collect():
            got[r.doc_id, r.item_id] = min(r.edits, got.get((r.doc_id, r.item_id), 99))
        want = {}
        for d, t in rows:
            plain = re.sub(r"[^a-z0-9]+", " ", t.lower())
            for i, item in items:
                if (n := distance(item, plain)) <= decontaminate.budget(len(item)):
                    want[d, i] = n
        assert got == want and want
    kept = decontaminate.keep_clean(docs(rows), bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_leak_places_and_long_texts(docs, spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly box"
    text = "filler words go here " * 8000 + item + " end"
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    r = decontaminate.contaminated(docs([(1, text)]), bench).collect()
    assert [(x.item_id, x.start, x.end, x.edits) for x in r] == [
        ("q", text.index(item), text.index(item) + len(item), 0)]
    assert decontaminate.contaminated(docs(ODD_ROWS), bench).count() == 0
    assert decontaminate.contaminated(docs([]), bench).count() == 0
    assert decontaminate.contaminated(docs([(1, text)]), bench.limit(0)).count() == 0


def test_short_items_are_found_as_whole_words(docs, spark):
    items = [(1, "42"), (2, "It is so!"), (3, "a bc"), (4, "The answer is forty two, as all know."), (5, "?!"),
             (6, "no no")]
    rows = [(1, "Was 42 seen? 142 or 42."), (2, "it... IS -- so? It is sorry."), (3, "a bc, a bcd; xa bc"),
            (4, "Well: the answer is forty-two as all know"), (5, "the answer is forty two as all knows"), (6, "no no no no no")]
    bench = spark.createDataFrame(items, "item_id smallint, text string")
    got = [(r.doc_id, r.item_id, dict(rows)[r.doc_id][r.start:r.end], r.edits)
           for r in decontaminate.contaminated(docs(rows), bench).collect()]
    assert sorted(got) == [(1, 1, "42", 0), (1, 1, "42", 0), (2, 2, "it... IS -- so", 0), (3, 3, "a bc", 0),
                           (4, 4, "the answer is forty-two as all know", 0), (6, 6, "no no", 0), (6, 6, "no no", 0)]
    kept = decontaminate.keep_clean(docs(rows), bench)  # a filter leaves single words alone
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 6]


@pytest.mark.parametrize("kind", ["decimal(10,0)", "date", "binary", "tinyint"])
def test_item_ids_of_any_kind(docs, spark, kind):
    one = "DATE'2024-01-01'" if kind == "date" else f"CAST('1' AS {kind})"
    bench = spark.createDataFrame([("some short words",)], "text string").selectExpr(f"{one} AS item_id", "text")
    assert decontaminate.contaminated(docs([(1, "here are some short words")]), bench).count() == 1


# ---- pipeline ----

@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's input and output over the smallest tables."""
    folder = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, folder).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_columns_and_filter(stages):
    for name, before, after in stages:
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        kept = [r.doc_id for r in after.select("doc_id").collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= ids, name
        if name == "mixing":
            assert after.columns[:len(before.columns)] == before.columns
        else:
            assert after.columns == before.columns, name
    counts = {name: (b.count(), a.count()) for name, b, a in stages}
    assert counts["line_dedup"][0] == counts["line_dedup"][1]
    assert counts["toxicity"][0] > counts["toxicity"][1] > 0.8 * counts["toxicity"][0]


def test_near_dedup_stage_against_all_pairs(stages):
    from tests.llm.test_near_dedup import brute
    _, before, after = stages[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = {c for _, c in brute(rows).values()}
    assert {r.doc_id for r in after.collect()} == want


def test_decontamination_stage_against_search(stages, spark):
    _, before, after = stages[3]
    items = [re.sub(r"\s", " ", r.text.lower().strip()) for r in
             spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in before.collect()
             if any(i in re.sub(r"\s", " ", r.text.lower()) for i in items if len(i) >= 50)}
    kept = {r.doc_id for r in after.collect()}
    assert not leaks & kept
    assert len(kept) >= before.count() - len(leaks) - 2


def test_run_equals_the_stages(stages, spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.01")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, stages[-1][2].collect()))
