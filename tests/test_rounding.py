import random

from pyspark.sql import functions as F

from tidewatch.functions.scoring import risk_score, round_exact, round_half_up


def test_round_exact_equals_python(spark):
    rnd = random.Random(3)
    xs = [i / 2000 for i in range(-2500, 2501)] + [i / 16000 for i in range(-400, 400)]
    xs += [rnd.uniform(-1, 1) for _ in range(2000)] + [0.805 * 1.1, 0.0625, 0.1 + 0.2, 123456.0005]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select("x", round_exact(F.col("x"), 3).alias("a"), round_exact(F.col("x"), 6).alias("b"))
    for r in got.collect():
        assert r.a == round(r.x, 3), r.x
        assert r.b == round(r.x, 6), r.x


def test_round_half_up_ignores_noise(spark):
    df = spark.createDataFrame([(0.0624999999999999,), (0.0625,), (-0.0625,)], "x double")
    assert [r.a for r in df.select(round_half_up(F.col("x"), 3).alias("a")).collect()] == [
        0.063, 0.063, -0.063]


def plain_risk(neg, pos, score):
    base = max(0.0, min(1.0, (1.0 - score) / 2.0))
    n = neg + pos
    bias = 1.0 + (neg / n - 0.5) * 0.5 if n else 1.0
    return round(min(1.0, base * min(1.5, 1.0 + (n - 1) * 0.1) * bias), 3)


def test_risk_equals_the_formula_everywhere(spark):
    rows = [(a, b, s / 1000) for a in range(5) for b in range(5) for s in range(-1000, 1001, 7)]
    df = spark.createDataFrame(rows, "neg int, pos int, s double")
    got = df.withColumn("r", risk_score(F.col("neg"), F.col("pos"), F.col("s"))).collect()
    assert all(r.r == plain_risk(r.neg, r.pos, r.s) for r in got)
