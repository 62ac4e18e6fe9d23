"""Golden values, and random pairs against a plain model of each function."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import similarity as sim

# (a, b, distance, normalised, Jaro, Jaro-Winkler); None: not checked
GOLDEN = [
    ("hello", "hello", 0, 1.0, 1.0, 1.0), ("", "", 0, 1.0, 1.0, 1.0), ("", "hello", 5, 0.0, 0.0, 0.0), ("hello", "hallo", 1, 0.8, 0.866667, 0.88),
    ("kitten", "sitting", 3, None, None, None), ("saturday", "sunday", 3, None, None, None), ("Ghent", "Gent", 1, 0.8, 0.933333, 0.94),
    ("MARTHA", "MARHTA", 2, 0.666667, 0.944444, 0.961111), ("Jon", "John", 1, 0.75, 0.916667, 0.933333), ("Jon", "Jonathan", 5, 0.375, 0.791667, 0.854167),
    ("abc", "xyz", 3, 0.0, 0.0, 0.0), ("a", "a", 0, 1.0, 0.0, 0.1), ("a", "b", 1, 0.0, 0.0, 0.0), ("ab", "ba", 2, 0.0, 0.0, 0.0), ("é", "e", 2, None, None, None),
]


def model_jaro(a: bytes, b: bytes) -> float:
    if not a and not b:
        return 1.0
    if not a or not b or len(a) == len(b) == 1:
        return 0.0
    reach, used, matched = max(len(a), len(b)) // 2 - 1, set(), []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == x), None)
        if j is not None:
            used.add(j)
            matched.append(x)
    m = len(matched)
    half = sum(x != b[j] for x, j in zip(matched, sorted(used))) / 2
    return (m / len(a) + m / len(b) + (m - half) / m) / 3 if m else 0.0


def scores(spark, pairs):
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame(pairs, "a string, b string")
    columns = [sim.levenshtein(a, b), sim.normalized_levenshtein(a, b), sim.jaro(a, b), sim.jaro_winkler(a, b), sim.is_similar(a, b, 0.7), sim.is_similar(a, b, 0.7, "levenshtein"), sim.upper_bound(a, b), sim.upper_bound(a, b, "levenshtein")]
    return df.select("a", "b", *(c.alias(f"c{k}") for k, c in enumerate(columns))).collect()


def test_golden(spark):
    for row, want in zip(scores(spark, [g[:2] for g in GOLDEN]), GOLDEN):
        for got, expected in zip(row[2:6], want[2:]):
            assert expected is None or got == pytest.approx(expected, abs=1e-6)


def test_random_pairs(spark):
    r = random.Random(1)
    text = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(0, 12)))
    for a, b, distance, normal, jaro, winkler, near, near_edits, bound, bound_edits in scores(spark, [(text(), text()) for _ in range(600)]):
        x, y = a.encode(), b.encode()
        assert jaro == pytest.approx(model_jaro(x, y), abs=1e-12)
        prefix = next((k for k in range(4) if k >= min(len(x), len(y)) or x[k] != y[k]), 4)
        assert winkler == pytest.approx(jaro + prefix * 0.1 * (1 - jaro), abs=1e-12)
        assert winkler >= jaro and winkler <= bound + 1e-9 and normal <= bound_edits + 1e-9
        assert near == (winkler >= 0.7) and near_edits == (normal >= 0.7)
        assert distance >= abs(len(x) - len(y))


def test_symmetry_and_null(spark):
    pairs = [("kitten", "sitting"), ("Jon", "John")]
    assert [r[2] for r in scores(spark, pairs)] == [r[2] for r in scores(spark, [p[::-1] for p in pairs])]
    row = scores(spark, [(None, "x")])[0]
    assert row[2] is None and row[5] is None and row[6] is False and row[7] is False


def test_case_folds_ascii_only(spark):
    df = spark.createDataFrame([("GHENT", "ghent"), ("É", "é")], "a string, b string")
    assert [r[0] for r in df.select(sim.levenshtein_ci(F.col("a"), F.col("b"))).collect()] == [0, 1]


def test_sql_functions_agree(spark):
    sim.register(spark)
    spark.createDataFrame([g[:2] for g in GOLDEN], "a string, b string").createOrReplaceTempView("pairs")
    rows = spark.sql("SELECT byte_levenshtein(a, b), norm_levenshtein(a, b), jaro(a, b), jaro_winkler(a, b) FROM pairs").collect()
    for row, same in zip(rows, scores(spark, [g[:2] for g in GOLDEN])):
        assert list(row) == pytest.approx(list(same[2:6]), abs=1e-12)
