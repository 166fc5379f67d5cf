import hashlib
import math
from collections import Counter

import pytest

from assertia.llm.mixing import SEED, replicate, shuffled, source_rates

ROWS = [(i, "x" * (i % 40 + 1), "big" if i % 3 else "small") for i in range(900)] + [(1000, None, "small"), (1001, "", "void"), (1002, "abc", None), (None, "n", "big"), (5, "x" * 6, "big")]


def poisson(u, rate):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def u(*parts):
    return int(hashlib.md5("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:13], 16) / 2**52


def test_counts_follow_the_inverted_distribution(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").selectExpr("*", "1 as rate", "2 as chars", "map(1, 2) as cdf", "3 as `__n`", "4 as base", "5 as of", "6 as id", "7 as `row`", "8 as copy", "9 as `x.y`")
    chars = Counter()
    for _, t, s in ROWS:
        chars[s] += len(t or "")
    rates = {s: 0 if not c else c**0.5 / sum(x**0.5 for x in chars.values()) * sum(chars.values()) / c for s, c in chars.items()}
    assert {r.source: pytest.approx(r.rate) for r in source_rates(df).collect()} == rates
    want = Counter((i, t, s, c + 1) for i, t, s in ROWS for c in range(poisson(u(i, SEED), rates[s])))
    out = shuffled(replicate(df))
    assert out.columns == [*df.columns, "__copy", "__place"]
    rows = out.collect()
    assert Counter((r.doc_id, r.text, r.source, r["__copy"]) for r in rows) == want
    assert all((r.rate, r.chars, r.cdf, r["__n"], r.base, r.of, r.id, r.row, r.copy, r["x.y"]) == (1, 2, {1: 2}, 3, 4, 5, 6, 7, 8, 9) for r in rows)
    assert all(r["__place"] == u(r.doc_id, r["__copy"], SEED) for r in rows)
    assert replicate(df.limit(0)).count() == 0


def test_named_weights_and_large_rates(spark):
    df = spark.createDataFrame([(i, "y" * 1000, "big") for i in range(2000)] + [(5000, "zz", "tiny")], "doc_id long, text string, source string")
    rates = {r.source: r for r in source_rates(df, {"tiny": 0.001, "big": 0.0}).collect()}
    assert rates["big"].rate == 0 and rates["tiny"].rate == pytest.approx(0.001 * 2_000_002 / 2)
    assert rates["tiny"].cdf[-1] == pytest.approx(1)
    n = replicate(df, {"tiny": 0.001, "big": 0.0}).count()
    assert n == poisson_large(u(5000, SEED), 0.001 * 2_000_002 / 2)
    with pytest.raises(ValueError):
        source_rates(df, {"big": 2.0})


def poisson_large(at, rate):
    k, total = 0, math.exp(-rate)
    while total <= at:
        k += 1
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    return k


def test_a_rate_of_a_million(spark):
    """One row of a source of two characters in a corpus whose other source has a billion's weight: found in a short array."""
    import time

    from assertia.llm import mixing

    df = spark.createDataFrame([(i, "y" * 1_000_000, "big") for i in range(4)] + [(9, "zz", "tiny")], "doc_id long, text string, source string")
    began = time.time()
    [row] = [r for r in mixing.source_rates(df, {"tiny": 0.5, "big": 0.0}).collect() if r.source == "tiny"]
    assert row.rate == pytest.approx(1_000_000, rel=1e-5) and len(row.cdf) < 24_100 and row.cdf[0] < 1e-25 and row.cdf[-1] == pytest.approx(1, abs=1e-7)
    assert time.time() - began < 60
    n = mixing.replicate(df, {"tiny": 0.5, "big": 0.0}).count()
    at = u(9, SEED)
    assert abs(n - (row.rate + 1000 * _normal_quantile(at))) < 5


def _normal_quantile(p):
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def test_log_factorial(spark):
    from pyspark.sql import functions as F

    from assertia.llm.mixing import log_factorial

    rows = spark.createDataFrame([(float(k),) for k in (0, 1, 2, 3, 9, 10, 40, 1000, 10**6)], "k double").select("k", log_factorial(F.col("k")).alias("x")).collect()
    assert all(abs(r.x - math.lgamma(r.k + 1)) < 1e-12 * max(1, r.k * 20) for r in rows)
