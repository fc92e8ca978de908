"""Radix selection against numpy and the built-in exact percentile."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators.quantiles import group_percentiles, with_order_code

EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308,
         math.inf, -math.inf, 1.0, math.nextafter(1.0, 0.0), math.nextafter(1.0, 2.0), 2.0, math.nextafter(2.0, 0.0), 1023.9999999999999]


def _doubles(n, seed):
    """Doubles of random bits: every exponent is as likely as any other."""
    rng = random.Random(seed)
    drawn = (struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(n))
    return [v for v in drawn if not math.isnan(v)]


def _quantile(values, p):
    ordered = sorted(values)
    pos = p * (len(ordered) - 1)
    low, high = ordered[math.floor(pos)], ordered[math.ceil(pos)]
    return low if low == high else low + (high - low) * (pos - math.floor(pos))


def test_codes_keep_the_order_of_doubles(spark):
    values = _doubles(3000, 1) + EDGES + [2.0 ** e for e in range(-1074, 1024)] + [math.nextafter(2.0 ** e, 0) for e in range(-1000, 1024)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = sorted((r.v, r.c) for r in with_order_code(df, "v", "c").collect())
    for (v, c), (w, d) in zip(rows, rows[1:]):
        assert (c == d) if v == w else (c < d)
    # the codes are the places of the doubles: neighbours differ by one
    near = with_order_code(spark.createDataFrame([(1.0,), (math.nextafter(1.0, 2.0),), (5e-324,)], "v double"), "v", "c")
    one, above, least = [r.c for r in near.collect()]
    assert above == one + 1 and least == 1


def test_nan_comes_last(spark):
    df = spark.createDataFrame([(1.0,), (math.inf,), (math.nan,)], "v double")
    got = group_percentiles(df, [], "v", {"low": 0.0, "mid": 0.5, "top": 1.0}).first()
    assert (got.low, got.mid, got.n) == (1.0, math.inf, 3) and math.isnan(got.top)


@pytest.mark.parametrize("spread", ["bits", "tail", "ties", "shift", "integers"])
def test_any_spread_of_values(spark, spread):
    rng = np.random.default_rng(4)
    values = {
        "bits": [v for v in _doubles(9000, 2) if abs(v) < 1e300],
        "tail": [float(v) for v in rng.pareto(0.2, 9000)],
        "ties": [7.5] * 6000 + [float(v) for v in rng.normal(size=3000)],
        "shift": [1e15 + float(v) for v in rng.normal(size=9000)],
        "integers": [float(v) for v in rng.integers(-40, 40, 9000)],
    }[spread]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = {"q0": 0.0, "q1": 0.25, "q5": 0.5, "q9": 0.9, "q99": 0.9999, "q10": 1.0}
    got = group_percentiles(df, [], "v", probs).first()
    assert got.n == len(values)
    for name, p in probs.items():
        assert got[name] == _quantile(values, p)


def test_null_keys_null_values_and_extra_aggregates_equal_the_built_in(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", None]), rng.choice([1, 2, None]), rng.choice([None, rng.gauss(0, 1), 2.0])) for _ in range(800)]
    rows += [("empty", 1, None)] * 3 + [("one", 2, 4.0)]
    df = spark.createDataFrame(rows, "k string, j int, v double")
    probs, extra = {"a": 0.1, "b": 0.5}, [F.avg("v").alias("mean")]
    want = group_percentiles(df, ["k", "j"], "v", probs, "sort", extra).collect()
    got = group_percentiles(df, ["k", "j"], "v", probs, "bracket", extra).collect()
    place = {(r.k, r.j): r for r in got}
    assert len(got) == len(want)
    for r in want:
        mine = place[(r.k, r.j)]
        assert mine.n == r.n
        for name in ("a", "b", "mean"):
            assert mine[name] == (None if r[name] is None else pytest.approx(r[name], abs=1e-12))


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert group_percentiles(df, ["k"], "v", {"m": 0.5}).count() == 0
    assert group_percentiles(df, [], "v", {"m": 0.5}).collect() == [(0, None)]


def test_a_round_orders_only_bounded_counts(spark, monkeypatch):
    """With few bits a round a group of many values still ends within its rounds, and is exact."""
    from fieldspark.operators import quantiles

    monkeypatch.setattr(quantiles, "_BITS", 4)
    monkeypatch.setattr(quantiles, "_FEW", 8)
    monkeypatch.setattr(quantiles, "_ROUNDS", 22)
    values = [v for v in _doubles(700, 5) if abs(v) < 1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert group_percentiles(df, [], "v", {"m": 0.37}).first().m == _quantile(values, 0.37)
