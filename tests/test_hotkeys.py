import math
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import hotkeys

SCHEMA = "k string, v long, value string, key long"


@pytest.mark.parametrize("hot_keys", [0, 3, 1000])  # no key is hot, one is, all are
def test_exact_figures_with_a_hot_key(spark, hot_keys):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}", rng.choice([None, rng.randrange(-(10**12), 10**12), 5]), "x", 1) for _ in range(3000)]
    rows += [(None, 1, "x", 1), ("nulls", None, "x", 1), ("one", 7, "x", 1)]
    got = {r.key: r for r in hotkeys.key_figures(spark.createDataFrame(rows, SCHEMA), F.col("k"), F.col("v"), (0.0, 0.5, 0.9, 1.0), bins=16, hot_keys=hot_keys).collect()}
    groups = {}
    for k, v, *_ in rows:
        if k is not None:
            groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, values in groups.items():
        held = sorted(v for v in values if v is not None)
        assert (got[k].n_rows, got[k].n_values) == (len(values), len(held))
        if held:
            want = [held[max(1, math.ceil(p * len(held))) - 1] for p in (0.0, 0.5, 0.9, 1.0)]
            assert [got[k].q0, got[k].q1, got[k].q2, got[k].q3] == want and (got[k].first, got[k].last) == (held[0], held[-1])
        else:
            assert got[k].q1 is None


def test_heavy_keys_and_empty(spark):
    rows = spark.createDataFrame([("a", 1, "", 0)] * 98 + [("b", 1, "", 0)] * 2, SCHEMA)
    held = hotkeys.key_figures(rows, F.col("k"), F.col("v"), ())
    assert {r.key for r in hotkeys.heavy_keys(held, 100).collect()} == {"a", "b"}
    assert {r.key for r in hotkeys.heavy_keys(held, 101).collect()} == {"a"}
    assert {r.key for r in hotkeys.heavy_keys(spark.createDataFrame([("x", 7)], "key string, n_rows long"), 350).collect()} == {"x"}
    none = hotkeys.key_figures(rows.filter("false"), F.col("k"), F.col("v"))
    assert none.count() == 0 and hotkeys.heavy_keys(none, 0).count() == 0


def test_counts_of_hot_keys_are_those_of_their_histograms(spark):
    rows = spark.createDataFrame([("hot", i % 7, "", 0) for i in range(500)] + [("hot", None, "", 0)] * 3 + [(f"k{i}", i, "", 0) for i in range(300)], SCHEMA)
    pairs, counted = hotkeys.key_counts(rows, F.col("k"), F.col("v"), 100)
    got = hotkeys.hot_figures(pairs, counted, (), bins=4).collect()
    assert [(r.key, r.n_rows, r.n_values, r.first, r.last) for r in got] == [("hot", 503, 500, 0, 6)]
    assert hotkeys.hot_figures(pairs.limit(0), counted, (), bins=4).collect()[0].n_values == 0
