import functools
import os
import random
import sys
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from compare import DATA  # noqa: E402

from skein.operators import hotkeys  # noqa: E402
from skein.plans import corpus  # noqa: E402


@pytest.mark.parametrize("share", [0.0002, 0.02, 0.3])
def test_heavy_keys_have_a_row_of_that_rank(spark, share):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(60)}", rng.choice([None, rng.randrange(-(10**12), 10**12), 5])) for _ in range(3000)]
    rows += [(None, 1)] * 50 + [("nulls", None)] * 1400 + [("just", 7 * i) for i in range(100)] + [("less", i) for i in range(99)] + [("", 1)] * 351
    rows = rows[:5000]
    got = {r.key: r.value for r in hotkeys.heavy_ranks(spark.createDataFrame(rows, "k string, v long"), F.col("k"), F.col("v"), len(rows), share, bins=16).collect()}
    groups = {}
    for k, v in rows:
        if k is not None:
            groups.setdefault(k, []).append(v)
    least = -(-Fraction(str(share)) * len(rows) // 1)
    order = lambda v: (v is not None, v or 0)
    assert len(rows) == 5000 and got == {k: sorted(held, key=order)[int(least) - 1] for k, held in groups.items() if len(held) >= least}
    assert share != 0.02 or ("just" in got and "less" not in got and got["nulls"] is None)


def test_no_keys_of_no_rows(spark):
    rows = spark.createDataFrame([], "k string, v long")
    assert hotkeys.heavy_ranks(rows, F.col("k"), F.col("v"), 0).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_p6_found_comes_from_ranks_that_resolve(spark, monkeypatch):
    """Histograms are refined over several rounds, and without what they resolve no key is left."""
    staged = []
    monkeypatch.setattr(hotkeys, "heavy_ranks", functools.partial(hotkeys.heavy_ranks, bins=16))
    monkeypatch.setattr(hotkeys, "stage", lambda df, purpose, stage=hotkeys.stage: staged.append(purpose) or stage(df, purpose))
    assert corpus.p6_found(spark, DATA).count() > 0 and staged.count("targets") > 2
    monkeypatch.setattr(hotkeys, "stage", lambda df, purpose, stage=hotkeys.stage: stage(df.limit(0) if purpose == "targets" else df, purpose))
    assert corpus.p6_found(spark, DATA).count() == 0
