import numpy as np
import pytest

from skein.llm import seen

ROWS = "row_id long, url string, key string, fp long"
EARLIER = "url string, key string"


def key(url):
    rest = url.split("://", 1)[-1]
    n = min([i for i, c in enumerate(rest) if c in "?/:"] or [len(rest)])
    return rest[:n].lower() + rest[n:]


def brute(rows, earlier):
    known, found = {key(u) for (u, *_) in earlier if u is not None}, set()
    for row_id, url, *_ in sorted(rows):
        if url is not None:
            if key(url) in known:
                found.add(row_id)
            known.add(key(url))
    return found


@pytest.mark.parametrize("bits", [8, 16, 32])
def test_against_brute_force(spark, bits):
    rng = np.random.default_rng(4)
    urls = [f"{s}{h}/p{k}" for s, h, k in zip(rng.choice(["", "http://", "HTTPS://"], 3000), rng.choice(["h.test", "H.Test", "k.test"], 3000), rng.integers(0, 900, 3000))]
    rows = [(i, "http://hot.test/" if i % 3 == 0 else u, "x", i) for i, u in enumerate(urls)] + [(9000, None, "x", 0), (9001, "", "x", 0), (9002, "h.test/P1", "x", 0)]
    earlier = [(f"h.test/p{i}", "x") for i in range(0, 900, 7)] + [(None, "x"), ("H.TEST/p1", "x")]
    checked = seen.seen_before(spark.createDataFrame(rows, ROWS).repartition(5), spark.createDataFrame(earlier, EARLIER), bits)
    got = checked.collect()
    assert len(got) == len({r.row_id for r in got})
    assert {r.row_id for r in got if not r.wrong} == brute(rows, earlier)
    rates = seen.error_rates(checked, len(rows), len(rows) + len(earlier), bits).collect()[0]
    assert rates.n_wrong == sum(r.wrong for r in got) and 0 <= rates.derived_rate < 1


def test_a_coarse_filter_gives_wrong_candidates_that_the_check_finds(spark, monkeypatch):
    class Coarse(seen.Layout):
        def __init__(self, n, remainder_bits):
            super().__init__(n, 8)
            self.quotient_bits, self.shard_bits = 10, 6

    monkeypatch.setattr(seen, "Layout", Coarse)
    rows = [(i, f"h.test/{i}", "", 0) for i in range(3000)]
    got = seen.seen_before(spark.createDataFrame(rows, ROWS), spark.createDataFrame([(f"k.test/{i}", "") for i in range(3000)], EARLIER)).collect()
    assert got and all(r.wrong for r in got)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], ROWS), spark.createDataFrame([(1, "h.test/a", "", 0), (2, "h.test/a", "", 0)], ROWS)
    empty = spark.createDataFrame([], EARLIER)
    assert seen.seen_before(none, empty).count() == 0
    assert [(r.row_id, r.wrong) for r in seen.seen_before(some, empty).collect()] == [(2, False)]


@pytest.mark.parametrize("bits", [8, 16, 32])
def test_packing_and_merging(bits):
    layout = seen.Layout(20_000, bits)
    rng = np.random.default_rng(1)
    within = layout.quotient_bits - layout.shard_bits + layout.remainder_bits
    parts = [np.unique((5 << within) | rng.integers(0, 1 << within, 400)) for _ in range(3)] + [np.full(1, 5 << within)]
    packed = [layout.pack(p) for p in parts]
    for part, held in zip(parts, packed):
        assert (layout.unpack(5, *held) == part).all()
    merger = seen.Merger()
    for part in parts:
        shards, prints = layout.split(part[::-1])
        assert shards.tolist() == [5] and (layout.join(5, prints[0]) == part).all()
        merger.add(layout.join(5, prints[0]))
    assert layout.pack(merger.all()) == layout.pack(np.unique(np.concatenate(parts)))


def test_partial_filters_of_many_keys_are_no_larger_than_their_fingerprints():
    layout = seen.Layout(10**10)
    prints = np.random.default_rng(3).integers(0, 1 << (layout.quotient_bits + layout.remainder_bits), 1_000_000)
    shards, parts = layout.split(prints)
    assert len(shards) == 1 << layout.shard_bits and sum(map(len, parts)) <= prints.nbytes
    own = np.unique(prints)
    at = seen.KEYS_PER_SHARD
    assert (np.concatenate([layout.join(int(s), p) for s, p in zip(shards, parts)]) == own).all() and at * 2 >= 10**10 / len(shards)
    assert layout.split(prints[:0])[1] == []


def test_bitmap_keeps_all_that_are_wanted(spark):
    keys = spark.range(40_000).selectExpr("id * 7919 as fp", "id")
    wanted = keys.filter("id % 100 = 3").select("fp")
    kept = seen.cut_by_bitmap(keys, wanted, 400)
    assert kept.join(wanted, "fp", "left_semi").count() == 400 and kept.count() < 40_000 // 4
    assert seen.cut_by_bitmap(keys, wanted.limit(0), 0).count() == 0
    assert seen.cut_by_bitmap(keys, wanted, (1 << seen.MAP_BITS) + 1).count() == 40_000


def test_the_derived_rate_is_the_measured_one_on_a_coarse_filter(spark, monkeypatch):
    class Coarse(seen.Layout):
        def __init__(self, n, remainder_bits):
            super().__init__(n, 8)
            self.quotient_bits, self.shard_bits = 10, 6

    monkeypatch.setattr(seen, "Layout", Coarse)
    rows, n = [(i, f"h.test/{i}", "", 0) for i in range(2000)], 20_000
    earlier = spark.range(n).selectExpr("concat('k.test/', id) as url", "'' as key")
    rates = seen.error_rates(seen.seen_before(spark.createDataFrame(rows, ROWS), earlier, 8), 2000, n, 8).collect()[0]
    assert rates.n_rows == 2000 and abs(rates.measured_rate - rates.derived_rate) < 0.02
