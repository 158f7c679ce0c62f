import json

from skein.operators import drift
from skein.runtime import stage

SCHEMA = "raw_id long, feed string, file_no int, body string, type string, url string"


def rows_of(files, feed="f"):
    out = []
    for no, lines in files.items():
        out += [(no * 1000 + i, feed, no, line if isinstance(line, str) or line is None else json.dumps(line), "x", "clash") for i, line in enumerate(lines)]
    return out


def changes(spark, rows):
    return {(r.feed, r.file_no, r.change_kind, r.field_name) for r in drift.schema_changes(spark.createDataFrame(rows, SCHEMA)).collect()}


def page(i, **fields):
    return {"url": f"http://h.test/{i}", **fields}


def test_each_kind_of_change(spark):
    files = {
        1: [page(i, lastCrawled=f"2014-01-0{1 + i % 5}T00:00:00.250000", code=str(200 + i), flag=True, keep=1.5) for i in range(9)],
        2: [page(i, fetched=f"2014-01-0{1 + i % 5}T00:00:00.250000", code=200 + i, keep=2, extra=[1]) for i in range(9)],
        3: [page(i, crawl_time=1388534400.25 + 86400 * (i % 5), code=200 + i, keep=2, extra=[1]) for i in range(9)],
    }
    assert changes(spark, rows_of(files)) == {
        ("f", 2, "renamed", "fetched"), ("f", 2, "retyped", "code"), ("f", 2, "retyped", "keep"), ("f", 2, "removed", "flag"), ("f", 2, "added", "extra"),
        ("f", 3, "renamed", "crawl_time"), ("f", 3, "retyped", "crawl_time"),
    }


def test_thresholds_bad_lines_and_gaps(spark):
    one = [page(i, a=1) for i in range(6)]
    two = [page(i, a=1, **({"rare": 1} if i < 1 else {}), **({"third": 1} if i < 2 else {})) for i in range(6)]
    bad = ['{"url": "x", "a"', "[1]", '"text"', "", None, '{"a":1} trailing', '{"a":1,"a":2}']
    got = changes(spark, rows_of({1: one, 2: two + bad, 4: one}) + rows_of({7: one}, "g"))
    assert got == {("f", 2, "added", "third")}


def test_fields_of_nulls_and_empty_tables(spark):
    got = changes(spark, rows_of({1: [page(i, a=None) for i in range(3)], 2: [page(i, a=1) for i in range(3)]}))
    assert got == set()
    assert changes(spark, []) == set()


def test_consistent_table(spark):
    files = {1: [page(i, n="1", old=f"v{i}") for i in range(5)], 2: [page(i, n=2.5, new=f"v{i}", N=True) for i in range(5)]}
    rows = spark.createDataFrame(rows_of(files), SCHEMA)
    fields = stage(drift.line_fields(rows), "f")
    names = drift.unified_names(drift.schema_changes(rows, fields))
    types = drift.unified_types(fields, names)
    assert {tuple(r) for r in names.collect()} == {("old", "new"), ("new", "new")}
    assert {tuple(r) for r in types.collect()} == {("N", "boolean"), ("n", "string"), ("new", "string"), ("url", "string")}
    got = drift.consistent_table(rows, fields, names, types)
    assert got.count() == 10 and {r.f_new for r in got.collect()} == {f"v{i}" for i in range(5)}
    assert "f_n_2" in got.columns or "f_N" in got.columns


def test_promotion_is_a_lattice():
    kinds = [None, *drift.TYPES]
    for a in kinds:
        assert drift.promote(a, a) == a
        for b in kinds:
            assert drift.promote(a, b) == drift.promote(b, a)
            for c in kinds:
                assert drift.promote(drift.promote(a, b), c) == drift.promote(a, drift.promote(b, c))


def test_promotion_of_a_set_is_the_fold(spark):
    from functools import reduce
    from itertools import combinations

    sets = [list(c) for k in range(4) for c in combinations(drift.TYPES, k)]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, types array<string>")
    got = {r.i: r.t for r in frame.select("i", drift.promoted(frame.types).alias("t")).collect()}
    assert got == {i: reduce(drift.promote, s, None) or "string" for i, s in enumerate(sets)}


def test_names_in_long_chains_and_in_great_number(spark):
    chain = [("f", i, "renamed", f"n{i + 1:05}", f"n{i:05}") for i in range(40)]
    others = [("f", 1, "renamed", f"y{i}", f"x{i}") for i in range(12_000)] + [("f", 2, "renamed", "n00007", "z"), ("g", 2, "renamed", "n00007", "z"), ("g", 2, "added", "w", None)]
    changes = spark.createDataFrame(chain + others, "feed string, file_no int, change_kind string, field_name string, old_name string")
    got = {r.field: r.name for r in drift.unified_names(changes).collect()}
    assert {got[f"n{i:05}"] for i in range(41)} | {got["z"]} == {"n00007"} and all(got[f"x{i}"] == f"y{i}" for i in range(0, 12_000, 997)) and "w" not in got


def test_a_rename_is_seen_by_any_of_the_values_of_an_address(spark):
    files = {1: [page(i, old=v) for i in range(6) for v in (f"a{i}", f"m{i}", f"z{i}")], 2: [page(i, new=v) for i in range(6) for v in (f"b{i}", f"m{i}", f"y{i}")]}
    assert changes(spark, rows_of(files)) == {("f", 2, "renamed", "new")}
