import pytest

from skein.operators import content, frontier
from skein.sources import frontier_files as files

MESSAGES = "id long, queue string"


def test_queues_are_kept_deleted_and_filled_again(spark, tmp_path):
    folder, other = str(tmp_path / "f"), str(tmp_path / "g")
    files.persist(spark.createDataFrame([(i, "hot" if i % 2 else None if i % 4 == 0 else f"q{i}") for i in range(40)], MESSAGES), folder, 4)
    assert files.restore(spark, folder).count() == 40
    files.delete_queues(spark.createDataFrame([("hot",), (None,), ("none",)], "queue string"), folder)
    files.persist(spark.createDataFrame([(100, "hot"), (101, None)], MESSAGES), folder, 4)
    want = {(i, f"q{i}") for i in range(40) if i % 4 == 2} | {(100, "hot"), (101, None)}
    assert {tuple(r) for r in files.restore(spark, folder).collect()} == want
    files.compact(spark, folder, other, 4)
    assert files.delete_persisted(spark, folder) and {tuple(r) for r in files.restore(spark, other).collect()} == want
    with pytest.raises(Exception, match="(?i)path"):
        files.restore(spark, folder).count()


def test_how_pages_are_had(spark):
    rows = [(1, True, 5.0, None, 200, 9), (2, True, None, None, 200, None), (3, False, 5.0, None, 304, 9), (4, False, None, "e", 304, None), (5, False, None, None, 304, 9), (6, False, 5.0, "e", None, 9)]
    frame = spark.createDataFrame(rows, "row_id long, use_cached boolean, fetched double, etag string, answer int, content_id long")
    assert [r.had for r in content.fetch_plan(frame).orderBy("row_id").collect()] == ["cache", "fetched", "not_modified", "again", "fetched", "fetched"]


def test_what_a_consumer_is_given(spark):
    who = spark.createDataFrame([("a",), ("b",), ("c",)], "consumer string")
    owned = spark.createDataFrame([("a", q, True, q) for q in (1, 2, 3)] + [("b", 4, True, 1), ("b", 5, False, 9), ("c", 6, True, 2), ("c", 7, True, 3)], "consumer string, queue long, active boolean, assigned long")
    free = lambda rows: spark.createDataFrame(rows, "queue long, active boolean, waiting long")
    got = lambda rows, held=owned: {r.consumer: (r.step, r.queue, r.donor) for r in frontier.load(who, free(rows), held).collect()}
    assert set(got([(9, False, 5), (8, True, 0), (7, True, 0)]).values()) == {("active", 7, None)}
    assert set(got([(9, False, 5), (8, False, 0)]).values()) == {("waiting", 9, None)}
    assert got([(8, False, 0)]) == {"a": ("donated", 7, "c"), "b": ("donated", 3, "a"), "c": ("donated", 3, "a")}
    assert set(got([], owned.filter("not active")).values()) == {("stop", None, None)}
