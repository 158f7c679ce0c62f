import datetime as dt
import os
import random

import numpy as np
import pytest

from skein.functions.ids import message_key
from skein.streaming import dedup
from skein.streaming.dedup import LAST, fold_page, repeated_deliveries

SCHEMA = "delivery_id long, msg_id string, queue string, received_at timestamp_ntz, frontier_message string, page int"
START = dt.datetime(2024, 1, 1)


def brute(rows):
    best = {}
    for d, m, q, at, *_ in rows:
        if m is None:
            continue
        bare = "".join(m.split()).strip("{}")
        k = (q, bare.lower() if len(bare) == 36 and bare.count("-") == 4 else m)
        best.setdefault(k, []).append((at is None, at or START, d))
    return {d for group in best.values() for _, _, d in sorted(group)[1:]}


def write(spark, path, rows, files):
    for i in range(files):
        part = rows[i::files] if i % 2 else rows[i::files][::-1]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_fold_page_is_the_same_in_any_batches():
    rng = np.random.default_rng(3)
    rows = np.column_stack([rng.integers(0, 20, 200), np.zeros(200), rng.integers(0, 50, 200), np.arange(200)]).astype(np.int64)
    lost = set()
    entries = np.empty((0, 5), np.int64)
    for part in np.array_split(rows, 7):
        entries, copies, _, _ = fold_page(entries, part, None)
        lost |= set(copies[:, 3])
    kept = {}
    for h, _, at, d in rows.tolist():
        kept[h] = min(kept.get(h, (at, d)), (at, d))
    assert lost == set(range(200)) - {d for _, d in kept.values()}
    assert len(entries) == 20


def test_fold_page_expires_old_entries():
    rows = np.array([[1, 1, 10, 1], [2, 1, 99, 2], [3, 1, LAST, 3]], np.int64)
    entries, *_ = fold_page(np.empty((0, 5), np.int64), rows, None)
    left, copies, claims, expired = fold_page(entries, np.array([[1, 1, 120, 4]], np.int64), 50)
    assert sorted(expired[:, 3]) == [1, 3] and len(copies) == 0 and list(claims[:, 3]) == [4]
    assert sorted(left[:, 3]) == [2, 4]


@pytest.mark.parametrize("horizon", ["1 minute", "6 hours"])
def test_stream_against_brute_force(spark, tmp_path, horizon):
    rng = random.Random(5)
    uuid = "ab%06x-1111-2222-3333-444455556666"
    rows = []
    for d in range(1, 601):
        k = rng.randrange(80)
        msg = [uuid % k, (uuid % k).upper(), "{%s}" % (uuid % k), " %s\n" % (uuid % k), str(k), None][rng.randrange(6)]
        at = None if rng.random() < 0.02 else START + dt.timedelta(seconds=d * 20 - rng.randrange(4000) * (rng.random() < 0.1))
        rows.append((d, msg, rng.choice(["a", "b", "hot", "hot", "hot", None]), at, "x" * rng.randrange(5), 7))
    path = str(tmp_path / "m.parquet")
    write(spark, path, rows, 6)
    found = repeated_deliveries(spark, path, horizon=horizon, max_bytes_per_trigger=1, pages=8)
    got = [r.delivery_id for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_rows_that_look_ups_read_grow_with_the_input_not_with_the_batches(spark, tmp_path, monkeypatch):
    files, each = 52, 60
    rows = [(i * each + j, str((i * each + j) % 2000), "q", START + dt.timedelta(minutes=i * 60 + j), None, 1) for i in range(files) for j in range(each)]
    path = str(tmp_path / "m.parquet")
    for i in range(files):
        spark.createDataFrame(rows[i * each : (i + 1) * each], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    read, lost = [], dedup._lost

    def counted(archive, claims):
        read.append((archive.count(), claims.count()))
        return lost(archive, claims)

    monkeypatch.setattr(dedup, "_lost", counted)
    folder = str(tmp_path / "state")
    found = repeated_deliveries(spark, path, horizon="1 hour", max_bytes_per_trigger=1, pages=2, folder=folder)
    assert {r.delivery_id for r in found.collect()} == brute(rows)
    assert len([f for f in os.listdir(f"{folder}/events") if f.startswith("batch=")]) >= 50
    assert sum(claims for _, claims in read) <= len(rows) and sum(archive for archive, _ in read) <= 4 * len(rows)


def test_a_kept_state_goes_on_with_the_files_that_came(spark, tmp_path):
    rng = random.Random(11)
    rows = [(d, str(rng.randrange(40)), rng.choice("ab"), START + dt.timedelta(seconds=rng.randrange(100_000)), None, 1) for d in range(300)]
    path, folder = str(tmp_path / "m.parquet"), str(tmp_path / "state")
    for upto, part in ((100, rows[:100]), (300, rows[100:])):
        write(spark, path, part, 2)
        found = repeated_deliveries(spark, path, horizon="1 hour", max_bytes_per_trigger=1, pages=4, folder=folder)
        assert {r.delivery_id for r in found.collect()} == brute(rows[:upto])
    with pytest.raises(ValueError):
        repeated_deliveries(spark, path, folder=folder)


def test_ties_and_empty(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    rows = [(3, "1", "q", START, None, None), (2, "1", "q", START, None, None), (4, "01", "q", START, None, None), (5, None, "q", START, None, None), (6, None, "q", START, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    assert [r.delivery_id for r in repeated_deliveries(spark, path).collect()] == [3]
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "e.parquet"))
    assert repeated_deliveries(spark, str(tmp_path / "e.parquet")).count() == 0


def test_message_key(spark):
    from pyspark.sql import functions as F

    values = [("{0000ABCD-0000-0000-0000-000000000000}",), (" 12 ",), (None,)]
    got = [r[0] for r in spark.createDataFrame(values, "v string").select(message_key(F.col("v"))).collect()]
    assert got == ["0000abcd-0000-0000-0000-000000000000", " 12 ", None]
