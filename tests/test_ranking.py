import random

from pyspark.sql import functions as F

from skein.operators.ranking import place, previous, running_sums


def test_groups_over_many_parts(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.randrange(9)) for i in range(500)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, o long, v long").repartition(7)
    groups = {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(k, []).append((o, v))
    want_sum, want_place, want_last = {}, {}, {}
    for own in groups.values():
        total = 0
        for i, (o, v) in enumerate(own):
            want_sum[o], want_place[o], want_last[o] = total, i + 1, own[i - 1][1] if i else None
            total += v
    assert {r.o: r.s for r in running_sums(frame, ["k"], ["o"], {"s": F.col("v")}, inclusive=False).collect()} == want_sum
    assert {r.o: r.rn for r in place(frame, ["k"], ["o"]).collect()} == want_place
    assert {r.o: r.last for r in previous(frame, ["k"], ["o"], "v", "last").collect()} == want_last
    assert sorted(r.rn for r in place(frame, [], ["o"]).collect()) == list(range(1, 501))
    assert place(frame.filter("false"), ["k"], ["o"]).count() == 0
