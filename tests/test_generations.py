from skein.operators.hierarchy import depths
from skein.streaming import windows


def test_a_crawl_goes_on_until_its_frontier_is_empty(spark):
    links = [(i, i + 1) for i in range(52)] + [(0, 2), (52, 3), (100, 101), (101, 100)]
    got = windows.crawl_generations(spark, spark.createDataFrame(links, "referrer_id long, id long"), spark.createDataFrame([(0,)], "id long"))
    assert {r.id: r.generation for r in got.collect()} == {0: 0, 1: 1} | {i: i - 1 for i in range(2, 53)}


def test_depths_have_no_limit_and_leave_out_cycles(spark):
    links = [(i + 1, i) for i in range(60)] + [(101, 100), (100, 101), (102, 100), (103, 103), (1, 0), (None, 1), (5000, None)]
    got = {r.node: r.depth for r in depths(spark.createDataFrame(links, "node long, parent long")).collect()}
    assert got == {i: i for i in range(1, 61)}
