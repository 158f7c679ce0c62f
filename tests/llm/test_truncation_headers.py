from skein.llm import truncation as T

SCHEMA = "row_id long, fetcher string, url string, raw_url string, referrer_id string, response_headers map<string,string>"


def found(spark, rows):
    frame = spark.createDataFrame([(i, f, None, None, None, h) for i, (f, h) in enumerate(rows)], SCHEMA)
    return {r.row_id for r in T.cut_headers(frame).collect()}


def test_a_third_of_the_rows_cut_to_one_value(spark):
    whole = [("f", {"content-type": t}) for t in ["text/html; charset=utf-8", "text/html; charset=utf-8", "text/html"] * 60]
    hot = [("hot", {"Content-Type": "text/html; cha"})] * 90
    limit = [("hot", {"content-type": "application/oc"})]  # has no longer copy, but the length of all that is cut there
    fine = [("hot", {"content-type": "text/html"})] * 30
    rows = [*whole, *fine, *hot, *limit]
    assert found(spark, rows) == set(range(len(whole) + len(fine), len(rows)))


def test_longer_copies_that_are_rare(spark):
    cut = ["sid=77ff; Path=/; Theme=wint", "sid=77ff; Path=/; Theme=winter; Token=9a8b7", "sid=77ff; Path=/; Theme=winter; Token=9a8b7c-", "sid=77ff; Path=/; Theme=winter; Token"]
    whole = ["sid=77ff; Path=/; Theme=winter; Token=9a8b7c-x"]
    rows = [("f", {"set-cookie": v}) for v in [*cut, *whole]]
    assert found(spark, rows) == set(range(len(cut)))


def test_values_that_are_whole_beside_longer_ones(spark):
    pairs = {
        "cache-control": ["private", 'private="set-cookie"', "max-age=60", "max-age=600"], "x-robots-tag": ["noindex", "noindex, nosnippet"], "server": ["apache", "apache2", "apache/2"],
        "content-language": ["en", "en-GB"], "content-type": ["text/html", "text/html; charset=utf-8"], "content-length": ["8", "81"], "upgrade": ["h2", "h2c"],
    }
    rows = [("f", {n: v}) for n, values in pairs.items() for v in values]
    assert found(spark, rows) == set()
