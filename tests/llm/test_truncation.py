import random

from skein.llm import truncation as T

SCHEMA = "row_id long, fetcher string, url string, raw_url string, referrer_id string, response_headers map<string,string>, value string, cut boolean"


def rows_of(rows):
    return [(i, f, u, r, p, h, "x", True) for i, (f, u, r, p, h) in enumerate(rows)]


def found(spark, rows, **more):
    return {(r.row_id, r.field_name) for r in T.cut_fields(spark.createDataFrame(rows_of(rows), SCHEMA), **more).collect()}


def test_strict_prefixes_over_ranges(spark):
    rng = random.Random(6)
    values = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(200)}
    frame = spark.createDataFrame([(v,) for v in [*values, *values, "", None]], "value string").repartition(6)
    got = {r.value for r in T.strict_prefixes(frame).collect()}
    assert got == {v for v in values if any(w != v and w.startswith(v) for w in values)}


def test_addresses(spark):
    page = "http://h.test/docs/garden-lantern.html"
    rows = [
        ("f", page, "HTTP://H.TEST:80/docs/garden-lantern.html", None, {}),  # whole
        ("f", page[:-8], page, "h.test/docs/garden-lan", {}),  # url and referrer cut
        ("f", page, page[7:-3], "h.test/docs/garden-lantern.html", {}),  # raw_url cut
        ("f", page + "?a=1", page + "?a=1", "h.test/docs", {}),  # a folder is no cut page, nor is the page without query
        (None, None, None, "", None),
        ("f", "http://h.test/docs/garden-lantern.ht", "http://h.test/docs/garden-lantern.ht", "k.test/x", {}),  # both ends agree, a longer copy elsewhere
    ]
    assert found(spark, rows) == {(1, "url"), (1, "referrer_id"), (2, "raw_url"), (5, "url"), (5, "raw_url")}
    more = spark.createDataFrame([("http://k.test/xylophone",)], "value string")
    assert (5, "referrer_id") in found(spark, rows, elsewhere=more)


def test_referrers_that_end_in_part_of_a_word(spark):
    rows = [("f", f"http://h.test/d{i}/copper-garden.html", f"http://h.test/d{i}/copper-garden.html", f"k.test/{i}/garden-copper", {}) for i in range(50)]
    tails = ["garden-cop", "garden.ht", "caf%c3%a", "caf%", "gardener", "garden"]
    rows += [("f", None, None, f"o{i}.test/x{i}/{t}", {}) for i, t in enumerate(tails)]
    rows.append(("f", None, None, "copper.ht", {}))
    assert found(spark, rows) == {(50 + i, "referrer_id") for i in range(4)}


def test_field_limits(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    rows = []
    for i in range(200):
        url = f"http://h.test/{word(rng.randrange(20, 150))}"
        rows.append(("short", url[:100], url, None, {}))
        rows.append(("long", url, url, f"h.test/{word(9)}", {}))
    got = found(spark, rows)
    assert got == {(i, "url") for i, r in enumerate(rows) if r[0] == "short" and len(r[2]) > 100}


def test_limits_below_64_characters_and_beside_longer_values(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    rows = []
    for i in range(200):
        url = f"http://h.test/{word(rng.randrange(20, 150))}"
        rows.append(("short", url[:40], url, None, {}))  # a limit of 40
        rows.append(("long", url[:120], url[:120], None, {}))  # a limit of 120, in both fields
        rows.append(("even", f"http://h.test/{i:020}", f"http://h.test/{i:020}", None, {}))  # of one length, and whole
    whole = f"http://h.test/{word(300)}"
    rows += [("short", whole, whole, None, {}), ("long", whole, whole, None, {})]  # written before the limit was there
    want = {(i, "url") for i, r in enumerate(rows) if r[0] == "short" and len(r[2]) > 40 and r[2] != whole}
    want |= {(i, f) for i, r in enumerate(rows) if r[0] == "long" and len(r[1]) == 120 for f in ("url", "raw_url")}
    got = found(spark, rows)
    # a value of the long fetcher may be shown whole by the other fetcher's row, or cut by it as its prefix
    assert {x for x in got if rows[x[0]][0] == "short"} == {x for x in want if rows[x[0]][0] == "short"}
    assert {x for x in want if rows[x[0]][0] == "long"} <= got and not any(rows[i][0] == "even" for i, _ in got)


def test_headers(spark):
    rng = random.Random(3)
    whole = [{"Content-Type": rng.choice(["text/html; charset=utf-8", "text/html", "text/css"]), "etag": f'"{i:05x}-{i * 7:05x}"', "x-robots-tag": rng.choice(["noindex", "noindex, nosnippet"]), "content-length": str(rng.randrange(9, 99999)),
              "set-cookie": f"sid={i:08x}; Path=/; Max-Age={rng.randrange(5000)}; HttpOnly; SameSite=Lax", "expires": "Wed, 20 Apr 2011 05:46:23 GMT", "link": f'<http://h.test/{i}>; rel="next"'} for i in range(150)]
    cut = [{"content-type": "text/html; cha"}, {"ETag": '"24b67f6-b2a'}, {"etag": 'W/"1'}, {"Expires": "Wed, 20 Apr 20"}, {"last-modified": "Mo"}, {"link": '<http://h.test/a>; rel="ne'}, {"link": "<http://h.test"}, {"link": '<http://h.test/a>; rel="next", <http://h.test/b>'}, {"set-cookie": "sid=00aa; Path=/; Max"}, {"set-cookie": "sid=00aa; Path=/; Max-Age=12; HttpOnly; SameSite=La"}, {"x-robots-tag": "noind"}, {"a": None, "warning": '110 - "The stor'}]
    fine = [{"expires": "0"}, {"expires": "-1"}, {"content-length": "8"}, {"etag": "", "link": None}, {"other": "anything at al"}, None]
    rows = [("f", None, None, None, h) for h in [*whole, *cut, *fine]]
    assert found(spark, rows) == {(len(whole) + i, "response_headers") for i in range(len(cut))}


def test_empty_table(spark):
    assert found(spark, []) == set()
