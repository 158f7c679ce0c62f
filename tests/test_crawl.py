import datetime as dt

import pytest
from pyspark.sql import functions as F

from skein.config import JobLayout, JobSettings, Scope, read_sections, url_rules
from skein.operators import admission, content, extract, frontier, jobs, outcomes, redundancy
from skein.sources import versions

LIST = "stray\n[Global]\nName: j\n<> Version: 1\nMaxFetchRate: 60\n\n[IncludeDomains]\nh\\.test\n[UrlTransformations]\n{(?P<begin>\\.pdf.*)p=.*}: {RemoveParam}\n"


def test_config():
    assert read_sections(LIST)["IncludeDomains"] == ["h\\.test"]
    settings = JobSettings.parse(LIST)
    assert (settings.name, settings.version, settings.max_fetch_rate, settings.max_attempts) == ("j", 2, 1.0, 2)
    rule = url_rules(LIST)[0]
    assert rule.removes_parameter and rule.replacement == "${begin}" and rule.pattern.endswith("?(&|$)")
    with pytest.raises(ValueError):
        JobLayout("/tmp", "no good name")


def test_scope_has_each_branch(spark):
    scope = Scope(include_domains=(r"h\.test|^k\.test",), include_urls=(r"[^/]*/in",), exclude_domains=("bad",), exclude_urls=(r"[^/]*/(de|in/de)",))
    cases = {
        "ftp://h.test/": -2, "http://o.test/": -2, "http://bad.h.test/x": -4, "http://bad.h.test/in": 1, "http://h.test/de": -1, "http://h.test/in/de": -1, "http://h.test/x": 1,
        "http://o.test/in": 1, "http://ak.test/": -2, None: None,
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select(admission.scope_class(F.col("u"), scope)).collect()
    assert [r[0] for r in rows] == list(cases.values())


def test_robots(spark):
    rules = [("h", "*", "disallow", "/a"), ("h", "*", "allow", "/a/b"), ("h", "*", "disallow", "/*.gif$"), ("k", "me", "disallow", "/x"), ("k", "*", "disallow", "/"), ("t", "*", "allow", "/p"), ("t", "*", "disallow", "/p")]
    urls = {("h/a", "h"): False, ("h/a/b?c", "h"): True, ("h/i.gif", "h"): False, ("h/i.gif?x", "h"): True, ("k/y", "k"): True, ("k/X1", "k"): False, ("t/p", "t"): True, ("u/", "u"): True, ("h", "h"): True}
    frame = spark.createDataFrame(list(urls), "id string, domain string")
    got = admission.robots_allowed(frame, spark.createDataFrame(rules, "domain string, agent string, rule string, path string"), "Me/1.0")
    assert {(r.id, r.domain): r.allowed for r in got.collect()} == urls


def test_traps_and_reasons(spark):
    rows = spark.createDataFrame([("h/a/b/a/c/a",), ("h/a/b",), ("h/" + "/".join(map(str, range(21))),), ("h",)], "id string")
    assert [r[0] for r in rows.select(admission.is_spider_trap(F.col("id"))).collect()] == [True, False, True, False]


def test_admission_order(spark):
    links = spark.createDataFrame([("h.test/a", "http://h.test/a"), ("h.test/a", "http://h.test/a"), ("h.test/s", "http://h.test/s"), ("o.test/", "http://o.test/"), ("h.test/r", "http://h.test/r")], "id string, link string")
    rules = spark.createDataFrame([("h.test", "*", "disallow", "/r")], "domain string, agent string, rule string, path string")
    got = admission.admit(links, spark.createDataFrame([("h.test/s",)], "id string"), Scope(include_domains=("h",)), rules, "me")
    assert {r.id: r.reason for r in got.collect()} == {"h.test/a": None, "h.test/s": 0, "o.test/": -2, "h.test/r": -5}


def test_edges_drop_self_and_repeats(spark):
    pages = spark.createDataFrame([(1, "http://h.test/a", '<a href="/b"><a HREF=\'/b#x\'><a href="a">'), (2, "http://h.test", None)], "page_id long, url string, body string")
    assert [(r.page_id, r.id) for r in extract.link_edges(extract.html_links(pages)).collect()] == [(1, "h.test/b")]


def log(spark, rows):
    return spark.createDataFrame([(i, u, r) for i, (u, r) in enumerate(rows)], "seq long, id string, redundant boolean")


def redundant(spark, rows, url, **thresholds):
    supports = redundancy.support(log(spark, rows))
    return redundancy.probe(spark.createDataFrame([(url,)], "id string"), supports, **thresholds).collect()[0].redundant


def test_redundant_paths_and_parameters(spark):
    at = dict(path=10, file=20, parameter=2)
    nine = [(f"h/a/p{i}", True) for i in range(9)]
    assert not redundant(spark, nine, "h/a/new", **at)
    ten = [*nine, ("h/a/p9", True)]
    assert redundant(spark, ten, "h/a/new", **at)
    assert not redundant(spark, [*ten, ("h/a/q", False)], "h/a/new", **at)
    keys = [("h/b?k=1", True), ("h/b?k=2", True)]
    assert redundant(spark, keys, "h/b?k=3&z=1", **at) and not redundant(spark, keys, "h/b?z=1", **at)
    assert not redundant(spark, [*keys, ("h/b?k=9", False)], "h/b?k=3", **at)
    # pinned by a second plain insert, whatever comes later
    assert not redundant(spark, [("h/c?k=1", False), ("h/c?k=2", False), *[("h/c?k=3", True)] * 5], "h/c?k=4", **at)


def test_redundancy_of_files_and_of_paths_with_plain_inserts(spark):
    # a path that a plain insert has come to twice gives no support, another one below it does
    at = dict(path=10, file=20, parameter=2)
    plain = [("h/one/p1", False)] * 2 + [(f"h/one/p{i}", True) for i in range(2, 12)]
    assert not redundant(spark, plain, "h/one/p12", **at)
    more = plain + [(f"h/p{i}/p1", True) for i in range(2, 12)]
    assert not redundant(spark, more, "h/p12/p1", **at)
    more += [("h/p8/p1", True)] * 9
    assert redundant(spark, more, "h/p8/p1", **at) and not redundant(spark, more, "h/p9/p1", **at)
    # a slash at the end makes no other file; a bare host is a path too
    at = dict(path=10, file=4, parameter=2)
    assert redundant(spark, [("h/f/", True), ("h/f", True)] * 2, "h/f//", **at)
    assert redundant(spark, [("h", True), ("h/", True)] * 2, "h", **at)
    # keys that are shared, and those that a plain insert came to
    one = [("h/f?p1=1&p2=2", True)]
    assert not redundant(spark, one, "h/f?p1=1&p4=4", **at)
    two = [*one, ("h/f?p1=1&p3=3", True)]
    assert redundant(spark, two, "h/f?%701=1&p4=4", **at)
    assert not redundant(spark, [*two, ("h/f?p1=1&p4=4", False)], "h/f?p1=1&p4=4", **at)
    at = dict(path=50, file=50, parameter=2)
    pinned = [("h/f?p1=1&p2=1", False)] * 2 + [(f"h/f?p1=1&p2={i}", True) for i in (2, 3, 4)]
    assert not redundant(spark, pinned, "h/f?p1=1&p2=5", **at)


def test_redundancy_as_of_uses_earlier_inserts_only(spark):
    rows = [(f"h/a/p{i}", True) for i in range(5)]
    got = {r.seq: r.redundant for r in redundancy.probe_as_of(log(spark, rows), path=3, file=9, parameter=9).collect()}
    assert got == {0: False, 1: False, 2: False, 3: True, 4: True}
    bulk = [(f"h/{a}/{b}", True) for a in range(10) for b in range(10)]
    assert redundancy.created(log(spark, bulk + bulk[:7])).collect()[0].n_urls == 100


def test_similar_runs(spark):
    rows = [(1, None, 100, None)] + [(i, i - 1, 100 + i, True) for i in range(2, 8)] + [(8, 7, 300, True), (9, 8, 301, True), (10, 9, 302, False), (11, 10, 302, None)]
    got = {r.id: r["count"] for r in content.similar_runs(spark.createDataFrame(rows, "id long, parent long, size int, similar boolean")).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6, 8: 0, 9: 1, 10: 0, 11: 0}


def test_digest_is_near_for_near_texts(spark):
    text = ("the quick brown fox jumps over the lazy dog " * 8).encode()
    rows = [("a", text), ("b", text), ("c", text[:-9] + b"small cat"), ("d", bytes(range(256)) * 2), ("e", None), ("f", b"ab")]
    got = {r.key: r.digest for r in content.nilsimsa(spark.createDataFrame(rows, "key string, body binary")).collect()}
    assert all(len(d) == 64 for d in got.values()) and got["a"] == got["b"] and got["e"] == "0" * 64
    pairs = spark.createDataFrame([(got["a"], got["b"]), (got["a"], got["c"]), (got["a"], got["d"])], "x string, y string")
    same, near, far = (r[0] for r in pairs.select(content.hex_similarity(F.col("x"), F.col("y"))).collect())
    assert same == 1.0 and near > 0.85 > far


@pytest.mark.parametrize("codec", content.CODECS)
def test_content_round_trip(spark, codec):
    rows = spark.createDataFrame([("k", b"body \xc3\xa9"), ("n", None)], "key string, body binary")
    back = content.unpack_bodies(content.pack_bodies(rows, codec), codec)
    assert {(r.key, bytes(r.body) if r.body else None) for r in back.collect()} == {("k", b"body \xc3\xa9"), ("n", None)}
    with pytest.raises(ValueError):
        content.pack_bodies(rows, "zip")


def test_cache_decision(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(None, None, None), (1, 9, None), (1, 4, None), (4, 4, -90), (1, 4, 0)]
    at = lambda d: None if d is None else day + dt.timedelta(days=d)
    frame = spark.createDataFrame([tuple(map(at, r)) for r in rows], "f timestamp, e timestamp, m timestamp")
    now = F.lit(at(5))
    assert [r[0] for r in frame.select(content.use_cached(F.col("f"), F.col("e"), F.col("m"), now)).collect()] == [False, True, False, True, False]


def test_store_keeps_the_last_row_of_a_key(spark):
    rows = [("h/a/", "http://h/a/", "self", b"1", {"Content-Type": "t", "X": "y"}, 1.0), ("h/a", "http://h/a", "h/b/", b"2", {}, 2.0)]
    got = content.store_rows(spark.createDataFrame(rows, "id string, url string, original string, body binary, response_headers map<string,string>, fetched double")).collect()
    assert len(got) == 1 and got[0].key == "h/a" and bytes(got[0].body) == b"2" and got[0].meta == {"original_url": "http://h/a", "original": "h/b"}


def test_retries(spark):
    rows = [("", 200, 0), ("", 410, 0), ("", 503, 0), ("timeout", None, 0), ("timeout", None, 1), ("request", None, 0), ("", None, 0)]
    frame = spark.createDataFrame(rows, "e string, s int, a int")
    got = [r[0] for r in frame.select(outcomes.retry(F.col("e"), F.col("s"), F.col("a"))).collect()]
    assert got == ["done", "failed", "requeue", "requeue", "failed", "failed", "done"]


def test_redirect_chains(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(25)] + [("s", "s"), ("a", "b"), ("b", "a")]
    got = {r.id: r for r in outcomes.redirect_chains(spark.createDataFrame(chain, "id string, target string")).collect()}
    assert (got["n20"].final_id, got["n20"].hops) == ("n25", 5) and (got["n0"].final_id, got["n0"].hops) == ("n20", 20)
    assert got["n0"].too_many and got["n4"].too_many and not got["n5"].too_many and (got["n5"].final_id, got["n5"].hops) == ("n25", 20)
    assert got["s"].looped and got["s"].hops == 1 and got["a"].looped and got["a"].hops == 2 and len(got) == 28


def test_outcomes_are_written_once_per_batch(spark, tmp_path):
    layout = JobLayout(str(tmp_path), "job")
    rows = spark.createDataFrame([("u1", "crawled"), ("u2", "failed"), ("u3", "crawled")], "url string, outcome string")
    for _ in range(2):
        outcomes.save_outcomes(rows, layout, batch=1)
    assert spark.read.parquet(layout.path("crawled_urls")).count() == 2
    assert layout.destroy(spark)


def test_queue_states(spark):
    rows = [("a", i, i > 1) for i in range(8)] + [("b", 1, True), ("c", 1, False)]
    got = {r.queue: (r.empties, r.skips, r.active, r.presumed_active) for r in frontier.queue_states(spark.createDataFrame(rows, "queue string, at long, empty boolean"), "queue", "at", F.col("empty")).collect()}
    assert got == {"a": (3, 0, False, False), "b": (1, 0, False, False), "c": (0, 0, True, True)}


def test_jobs(spark):
    lines = spark.createDataFrame([(" http://H.test ",), ("",), ("h.test/",)], "value string")
    assert [(r.id, r.is_seed) for r in jobs.read_seeds(lines, F.lit(0.0)).collect()] == [("h.test/", True)]
    rows = spark.createDataFrame([("h/robots.txt", "http://h/robots.txt"), ("h/x", "http://h/x"), ("k/y", "http://k/y")], "id string, url string")
    store = spark.createDataFrame([("h/x",), ("k/y",)], "key string")
    kept, out, left = jobs.purge(rows, store, Scope(include_domains=("k",)))
    assert {r.id for r in kept.collect()} == {"h/robots.txt", "k/y"} and {r.id for r in out.collect()} == {"h/x"} and {r.key for r in left.collect()} == {"k/y"}
    back, stay = jobs.requeue_skipped(spark.createDataFrame([("http://k/1", "k/1", -2), ("http://k/2", "k/2", -5)], "raw_url string, id string, reason int"), Scope(include_domains=("k",)))
    assert [r.id for r in back.collect()] == ["k/1"] and [r.id for r in stay.collect()] == ["k/2"]


def test_message_codec(spark):
    rows = spark.createDataFrame([(1, "http://h", True)], "id long, url string, seed boolean")
    packed = rows.select("id", versions.pack_message(F.struct("url", "seed")).alias("m")).union(spark.createDataFrame([(2, "%%%"), (3, None), (4, "WzFd"), (5, "eyJ1cmwi")], "id long, m string"))
    got = {r.id: (r.corrupt, r.record.url if r.record and not r.corrupt else None) for r in versions.unpack_messages(packed, "m", "url string, seed boolean").collect()}
    assert got == {1: (False, "http://h"), 2: (True, None), 3: (True, None), 4: (True, None), 5: (True, None)}
    with pytest.raises(ValueError):
        versions.read_rows(rows, 9)


def test_reports(spark):
    from skein.operators import reports

    gauges = spark.createDataFrame([("c1", 2, 3.5)], "consumer string, a long, b double")
    got = {(r.name, r.unit, tuple(r.dimensions.items()), r.value) for r in reports.metric_rows(gauges, {"a": "Count", "b": "Count/Second"}, "consumer").collect()}
    assert got == {("a", "Count", (("consumer", "c1"),), 2.0), ("b", "Count/Second", (("consumer", "c1"),), 3.5)}
    plan = reports.assignment_plan(spark.createDataFrame([("a", False, 0), ("b", True, 0), ("c", False, 5), ("d", True, 1)], "queue string, active boolean, waiting long"), 3)
    assert {r.queue: r.consumer_no for r in plan.collect()} == {"b": 0, "d": 1, "c": 2, "a": 0}
    files = spark.createDataFrame([("h", 0.0, 9e9, False), ("h", 10.0, 9e9, True), ("k", 0.0, 9e9, False)], "domain string, at double, expires double, failed boolean")
    assert {r.domain: r.refetch for r in reports.robots_cache(files, F.lit(4000.0)).collect()} == {"h": True, "k": False}
    assert reports.latest(spark.createDataFrame([], "image string, created long"), "created", "image").count() == 0


def test_crawl_step_and_its_stream(spark, tmp_path):
    import base64
    import json

    from skein.streaming import windows
    from skein.streaming.crawl import crawl_step, run_crawl

    def message(url):
        return base64.b64encode(json.dumps({"url": url, "id": url.split("://")[1]}).encode()).decode()

    rows = [(1, message("http://h/a")), (2, message("http://h/a")), (3, message("http://o/x")), (4, "broken"), (5, message("http://h/gone")), (6, message("http://h/new")), (7, None)]
    messages = spark.createDataFrame(rows, "delivery_id long, frontier_message string")
    crawled = spark.createDataFrame([("h/a", 200), ("h/gone", 410)], "id string, http_status int")
    bodies = spark.createDataFrame([("h/a", 9)], "key string, content_id long")
    scope = Scope(include_domains=("h",))
    routed, dead = crawl_step(messages, crawled, bodies, scope)
    want = {"h/a": ("crawled", 9), "o/x": ("skipped", None), "h/gone": ("failed", None), "h/new": ("requeue", None)}
    assert {r.id: (r.outcome, r.content_id) for r in routed.collect()} == want
    assert {r.delivery_id for r in dead.collect()} == {4, 7}
    path = str(tmp_path / "m.parquet")
    for part in (rows[:3], rows[1:5], rows[5:]):
        spark.createDataFrame(part, messages.schema).coalesce(1).write.mode("append").parquet(path)
    stream = windows.read_stream(spark, path, messages.schema, 1)
    folder = run_crawl(stream, crawled, bodies, scope, windows.run_batches)
    got = [(r.id, r.outcome, r.delivery_id) for r in spark.read.parquet(f"{folder}/routed").collect()]
    alive = sorted((i, o) for i, o, _ in got if o != "dead")
    assert alive == sorted((i, o) for i, (o, _) in want.items()) and sorted(d for *_, o, d in got if o == "dead") == [4, 7]


def test_a_failed_fetch_is_tried_again_in_a_later_batch(spark, tmp_path):
    import base64
    import json

    from skein.streaming import windows
    from skein.streaming.crawl import run_crawl

    pack = lambda i: base64.b64encode(json.dumps({"url": f"http://h/{i}", "id": f"h/{i}"}).encode()).decode()
    parts = [[(1, "slow"), (2, "ok"), (3, "late")], [(4, "slow"), (5, "slow"), (6, "ok")], [(7, "late"), (8, "slow")]]
    path, schema = str(tmp_path / "m.parquet"), "delivery_id long, frontier_message string"
    for part in parts:
        spark.createDataFrame([(d, pack(i)) for d, i in part], schema).coalesce(1).write.mode("append").parquet(path)
    stream = windows.read_stream(spark, path, spark.read.parquet(path).schema, 1)
    answers = spark.createDataFrame([("h/slow", 503), ("h/ok", 200), ("h/late", 500)], "id string, http_status int")
    folder = run_crawl(stream, answers, spark.createDataFrame([], "key string, content_id long"), Scope(include_domains=("h",)), windows.run_batches, pages=2)
    got = {(r.id, r.outcome, r.delivery_id) for r in spark.read.parquet(f"{folder}/routed").collect()}
    assert got == {("h/slow", "requeue", 1), ("h/ok", "crawled", 2), ("h/late", "requeue", 3), ("h/slow", "failed", 4), ("h/late", "failed", 7)}


def test_late_rows_are_those_behind_the_watermark(spark, tmp_path):
    from pyspark.sql import types as T

    from skein.streaming import windows

    at = lambda m: None if m is None else dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=m)
    parts = [[(1, 600), (2, 0)], [(3, 539), (4, 541), (5, None), (6, 900)], [(7, 839), (8, 840)]]
    schema = T.StructType.fromDDL("k long, at timestamp")
    for part in parts:
        spark.createDataFrame([(k, at(m)) for k, m in part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        windows.continue_to_end(windows.split_late(windows.read_stream(spark, f"{tmp_path}/in", schema, 1 << 60), "k", "at", "1 hour", 3), str(tmp_path))
    got = {r.k: r.side for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {k: "late" if k in (3, 7) else "main" for k in range(1, 9)}


def test_fetch_seam(spark):
    from skein.sources import fetch

    def echo():
        """A fetcher, made inside the task."""
        from skein.sources.fetch import Answer

        class Echo:
            def fetch(self, url, headers):
                if "slow" in url:
                    raise TimeoutError
                if "bad" in url:
                    raise ValueError
                return Answer(200, headers={"etag": headers.get("If-None-Match", "")}, body=url.encode())

        return Echo()

    rows = spark.createDataFrame([("a", "http://a", {"If-None-Match": "1"}, "q"), ("s", "http://slow", None, "q"), ("b", "http://bad", {}, "r")], "id string, url string, request_headers map<string,string>, queue string")
    got = {r.id: (r.http_status, r.error, r.body and bytes(r.body)) for r in fetch.fetch_rows(rows, echo, "queue").collect()}
    assert got == {"a": (200, "", b"http://a"), "s": (None, "timeout", None), "b": (None, "request", None)}
    pages = spark.createDataFrame([("a", 200, {"x": "y"}, b"1")], "key string, http_status int, headers map<string,string>, body binary")
    got = {r.id: (r.http_status, r.error) for r in fetch.fetch_from_table(rows, pages).collect()}
    assert got == {"a": (200, ""), "s": (None, "timeout"), "b": (None, "timeout")}


def test_links_are_those_of_elements(spark):
    page = """<html><!-- <a href="/no1"> --><base href='http://b/x/'><script src="s.js?a=1&amp;b=2">var t = '<a href="/no2">';</script>
      <style>a { background: url(/no3) }</style><a title='href="/no4"' href="one&#47;two">1</a><img data-src="/no5" src=p.png><a
      href = "/three">3</a><p>href="/no6"</p><a href="caf&eacute;">4</a><object data="http://o/f?x=1&amp;y=2"></object></html>"""
    pages = spark.createDataFrame([(1, "http://h/p", page, "text/html; charset=x"), (2, "http://h/c.css", "a{background:url(q.png)}", "TEXT/CSS"), (3, "http://h/m.txt", "http://h/z", "sitemap"), (4, "http://h/j", page, "text/plain"), (5, "http://h/n", None, None)], "page_id long, url string, body string, content_type string")
    got = {(r.page_id, r.link) for r in extract.extract_links(pages).collect()}
    assert got == {(1, f"http://b/{x}") for x in ("x/", "x/s.js?a=1&b=2", "x/one/two", "x/p.png", "three", "x/café")} | {(1, "http://o/f?x=1&y=2"), (2, "http://h/q.png"), (3, "http://h/z")}


def test_links_of_dust_are_skipped(spark):
    links = spark.createDataFrame([(1, "h/a", "h/b"), (1, "h/a", "k/b"), (2, "h/c", "H/d"), (3, "h/e", "h/f")], "page_id long, referrer_id string, id string")
    runs = spark.createDataFrame([(1, True, True), (2, False, True)], "page_id long, dust boolean, has_digest boolean")
    got = {(r.page_id, r.id): (r.reason, r.carries) for r in content.dust_skips(links, runs).collect()}
    assert got == {(1, "h/b"): (-6, False), (1, "k/b"): (-6, False), (2, "H/d"): (None, True), (3, "h/f"): (None, False)}


def test_a_run_without_a_beginning_counts_as_endless(spark):
    rows = [(1, 2, 5, True), (2, 1, 5, True), (3, 1, 5, True), (4, 3, 900, True), (5, None, 5, None)]
    got = {r.id: r["count"] for r in content.similar_runs(spark.createDataFrame(rows, "id long, parent long, size int, similar boolean")).collect()}
    assert got == {1: content.ENDLESS, 2: content.ENDLESS, 3: content.ENDLESS, 4: 0, 5: 0}
