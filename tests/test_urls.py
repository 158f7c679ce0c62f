from pyspark.sql import functions as F

from skein.functions import formats, urls
from skein.functions.ids import address_id, host_folded_id, host_of


def one(spark, values, *columns):
    frame = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], "a string, b string" if isinstance(values[0], tuple) else "a string")
    rows = frame.select(*columns).collect()
    return [r[0] if len(r) == 1 else tuple(r) for r in rows]


def test_canonical(spark):
    cases = {
        "HTTP://H.test:80/A/./b/../C?Q=X#f": "http://h.test/a/c?Q=X#f", "h.test": "http://h.test", "https://h.test:443/": "https://h.test/", "http://h.test:8080/x": "http://h.test:8080/x",
        " http://h.test/a/.. ": "http://h.test/", "http://h.test/../x": "http://h.test/x", "https://h.test:80/x": "https://h.test:80/x", "http://h.test?q=/../A": "http://h.test?q=/../A",
    }
    assert one(spark, list(cases), urls.canonical_url(F.col("a"))) == list(cases.values())
    assert one(spark, ["http://h.test?x#y", None], urls.rooted(urls.canonical_url(F.col("a"), drop_fragment=True))) == ["http://h.test/?x", None]


def test_reference_resolution_of_the_rfc(spark):
    base = "http://a/b/c/d;p?q"
    cases = {
        "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y",
        "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/",
        "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
        "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/../h": "http://a/b/c/h", "g?y/../x": "http://a/b/c/g?y/../x",
    }
    assert one(spark, [(base, r) for r in cases], urls.join_url(F.col("a"), F.col("b"))) == list(cases.values())


def test_parts(spark, tmp_path):
    address = address_id(F.col("a"))
    assert one(spark, ["https://H.test:8/x?y", "h.test?z", None], host_of(address)) == ["H.test", "h.test", None]
    assert one(spark, ["HTTP://H.Test/Xy", "h.TEST"], host_folded_id(F.col("a"))) == ["h.test/Xy", "h.test"]
    assert one(spark, ["h.test/a/?", "h.test//", "h.test/a?b"], urls.storage_key(F.col("a"))) == ["h.test/a", "h.test", "h.test/a?b"]
    assert one(spark, ["a.b.co.uk", "a.b.test", "localhost"], urls.registered_domain(F.col("a"))) == ["b.co.uk", "b.test", "localhost"]
    table = tmp_path / "suffixes"
    table.write_text("// a table\n\nuk\nco.uk\n*.ck\n!www.ck\nk12.ma.us  x\n")
    hosts = ["a.b.co.uk", "b.uk", "co.uk", "x.y.other.ck", "a.www.ck", "s.k12.ma.us", "t.s.k12.ma.us", "y.ma.us"]
    rules = urls.read_suffixes(str(table))
    assert one(spark, hosts, urls.registered_domain(F.col("a"), rules)) == ["b.co.uk", "b.uk", "co.uk", "y.other.ck", "www.ck", "s.k12.ma.us", "s.k12.ma.us", "ma.us"]
    assert one(spark, ["h.test/a/b?x=1&y=&x=2", "h.test/", "h.test"], urls.url_tokens(F.col("a")), urls.query_keys(F.col("a"))) == [(["h.test", "a", "b"], ["x"]), (["h.test", ""], []), (["h.test", ""], [])]
    found = one(spark, ["h.test//a/b//", "h.test:80/a?a%20b=1&a+b=2;%zz=3&=4&c"], urls.url_tokens(F.col("a")), urls.query_keys(F.col("a")))
    assert found == [(["h.test", "a", "b"], []), (["h.test:80", "a"], ["a b", "%zz", ""])]


def test_parameter_rules(spark):
    pdf = [(r"(\.pdf.*)p(?:age)?=.*?(?:&|$)", "$1")]
    cases = {"a.pdf?p=1": "a.pdf", "a.pdf?x=1&p=1": "a.pdf?x=1", "a.pdf?x=1&p=1&y=2": "a.pdf?x=1&y=2", "a.pdf?p=1&y=2": "a.pdf?y=2", "a.pdf?page=1": "a.pdf", "a.pdf?x=1&page=1&y=2": "a.pdf?x=1&y=2"}
    assert one(spark, list(cases), urls.remove_parameters(F.col("a"), pdf)) == list(cases.values())
    for pattern, cases in ((r"print=1(&|$)", {"s/?p=5&print=1&print=1": "s/?p=5", "s/?print=1&p=5": "s/?p=5"}), (r"prnt=true(&|$)", {"u?L=de&prnt=True&U=1": "u?L=de&U=1", "u?prnt=True": "u"})):
        assert one(spark, list(cases), urls.remove_parameters(F.col("a"), [(pattern, "")])) == list(cases.values())


def test_formats(spark):
    assert one(spark, ["i-1:2"], *formats.fetcher_parts(F.col("a"))) == [("i-1", "2")]
    assert one(spark, ["abc", "a", "Ab-c.d", "a_b c"], formats.is_job_name(F.col("a"))) == [True, False, True, False]
    assert one(spark, ["http://p.test/?url=http%3A%2F%2Fh.test", "http://h.test"], formats.strip_proxy(F.col("a"))) == ["http://h.test", "http://h.test"]
