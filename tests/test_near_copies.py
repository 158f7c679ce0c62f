from skein.plans.content import dust_near_copies

TEXT = "<html><body><p>" + " ".join(f"garden lantern {i % 7} winter harvest" for i in range(60)) + " {}</p></body></html>"
OTHER = "<html><body><p>" + " ".join(f"{i * i} QX_{i * 7919}" for i in range(190)) + "</p></body></html>"


def test_bodies_are_compared_along_referrers(spark, tmp_path):
    pages = [(i, f"http://h.test/{i}", f"h.test/{i - 1}" if i else None) for i in range(12)]
    pages += [(12, "http://k.test/12", "h.test/7"), (13, "http://h.test/13/", "h.test/7"), (14, "http://h.test/14", "h.test/7"), (15, None, None), (16, "http://h.test/7", "h.test/0")]
    bodies = {f"h.test/{i}": TEXT.format(f"page{i}") for i in range(12)} | {"h.test/8": OTHER, "k.test/12": TEXT.format("k"), "h.test/13": TEXT.format("slash"), "h.test/14": ""}
    del bodies["h.test/10"]  # no body
    stored = [(i, k, b.encode(), {"content-type": "text/html; charset=utf-8"}) for i, (k, b) in enumerate(bodies.items())]
    stored += [(-1, "h.test/1", OTHER.encode(), {"content-type": "text/html"}), (99, None, b"x", {})]  # an earlier copy doesn't count
    kind = "text/html; charset=utf-8"
    rows = [(*p, {"content-type": kind, "content-length": "2000"}) for p in pages]  # headers alike on all pages
    spark.createDataFrame(rows, "row_id long, url string, referrer_id string, response_headers map<string,string>").write.parquet(f"{tmp_path}/crawled_urls.parquet")
    spark.createDataFrame(stored, "content_id long, s3_key string, contents binary, meta map<string,string>").write.parquet(f"{tmp_path}/crawled_content.parquet")
    got = {r.row_id: (r["count"], r.dust, r.has_digest) for r in dust_near_copies(spark, str(tmp_path)).collect()}
    assert got == {i: (i, i > 5, True) for i in range(8)} | {
        8: (0, False, True), 9: (0, False, True), 10: (0, False, False), 11: (0, False, True),
        12: (0, False, True), 13: (8, True, True), 14: (0, False, False),
    }
