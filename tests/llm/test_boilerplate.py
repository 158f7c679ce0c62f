from skein.llm import boilerplate as B

SCHEMA = "content_id long, s3_key string, contents binary, meta map<string,string>, host string, lines string, text string"
HTML = {"Content-Type": "text/html; charset=utf-8"}


def site(host, pages, menu_first=True, share="Share this page"):
    out = []
    for i in range(pages):
        menu = '<div class="main-content">\n<li><a href="/a">Home</a></li>\n<li><a href="/b">News</a></li>\n</div>'
        body = [f"<h1>Headline {i} of {host}</h1>", f'<p class="meta">By desk {i}</p>', f"<p>Some paragraph {'abcdefgh'[i % 8]} that only {host} has.</p>", f"<p>{share}</p>"]
        body += ["<ul>", f"<li>point {host} {'xyzuvwts'[i % 8]}", "</ul>", f"<pre>GET /{i}", f"Host: {host}.{i}</pre>", "<p>Yes.</p>" if i == 1 else "<!-- note -->"]
        main = '<div class="widget">\n' + "\n".join(body) + "\n</div>"
        foot = "<div class=\"foot\">\n<p>All rights reserved.</p>\n</div>"
        parts = [menu, main, foot] if menu_first else [foot, main, menu]
        out.append((f"{host}/p{i}", f"<html><head><title>Headline {i} of {host} - Site</title>\n<script>var x = '<p>no</p>';</script></head><body>\n" + "\n".join(parts) + "\n</body></html>"))
    return out


WANTED = ("Headline", "By desk", "Some paragraph", "point", "GET /", "Host: ", "Yes.")


def wanted_lines(text):
    return {n for n, line in enumerate(text.split("\n"), 1) if any(w in line for w in WANTED) and "<title>" not in line}


def test_sites_of_different_layout(spark):
    made = [p for k, h in enumerate(("a.test", "b.test", "c.test", "d.test")) for p in site(h, 6, k % 2 == 0)] + site("one.test", 1)
    rows = [(i, key, text.encode(), HTML, "x", "y", "z") for i, (key, text) in enumerate(made)]
    links = "<html><body><div class='main-content'>\n<li><a href='/a'>Home</a></li>\n</div>\n<h2>Browse</h2>\n<li><a href='/x'>x</a></li>\n</body></html>"
    rows += [(900, "a.test/links", links.encode(), HTML, "x", "y", "z"), (901, "a.test/p0", made[0][1].replace("\n", "\r\n").encode(), HTML, "", "", ""), (902, "a.test/none", None, HTML, "", "", ""), (903, None, b"", None, "", "", "")]
    rows += [(904, "a.test/p1", made[1][1].encode(), None, "", "", "")]
    got = {}
    for r in B.main_body(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        got.setdefault(r.content_id, set()).add(r.line_no)
    for i, (_, text) in enumerate(made):
        assert got[i] == wanted_lines(text), i
    assert got[901] == wanted_lines(made[0][1]) and got[904] == got[1] and not {900, 902, 903} & set(got)


def plain_page(i, head, related):
    return f"Home | News\n\n\n{head}\n\nBy desk {i}\n\nfirst line {i}\nsecond line {i}\n\n- point {i}\n\n{related}:\n* other page {i}\n* another page {i}\n\n----------\nAll rights reserved."


def test_plain_text_and_charsets(spark):
    latin = {"content-type": "text/plain; charset=iso-8859-1"}
    rows = [(1, "p.test/a", plain_page(1, "GRÜSSE AUS KÖLN", "Related").encode("latin-1"), latin, "", "", "")]
    rows += [(2, "p.test/b", plain_page(2, "NEWS OF TODAY", "Related").encode(), {"content-type": "text/plain; charset=nonsense"}, "", "", "")]
    rows += [(3, "p.test/c", b"Home | News\n\n\nRelated:\n* one\n* two\n\n----------\nAll rights reserved.", {"content-type": "text/plain"}, "", "", "")]
    rows += [(4, "p.test/d", plain_page(4, "LATE NEWS", "Most read").encode(), None, "", "", "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in B.main_body(frame).collect():
        got.setdefault(r.content_id, []).append(r.line_no)
    assert {k: sorted(v) for k, v in got.items()} == {k: [4, 6, 8, 9, 11] for k in (1, 2, 4)}
    bodies = {r.content_id: (r.n_lines, r.body) for r in B.body_text(frame).collect()}
    assert bodies[1] == (5, "GRÜSSE AUS KÖLN\nBy desk 1\nfirst line 1\nsecond line 1\n- point 1") and bodies[3] == (0, "")


def test_rows_come_from_the_classes(spark, monkeypatch):
    rows = [(i, key, text.encode(), HTML, "", "", "") for i, (key, text) in enumerate(p for h in ("a.test", "b.test") for p in site(h, 6))]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert B.main_body(frame).count() > 0
    found = B.template_classes
    monkeypatch.setattr(B, "template_classes", lambda parsed: found(parsed).limit(0))
    assert B.main_body(frame).count() == 0


def test_no_headline_is_needed(spark):
    made = [(key, text.replace("<h1>", "<p>").replace("</h1>", "</p>")) for key, text in site("a.test", 6)]
    rows = [(i, key, text.encode(), HTML, "", "", "") for i, (key, text) in enumerate(made)]
    got = {}
    for r in B.main_body(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.content_id, set()).add(r.line_no)
    assert all(got[i] == wanted_lines(text) for i, (_, text) in enumerate(made))


def test_empty_table(spark):
    assert B.main_body(spark.createDataFrame([], SCHEMA)).count() == 0 and B.body_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tags_over_several_lines():
    page = B.parse_markup('<body>\n<div\n class="nav"\n>\n<a href="/x">menu</a>\n</div>\n<!-- a\nb --><p>text &amp;\nmore</p></body>')
    assert [(no, " ".join(shown), chars, links) for no, _, shown, chars, links in page.lines] == [(5, "menu", 0, 4), (8, "text &", 6, 0), (9, "more", 4, 0)]
    assert len(page.slots) == 3 and page.lines[0][1] == 2 and page.lines[1][1] == 1


def test_markup_is_told_from_the_whole_text():
    assert B.is_markup("<!--" + "x" * 5000 + "--><p>a</p>", None) and not B.is_markup("x" * 5000, None)


def test_broken_markup_does_not_fail():
    for text in ("<div><p>x", "</div></div>text", "<div class='a><p>b</p>", "<" * 1000, "<h1>", "<title>t</title>\nt", "\x00<table><tr><td>" * 2000, '<a "' * 20_000, "<script" * 20_000, "<!--" * 20_000, "İ<script>x</script>y"):
        page = B.parse_markup(text)
        assert all(0 <= line[1] < len(page.slots) for line in page.lines) and max(len(above) for _, above in page.slots) <= B.DEPTH
    assert [line[2] for line in B.parse_markup("İ<script>x</script>y").lines] == [["İy"]]
