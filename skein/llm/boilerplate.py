"""The main body of each page, without the menus, notices, teasers and footers of its site.

A template is deduced for each site (the pages of one host, those with mark-up and those without apart). The tokens of
a page are its elements, named by their path of containers; a page without mark-up has sections as containers, named by
the form of their first line. The occurrence vector of a token over the pages of its site is kept as the exclusive or of
page hashes times counts, which can be merged from partial ones; tokens of one vector form a class. A class is valid if
it has at least two tokens and holds for at least two pages (or the site has fewer than LEAST_PAGES pages). The containers
of valid classes nest by their paths and make the template; its slots are what lies in a container and in no deeper one.

A slot's filling is the text that does not recur over the pages of its container. Slots with filling on most pages, more of it outside of links than inside, are
joined to the topmost such container around them, and the one that holds most filling, links left out, is the slot of
the main body. Inside it, texts that recur on most pages of the site, or on most pages of the sites that have them at
all, belong to the template as well (share lines, sign-ups). What is left of the slot is the body.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.ids import host_of
from skein.runtime import stage

# Elements that hold blocks, those that are links, and those whose content is no text.
CONTAINERS = frozenset("div section main article aside nav header footer table tbody thead tr td th ul ol dl form center body".split())
LINKS = frozenset(("a", "button"))
SILENT = re.compile(r"(?i)<!--|<(script|style|head|noscript|template)\b")
CLOSING = {name: re.compile(rf"(?i)</{name}\s*>" if name else "-->") for name in ("", "script", "style", "head", "noscript", "template")}
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>")
ATTRIBUTE = re.compile(r"([\w:-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAMING = frozenset("class id role itemprop width valign colspan bgcolor".split())  # attributes whose values tell containers apart
MARKUP = re.compile(r"(?i)<(?:!doctype|html|body|head|div|p|table)\b")
DEPTH = 512  # containers nested deeper count as part of the last one, as in browsers
GAP = 2  # blank lines that part the sections of a plain text
COMMON = 0.5  # share of pages from which a text belongs to the template
LEAST_PAGES = 3
SALT = 32

TOKEN, ABOVE, LINE = 0, 1, 2
PARSED = "kind int, content_id long, site long, page long, slot long, token long, n long, links long, line_no int, above array<long>, text string"


def decoded(contents: bytes | None, meta: dict | None) -> str:
    """Contents in the charset their content-type names, else UTF-8; bytes that do not fit are replaced."""
    if not contents:
        return ""
    kind = next((v for k, v in (meta or {}).items() if k and k.lower() == "content-type" and v), "")
    charset = re.search(r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", kind)
    try:
        return contents.decode(charset.group(1) if charset else "utf-8", "replace")
    except LookupError:
        return contents.decode("utf-8", "replace")


def is_markup(text: str, meta: dict | None) -> bool:
    kind = next((v for k, v in (meta or {}).items() if k and k.lower() == "content-type" and v), "").lower()
    return "html" in kind or ("plain" not in kind and bool(MARKUP.search(text)))


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def text_hash(text: str) -> int:
    """64-bit hash of a text in any letter case."""
    return hash_of(text.lower())


@functools.lru_cache(100_000)
def path_hash(above: int, name: str, attributes: str) -> int:
    """Token of a container or element below another: its name, the values of naming attributes (digits of an id count as one) and the names of the others."""
    own = []
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        own.append(f"{key}={re.sub('[0-9]+', '0', value) if key == 'id' else value}" if key in NAMING else key)
    return hash_of(f"{above}/{name}[{' '.join(sorted(own))}]")


def _blanked(text: str) -> str:
    """The text with comments, scripts, styles and the head made blank; line feeds stay. What is never closed stays as it is."""
    parts, at, unclosed = [], 0, set()
    for match in SILENT.finditer(text):
        name = (match.group(1) or "").lower()
        if match.start() < at or name in unclosed:
            continue
        end = CLOSING[name].search(text, match.end())
        if not end:
            unclosed.add(name)
            continue
        parts += [text[at : match.start()], "\n" * text.count("\n", match.start(), end.end())]
        at = end.end()
    return "".join([*parts, text[at:]]) if parts else text


def _plain(markup: str) -> str:
    text = " ".join(markup.split())
    return " ".join(html.unescape(text).split()) if "&" in text else text


class Page:
    """Slots as (token, tokens from the outermost container down to it), counts of tokens, and lines as [line_no, slot, texts, characters outside of links, characters in links]."""

    def __init__(self):
        self.slots: list[tuple[int, tuple[int, ...]]] = [(0, ())]
        self.tokens: Counter = Counter()
        self.lines: list[list] = []

    def open(self, above: int, name: str, attributes: str = "") -> int:
        token = path_hash(self.slots[above][0], name, attributes)
        self.tokens[token] += 1
        self.slots.append((token, (*self.slots[above][1], token)))
        return len(self.slots) - 1

    def element(self, above: int, name: str) -> None:
        self.tokens[path_hash(self.slots[above][0], name, "")] += 1

    def text(self, no: int, slot: int, shown: str, linked: bool) -> None:
        if not self.lines or self.lines[-1][0] != no:
            self.lines.append([no, slot, [], 0, 0])
        line = self.lines[-1]
        line[2].append(shown)
        line[4 if linked else 3] += len(shown)


def parse_markup(text: str) -> Page:
    """A page of mark-up. A line lies in the container in which its text begins; a tag may go over several lines."""
    page, body = Page(), _blanked(text)
    stack: list[tuple[str, int]] = []
    at, no, linked = 0, 1, False

    def pieces(start: int, end: int) -> None:
        nonlocal no
        between = body[start:end]
        if between.isspace():
            no += between.count("\n")
            return
        for i, piece in enumerate(between.split("\n")):
            no += i > 0
            shown = _plain(piece)
            if shown:
                page.text(no, stack[-1][1] if stack else 0, shown, linked)

    for tag in TAG.finditer(body):
        if tag.start() > at:
            pieces(at, tag.start())
        at = tag.end()
        no += tag.group().count("\n")
        closing, name = tag.group(1), tag.group(2).lower()
        if name in LINKS:
            linked = not closing
        if name not in CONTAINERS:
            if not closing:
                page.element(stack[-1][1] if stack else 0, name)
            continue
        linked = False
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
        elif len(stack) >= DEPTH:
            stack.append((name, stack[-1][1]))
        else:
            stack.append((name, page.open(stack[-1][1] if stack else 0, name, tag.group(3).rstrip("/"))))
    if at < len(body):
        pieces(at, len(body))
    return page


def line_form(shown: str, listed: bool) -> str:
    """What a line of a plain text is by its form; it stands for the name of an element."""
    if listed:
        return "list"
    if " | " in shown or shown.startswith("["):
        return "bar"
    if shown.isupper() and sum(c.isalpha() for c in shown) >= 3:
        return "headline"
    return "item" if shown.startswith(("* ", "- ")) else "text"


def parse_plain(text: str) -> Page:
    """A page without mark-up. Sections begin after GAP blank lines, at ruled lines, and at a line with a colon over a list, whose items count as links."""
    page, slot, blank, listed = Page(), -1, 0, False
    raw = text.split("\n")
    for no, line in enumerate(raw, 1):
        shown = " ".join(line.split())
        if not shown:
            blank += 1
            continue
        ruled = re.fullmatch(r"[-=_*~]{5,}", shown) is not None
        opens = blank > 0 and shown.endswith(":") and no < len(raw) and raw[no].lstrip().startswith("* ")
        form = "rule" if ruled else line_form(shown, opens)
        if ruled or opens or slot < 0 or blank >= GAP:
            slot, listed = page.open(0, form), opens
            page.element(slot, "first")
        blank = 0
        if not ruled:
            page.element(slot, form)
            page.text(no, slot, shown, form == "bar" or (listed and form == "item"))
    return page


def _parsed(with_text: bool):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        rows: list[tuple] = []
        for batch in batches:
            for content_id, host, key, contents, meta in zip(*(c.to_pylist() for c in batch.columns)):
                meta = dict(meta) if meta is not None else None
                text = decoded(contents, meta)
                if not text or text.isspace():
                    continue
                markup = is_markup(text, meta)
                read = parse_markup(text) if markup else parse_plain(text)
                site, page = hash_of(f"{host or ''}\0{markup}"), hash_of(f"{host or ''}\0{key or ''}")
                rows.append((TOKEN, None, site, page, None, 0, 1, None, None, None, None))
                rows += [(TOKEN, None, site, page, None, token, n, None, None, None, None) for token, n in read.tokens.items()]
                for slot, above in read.slots[1:]:
                    if (site, slot) not in told:  # once for each task is enough
                        told.add((site, slot))
                        rows.append((ABOVE, None, site, None, slot, None, None, None, None, above, None))
                if len(told) > 1_000_000:
                    told.clear()
                for no, slot, shown, chars, links in read.lines:
                    shown = " ".join(shown)
                    rows.append((LINE, content_id, site, page, read.slots[slot][0], text_hash(shown), chars, links, no, None, shown if with_text else None))
                if len(rows) > 50_000:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    return parse


_KINDS = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "string": pa.string()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in PARSED.split(", ")]
    return pa.record_batch([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def parsed_pages(content: DataFrame, with_text: bool = False) -> DataFrame:
    """The staged rows of every page (PARSED): its tokens, the paths of its slots, and its lines."""
    pages = content.select(
        F.col("content_id").cast("long").alias("content_id"), F.coalesce(host_of(F.col("s3_key")), F.lit("")).alias("host"), F.col("s3_key").alias("key"), "contents", "meta"
    )
    return stage(pages.mapInArrow(_parsed(with_text), PARSED), "parsed", by="kind")


def template_classes(parsed: DataFrame) -> DataFrame:
    """(site, token, n_pages) of the tokens in valid classes. Two copies of a page (of one key) count once."""
    once = parsed.filter(F.col("kind") == TOKEN).groupBy("site", "token", "page").agg(F.max("n").alias("n"))
    vectors = stage(once.groupBy("site", "token").agg(F.count(F.lit(1)).alias("n_pages"), F.bit_xor(F.xxhash64("page", "n")).alias("vector")), "vectors")
    sizes = vectors.filter("token = 0").select("site", F.col("n_pages").alias("n_site"))
    classes = vectors.filter("token <> 0").groupBy("site", "vector", "n_pages").agg(F.count(F.lit(1)).alias("n_tokens")).join(sizes, "site")
    valid = classes.filter((F.col("n_tokens") >= 2) & ((F.col("n_pages") >= 2) | (F.col("n_site") < LEAST_PAGES)))
    return vectors.filter("token <> 0").join(valid.select("site", "vector", "n_pages"), ["site", "vector", "n_pages"], "left_semi").select("site", "token", "n_pages")


def text_counts(parsed: DataFrame) -> DataFrame:
    """(site, slot, token, n, chars, links) of each text of a slot: the pages that have it and its characters outside and inside of links."""
    once = parsed.filter(F.col("kind") == LINE).groupBy("site", "slot", "token", "page").agg(F.max("n").alias("chars"), F.max("links").alias("links"))
    return once.groupBy("site", "slot", "token").agg(F.count(F.lit(1)).alias("n"), F.max("chars").alias("chars"), F.max("links").alias("links"))


def main_slots(parsed: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(site, slot, n_pages): the slots that make up the main body of a site, and the pages that have their container."""
    above = parsed.filter(F.col("kind") == ABOVE).select("site", "slot", "above").dropDuplicates(["site", "slot"])
    held = above.select("site", "slot", F.posexplode("above").alias("depth", "token"))
    around = stage(held.join(classes, ["site", "token"]), "around")  # the template's containers around each slot
    home = around.groupBy("site", "slot").agg(F.max(F.struct("depth", "token", "n_pages")).alias("home"))
    # texts of one count are one row, so that a slot of many texts is a few rows
    by_count = texts.groupBy("site", "slot", "n").agg(*[F.sum(F.col(c) * F.col("n")).alias(c) for c in ("chars", "links")], F.sum(F.when(F.col("chars") > 0, F.col("n")).otherwise(0)).alias("lines"))
    fresh = (F.col("n") < 2) | (F.col("n") * 2 <= F.col("home.n_pages"))
    filled = stage(
        by_count.join(home, ["site", "slot"]).groupBy("site", "slot", "home.token", "home.n_pages")
        .agg(*[F.sum(F.when(fresh, F.col(c)).otherwise(0)).alias(c) for c in ("chars", "lines")], F.sum("links").alias("links")),
        "filled",
    )
    direct = filled.groupBy("site", "token", "n_pages").agg(*[F.sum(c).alias(c) for c in ("lines", "chars", "links")])
    carrying = direct.filter((F.col("lines") * 2 >= F.col("n_pages")) & (F.col("chars") > F.col("links"))).select("site", "token")
    top = around.join(carrying, ["site", "token"], "left_semi").groupBy("site", "slot").agg(F.min(F.struct("depth", "token", "n_pages")).alias("top"))
    joined = top.select("site", "slot", F.col("top.token").alias("token"), F.col("top.n_pages").alias("n_pages"))
    mass = joined.join(filled.select("site", "slot", "chars", "links"), ["site", "slot"]).groupBy("site", "token").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    main = mass.filter("chars > links").groupBy("site").agg(F.max(F.struct("chars", "token")).getField("token").alias("token"))
    return joined.join(main, ["site", "token"], "left_semi").select("site", "slot", "n_pages")


def template_texts(texts: DataFrame, slots: DataFrame) -> DataFrame:
    """(site, token) of the texts in the main slots that belong to the template."""
    own = texts.join(slots, ["site", "slot"]).groupBy("site", "token").agg(F.max("n").alias("n"), F.max("n_pages").alias("n_site"))
    own = stage(own, "own")
    large = F.col("n_site") >= LEAST_PAGES
    known = own.groupBy("token").agg(
        F.count(F.lit(1)).alias("n_sites"), F.sum("n").alias("total"),
        F.sum(F.when(large, F.col("n"))).alias("with"), F.sum(F.when(large, F.col("n_site"))).alias("of"),
    ).filter("total >= 2")
    shared = (F.col("n_sites") >= LEAST_PAGES) & (F.col("with") >= COMMON * F.col("of"))
    alone = (F.col("n_sites") < LEAST_PAGES) & (F.col("n") >= LEAST_PAGES) & (F.col("n") >= COMMON * F.col("n_site"))
    return own.join(known, "token").filter(shared | alone).select("site", "token")


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def _body_lines(content: DataFrame, with_text: bool) -> DataFrame:
    parsed = parsed_pages(content, with_text)
    texts = stage(text_counts(parsed), "texts")
    slots = stage(main_slots(parsed, stage(template_classes(parsed), "classes"), texts), "slots")
    lines = parsed.filter(F.col("kind") == LINE).select("content_id", "line_no", "site", "slot", "token", "text", F.pmod("page", F.lit(SALT)).cast("int").alias("salt"))
    # a site may have a third of all lines: its few rows of slots and texts are there for every salt
    body = lines.join(_salted(slots.select("site", "slot")), ["site", "slot", "salt"], "left_semi")
    return body.join(_salted(template_texts(texts, slots)), ["site", "token", "salt"], "left_anti")


def main_body(content: DataFrame) -> DataFrame:
    """(content_id, line_no) of each line that holds text of the page's main body.

    ``content`` has content_id, s3_key, contents and meta. Null and empty contents, and pages without the slot of their
    site's main body (pages of links only), have no lines. Without meta, contents are UTF-8 and mark-up is told by its
    tags. Copies come out each. A page without s3_key belongs to the host of no name.
    """
    return _body_lines(content, False).select("content_id", "line_no")


def body_text(content: DataFrame) -> DataFrame:
    """(content_id, n_lines, body): the lines of the main body put together, without mark-up; no lines and the empty text for a page without one."""
    lines = _body_lines(content, True).select("content_id", F.struct("line_no", "text").alias("line"))
    pages = content.select(F.col("content_id").cast("long").alias("content_id"), F.lit(None).cast("struct<line_no:int,text:string>").alias("line"))
    # collect_list leaves nulls out; a page with several rows of one content_id is one
    whole = pages.union(lines).groupBy("content_id").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    return whole.select("content_id", F.size("lines").alias("n_lines"), F.array_join(F.col("lines.text"), "\n").alias("body"))
