"""Evaluation texts leaking into training text, found by windows of their templates.

Words of an item are turned into a template: numbers, names and units become typed placeholders; a second
template also has the words that follow a number in digits as units, which no list holds. A document's words that no item has are typed by the same rules, names by their own spelling. A word that
items have is typed by itself alone, the same in items and documents, so that windows of equal words have equal templates. All windows of
``run`` words of all item templates are hashed and joined with the windows of each document. A window that matches
is checked slot by slot: with all words equal the passage has leaked as it is; with other values, but each value of
the item always under the same value of the document and the other way round, the question was given new parameters.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.runtime import stage

RUN = 12
ITEM_BLOCK = 5_000  # items whose windows are sent to the documents; the windows of more are joined
MOST_WORDS = 8_000_000  # different words of the items that are sent to the documents as hashes, 64 MB
MAP_BITS = 29  # of the bitmap of the items' windows, 64 MB
WORD = r"[\p{L}\p{N}]+"
# Words for numbers and units.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
)
UNITS = (
    "ms s sec second seconds min minute minutes h hour hours day days week weeks month months year years byte bytes kb mb gb tb kib mib gib "
    "percent m km cm mm kg g mg usd eur dollars euros"
)
_NUM, _UNIT, _NAME, _SLOTS = 1, 2, 3, 3
_DIGITS = -1  # a number in digits, before it becomes _NUM
_NUMBERS = frozenset(NUMBER_WORDS.split())
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case."""
    import regex

    if not text:
        return []
    found = regex.findall(WORD, text) if "İ" in text else regex.findall(WORD, text.lower())
    return [w.lower() for w in found] if "İ" in text else found


def _spellings(text: str) -> Iterator[tuple[str, bool, bool]]:
    """(word in lower case, whether it is written with a capital after a lower-case word, whether with a small letter) of the words of a text."""
    import regex

    for match in regex.finditer(WORD, text):
        word = match.group()
        if word[0].isupper() and not word.isupper():
            yield word.lower(), regex.search(r"[\p{Ll}\p{N}],? $", text[max(0, match.start() - 3) : match.start()]) is not None, False
        elif word[0].islower():
            yield word, False, True


def _names(texts: list[str]) -> set[str]:
    """Words that the items write with a capital wherever they occur, at least once after a lower-case word."""
    found = [s for text in texts for s in _spellings(text)]
    return {word for word, capital, _ in found if capital} - {word for word, _, small in found if small}


@functools.lru_cache(1 << 18)
def _is_number(word: str) -> bool:
    return word in _NUMBERS or any(c.isdigit() for c in word)


def _counted(words: list[str]) -> set[str]:
    """Words that follow a number in digits."""
    return {w for before, w in zip(words, words[1:]) if any(c.isdigit() for c in before) and not _is_number(w)}


def _capitals(text: str, words: list[str]) -> set[str]:
    """Words of a text, in lower case, that it writes with a capital and not in capitals altogether."""
    import regex

    own = regex.findall(WORD, text)
    return {low for low, word in zip(words, own) if word[0].isupper() and not word.isupper()} if len(own) == len(words) else set()


class _Kinds(dict):
    """Template codes by word; a word without a code is a number in digits or 0."""

    def __missing__(self, word: str) -> int:
        return _DIGITS if _is_number(word) else 0


class Templates:
    """The windows of a block of items, sorted by hash."""

    def __init__(self, items: list[tuple[int, str | None]], run: int = RUN):
        self.run = run
        names = _names([t for _, t in items if t])
        self.named = bool(names)
        self.kinds = _Kinds(dict.fromkeys(UNITS.split(), _UNIT) | dict.fromkeys([n for n in names if not _is_number(n)], _NAME) | dict.fromkeys(_NUMBERS, _NUM))
        self.exact: list[str] = []  # the words of all items
        template, counted, item_of, starts = [], [], [], []
        for item_id, text in items:
            own = words_of(text)
            base = len(self.exact)
            units = _counted(own)
            for word in own:
                code = _NUM if _is_number(word) else self.kinds.setdefault(word, len(self.kinds) + _SLOTS + 1)
                template.append(code)
                counted.append(_UNIT if word in units and code > _SLOTS else code)
            self.exact += own
            starts.append(np.arange(base, max(base, len(self.exact) - run + 1)))
            item_of += [item_id] * len(starts[-1])
        self.template, self.counted = (np.array(codes, np.int64) for codes in (template, counted))
        at = np.concatenate(starts) if starts else np.empty(0, np.int64)
        items_at = np.array(item_of, np.int64)
        self.by_template, self.by_counted = (self._index(codes, at, items_at) for codes in (self.template, self.counted))

    def _index(self, codes: np.ndarray, at: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the windows in order, and the place and the item of each."""
        hashed = self.hashes(codes)[at] if len(at) else np.empty(0, np.uint64)
        order = np.argsort(hashed, kind="stable")
        return hashed[order], at[order], items[order]

    def hashes(self, template: np.ndarray) -> np.ndarray:
        """Hash of the window that begins at each place (0 places if the text is shorter than a window)."""
        n = len(template) - self.run + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        mixed = (template.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
        mixed ^= mixed >> np.uint64(29)
        total = np.zeros(n, np.uint64)
        for k in range(self.run):
            total = total * _MULTIPLIER + mixed[k : k + n]
        return total

    def codes(self, text: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Template codes of a document's words, and the same with each word after a number in digits as a unit.

        0 is a word no item has and no slot takes.
        """
        template = np.fromiter(map(self.kinds.__getitem__, words), np.int64, len(words))
        digits = template == _DIGITS
        template[digits] = _NUM
        after = np.concatenate([[False], digits[:-1]])  # whether the word before is a number in digits
        unknown = np.flatnonzero(template == 0)
        if self.named and len(unknown):
            capitals = _capitals(text, words)
            template[[i for i in unknown if words[i] in capitals]] = _NAME
            unknown = unknown[template[unknown] == 0]
        units = {words[i] for i in unknown[after[unknown]]}
        if units:
            template[[i for i in unknown if words[i] in units]] = _UNIT
        return template, np.where(after & (template > _SLOTS), _UNIT, template)

    def _pairs(self, codes: np.ndarray, there: np.ndarray, index: tuple, foreign: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place, place among the items, item) of the windows of equal codes, none with a foreign word."""
        hash_, at, item = index
        gone = np.concatenate([[0], np.cumsum(foreign)])
        places = np.flatnonzero(gone[self.run :] == gone[: -self.run])
        if not len(places):
            return
        hashed = self.hashes(codes)[places]
        low, high = np.searchsorted(hash_, hashed, "left"), np.searchsorted(hash_, hashed, "right")
        for place, a, b in zip(places[low < high], low[low < high], high[low < high]):
            for j in range(a, b):
                if (there[at[j] : at[j] + self.run] == codes[place : place + self.run]).all():  # else two windows of one hash
                    yield int(place), int(at[j]), int(item[j])

    def matches(self, text: str | None, changed_too: bool = True) -> dict[int, list[int]]:
        """item -> [windows with equal words, windows with consistent other values], both among the windows of equal templates"""
        words = words_of(text)
        found: dict[int, list[int]] = {}
        if len(words) < self.run or not len(self.by_template[0]):
            return found
        template, counted = self.codes(text, words)
        windows = {*self._pairs(template, self.template, self.by_template, template == 0)}
        if changed_too and (counted == _UNIT).any():
            windows |= {*self._pairs(counted, self.counted, self.by_counted, counted == 0)}
        for place, there, item in windows:
            held, own = self.exact[there : there + self.run], words[place : place + self.run]
            if held == own:
                found.setdefault(item, [0, 0])[0] += 1
            elif changed_too and len({*zip(held, own)}) == len({*held}) == len({*own}):
                found.setdefault(item, [0, 0])[1] += 1
        return found


def _word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word) - (1 << 63)


class Typing:
    """Kinds of words by the vocabulary and the names of all items, both as sorted hashes. ``Templates`` types by the same rules within a block."""

    def __init__(self, vocabulary: np.ndarray, names: np.ndarray, run: int):
        self.vocabulary, self.names, self.run = vocabulary, names, run
        self.units = frozenset(UNITS.split())

    @staticmethod
    def _among(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return held[np.minimum(np.searchsorted(held, hashes), len(held) - 1)] == hashes if len(held) else np.zeros(len(hashes), bool)

    def windows(self, text: str | None, item: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(mode, places, h1, h2, hashes of the words) of the windows by template (1) and with counted units too (2)."""
        words = words_of(text)
        if len(words) < self.run:
            return
        exact = np.fromiter(map(_word_hash, words), np.int64, len(words))
        known, named = self._among(self.vocabulary, exact), self._among(self.names, exact)
        capitals = _capitals(text, words) if len(self.names) and not item else frozenset()
        counted = _counted(words)
        kinds = np.zeros(len(words), np.int64)
        after = np.zeros(len(words), bool)  # whether the word before is a number in digits
        for i, word in enumerate(words):
            if _is_number(word):
                kinds[i] = _NUM
                after[i + 1 : i + 2] = word not in _NUMBERS
            elif named[i]:
                kinds[i] = _NAME
            elif word in self.units:
                kinds[i] = _UNIT
            elif not known[i] and word in capitals:
                kinds[i] = _NAME
            elif not known[i] and word in counted:
                kinds[i] = _UNIT
        more = np.where((kinds == 0) & (np.array([w in counted for w in words]) if item else after), _UNIT, kinds)
        for mode, own, foreign in ((1, kinds, ~known & (kinds == 0)), (2, more, ~known & (more == 0))):
            if mode == 2 and not item and not (more == _UNIT).any():
                continue
            codes = np.where(own > 0, own, exact)
            gone = np.concatenate([[0], np.cumsum(foreign)])
            places = np.flatnonzero(gone[self.run :] == gone[: -self.run])
            yield mode, places, _rolled(codes, self.run, 0)[places], _rolled(codes, self.run, 1)[places], exact


def _rolled(codes: np.ndarray, run: int, seed: int) -> np.ndarray:
    mixed = (codes.astype(np.uint64) + np.uint64(1 + seed)) * _MULTIPLIER
    mixed ^= mixed >> np.uint64(29 + seed)
    mixed *= _MULTIPLIER
    total = np.zeros(len(codes) - run + 1, np.uint64)
    for k in range(run):
        total = total * _MULTIPLIER + mixed[k : k + len(total)]
    return total ^ (total >> np.uint64(31))


WINDOW_SCHEMA = "id long, mode int, h1 long, h2 long, place int, words array<long>"


def _windows(typing, item: bool, bitmap=None, bits: int = 0, changed_too: bool = True):
    """The windows (WINDOW_SCHEMA) of (id, text); with a bitmap those whose h1 may be in it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bitmap.value if bitmap else None
        for batch in batches:
            parts: list[tuple] = []
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for mode, places, h1, h2, exact in typing.value.windows(text, item):
                    if mode == 2 and not changed_too:
                        continue
                    if held is not None:
                        at = h1 >> np.uint64(64 - bits)
                        hit = (held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
                        places, h1, h2 = places[hit], h1[hit], h2[hit]
                    run = typing.value.run
                    parts += [(row_id, mode, int(a), int(b), int(p), exact[p : p + run]) for p, a, b in zip(places, h1.view(np.int64), h2.view(np.int64))]
            columns = list(zip(*parts)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in WINDOW_SCHEMA.split(", ")])

    return find


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, capital, small) of the words of each batch of items, by the rules of ``_names``."""
    for batch in batches:
        texts = [t for t in batch.column(1).to_pylist() if t]
        rows = {w: [False, False] for t in texts for w in words_of(t)}
        for text in texts:
            for word, capital, small in _spellings(text):
                held = rows.setdefault(word, [False, False])
                held[0] |= capital
                held[1] |= small
        yield pa.record_batch({"h": pa.array(map(_word_hash, rows), pa.int64()), "capital": pa.array([r[0] for r in rows.values()], pa.bool_()), "small": pa.array([r[1] for r in rows.values()], pa.bool_())})


def _joined_passages(texts: DataFrame, items: DataFrame, run: int, changed_too: bool, most_words: int) -> DataFrame | None:
    """The passages by a join of windows, the documents read once; none if the items have more than ``most_words`` words."""
    spark = texts.sparkSession
    own = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    words = own.mapInArrow(_item_words, "h long, capital boolean, small boolean").groupBy("h").agg(F.max("capital").alias("capital"), F.max("small").alias("small"))
    words = stage(words, "words")
    if words.count() > most_words:
        return None
    of = lambda df: np.sort(np.array([r[0] for r in df.select("h").collect()], np.int64))
    typing = spark.sparkContext.broadcast(Typing(of(words), of(words.filter("capital and not small")), run))
    wanted = stage(own.mapInArrow(_windows(typing, True, changed_too=changed_too), WINDOW_SCHEMA), "windows")
    bits = min(MAP_BITS, max(15, (8 * wanted.count()).bit_length()))
    place = F.shiftrightunsigned("h1", 64 - bits)
    pieces = wanted.select(F.shiftright(place, 15).alias("piece"), place.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("map"))
    bitmap = np.zeros(1 << (bits - 3), np.uint8)  # 64 MB at most
    for piece, held in pieces.collect():
        bitmap[piece << 12 : (piece + 1) << 12] = np.frombuffer(held, np.uint8)
    found = texts.mapInArrow(_windows(typing, False, spark.sparkContext.broadcast(bitmap), bits, changed_too), WINDOW_SCHEMA).withColumnRenamed("id", "doc_id")
    there = wanted.select(F.col("id").alias("item_id"), "mode", "h1", "h2", F.col("place").alias("item_place"), F.col("words").alias("item_words"))
    pairs = found.join(there, ["mode", "h1", "h2"])
    equal = F.col("words") == F.col("item_words")
    width = lambda c: F.size(F.array_distinct(c))
    both = width(F.arrays_zip("words", "item_words"))
    changed = F.lit(changed_too) & ~equal & (both == width("words")) & (both == width("item_words"))
    told = pairs.select("doc_id", "item_id", "place", "item_place", equal.alias("equal"), changed.alias("changed")).filter("equal or changed")
    # a window that both kinds of template find counts once
    once = told.groupBy("doc_id", "item_id", "place", "item_place").agg(F.max("equal").alias("equal"), F.max("changed").alias("changed"))
    return once.groupBy("doc_id", "item_id").agg(F.count_if("equal").cast("int").alias("n_equal"), F.count_if("changed").cast("int").alias("n_changed"))


def leaked_passages(documents: DataFrame, items: DataFrame, run: int = RUN, block: int = ITEM_BLOCK, changed_too: bool = True) -> DataFrame:
    """(doc_id, item_id, n_equal, n_changed): pairs with a window of ``run`` words that match by template.

    n_equal counts the windows of the document with the words of the item, n_changed those where slots consistently
    hold other values. A unit that is in no list counts only after a number in digits. Null and short texts have no windows; repeated documents come out each; items of one text
    each match. Without ``changed_too`` only windows of equal words are kept. Only doc_id, item_id and text are read. Above ``block`` items the windows of the
    documents that the items may have are joined with theirs; repeated documents of one doc_id are then one row. Where even the items' words
    are too many to send to every task, the documents are read once for each ``block`` of items.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    joined = _joined_passages(texts.withColumnRenamed("doc_id", "id"), items, run, changed_too, MOST_WORDS) if items.count() > block else None
    if joined is not None:
        return joined
    schema = "doc_id long, item_id long, n_equal int, n_changed int"
    found = spark.createDataFrame([], schema)
    n = items.count()
    ordered = items.select("item_id", "text").orderBy("item_id")
    for start in range(0, n, block):
        held = spark.sparkContext.broadcast(Templates([tuple(r) for r in ordered.offset(start).limit(block).collect()], run))

        def probe(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [
                    (doc_id, item, *counts)
                    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for item, counts in held.value.matches(text, changed_too).items()
                ]
                columns = list(zip(*rows)) or [[]] * 4
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "n_equal", "n_changed"])

        part = texts.mapInArrow(probe, schema)
        found = part if start == 0 else found.union(part)
    return found
