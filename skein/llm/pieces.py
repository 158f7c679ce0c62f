"""Items over a size limit, cut into pieces at natural boundaries.

The least number of pieces gives equal targets; each target moves to the strongest boundary near it. If a piece is
over the limit, counted anew on its own text, or a cut falls inside a word though a better place was in reach, one
piece more is tried. Where TRIES such layouts have a piece over the limit, pieces are laid out one after another: the
rest of the text is shared out anew after each, and a piece that is over the limit gives up tokens until it fits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.tokens import Vocabulary

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True  # white space of one byte
# Strength of the place after a match, strongest last so that it overwrites. White space of one byte (1) is found without a pattern.
BOUNDARIES = [
    (1, re.compile(r"[^\S\x00-\x7f]+")),
    (2, re.compile(r"[,;:)\]}、，；：]+\s*")),
    (3, re.compile(r"[.!?…]+[\"')\]]*\s+|[。！？]+[”」]*\s*")),
    (4, re.compile(r"\s*(?:\r\n|\r|\n)\s*")),
    (5, re.compile(r"(?:[ \t]*(?:\r\n|\r|\n)){2,}\s*")),
]
TRIES = 16
LEAST_ROOM = 8  # tokens that a piece has beside the overlap; a character has four at most
PIECE_SCHEMA = "doc_id long, piece_no int, n_pieces int, n_tokens int, start_char int, end_char int, boundary int, text string"


def _strengths(text: str, data: np.ndarray, ends: np.ndarray, to_byte: np.ndarray | None) -> np.ndarray:
    """Strength of the cut after each token: -1 inside a character, 0 inside a word, up to 5 between paragraphs.

    ``data`` has the bytes of the text, ``to_byte`` the byte of each character (none if all are ASCII).
    """
    at_byte = np.zeros(len(data) + 1, np.int8)
    if to_byte is not None:
        at_byte[:] = -1
        at_byte[to_byte] = 0
    space = SPACES[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    at_byte[edge] = 1
    byte = (lambda c: c) if to_byte is None else to_byte.__getitem__
    for strength, pattern in BOUNDARIES:
        for match in pattern.finditer(text):
            # white space goes with the token after it, so a cut before the white space counts as well
            bare = match.start() + len(match.group().rstrip()) if strength in (2, 3) else match.start()
            at_byte[byte(match.end())] = at_byte[byte(bare)] = strength
    return at_byte[ends]


def cut(text: str, encode, table_lengths: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start_char, end_char, n_tokens, boundary) of each piece; boundary is the strength of its end."""
    tokens = np.asarray(encode(text), np.int64)
    n = len(tokens)
    if n <= limit:
        return [(0, len(text), n, 5)]
    ends = np.cumsum(table_lengths[tokens])
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    to_byte = None if len(data) == len(text) else np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    strength = np.concatenate([[5], _strengths(text, data, ends, to_byte)])  # by number of tokens before the cut
    char_of = ends if to_byte is None else np.searchsorted(to_byte, ends)
    at_char = lambda t: int(char_of[t - 1]) if t else 0
    step = limit - overlap
    least = -(-(n - overlap) // step)
    best = None
    for m in range(least, least + TRIES):
        pieces, start, fits, clean = [], 0, True, True
        for i in range(1, m + 1):
            if i == m or start + limit >= n and i > 1 and n - start <= limit:
                stop = n
            else:
                target = overlap + round(i * (n - overlap) / m)
                low = max(start + overlap + 1, n - (m - i) * step)
                high = min(start + limit, n - 1)
                near = np.arange(max(low, target - limit // 8), min(high, target + limit // 8) + 1)
                wide = np.arange(low, high + 1)
                if not len(near) or strength[near].max() < 1:
                    near = wide
                near = near[strength[near] >= 0] if len(near) else near
                if not len(near):
                    fits = False
                    break
                stop = int(near[np.lexsort((np.abs(near - target), -strength[near]))[0]])
                # inside a word though the piece holds a better place: more pieces leave more room
                clean &= strength[stop] > 0 or strength[start + overlap + 1 : high + 1].max() < 1
            pieces.append((start, stop))
            if stop == n:
                break
            start = stop - overlap
            while strength[start] < 0:
                start -= 1
        if not fits or pieces[-1][1] != n:
            continue
        found = []
        for start, stop in pieces:
            a, b = at_char(start), at_char(stop)
            found.append((a, b, len(encode(text[a:b])), int(strength[stop]) if stop < n else 5))
        if max(p[2] for p in found) > limit:
            continue
        best = best or found
        if clean:
            return found
    return best or _one_by_one(text, encode, strength, at_char, limit, overlap)


def _one_by_one(text: str, encode, strength: np.ndarray, at_char, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Pieces from the start on, each within the limit whatever its text: the last resort of ``cut``."""
    n, start, last, found = len(strength) - 1, 0, 0, []
    high = min(limit, n)
    while last < n:
        if high <= last:  # even a few tokens after the overlap are too many: this piece begins without one
            start, high = last, min(last + limit, n)
        low = max(start + overlap, last) + 1
        rest = max(1, -(-(n - start - overlap) // (limit - overlap)))  # pieces that the rest takes at least
        target = high if high == n else min(high, max(low, start + overlap + round((n - start - overlap) / rest)))
        near = np.arange(max(low, target - limit // 8), high + 1) if high < n else np.array([n])
        near = near[strength[near] >= 0]
        if not len(near):
            near = np.array([i for i in range(last + 1, high + 1) if strength[i] >= 0][-1:] or [last + 1 + int(np.argmax(strength[last + 1 :] >= 0))])
        stop = int(near[np.lexsort((np.abs(near - target), -strength[near]))[0]])
        n_tokens = len(encode(text[at_char(start) : at_char(stop)]))
        if n_tokens > limit and (start < last or stop > start + LEAST_ROOM):
            high = stop - max(1, n_tokens - limit)
            if start == last:
                high = max(high, start + LEAST_ROOM)
            continue
        found.append((at_char(start), at_char(stop), n_tokens, int(strength[stop]) if stop < n else 5))
        last, start = stop, max(stop - overlap, start + 1)
        while strength[start] < 0:
            start -= 1
        high = min(start + limit, n)
    return found


def split_pieces(documents: DataFrame, vocabulary: Vocabulary, limit: int = 1024, overlap: int = 64) -> DataFrame:
    """The pieces of each document: doc_id, piece_no from 1, n_pieces, n_tokens, start_char, end_char, boundary, text.

    A text within the limit is one piece; a null text counts as the empty one. Consecutive pieces share ``overlap``
    tokens of the document (a few more where the overlap would begin inside a character), and every piece has at
    most ``limit`` tokens when encoded by itself. Without any boundary cuts fall between characters. Only doc_id
    and text are read, repeated rows come out each. The overlap leaves a piece at least LEAST_ROOM tokens of its own.
    """
    if overlap < 0 or limit < overlap + LEAST_ROOM:
        raise ValueError(f"limit must be at least overlap + {LEAST_ROOM}")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = vocabulary.get()
        lengths = np.fromiter(map(len, table), np.int64, len(table))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                pieces = cut(text, encoder.encode_ordinary, lengths, limit, overlap)
                rows += [(doc_id, i, len(pieces), p[2], p[0], p[1], p[3], text[p[0] : p[1]]) for i, p in enumerate(pieces, 1)]
            columns = list(zip(*rows)) or [[]] * 8
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in PIECE_SCHEMA.split(", ")])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(split, PIECE_SCHEMA)


def oversized(documents: DataFrame, vocabulary: Vocabulary, limit: int = 1024, overlap: int = 64) -> DataFrame:
    """(doc_id) of the documents that are cut into more than one piece. A token has at least one byte, so shorter texts are not split."""
    long = documents.filter(F.octet_length("text") > limit)
    return split_pieces(long, vocabulary, limit, overlap).filter("piece_no = 2").select("doc_id")
