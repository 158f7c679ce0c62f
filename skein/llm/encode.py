"""Encoding of a whole corpus with a public tokenizer, each distinct word encoded once.

Texts are split into pre-tokens. A block of documents keeps its pre-tokens as numbers of a dictionary of its own, so
that what is shuffled is each distinct word of each block, not each occurrence. The words of all blocks are made
distinct, encoded once each, and joined back to the blocks, where the ids of each document are put together in the
order of positions. Decoding joins ids with the table of token bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.tokens import PATTERN, Vocabulary
from skein.runtime import stage

BLOCK_CHARS = 8_000_000  # characters of a block; its dictionary and its codes are bounded by it


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        return code


def _take_runs(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + length], one after another."""
    ends = np.cumsum(lengths)
    shift = np.repeat(starts - (ends - lengths), lengths)
    return flat[np.arange(ends[-1] if len(ends) else 0) + shift]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import regex
    from pyspark import TaskContext

    find = regex.compile(PATTERN).findall
    first = TaskContext.get().partitionId() << 32
    made = 0
    ids: list[int] = []
    counts: list[int] = []
    parts: list[np.ndarray] = []
    codes = _Codes()
    chars = 0

    def close() -> pa.RecordBatch:
        nonlocal made, ids, counts, parts, codes, chars
        small = np.uint16 if len(codes) <= 1 << 16 else np.uint32
        data = np.concatenate(parts).astype(small).tobytes() if parts else b""
        batch = pa.record_batch(
            {
                "block": pa.array([first + made], pa.int64()),
                "doc_ids": pa.array([ids], pa.list_(pa.int64())),
                "counts": pa.array([counts], pa.list_(pa.int32())),
                "codes": pa.array([data], pa.binary()),
                "words": pa.array([list(codes)], pa.list_(pa.string())),
            }
        )
        made += 1
        ids, counts, parts, codes, chars = [], [], [], _Codes(), 0
        return batch

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = find(text) if text else []
            ids.append(doc_id)
            counts.append(len(words))
            if words:
                parts.append(np.fromiter(map(codes.__getitem__, words), np.uint32, len(words)))
                chars += len(text)
            if chars >= BLOCK_CHARS or len(ids) >= 100_000:
                yield close()
    if ids:
        yield close()


BLOCK_SCHEMA = "block long, doc_ids array<long>, counts array<int>, codes binary, words array<string>"


def _encode_words(vocabulary: Vocabulary):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = vocabulary.get()
        for batch in batches:
            words = batch.column(0)
            yield pa.record_batch({"word": words, "word_ids": pa.array([encoder.encode_ordinary(w) for w in words.to_pylist()], pa.list_(pa.int32()))})

    return encode


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            doc_ids, counts, codes, entries = (batch.column(i)[row] for i in range(4))
            doc_ids, counts = doc_ids.values.to_numpy(), counts.values.to_numpy().astype(np.int64)
            n_words = 0
            if entries.is_valid:
                structs = entries.values
                place = structs.field(0).to_numpy(zero_copy_only=False)
                lists = structs.field(1)
                flat = lists.flatten().to_numpy()
                length = np.asarray(lists.value_lengths()).astype(np.int64)
                start = np.cumsum(length) - length
                n_words = len(place)
                by_code = np.empty(n_words, np.int64)
                by_code[place] = np.arange(n_words)
            data = codes.as_py()
            coded = np.frombuffer(data, np.uint16 if n_words <= 1 << 16 else np.uint32)
            at = 0
            for lo in range(0, len(doc_ids), 2000):
                own = counts[lo : lo + 2000]
                used = coded[at : at + own.sum()]
                at += len(used)
                lengths = np.zeros(len(own), np.int64)
                ids = np.empty(0, np.int32)
                if len(used):
                    entry = by_code[used]
                    ids = _take_runs(flat, start[entry], length[entry]).astype(np.int32)
                    upto = np.concatenate([[0], np.cumsum(length[entry])])
                    ends = np.cumsum(own)
                    lengths = upto[ends] - upto[ends - own]
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                yield pa.record_batch({"doc_id": pa.array(doc_ids[lo : lo + 2000]), "ids": pa.ListArray.from_arrays(offsets, pa.array(ids))})


def encode_corpus(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids) of each row: the ids of its text, without special tokens.

    A null text and an empty one have the empty list. Repeated rows come out each. Only doc_id and text are read.
    An empty table gives no rows.
    """
    blocks = stage(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_blocks, BLOCK_SCHEMA), "blocks")
    words = blocks.select("block", F.posexplode("words").alias("code", "word"))
    encoded = words.select("word").distinct().mapInArrow(_encode_words(vocabulary), "word string, word_ids array<int>")
    dictionary = words.join(encoded.hint("shuffle_hash"), "word").groupBy("block").agg(F.collect_list(F.struct("code", "word_ids")).alias("entries"))
    return (
        blocks.select("block", "doc_ids", "counts", "codes").join(dictionary, "block", "left")
        .select("doc_ids", "counts", "codes", "entries").mapInArrow(_assemble, "doc_id long, ids array<int>")
    )


def token_table(spark, vocabulary: Vocabulary) -> DataFrame:
    """(token, hex) of each token id: its bytes in hex. As many rows as the vocabulary has tokens."""
    _, table = vocabulary.get()
    return spark.createDataFrame(pa.table({"token": pa.array(range(len(table)), pa.int32()), "hex": pa.array([t.hex() for t in table])}))


def decode_corpus(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): each id joined with the table of token bytes, put together by position.

    Empty and null lists give the empty text, ids that no token has no bytes; bytes that are no UTF-8 are replaced. Repeated rows come out each.
    """
    rows = stage(encoded.select("doc_id", "ids").withColumn("row", F.monotonically_increasing_id()), "encoded")
    tokens = rows.select("doc_id", "row", F.posexplode_outer("ids").alias("pos", "token"))
    joined = tokens.join(F.broadcast(token_table(encoded.sparkSession, vocabulary)), "token", "left")
    whole = joined.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("hex").isNotNull(), F.struct("pos", "hex")))).alias("parts"))
    return whole.select("doc_id", F.make_valid_utf8(F.unhex(F.array_join("parts.hex", "")).cast("string")).alias("text"))
