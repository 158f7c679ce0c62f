import random

import pytest

from skein.llm import encode, pieces
from skein.llm.tokens import Vocabulary

DOCS = "doc_id long, text string, ids string, block int"
WORDS = ["a", "the", "Übung", "don't", "  ", "\n", "\r\n\t", "漢字", "🙂", "12345", "--'s", "x" * 300, "é", " ", "　", "İ"]


@pytest.fixture(scope="module")
def vocabulary(spark):
    return Vocabulary(spark)


def texts():
    rng = random.Random(9)
    made = ["".join(rng.choice(WORDS) + rng.choice(["", " "]) for _ in range(rng.randrange(60))) for _ in range(300)]
    return [(i, t, "", 0) for i, t in enumerate([*made, "", None, " ", "\n\n", "word " * 20_000, "漢" * 20_000, "'"])]


@pytest.mark.parametrize("chars", [500, 8_000_000])
def test_ids_equal_the_tokenizer_and_decode_to_the_text(spark, vocabulary, monkeypatch, chars):
    monkeypatch.setattr(encode, "BLOCK_CHARS", chars)
    docs = texts()
    encoded = encode.encode_corpus(spark.createDataFrame(docs + docs[:2], DOCS).repartition(3), vocabulary)
    rows = encoded.collect()
    assert len(rows) == len(docs) + 2
    tokenizer, _ = vocabulary.get()
    want = {d: tokenizer.encode_ordinary(t or "") for d, t, *_ in docs}
    assert all(r.ids == want[r.doc_id] for r in rows)
    back = {r.doc_id: r.text for r in encode.decode_corpus(encoded, vocabulary).collect()}
    assert back == {d: t or "" for d, t, *_ in docs}


def test_empty_table(spark, vocabulary):
    assert encode.encode_corpus(spark.createDataFrame([], DOCS), vocabulary).count() == 0
    assert pieces.split_pieces(spark.createDataFrame([], DOCS), vocabulary).count() == 0


@pytest.mark.parametrize(("limit", "overlap"), [(64, 8), (100, 0), (1024, 64)])
def test_pieces(spark, vocabulary, limit, overlap):
    rng = random.Random(2)
    made = []
    for _ in range(40):
        sentence = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "漢字"]) for _ in range(rng.randrange(3, 15))) + rng.choice([". ", "! ", "? "])
        made.append("\n\n".join("".join(sentence() for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 40))))
    made += ["", None, "x" * 9000, "漢字" * 3000, "🙂" * 900, "\n" * 3000, " ", "a, " * 3000, "word\r\n" * 2000]
    docs = [(i, t, "", 0) for i, t in enumerate(made)]
    tokenizer, _ = vocabulary.get()
    count = lambda t: len(tokenizer.encode_ordinary(t))
    held = {}
    for r in pieces.split_pieces(spark.createDataFrame(docs, DOCS), vocabulary, limit, overlap).collect():
        held.setdefault(r.doc_id, []).append(r)
    assert set(held) == {d for d, *_ in docs}
    for doc_id, text, *_ in docs:
        text = text or ""
        own = sorted(held[doc_id], key=lambda r: r.piece_no)
        assert [r.piece_no for r in own] == list(range(1, len(own) + 1)) and {r.n_pieces for r in own} == {len(own)}
        assert (len(own) > 1) == (count(text) > limit)
        assert own[0].start_char == 0 and own[-1].end_char == len(text)
        for r in own:
            assert r.text == text[r.start_char : r.end_char] and r.n_tokens == count(r.text) <= limit
        for a, b in zip(own, own[1:]):
            assert a.start_char < b.start_char <= a.end_char < b.end_char
            if overlap:
                assert b.start_char < a.end_char
    # prose is never cut inside a word
    assert all(r.boundary > 0 for d in range(40) for r in held[d])
    found = {r.doc_id for r in pieces.oversized(spark.createDataFrame(docs, DOCS), vocabulary, limit, overlap).collect()}
    assert found == {d for d, rows in held.items() if len(rows) > 1}
