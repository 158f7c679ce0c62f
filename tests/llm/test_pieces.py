import random

import numpy as np
import pytest

from skein.llm import pieces
from skein.llm.tokens import Vocabulary


def texts():
    rng = random.Random(5)
    sentence = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "漢字"]) for _ in range(rng.randrange(3, 15))) + rng.choice([". ", "! "])
    made = ["".join(sentence() for _ in range(rng.randrange(1, 120))) for _ in range(20)]
    return made + ["x" * 9000, "漢字" * 3000, "🙂" * 900, "\n" * 3000, "a, " * 3000, "word\r\n" * 2000, "12345 " * 900]


def check(text, found, encode, limit):
    assert found[0][0] == 0 and found[-1][1] == len(text)
    for start, stop, n, _ in found:
        assert start < stop and n == len(encode(text[start:stop])) <= limit
    for a, b in zip(found, found[1:]):
        assert a[0] < b[0] <= a[1] < b[1]


@pytest.mark.parametrize(("limit", "overlap"), [(64, 8), (100, 0), (12, 4)])
def test_one_by_one_when_no_layout_fits(spark, monkeypatch, limit, overlap):
    monkeypatch.setattr(pieces, "TRIES", 0)
    tokenizer, table = Vocabulary(spark).get()
    lengths = np.array([len(t) for t in table])
    for text in texts():
        found = pieces.cut(text, tokenizer.encode_ordinary, lengths, limit, overlap)
        check(text, found, tokenizer.encode_ordinary, limit)


def test_pieces_that_take_more_tokens_by_themselves():
    # by itself a piece that does not begin the text takes up to half as many tokens again
    text = "".join(random.Random(1).choice("abc de") for _ in range(3000))
    encode = lambda t: list(t.encode()) + [0] * (0 if text.startswith(t) else len(t) // 2)
    found = pieces.cut(text, encode, np.ones(256, np.int64), 60, 10)
    check(text, found, encode, 60)


def test_limit_must_leave_room(spark):
    with pytest.raises(ValueError):
        pieces.split_pieces(spark.createDataFrame([], "doc_id long, text string"), None, 64, 60)
