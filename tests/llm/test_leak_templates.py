import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from compare import DATA  # noqa: E402
from test_leak import DOCS, ITEMS, brute  # noqa: E402

from skein.llm import leak, queries  # noqa: E402

ITEM = "On day 12 the keeper Marlow opens 3 crates of salt and gives them to the guard"


def without_templates(templates):
    none = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    templates.by_template = templates.by_counted = none
    return templates


@pytest.mark.parametrize("changed_too", [True, False])
def test_equal_words_are_found_by_their_template(changed_too):
    held = leak.Templates([(1, ITEM)], 12)
    assert held.matches(ITEM.upper(), changed_too) == {1: [6, 0]}
    assert without_templates(held).matches(ITEM.upper(), changed_too) == {}


def test_joined_windows_are_those_of_templates():
    words = np.sort(np.array([leak._word_hash(w) for w in set(leak.words_of(ITEM))], np.int64))
    typing = leak.Typing(words, np.array([leak._word_hash("marlow")], np.int64), 12)
    assert {mode for item in (True, False) for mode, *_ in typing.windows(ITEM, item)} == {1, 2}


@pytest.mark.parametrize("block", [4, 1000])
def test_no_typing_hides_equal_words(spark, block):
    """Names, units and numbers that are spelled like each other."""
    rng = random.Random(5)
    words = ["the", "Ms", "ms", "Two", "two", "X9a", "x9a", "Km", "7", "7th", "May", "may", "Rome", "ROME", "crates", "Straße", "x²", "of"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 20))), 0) for i in range(12)]
    docs = []
    for d in range(150):
        own = rng.choice(items)[1].split()
        docs.append((d, " ".join([rng.choice(["7", "pile", "Oslo"]), *[rng.choice([w, w, w.lower(), w.upper()]) if "ß" not in w else w for w in own], rng.choice(["9", "boxes"])]), 0))
    got = leak.leaked_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), run=4, block=block)
    found = {(r.doc_id, r.item_id) for r in got.filter("n_equal > 0").collect()}
    assert len(found) > 100 and found == brute(docs, items, 4)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_p9_found_comes_from_templates(spark, monkeypatch):
    build = leak.Templates.__init__
    monkeypatch.setattr(leak.Templates, "__init__", lambda self, *args: build(self, *args) or without_templates(self) and None)
    assert queries.p9_found(spark, DATA).count() == 0
