import random

import pytest

from skein.llm import leak

DOCS = "doc_id long, text string, item_id long"
ITEMS = "item_id long, text string, doc_id long"


def brute(docs, items, run):
    windows = {}
    for item, text, *_ in items:
        w = leak.words_of(text)
        for k in range(len(w) - run + 1):
            windows.setdefault(tuple(w[k : k + run]), set()).add(item)
    found = set()
    for doc, text, *_ in docs:
        w = leak.words_of(text)
        for k in range(len(w) - run + 1):
            found |= {(doc, i) for i in windows.get(tuple(w[k : k + run]), ())}
    return found


@pytest.mark.parametrize("block", [3, 1000])
def test_against_brute_force(spark, block):
    rng = random.Random(8)
    vocabulary = ["alpha", "beta", "Gamma", "two", "7", "42", "ms", "Paris", "x9", "über", "Straße"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(2, 25))), i) for i in range(10)] + [(90, None, 0), (91, "", 0)]
    items.append((92, items[0][1].upper() if "ß" not in items[0][1] else items[0][1], 0))
    docs = []
    for d in range(200):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        if d % 3 == 0:
            own = rng.choice(items[:10])[1].split()
            words += own[rng.randrange(4) :] + ["end"]
        docs.append((d, rng.choice([" ", "\n", " - ", "... "]).join(words), d))
    docs += [(900, None, 0), (901, "", 0), (902, docs[0][1], 0), (903, "alpha " * 30_000, 0)]
    got = leak.leaked_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), run=5, block=block)
    assert {(r.doc_id, r.item_id) for r in got.filter("n_equal > 0").collect()} == brute(docs, items, 5)


def test_other_values_in_the_slots(spark):
    items = [(1, "If the pump moves 12 litres in 3 minutes how many litres does it move in 12 minutes", 0)]
    docs = [
        (1, "If the pump moves 50 litres in 8 minutes how many litres does it move in 50 minutes", 0),  # one value for each value
        (2, "If the pump moves 50 litres in 8 minutes how many litres does it move in 51 minutes", 0),  # 12 under two values
        (3, items[0][1].upper(), 0),
    ]
    got = {r.doc_id: (r.n_equal, r.n_changed) for r in leak.leaked_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), run=18).collect()}
    assert got == {1: (0, 1), 3: (1, 0)}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b c d e f g h i j k l m", 0)], DOCS)
    assert leak.leaked_passages(docs, items).count() == 0 and leak.leaked_passages(some, items).count() == 0
    assert leak.leaked_passages(docs, some.select(some.doc_id.alias("item_id"), "text", some.item_id.alias("doc_id"))).count() == 0
