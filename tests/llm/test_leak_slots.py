import random

from skein.llm import leak


def counts(item, doc, run=12):
    return leak.Templates([(1, item)], run).matches(doc).get(1)


def test_a_name_no_item_holds():
    item = "On that day the keeper Marlow opens the gate in Tarsia and counts every boat"
    assert counts(item, item.replace("Marlow", "Quentin").replace("Tarsia", "Oslo"), 15) == [0, 1]
    assert counts(item, item.replace("Marlow", "Tarsia").replace("in Tarsia", "in Marlow"), 15) == [0, 1]
    assert counts(item, item.replace("Marlow", "quentin"), 15) is None  # no name by its spelling
    assert counts(item, item.upper(), 15) == [1, 0]


def test_units_that_no_list_holds():
    item = "Name the first relay to stop when 425 ledgers reach the inspector before other ledgers do"
    assert counts(item, item.replace("425 ledgers", "77 parcels").replace("other ledgers", "other parcels"), 16) == [0, 1]
    assert counts(item, item.replace("inspector", "parcel"), 16) is None


def test_one_rule_for_digits():
    item = "Open the valve a3b and then close the valve c4d before the tank is full"
    assert counts(item, item.replace("a3b", "x9y"), 15) == [0, 1]


def test_joined_windows_are_those_that_are_sent(spark, monkeypatch):
    rng = random.Random(12)
    words = ["alpha", "beta", "gate", "opens", "the", "two", "7", "42", "ms", "days", "Paris", "Marlow", "in", "x9", "über", "crates", "ledgers"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 30))), 0) for i in range(25)] + [(90, None, 0), (91, "", 0), (92, "a b", 0)]
    docs = []
    for d in range(150):
        own = rng.choice(items[:25])[1].split()
        swap = {w: rng.choice([w, "9", "Quentin", "km", "barrels", "three", "quentin"]) for w in set(own)}
        docs.append((d, " ".join(["start", *(swap[w] if d % 2 else w for w in own), rng.choice(words)]), 0))
    docs += [(900, None, 0), (901, "7 ledgers", 0)]
    frames = spark.createDataFrame(docs, "doc_id long, text string, item_id long"), spark.createDataFrame(items, "item_id long, text string, doc_id long")
    get = lambda **more: {tuple(r) for r in leak.leaked_passages(*frames, run=4, **more).collect()}
    sent = get()
    assert sum(n for *_, n in sent) > 50 and get(block=5) == sent
    assert {r[:3] for r in get(block=5, changed_too=False)} == {r[:3] for r in sent if r[2]}
    monkeypatch.setattr(leak, "MOST_WORDS", 3)
    assert {r[:2] for r in get(block=100)} == {r[:2] for r in sent}


def test_changed_passages_are_found_again(spark):
    """At least nine in ten of planted questions with other numbers, names and units."""
    rng = random.Random(4)
    names, new, units = ["Marlow", "Tarsia", "Ilmen"], ["Quentin", "Zora", "Ivan", "Oslo"], ["crates", "ledgers", "boats"]
    items, docs = [], []
    for i in range(60):
        verb, thing = rng.choice(["counts", "moves", "sells"]), rng.choice(["before", "after", "until"])
        form = "On day {a} the keeper {n} " + verb + " {b} {u} " + thing + " noon and " + rng.choice(["then", "later"]) + " gives {a} {u} to {m} at gate " + "abcdefgh"[i % 8]
        fill = lambda pool, more: form.format(a=rng.randrange(2, 50), b=rng.randrange(60, 99), n=(p := rng.sample(pool, 2))[0], m=p[1], u=rng.choice(more))
        items.append((i, fill(names, units), 0))
        docs.append((i, "Notes. " + fill(new, ["parcels", "barrels"]) + " and so on", 0))
    frames = spark.createDataFrame(docs, "doc_id long, text string, item_id long"), spark.createDataFrame(items, "item_id long, text string, doc_id long")
    for block in (1000, 7):
        got = {(r.doc_id, r.item_id) for r in leak.leaked_passages(*frames, block=block).filter("n_changed > 0").collect()}
        assert sum((i, i) in got for i in range(60)) >= 54
