import random

import pytest

from skein.operators.hierarchy import address_links, ancestors, hierarchy, nested_sets


def brute(parent):
    root, depth = {}, {}
    for start in parent:
        seen, node = [], start
        while node in parent and node not in seen:
            seen.append(node)
            node = parent[node]
        if node in seen:  # a cycle, cut at its smallest node
            cycle = seen[seen.index(node) :]
            top = min(cycle)
            steps, node = 0, start
            while node != top:
                node, steps = parent[node], steps + 1
            root[start], depth[start] = top, steps
        else:
            root[start], depth[start] = node, len(seen)
    return root, depth


def graphs():
    yield {}
    yield {1: 1}
    yield {2: 1, 1: 2, 3: 2}
    yield {i: i - 1 for i in range(1, 300)}  # a deep chain
    yield {i: 0 for i in range(1, 400)}  # one parent of all
    yield {**{i: i + 1 for i in range(60)}, 60: 20, **{i: 7 for i in range(100, 140)}}  # a long tail into a long cycle
    for seed in range(3):
        rng = random.Random(seed)
        yield {i: rng.randrange(80) for i in range(80) if rng.random() < 0.9}


@pytest.mark.parametrize("parent", list(graphs()))
def test_against_brute_force(spark, parent):
    rows = [(n, p, "x") for n, p in parent.items()] + [(None, 1, "x"), (5000, None, "x")]
    tree = hierarchy(spark.createDataFrame(rows + rows[:3], "node long, parent long, root string"))
    root, depth = brute(parent)
    got = {r.node: r for r in tree.collect()}
    assert {n: r.root for n, r in got.items()} == root and {n: r.depth for n, r in got.items()} == depth
    if not parent or len(parent) > 100:
        return
    sets = nested_sets(spark.createDataFrame(rows, "node long, parent long, root string"), with_path=True)
    placed = {r.node: r for r in sets.collect()}
    assert set(placed) == set(parent) | set(parent.values()) and sorted(r.pre for r in placed.values()) == list(range(len(placed)))
    pairs = {(r.node, r.ancestor) for r in ancestors(sets, sets.select("node", "pre")).collect()}
    assert pairs == {(n, a) for n, r in placed.items() for a in r.path[:-1]}
    for node, row in placed.items():
        below = {m for m, o in placed.items() if o.root == row.root and row.pre < o.pre <= row.pre + row.below}
        assert below == {m for m, o in placed.items() if m != node and node in o.path}
        assert row.path[-1] == node and row.path[0] == row.root and len(row.path) == row.depth + 1


def test_parents_of_addresses(spark):
    rows = [
        (5, "http://h.test/a", None), (7, "https://h.test/a", "h.test/b"), (3, "http://h.test/b", "h.test/none"), (4, "http://h.test/b", "h.test/a"),
        (9, "http://h.test/c", ""), (10, None, "h.test/a"), (11, "http://h.test/d", "h.test/d"),
    ]
    sent = [(8, "http://h.test/d", "http://h.test/c"), (6, "http://h.test/b", "h.test/c"), (12, "http://h.test/b", None)]
    nodes, links = address_links(spark.createDataFrame(rows, "row_id long, url string, referrer_id string"), spark.createDataFrame(sent, "row_id long, url string, redirects_to string"))
    assert {(r.id, r.node) for r in nodes.collect()} == {("h.test/a", 5), ("h.test/b", 3), ("h.test/c", 9), ("h.test/d", 11)}
    assert {(r.node, r.parent) for r in links.collect()} == {(5, 3), (9, 3), (11, 11)}
