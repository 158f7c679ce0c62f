"""Parent-child links to full hierarchies by nested sets, in a number of rounds that grows with the logarithm of the depth.

Upward, every node holds its ancestor at distance 2^k; a round adds to each node the sizes of the subtrees that hang
exactly 2^k below it and doubles the distance, so that only nodes of depth 2^k or more are left in round k. Nodes that
are always left hang on a cycle: they are the unprocessed ones. Each cycle is cut at its smallest node, which then counts
as a root, and its nodes are processed the same way. Downward, siblings get ranges by prefix sums of their sizes, all
trees side by side, and a node's place is the sum of these along its way from the root. The places answer the rest: d is
a descendant of a exactly if a.pre < d.pre <= a.pre + a.below, and the root of a node is the last root at or before it.
Rows that are settled are not written again, and no row of theirs is joined but to those that end at them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.ids import address_id
from skein.operators.ranking import latest, running_sums
from skein.runtime import drop_staged, stage

SALT = 32
WIDE = 10  # ranges of 2^WIDE places and more may hold most nodes, so their few blocks are there for every salt


def subtree_sizes(links: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(node, size) of nodes with something below them, the unprocessed rows (node, anc), and their number.

    ``links`` is (node, parent), one row for each node. Sizes of unprocessed nodes mean nothing.
    """
    active = stage(links.select("node", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("size")), "active")
    parts, before = [], active.count()
    while True:
        below = stage(active.groupBy(F.col("anc").alias("node")).agg(F.sum("size").alias("more")), "below")
        parts.append(below)
        upper = active.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"))
        left = active.join(upper, "anc").join(below, "node", "left")
        old, active = active, stage(left.select("node", F.col("anc2").alias("anc"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "active")
        n_left = active.count()
        drop_staged(old)
        if n_left in (0, before):
            sums = reduce(DataFrame.union, parts).groupBy("node").agg((F.sum("more") + 1).alias("size"))
            return sums, active.select("node", "anc"), n_left
        before = n_left


def places(laid: DataFrame, with_path: bool = False) -> DataFrame:
    """(node, depth, pre) of each node, and path, the nodes from the root down to it.

    ``laid`` is (node, above, offset): above is null for roots, offset is what lies between the place of a node and that of the one above.
    Nodes whose chain has no end have no row.
    """
    path = [F.array("node").alias("path")] if with_path else []
    more = ["path"] if with_path else []
    closed = [laid.filter("above is null").select("node", F.lit(0).cast("long").alias("depth"), F.col("offset").alias("pre"), *path)]
    active = laid.filter("above is not null").select("node", F.col("above").alias("anc"), F.col("offset").alias("pre"), *path)
    reach, old, before = 1, None, -1
    while True:
        upper = active.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("pre").alias("pre2"), *[F.col(c).alias(f"{c}2") for c in more])
        joined = stage(active.join(upper, "anc", "left"), "joined")
        if old is not None:
            drop_staged(old)
        old = joined
        # the nodes whose ancestor is settled already end here
        settled = reduce(DataFrame.union, closed).select(F.col("node").alias("anc"), F.col("depth").alias("depth2"), F.col("pre").alias("pre3"), *[F.col(c).alias(f"{c}3") for c in more])
        ending = joined.filter("anc2 is null").join(settled, "anc")
        closed.append(
            stage(ending.select("node", (F.col("depth2") + reach).alias("depth"), (F.col("pre") + F.col("pre3")).alias("pre"), *[F.concat(f"{c}3", c).alias(c) for c in more]), "settled")
        )
        going = joined.filter("anc2 is not null")
        n_going = going.count()
        if n_going in (0, before):  # what is left unchanged by a round hangs on a cycle
            drop_staged(old)
            return reduce(DataFrame.union, closed)
        before = n_going
        active = going.select("node", F.col("anc2").alias("anc"), (F.col("pre") + F.col("pre2")).alias("pre"), *[F.concat(f"{c}2", c).alias(c) for c in more])
        reach *= 2


def nested_sets(links: DataFrame, with_path: bool = False) -> DataFrame:
    """(node, parent, root, depth, pre, below, on_cycle) of every node, roots included, and path if asked for.

    ``links`` is (node, parent), both long, one row for each node that has a parent (a node may be its own parent;
    of repeated rows of a node the smallest parent counts; rows with nulls are left out). pre is the node's place among
    the nodes of all trees, below the number of its descendants, which have the places after it; siblings are laid out by
    node. For a node whose chain runs into a cycle, root is the smallest node of the cycle; the cycle is cut there, so
    that node has depth 0 and the depth of the others is counted from it. A path has as many nodes as its node is deep, so
    that paths of deep trees are long. An empty table gives no rows.
    """
    links = stage(links.filter("node is not null and parent is not null").groupBy("node").agg(F.min("parent").alias("parent")), "links")
    sizes, unprocessed, n_unprocessed = subtree_sizes(links)
    roots = links.select(F.col("parent").alias("node")).distinct().join(links.select("node"), "node", "left_anti").select("node", F.lit(None).cast("long").alias("parent"))
    nodes, no = links.unionByName(roots), F.lit(False)
    if n_unprocessed:
        ring = stage(_rings(links, unprocessed), "ring")
        heads = ring.filter("node = head").select("node")
        again, _, _ = subtree_sizes(links.join(unprocessed, "node", "left_semi").join(heads, "node", "left_anti"))
        sizes = sizes.join(unprocessed, "node", "left_anti").unionByName(again)
        nodes = nodes.join(ring.select("node", F.lit(True).alias("on_cycle"), (F.col("node") == F.col("head")).alias("top")), "node", "left")
    else:
        nodes = nodes.withColumns({"on_cycle": no, "top": no})
    sized = nodes.join(sizes, "node", "left").select(
        "node", "parent", F.when(~F.coalesce("top", no), F.col("parent")).alias("above"), F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("on_cycle", no).alias("on_cycle")
    )
    summed = running_sums(sized, ["above"], ["node"], {"inner": F.col("size")}, inclusive=False)
    laid = stage(summed.withColumn("offset", F.col("inner") + F.when(F.col("above").isNull(), 0).otherwise(1)).drop("inner"), "laid")
    placed = laid.join(places(laid.select("node", "above", "offset"), with_path), "node")
    rooted = latest(placed, [], ["pre"], F.when(F.col("above").isNull(), F.col("node")), "root")
    return rooted.select("node", "parent", "root", "depth", "pre", (F.col("size") - 1).alias("below"), "on_cycle", *(["path"] if with_path else []))


def hierarchy(links: DataFrame) -> DataFrame:
    """(node, parent, root, depth, size, on_cycle) of every node with a parent, as in ``nested_sets``; size counts the node and all below it."""
    return nested_sets(links).filter("parent is not null").select("node", "parent", "root", "depth", (F.col("below") + 1).alias("size"), "on_cycle")


def ancestors(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, ancestor) of each of ``nodes`` (node, pre): the nodes of ``sets`` (node, pre, below) whose ranges hold its place.

    A range is cut into blocks of 2^k places that begin at a multiple of 2^k, two of each k at most. A place lies in one
    block of each k, so the join is one of equal blocks, and its work grows with what it finds.
    """
    wide = sets.filter("below > 0")
    deepest = wide.agg(F.max("below")).first()[0] or 0
    levels = F.sequence(F.lit(0), F.lit(max(1, deepest).bit_length()))
    start = lambda k: F.ceil((F.col("pre") + 1) / F.pow(F.lit(2.0), k)).cast("long")
    stop = lambda k: F.floor((F.col("pre") + F.col("below") + 1) / F.pow(F.lit(2.0), k)).cast("long")
    own = lambda k: F.array_compact(
        F.array(F.when((start(k) < stop(k)) & (start(k) % 2 == 1), start(k)), F.when((start(k) < stop(k)) & (stop(k) % 2 == 1), stop(k) - 1))
    )
    held = wide.select(F.col("node").alias("ancestor"), "pre", "below", F.explode(levels).alias("level")).select("ancestor", "level", F.explode(own(F.col("level"))).alias("block"))
    salts = F.when(F.col("level") >= WIDE, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    points = nodes.select("node", "pre", F.explode(levels).alias("level")).select(
        "node", "level", F.floor(F.col("pre") / F.pow(F.lit(2.0), F.col("level"))).cast("long").alias("block"),
        F.when(F.col("level") >= WIDE, F.pmod("node", F.lit(SALT)).cast("int")).otherwise(0).alias("salt"),
    )
    return points.join(held.withColumn("salt", F.explode(salts)), ["level", "block", "salt"]).select("node", "ancestor")


def depths(links: DataFrame) -> DataFrame:
    """(node, depth) of every node whose chain of parents ends in a root, at any depth; nodes that hang on a cycle have no row.

    ``links`` is as in ``nested_sets``; roots have no row.
    """
    links = stage(links.filter("node is not null and parent is not null").groupBy("node").agg(F.min("parent").alias("parent")), "links")
    roots = links.select(F.col("parent").alias("node")).distinct().join(links.select("node"), "node", "left_anti")
    laid = links.unionByName(roots.withColumn("parent", F.lit(None).cast("long"))).select("node", F.col("parent").alias("above"), F.lit(0).cast("long").alias("offset"))
    return places(stage(laid, "laid")).filter("depth > 0").select("node", "depth")


def _rings(links: DataFrame, unprocessed: DataFrame) -> DataFrame:
    """(node, head) of each node on a cycle, head being its smallest node."""
    cyclic, width = unprocessed.select("node", "anc"), -1
    while True:
        # jump on until the set of nodes that are reached no longer shrinks: it is then exactly the cycles
        reached = cyclic.select(F.col("anc").alias("node")).distinct()
        n = reached.count()
        if n == width:
            break
        width = n
        jump = cyclic.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"))
        cyclic = stage(cyclic.join(jump, "anc").select("node", F.col("anc2").alias("anc")), "cyclic")
    ring = stage(links.join(reached, "node", "left_semi").select("node", F.col("parent").alias("ptr"), F.least("node", "parent").alias("least")), "ring")
    while True:
        ahead = ring.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("least").alias("least2"))
        step = stage(ring.join(ahead, "ptr").select("node", F.col("ptr2").alias("ptr"), F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("changed")), "ring")
        changed = step.filter("changed").count()
        drop_staged(ring)
        ring = step.drop("changed")
        if not changed:
            return ring.select("node", F.col("least").alias("head"))


def address_links(rows: DataFrame, redirects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, node) and links (node, parent) of addresses.

    ``rows`` is (row_id, url, referrer_id), ``redirects`` (row_id, url, redirects_to). A node is an id, named by the
    smallest row_id that has it. Its parent is the node of the earliest row that redirects to it, else the
    referrer_id of its own earliest row that has one, if that is a node. Null urls and targets are left out, an
    empty referrer_id counts as one that is no node.
    """
    ids = rows.filter(F.col("url").isNotNull()).select(address_id(F.col("url")).alias("id"), "row_id", "referrer_id")
    # for each id its name and the referrer of the earliest row that has one, in one pass
    nodes = stage(
        ids.groupBy("id").agg(
            F.min("row_id").alias("node"),
            F.min(F.when(F.col("referrer_id").isNotNull(), F.struct("row_id", "referrer_id"))).getField("referrer_id").alias("referrer"),
        ),
        "nodes",
    )
    sent = redirects.filter("url is not null and redirects_to is not null").select(
        address_id(F.col("redirects_to")).alias("id"), F.struct("row_id", address_id(F.col("url")).alias("source")).alias("by")
    )
    by = sent.groupBy("id").agg(F.min("by").getField("source").alias("source"))
    named = nodes.select(F.col("id").alias("parent_id"), F.col("node").alias("parent"))
    chosen = nodes.join(by, "id", "left").select("node", F.coalesce("source", "referrer").alias("parent_id")).filter("parent_id is not null")
    return nodes.select("id", "node"), chosen.join(named, "parent_id").select("node", "parent")
