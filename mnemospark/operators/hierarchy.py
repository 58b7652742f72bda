"""Parent-child links to full hierarchies by tree contraction (problem 3).

Every node has at most one successor (its parent), so the links form trees that hang on a root or on
a ring.  Each contraction round takes two kinds of edges away and writes them to a round's table:

* rake: an edge whose child has no children of its own;
* compress: a node with one child and a parent is spliced out of its chain when the hash of its id and
  the round is larger than its child's and its parent's, which makes the spliced nodes independent.

A round removes a constant share of any tree, so the number of rounds is logarithmic in the number of
nodes, whatever the depth.  What cannot be contracted is a ring: it shrinks to a self-loop, the
nonterminating core.  Edges carry their length, the nodes spliced out of them and the smallest such id,
so the core's self-loop knows its ring's members.  The rounds are then read backwards: a removed node
takes root, depth and path from the node it was attached to.

Scale: a round's joins are equi-joins on node ids over a geometrically shrinking edge table; nothing is
collected.  A parent of a third of all rows is met by map-side aggregation when children are counted,
and by AQE's skew split where its children look it up.

Defined results: null and empty link elements and links to absent records are ignored; redelivered
links count once; a record linking to itself is a ring of one; a record with several successors (the
data promise there is none) keeps the smallest id; records without links give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.plans.staging import Staging


def successor_links(record: DataFrame) -> DataFrame:
    """(child, parent): each record's successor, from either side's link."""
    ids = record.select("memory_id").filter("memory_id IS NOT NULL").distinct()
    older = record.select(F.explode("supersedes").alias("child"), F.col("memory_id").alias("parent"))
    newer = record.select(F.col("memory_id").alias("child"), F.explode("superseded_by").alias("parent"))
    child_known = older.filter("child <> '' AND parent IS NOT NULL").join(ids, F.col("child") == F.col("memory_id"), "left_semi")
    parent_known = newer.filter("parent <> '' AND child IS NOT NULL").join(ids, F.col("parent") == F.col("memory_id"), "left_semi")
    return child_known.unionByName(parent_known).groupBy("child").agg(F.min("parent").alias("parent"))


def _priority(column, turn: int):
    return F.xxhash64(column, F.lit(turn))


def hierarchy(links: DataFrame, with_paths: bool = False) -> DataFrame:
    """(node, root, depth[, path]) for every node of ``links(child, parent)``.

    depth is -1 and root the smallest id of the ring where the steps never end; path runs from the
    node to its root and is null on and behind rings.
    """
    spark = links.sparkSession
    stage = Staging(spark, "hierarchy")
    via = [F.array().cast("array<string>").alias("via")] if with_paths else []
    keep_via = ["via"] if with_paths else []
    edges = stage.cut(links.select("child", "parent", F.lit(1).cast("long").alias("steps"), F.col("child").alias("least_id"), *via))
    first = edges
    rounds: list[DataFrame] = []
    turn = 0
    while True:
        open_edges = edges.filter("child <> parent").count()
        if not open_edges:
            break
        turn += 1
        below = edges.groupBy(F.col("parent").alias("mid")).agg(
            F.count(F.lit(1)).alias("n_children"),
            F.max("child").alias("only_child"),
        )
        priority = _priority(F.col("child"), turn)
        spliced = (
            (F.col("n_children") == 1)
            & (F.col("child") != F.col("parent"))
            & (F.col("only_child") != F.col("child"))
            & (priority > _priority(F.col("only_child"), turn))
            & ((F.col("only_child") == F.col("parent")) | (priority > _priority(F.col("parent"), turn)))
        )
        seen = edges.join(below, F.col("child") == F.col("mid"), "left").select(
            "child", "parent", "steps", "least_id", *keep_via, F.col("mid").isNull().alias("leaf"), F.coalesce(spliced, F.lit(False)).alias("spliced")
        )
        seen = stage.cut(seen)
        out = seen.filter("spliced").select(
            F.col("child").alias("mid"), F.col("parent").alias("up"), F.col("steps").alias("up_steps"), F.col("least_id").alias("up_least"), *([F.col("via").alias("up_via")] if with_paths else [])
        )
        hooked = seen.filter("NOT spliced").join(out, F.col("parent") == F.col("mid"), "left")
        relinked = F.col("mid").isNotNull()
        joined_via = [F.when(relinked, F.concat("via", F.array("mid"), "up_via")).otherwise(F.col("via")).alias("via")] if with_paths else []
        after = hooked.select(
            "child",
            F.coalesce("up", "parent").alias("parent"),
            (F.col("steps") + F.coalesce("up_steps", F.lit(0))).alias("steps"),
            F.least("least_id", F.coalesce("up_least", "least_id")).alias("least_id"),
            *joined_via,
            (F.col("leaf") & ~relinked).alias("raked"),
        )
        after = stage.cut(after)
        rounds.append(seen.filter("spliced").select("child", "parent", "steps", *keep_via).unionByName(after.filter("raked").select("child", "parent", "steps", *keep_via)))
        edges = after.filter("NOT raked").drop("raked")

    no_path = [F.lit(None).cast("array<string>").alias("path")] if with_paths else []
    roots = first.select(F.col("parent").alias("node")).distinct().join(first.select(F.col("child").alias("node")), "node", "left_anti")
    root_path = [F.array("node").alias("path")] if with_paths else []
    parts = [
        roots.select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), *root_path),
        edges.select(F.col("child").alias("node"), F.col("least_id").alias("root"), F.lit(-1).cast("long").alias("depth"), *no_path),
    ]
    known = stage.cut(parts[0].unionByName(parts[1]))
    done = [known]
    for removed in reversed(rounds):
        above = known.select(F.col("node").alias("parent"), "root", "depth", *([F.col("path").alias("up_path")] if with_paths else []))
        path = [F.when(F.col("depth") >= 0, F.concat(F.array("child"), "via", "up_path")).alias("path")] if with_paths else []
        found = removed.join(above, "parent").select(
            F.col("child").alias("node"), "root", F.when(F.col("depth") < 0, F.lit(-1)).otherwise(F.col("depth") + F.col("steps")).cast("long").alias("depth"), *path
        )
        found = stage.cut(found)
        done.append(found)
        known = known.unionByName(found)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def descendants(links: DataFrame) -> DataFrame:
    """(ancestor, descendant, steps): every older record below every node; none on or behind rings."""
    rows = hierarchy(links, with_paths=True).filter("path IS NOT NULL")
    return rows.select(F.col("node").alias("descendant"), F.posexplode("path").alias("steps", "ancestor")).filter("steps > 0").select("ancestor", "descendant", F.col("steps").cast("long").alias("steps"))
