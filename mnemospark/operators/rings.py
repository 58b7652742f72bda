"""Records on never-ending links, where a record may have several successors.

Links are trimmed: a link whose start has no link into it, or whose end has none out of it, lies on no
ring.  A record with one link in and one out is spliced out of its chain when its hash of the round is the
largest of the three, so chains of any length take logarithmic rounds.  What neither step can shorten are
self-loops and tangled cores; their strongly connected parts are found by colouring: the least id that
reaches a record along the links is its colour, and the records of a colour that the colour's own record
reaches backwards are one part.  Spliced records are put back last, round by round: one lies on the ring
its two ends are both on.

Scale: every step is an equi-join or an aggregate over the links that are left, which shrink fast where
rings are few; the state is one row a record.  Defined results: null and empty ends are ignored, repeated
links count once, a record linked to itself is a ring of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.plans.staging import Staging


def _trimmed(links: DataFrame) -> DataFrame:
    starts, ends = links.select(F.col("src").alias("dst")).distinct(), links.select(F.col("dst").alias("src")).distinct()
    return links.join(starts, "dst", "left_semi").join(ends, "src", "left_semi").select("src", "dst")


def _spliceable(links: DataFrame, turn: int) -> DataFrame:
    """(mid, src, dst): records with one link in and one out, no two of them neighbours."""
    into = links.groupBy(F.col("dst").alias("mid")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("src")).filter("n = 1").drop("n")
    out = links.groupBy(F.col("src").alias("mid")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("dst")).filter("n = 1").drop("n")
    rank = lambda c: F.xxhash64(F.col(c), F.lit(turn))
    return into.join(out, "mid").filter((F.col("mid") != F.col("src")) & (F.col("mid") != F.col("dst")) & (rank("mid") > rank("src")) & (rank("mid") > rank("dst"))).select("mid", "src", "dst")


def _spread(links: DataFrame, start: DataFrame, stage: Staging) -> DataFrame:
    """(node, mark): the least mark of ``start(node, mark)`` that reaches each node along ``links(src, dst)``."""
    now = stage.cut(start)
    while True:
        sent = links.join(now.select(F.col("node").alias("src"), "mark"), "src").select(F.col("dst").alias("node"), "mark")
        after = stage.cut(now.unionByName(sent).groupBy("node").agg(F.min("mark").alias("mark")))
        changed = not after.join(now, ["node", "mark"], "left_anti").isEmpty()
        stage.drop(now)
        now = after
        if not changed:
            return now


def on_rings(links: DataFrame) -> DataFrame:
    """(node, ring) of ``links(src, dst)``: the nodes that their own links lead back to; ring is the least id of their part."""
    stage = Staging(links.sparkSession, "rings")
    edges = stage.cut(links.filter("src <> '' AND dst <> ''").select("src", "dst").distinct())
    rounds: list[DataFrame] = []
    left, turn = edges.count(), 0
    while left:
        turn += 1
        kept = stage.cut(_trimmed(edges))
        mids = stage.cut(_spliceable(kept, turn))
        gone = mids.select(F.col("mid").alias("src")), mids.select(F.col("mid").alias("dst"))
        rest = kept.join(gone[0], "src", "left_anti").join(gone[1], "dst", "left_anti").select("src", "dst")
        after = stage.cut(rest.unionByName(mids.select("src", "dst")).distinct())
        rounds.append(mids)
        stage.drop(edges)
        stage.drop(kept)
        edges, was, left = after, left, after.count()
        if left == was and mids.isEmpty():
            break
    parts: list[DataFrame] = []
    while left:
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colour = _spread(edges, nodes.select("node", F.col("node").alias("mark")), stage)
        coloured = edges.join(colour.select(F.col("node").alias("src"), F.col("mark").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("mark").alias("b")), "dst")
        inner = stage.cut(coloured.filter("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        back = _spread(inner, colour.filter("node = mark"), stage)
        looped = inner.select(F.col("src").alias("node")).distinct()  # a colour without links inside is no ring
        part = stage.cut(back.join(looped, "node", "left_semi").select("node", F.col("mark").alias("ring")))
        parts.append(part)
        done = back.select("node")
        edges = stage.cut(_trimmed(edges.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti")))
        left = edges.count()
    known = stage.cut(links.sparkSession.createDataFrame([], "node string, ring string"))
    for part in parts:
        known = known.unionByName(part)
    for mids in reversed(rounds):
        ends = mids.join(known.select(F.col("node").alias("src"), "ring"), "src").join(known.select(F.col("node").alias("dst"), F.col("ring").alias("other")), "dst")
        known = stage.cut(known.unionByName(ends.filter("ring = other").select(F.col("mid").alias("node"), "ring")))
    least = known.groupBy("ring").agg(F.min("node").alias("least"))
    return known.join(least, "ring").select("node", F.col("least").alias("ring"))
