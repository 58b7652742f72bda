"""Connected components of an undirected link table by alternating large-star and small-star.

Rounds are logarithmic in practice; a round is map-side combinable minimum aggregation plus equi-joins,
so a hub of a third of all links never meets in one task (AQE splits the join's hot key).

Defined results: links with a null end are ignored, self-links and repeated links change nothing; a
node that occurs only in self-links is no component; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.plans.staging import Staging


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links(a, b) with a > b.  Large: each node's larger neighbours go to its least one; small: its smaller ones."""
    if large:
        # a node without smaller neighbours is its own minimum and keeps its links
        least = links.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        out = links.join(least, links["b"] == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b"))
        return out.filter("a > b").distinct()
    least = links.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    out = links.join(least, links["a"] == F.col("u")).select(F.col("b").alias("v"), F.col("m"))
    own = least.select(F.col("u").alias("v"), "m")
    return out.unionByName(own).select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): component is the smallest id reached; ``links(a, b)`` of one orderable type."""
    stage = Staging(links.sparkSession, "components")
    now = stage.cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        after = stage.cut(_star(_star(now, True), False))
        stage.drop(now)
        now = after
        was, state = state, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if was is not None and tuple(was) == tuple(state):
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
