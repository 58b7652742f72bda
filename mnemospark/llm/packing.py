"""Filling fixed-capacity containers with documents by the sum-of-squares rule (problem 7).

The rule keeps N(g), the number of open containers with g tokens left, and places a document of s tokens
where the sum of all N(g)^2 grows least: in an open container of some gap g >= s, or in a new one.  The
rule is sequential and sees a shard's documents from the longest to the shortest, which leaves less unused
than a random order.  The collection is cut by a hash of the key into shards of about ``SHARD`` documents
that are packed independently, one task each; what a shard leaves in poorly filled containers (fill below
``REPACK_BELOW``) is packed again over as many shards as those documents need, and so on until one shard
holds what is left or a pass leaves more than ``STOPS_AT`` of what it was given; then every container stays
as it is.  A shard's unused space is thus shared by many.

Scale: the shard count of every pass follows its row count, so no task ever gets more than about ``SHARD``
rows, also where no two documents fit a container; each shard is a partition of its own (the planner would
join shards of few bytes into one task, though the work is in the rule).  Per document the rule looks at as
many gaps as a container has tokens, at most ``capacity``.

Defined results: a document above the capacity is split into full containers and a remainder, which is
placed as an item; part numbers count from 0.  Null and empty texts have 0 tokens and are placed in the
shard's first container.  Rows with a null key are left out; repeated keys are separate items.  A capacity
that is null or below 1 gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.tokens import TOKENIZER, with_tokens
from mnemospark.plans.staging import Staging

SHARD = 25_000
REPACK_BELOW = 0.9
STOPS_AT = 0.8


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item by the sum-of-squares rule; sizes are in 0..capacity."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # containers by gap
    n_open = np.zeros(capacity + 1, dtype=np.int64)
    out = np.zeros(len(sizes), dtype=np.int64)
    made = 0
    for i, s in enumerate(sizes.tolist()):
        if s == 0:
            continue  # container 0 is the first one made
        # growth of the sum of squares over 2, of a container of gap g turning into one of gap g - s
        growth = n_open[: capacity - s + 1] - n_open[s:]
        growth = growth.astype(np.float64) + 1.0
        growth[0] = -n_open[s] + 0.5  # a gap of exactly s closes
        growth[n_open[s:] == 0] = np.inf
        best = int(np.argmin(growth))
        fresh = n_open[capacity - s] + 0.5 if s < capacity else 0.0
        if growth[best] <= fresh:
            gap = best + s
            box = open_at[gap].pop()
            n_open[gap] -= 1
        else:
            gap, box = capacity, made
            made += 1
        out[i] = box
        left = gap - s
        if left:
            open_at[left].append(box)
            n_open[left] += 1
    return out


def _pack_shard(capacity: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["tokens", "mixed", "item", "part"], ascending=[False, True, True, True], kind="stable")
        box = pack(frame["tokens"].to_numpy(), capacity)
        fill = np.bincount(box, weights=frame["tokens"].to_numpy(), minlength=1)
        done = fill[box] >= REPACK_BELOW * capacity
        label = frame["shard"].astype(str) + "." + pd.Series(box, index=frame.index).astype(str)
        return pd.DataFrame({"item": frame["item"], "part": frame["part"], "tokens": frame["tokens"], "mixed": frame["mixed"], "box": label, "done": done})

    return run


def pack_documents(rows: DataFrame, capacity: int) -> DataFrame:
    """(item, part, tokens, box) of ``rows(item, n_tokens)`` for one capacity."""
    spark = rows.sparkSession
    stage = Staging(spark, f"packing-{capacity}")
    kind = rows.schema["item"].dataType.simpleString()
    whole = F.floor(F.col("n_tokens") / capacity).cast("int")
    rest = (F.col("n_tokens") - whole * capacity).cast("long")
    base = rows.filter("item IS NOT NULL").select("item", "n_tokens", whole.alias("whole"), rest.alias("rest"), F.xxhash64("item").alias("mixed"))
    full = base.filter("whole > 0").select("item", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("part"), F.lit(capacity).cast("long").alias("tokens"), "mixed")
    full = full.select("item", "part", "tokens", F.concat_ws(".", F.lit("full"), F.col("item").cast("string"), F.col("mixed").cast("string"), F.col("part").cast("string")).alias("box"))
    items = stage.cut(base.filter("rest > 0 OR whole = 0").select("item", F.col("whole").alias("part"), F.col("rest").alias("tokens"), "mixed"))
    left, turn, parts = items.count(), 0, [full]
    while left:
        given, shards = left, max(1, math.ceil(left / SHARD))
        placed = items.withColumn("place", F.pmod("mixed", F.lit(shards)).cast("int")).withColumn("shard", F.concat_ws("-", F.lit(str(turn)), F.col("place").cast("string")))
        grouped = placed.repartitionById(shards, F.col("place")).groupBy("place", "shard")
        packed = stage.cut(grouped.applyInPandas(_pack_shard(capacity), f"item {kind}, part int, tokens long, mixed long, box string, done boolean"))
        left = packed.filter("NOT done").count()
        last = shards == 1 or left > STOPS_AT * given
        parts.append((packed if last else packed.filter("done")).select("item", "part", "tokens", "box"))
        if last:
            break
        items = packed.filter("NOT done").select("item", "part", "tokens", F.xxhash64("mixed").alias("mixed"))
        turn += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fill_containers(documents: DataFrame, specs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(spec_name, capacity_tokens, box, item, part, tokens) of ``documents(item, body)`` for each container spec.

    ``specs(spec_name, capacity_tokens)`` is a fixed table of a few rows.
    """
    stage = Staging(documents.sparkSession, "token-sizes")
    sized = stage.cut(with_tokens(documents.select("item", "body"), tokenizer))
    out = None
    for row in specs.select("spec_name", "capacity_tokens").filter("capacity_tokens >= 1").distinct().orderBy("capacity_tokens", "spec_name").collect():
        name, capacity = row["spec_name"], int(row["capacity_tokens"])
        part = pack_documents(sized, capacity).select(F.lit(name).alias("spec_name"), F.lit(capacity).cast("long").alias("capacity_tokens"), "box", "item", "part", "tokens")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no container has a capacity")
    return out


def container_report(placed: DataFrame) -> DataFrame:
    """(spec_name, capacity_tokens, n_containers, n_parts, tokens, unused_share) of ``fill_containers``."""
    box = placed.groupBy("spec_name", "capacity_tokens", "box").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("filled"))
    total = box.groupBy("spec_name", "capacity_tokens").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_parts"), F.sum("filled").alias("tokens"))
    return total.withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))
