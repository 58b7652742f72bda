"""Mixing sources to target shares of all tokens (problem 8).

Each source's documents are laid end to end and cut into blocks of ``block_tokens`` tokens.  The size of the
mixture is the largest at which no source needs more than its ``max_repeats`` passes.  For each output shard
the number of blocks per source is a multinomial draw with the target weights; a source whose draws exceed
its passes hands the excess to the sources furthest below their target.  Slot i of a source is mapped
through a pseudorandom permutation of the source's block numbers, another one each pass, and slots and
blocks are joined by source and number.

Scale: token offsets come from a two-level prefix sum (a hash bucket of a source is bounded, a table of
bucket totals is small), the permutation is a keyed Feistel network computed in place, and the join keys
are (source, block), all distinct, so a source of a third of all rows spreads evenly.  The driver holds
one count per source and group of shards, at most ``MOST_GROUPS`` groups; a group's task draws each of its
shards' counts from what the group has left (a multivariate hypergeometric draw, which is what a random order
of the group's slots would give) and yields shards of ``SHARD_BLOCKS`` slots one by one, so that neither the
driver nor a task holds more as the collection grows.

Defined results: rows with a null key, or of a null source or one without a weight, take no part; null and
empty texts have no tokens and fill no block; sources that are named but absent, or have no tokens, cannot
be drawn, and the others keep their proportions; a null or negative weight is 0, null max_repeats is 1; the
last block of a source is shorter.  Where nothing can be drawn the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.tokens import TOKENIZER, with_tokens
from mnemospark.plans.staging import Staging

BLOCK_TOKENS = 256
SHARD_BLOCKS = 8192
MOST_GROUPS = 4096
BUCKETS = 4096
SEED = 20240229


def _block_pieces(sized: DataFrame, block_tokens: int) -> DataFrame:
    """(source, block, item, from_token, to_token): which tokens of which document fill each block."""
    spread = sized.filter("n_tokens > 0").withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(BUCKETS)))
    totals = spread.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("bucket_tokens"))
    before = F.sum("bucket_tokens").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.withColumn("bucket_start", F.coalesce(before, F.lit(0))).drop("bucket_tokens")
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("item").rowsBetween(Window.unboundedPreceding, -1))
    laid = spread.withColumn("inside", F.coalesce(inside, F.lit(0))).join(starts, ["source", "bucket"])
    laid = laid.select("source", "item", "n_tokens", (F.col("bucket_start") + F.col("inside")).alias("start"))
    first, last = F.floor(F.col("start") / block_tokens), F.floor((F.col("start") + F.col("n_tokens") - 1) / block_tokens)
    cut = laid.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("block") * block_tokens, F.col("start")) - F.col("start")
    end = F.least((F.col("block") + 1) * block_tokens, F.col("start") + F.col("n_tokens")) - F.col("start")
    return cut.select("source", "block", "item", begin.alias("from_token"), end.alias("to_token"))


def plan_counts(blocks: dict[str, int], weights: dict[str, float], repeats: dict[str, int], seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """(sources, counts[group, source]): blocks each group of shards takes of each source."""
    names = sorted(s for s in weights if weights[s] > 0 and blocks.get(s, 0) > 0 and repeats[s] > 0)
    if not names:
        return [], np.zeros((0, 0), dtype=np.int64)
    share = np.array([weights[s] for s in names])
    share /= share.sum()
    most = np.array([blocks[s] * repeats[s] for s in names], dtype=np.int64)
    total = max(1, int(math.floor(min(m / w for m, w in zip(most, share)))))
    shards = min(MOST_GROUPS, max(1, math.ceil(total / SHARD_BLOCKS)))
    sizes = np.full(shards, total // shards, dtype=np.int64)
    sizes[: total % shards] += 1
    counts = np.random.default_rng(seed).multinomial(sizes, share).astype(np.int64)
    # hand draws beyond a source's passes to the sources furthest below their target
    excess = np.maximum(counts.sum(axis=0) - most, 0)
    for j in np.flatnonzero(excess):
        for k in range(shards):
            take = int(min(excess[j], counts[k, j]))
            while take > 0:
                short = share * total - counts.sum(axis=0)
                short[counts.sum(axis=0) >= most] = -np.inf
                to = int(np.argmax(short))
                if not np.isfinite(short[to]):
                    counts[k, j] -= take
                    excess[j] -= take
                    break
                n = int(min(take, max(1, math.ceil(short[to])), most[to] - counts[:, to].sum()))
                counts[k, j] -= n
                counts[k, to] += n
                excess[j] -= n
                take -= n
    return names, counts


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1 at the given places: Feistel rounds with cycle walking."""
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for turn in range(4):
            mixed = (right + np.uint64((key * 4 + turn) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(31)) & mask)
        return (left << np.uint64(half)) | right

    x = once(index.astype(np.uint64))
    outside = x >= n
    while outside.any():
        x[outside] = once(x[outside])
        outside = x >= n
    return x.astype(np.int64)


def shard_counts(counts: np.ndarray, seed: int) -> Iterator[np.ndarray]:
    """Blocks of each source in each shard of a group with ``counts`` blocks a source."""
    left, rng = counts.astype(np.int64).copy(), np.random.default_rng(seed)
    shards = max(1, math.ceil(int(left.sum()) / SHARD_BLOCKS))
    for i in range(shards):
        take = math.ceil(int(left.sum()) / (shards - i))
        drawn = np.zeros_like(left)
        rest = take
        for j in range(len(left)):  # one source after another, each out of what it and the following have
            after = int(left[j + 1 :].sum())
            drawn[j] = _hypergeometric(rng, int(left[j]), after, rest)
            rest -= int(drawn[j])
        left -= drawn
        yield drawn


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw; numbers beyond the generator's range by its normal limit."""
    if not good or not n:
        return 0
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    share = good / (good + bad)
    spread = math.sqrt(n * share * (1 - share) * (good + bad - n) / max(good + bad - 1, 1))
    return int(min(max(round(rng.normal(n * share, spread)), n - bad, 0), good, n))


def mix_sources(documents: DataFrame, mix: DataFrame, block_tokens: int = BLOCK_TOKENS, tokenizer: str = TOKENIZER, seed: int = SEED) -> DataFrame:
    """(shard, slot, source, block, pass, item, from_token, to_token): the mixture, a row per piece of a document.

    ``documents(item, source, body)``; ``mix(source, target_weight, max_repeats)`` is a small fixed table.
    """
    spark = documents.sparkSession
    stage = Staging(spark, "mixing")
    asked = {r["source"]: r for r in mix.filter("source IS NOT NULL").select("source", "target_weight", "max_repeats").collect()}
    weights = {s: max(r["target_weight"] or 0.0, 0.0) for s, r in asked.items()}
    repeats = {s: 1 if r["max_repeats"] is None else int(r["max_repeats"]) for s, r in asked.items()}
    named = documents.select("item", "source", "body").filter(F.col("item").isNotNull() & F.col("source").isin([s for s in weights if weights[s] > 0]))
    pieces = stage.cut(_block_pieces(stage.cut(with_tokens(named, tokenizer)), block_tokens))
    blocks = {r["source"]: r["n"] for r in pieces.groupBy("source").agg((F.max("block") + 1).alias("n")).collect()}
    names, counts = plan_counts(blocks, weights, repeats, seed)
    schema = "shard long, slot long, source string, block long, pass int"
    slots = spark.createDataFrame([], schema)
    if names:
        first = np.concatenate([np.zeros((1, len(names)), dtype=np.int64), np.cumsum(counts, axis=0)])
        in_group = np.maximum(1, np.ceil(counts.sum(axis=1) / SHARD_BLOCKS)).astype(np.int64)
        base = np.cumsum(in_group) - in_group

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for group in batch["id"]:
                    begun = first[group].copy()
                    for i, taken in enumerate(shard_counts(counts[group], seed + 15485863 * int(group))):
                        parts = []
                        for j, source in enumerate(names):
                            place = np.arange(begun[j], begun[j] + taken[j])
                            turn = place // blocks[source]
                            block = np.zeros(len(place), dtype=np.int64)
                            for p in np.unique(turn):
                                here = turn == p
                                block[here] = permute(place[here] % blocks[source], blocks[source], seed + 7919 * j + 104729 * int(p))
                            parts.append(pd.DataFrame({"source": source, "block": block, "pass": turn.astype(np.int32)}))
                        begun += taken
                        shard = int(base[group]) + i
                        table = pd.concat(parts, ignore_index=True)
                        table = table.iloc[np.random.default_rng([seed, shard]).permutation(len(table))].reset_index(drop=True)
                        table.insert(0, "slot", np.arange(len(table), dtype=np.int64))
                        table.insert(0, "shard", np.int64(shard))
                        yield table

        slots = spark.range(0, len(counts), 1, min(len(counts), 1024)).mapInPandas(draw, schema)
    # the planner can't know how many slots a shard yields and would broadcast them
    return slots.join(pieces.hint("merge"), ["source", "block"]).select("shard", "slot", "source", "block", "pass", "item", "from_token", "to_token")


def mixture_report(mixture: DataFrame, mix: DataFrame) -> DataFrame:
    """(source, target_weight, max_repeats, tokens, share, most_uses): what each source reached.

    most_uses is the largest number of times any token of the source is used.
    """
    used = mixture.groupBy("source").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("tokens"), (F.max("pass") + 1).alias("most_uses"))
    total = used.agg(F.sum("tokens").alias("all_tokens")).withColumn("k", F.lit(1))
    rows = mix.select("source", "target_weight", "max_repeats", F.lit(1).alias("k")).join(used, "source", "left").join(total, "k")
    tokens = F.coalesce("tokens", F.lit(0))
    share = F.coalesce(F.round(tokens / F.col("all_tokens"), 6), F.lit(0.0))
    return rows.select("source", "target_weight", "max_repeats", tokens.alias("tokens"), share.alias("share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
