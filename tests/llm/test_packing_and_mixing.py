import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import mixing, packing
from mnemospark.llm.tokens import TOKENIZER, encoder, with_tokens

import os

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary file here")


def test_sum_of_squares_rule():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 60, size=3000)
    box = packing.pack(sizes, 100)
    fill = np.bincount(box, weights=sizes)
    assert fill.max() <= 100 and (fill > 0).all()
    assert 1 - sizes.sum() / (len(fill) * 100) < 0.02
    assert packing.pack(np.array([60, 40, 60, 40]), 100).tolist() == [0, 0, 1, 1]
    assert packing.pack(np.array([0, 100, 0]), 100).tolist() == [0, 0, 0]


def documents(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, ["a", "b", "c"][i % 3 if i % 7 else 0], "word " * int(rng.integers(1, 400)), "x") for i in range(n)]
    rows += [(9000, "a", "long " * 5000, "x"), (9001, "a", "", "x"), (9002, "b", None, "x"), (9003, None, "text", "x"), (None, "a", "nobody", "x")]
    return spark.createDataFrame(rows, "item long, source string, body string, part string")


def test_tokens(spark):
    got = {r.item: r.n_tokens for r in with_tokens(documents(spark, 5).select("item", "body")).collect()}
    assert got[9001] == 0 and got[9002] == 0 and got[9003] == len(encoder().encode_ordinary("text"))


@pytest.mark.parametrize("shard", [packing.SHARD, 50])
def test_every_token_is_placed_once(spark, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD", shard)
    docs = documents(spark)
    specs = spark.createDataFrame([("s", 512), ("w", 2048), ("none", None), ("zero", 0)], "spec_name string, capacity_tokens long")
    placed = packing.fill_containers(docs, specs)
    size = {r.item: r.n_tokens for r in with_tokens(docs.select("item", "body").filter("item IS NOT NULL")).collect()}
    for name, capacity in (("s", 512), ("w", 2048)):
        rows = placed.filter(f"spec_name = '{name}'").collect()
        total, boxes, parts = collections.Counter(), collections.Counter(), collections.defaultdict(list)
        for r in rows:
            total[r.item] += r.tokens
            boxes[r.box] += r.tokens
            parts[r.item].append((r.part, r.tokens))
        assert set(total) == set(size) and all(total[i] == n for i, n in size.items())
        assert max(boxes.values()) <= capacity
        for i, p in parts.items():
            assert len(p) == 1 or (size[i] > capacity and all(n == capacity for _, n in sorted(p)[:-1]))
        report = packing.container_report(placed).filter(f"spec_name = '{name}'").first()
        assert report.n_containers == len(boxes) and report.unused_share < (0.05 if name == "s" else 0.15)
    assert packing.fill_containers(docs.limit(0), specs).count() == 0


def test_documents_of_which_no_two_fit_spread_over_tasks(spark, monkeypatch):
    """8,000 documents of 0.6 container: no task gets more than a shard, and no pass is made in vain."""
    monkeypatch.setattr(packing, "SHARD", 500)
    seen = []
    kept = packing.Staging.cut

    def cut(self, df, *more):
        out = kept(self, df, *more)
        if "box" in out.columns:
            seen.append([r["n"] for r in out.groupBy(F.regexp_extract("box", r"^([0-9]+-[0-9]+)", 1)).agg(F.countDistinct("item").alias("n")).collect()])
            seen.append([r["n"] for r in out.groupBy(F.input_file_name()).agg(F.count("item").alias("n")).collect()])
        return out

    monkeypatch.setattr(packing.Staging, "cut", cut)
    rows = spark.range(8000).select(F.col("id").alias("item"), F.lit(600).cast("long").alias("n_tokens"))
    placed = packing.pack_documents(rows, 1000)
    assert placed.count() == placed.select("box").distinct().count() == 8000
    assert len(seen) == 2 and all(len(n) == 16 and max(n) < 700 for n in seen)


def test_mixture(spark):
    docs = documents(spark, 1200)
    mix = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, None), ("absent", 0.4, 2), ("zero", 0.0, 1), (None, 0.1, 1)], "source string, target_weight double, max_repeats long")
    out = mixing.mix_sources(docs, mix, block_tokens=64).collect()
    tokens = collections.Counter()
    uses = collections.Counter()
    for r in out:
        tokens[r.source] += r.to_token - r.from_token
        uses[r.item, r.from_token] += 1
    share = {s: n / sum(tokens.values()) for s, n in tokens.items()}
    assert set(share) == {"a", "b", "c"}
    assert abs(share["a"] - 0.5) < 0.06 and abs(share["b"] - 0.3) < 0.06 and abs(share["c"] - 0.2) < 0.06
    most = {"a": 1, "b": 3, "c": 1}
    source = {r.item: r.source for r in out}
    assert all(n <= most[source[i]] for (i, _), n in uses.items())
    slots = collections.Counter((r.shard, r.slot) for r in out)
    assert len({(r.shard, r.slot, r.source, r.block) for r in out}) == len(slots)  # one block a slot
    report = {r.source: r for r in mixing.mixture_report(mixing.mix_sources(docs, mix, block_tokens=64), mix).collect()}
    assert report["absent"].tokens == 0 and abs(report["a"].share - share["a"]) < 1e-6 and report["a"].most_uses == 1
    again = mixing.mix_sources(docs, mix, block_tokens=64).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_mixture_of_nothing(spark):
    docs, mix = documents(spark, 10), spark.createDataFrame([("q", 1.0, 1)], "source string, target_weight double, max_repeats long")
    assert mixing.mix_sources(docs, mix).count() == 0
    assert mixing.mix_sources(docs.limit(0), mix).count() == 0
    assert mixing.mix_sources(docs, mix.limit(0)).count() == 0


def test_shards_of_a_group(monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 100)
    counts = np.array([700, 250, 0, 50])
    drawn = list(mixing.shard_counts(counts, 3))
    assert len(drawn) == 10 and (sum(drawn) == counts).all() and all(d.sum() == 100 and (d >= 0).all() for d in drawn)
    assert len({tuple(d) for d in drawn}) > 1
    big = [mixing._hypergeometric(np.random.default_rng(i), 3_000_000_000, 1_000_000_000, 8192) for i in range(40)]
    assert abs(np.mean(big) - 6144) < 60 and np.std(big) > 5


def test_groups_hold_many_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_GROUPS", 2)
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 50)
    mix = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, None)], "source string, target_weight double, max_repeats long")
    names, counts = mixing.plan_counts({"a": 500, "b": 200, "c": 400}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 3, "c": 1})
    assert len(counts) == 2 and counts.sum() == 1000


def test_counts_and_permutation():
    names, counts = mixing.plan_counts({"a": 100, "b": 10_000, "c": 0}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 2, "b": 1, "c": 1})
    assert names == ["a", "b"] and counts.sum(axis=0)[0] <= 200 and counts.sum() == 360
    for n in (1, 2, 3, 100, 4097):
        assert sorted(mixing.permute(np.arange(n), n, 5).tolist()) == list(range(n))
    assert mixing.permute(np.arange(1000), 1000, 1).tolist() != mixing.permute(np.arange(1000), 1000, 2).tolist()
