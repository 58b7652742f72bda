"""Graph checks: planted violations, rings against brute force, contradicting deliveries."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from mnemospark.operators import graph_checks
from mnemospark.operators.rings import on_rings
from mnemospark.plans.integrity_queries import PLANTED, _KINDS

FOLDER = "/root/testdata/sf0.001"


def planted(spark):
    rows = spark.createDataFrame(PLANTED, ", ".join(f"{n} {k}" for n, k in _KINDS.items()))
    return rows.withColumn("tenant_id", F.lit(None).cast("string"))


def test_every_kind_of_violation(spark):
    rows = planted(spark)
    state = rows.filter("memory_id <> 'planted-twice' OR content = 'one'")
    found = {(r.code, r.memory_id.removeprefix("planted-"), (r.other_id or "").removeprefix("planted-")) for r in graph_checks.all_violations(state, rows).collect()}
    ring = {("c6", "ring-1", "ring-1"), ("c6", "ring-2", "ring-1"), ("c6", "own", "own"), *(("c6", f"tangle-{i}", "tangle-1") for i in (1, 2, 3))}
    assert {f for f in found if f[0] == "c6"} == ring
    assert {("c1", "twice", ""), ("c2", "lost", "nowhere"), ("c3", "cross", "crossed"), ("c4", "both", "both-old"), ("c7", "head", "live"), ("c8", "live", "head"), ("c9", "two-1", "chain"), ("c10", "gone", ""), ("c11", "bare", ""), ("c12_layer", "layer", "")} <= found
    assert {f for f in found if f[0] in ("c1", "c2", "c3", "c4", "c9", "c10", "c12_layer")} == {("c1", "twice", ""), ("c2", "lost", "nowhere"), ("c3", "cross", "crossed"), ("c3", "crossed", "cross"), ("c4", "both", "both-old"), ("c9", "two-1", "chain"), ("c10", "gone", ""), ("c12_layer", "layer", "")}
    assert not any(f[1] == "kept" for f in found)  # an archived source is a proper predecessor


def rings_by_hand(links):
    ahead = {}
    for a, b in links:
        ahead.setdefault(a, set()).add(b)
    reach = {}
    for a in {x for l in links for x in l}:
        seen, todo = set(), list(ahead.get(a, ()))
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += ahead.get(b, ())
        reach[a] = seen
    return {(a, min(b for b in reach[a] if a in reach[b])) for a in reach if a in reach[a]}


@pytest.mark.parametrize("seed", range(4))
def test_rings_against_brute_force(spark, seed):
    rng = random.Random(seed)
    links = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(rng.choice([40, 60, 75]))]
    links += [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)] + ([("c120", "c017")] if seed % 2 else []) + links[:3] + [("n00", ""), (None, "n01")]
    got = {(r.node, r.ring) for r in on_rings(spark.createDataFrame(links, "src string, dst string")).collect()}
    assert got == rings_by_hand([l for l in links if l[0] and l[1]])


def test_no_links(spark):
    assert on_rings(spark.createDataFrame([], "src string, dst string")).count() == 0
    assert graph_checks.all_violations(planted(spark).limit(0)).count() == 0


def test_vectors_of_a_state(spark):
    records = planted(spark).filter("memory_id IN ('planted-raw', 'planted-head')")
    vectors = [("planted-raw", "s", 2, [0.0, 0.0]), ("planted-head", "s", 2, [0.0, 0.0]), ("planted-head", "t", 2, [1.0, 0.0]), ("x", "s", 2, [1.0]), ("y", "s", 2, None), ("z", "h", 2, [0.0, 0.0])]
    embeddings = spark.createDataFrame(vectors, "memory_id string, space_id string, dimensions int, vector array<float>")
    jobs = spark.createDataFrame([("planted-raw", "accepted"), ("planted-head", "accepted")], "raw_memory_id string, status string")
    spaces = spark.createDataFrame([("s", 2, "trained"), ("h", 2, "portable")], "space_id string, dimensions int, quality string")
    got = {(r.code, r.memory_id, r.other_id) for r in graph_checks.bad_embeddings(records, embeddings, jobs, spaces).collect()}
    assert got == {("c12_zero", "planted-head", "s"), ("c12_space", "planted-head", "t"), ("c12_width", "x", "s"), ("c12_width", "y", "s")}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")
def test_one_id_with_two_contents_and_all_checks(spark, tmp_path):
    for name in ("memory_embedding", "memory_job"):
        os.symlink(f"{FOLDER}/{name}.parquet", tmp_path / f"{name}.parquet")
    rows = spark.read.parquet(f"{FOLDER}/memory_record.parquet")
    chosen = rows.agg(F.min("memory_id")).first()[0]
    kept = rows.filter(F.col("memory_id") <= F.lit(sorted({r.memory_id for r in rows.select("memory_id").collect() if r.memory_id})[60]))
    other = kept.filter(F.col("memory_id") == chosen).limit(1).withColumn("content", F.lit("another content"))
    apart = kept.filter(F.col("memory_id") != chosen).limit(1).withColumn("memory_id", F.lit("apart")).withColumn("supersedes", F.array(F.lit(chosen))).withColumn("chain_id", F.lit("chain-apart"))
    kept.unionByName(other).unionByName(apart).write.parquet(str(tmp_path / "memory_record.parquet"))
    queries = __spark_entry__.queries()
    assert {r.memory_id for r in queries["c1_duplicate_id"](spark, str(tmp_path)).collect()} == {chosen, "planted-twice"}
    found = queries["c0_all_violations"](spark, str(tmp_path)).collect()
    assert {r.memory_id for r in found if r.code == "c1" and r["rank"] == 1} == {chosen, "planted-twice"}
    assert ("c13_chain", "apart", chosen) in {(r.code, r.memory_id, r.other_id) for r in found}
    want = queries["c12_embeddings"](spark, str(tmp_path)).count()
    assert sum(r.code in ("c12_width", "c12_zero", "c12_space") for r in found) == want


def test_all_violations_keep_only_their_results_on_disk(spark):
    folder = graph_checks.Staging(spark, "probe").root.removeprefix("file://").rsplit("/", 1)[0]
    before = set(os.listdir(folder))
    found = graph_checks.all_violations(planted(spark).filter("memory_id = 'planted-lost'"))
    (own,) = [d for d in set(os.listdir(folder)) - before if d.startswith("violations-")]
    assert not {"0001", "0002"} & set(os.listdir(f"{folder}/{own}"))  # the records and their links
    assert {r.code for r in found.collect()} == {"c2"}
