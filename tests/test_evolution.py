"""Transitions on small states: what they make, and that the state keeps its invariants."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from mnemospark.operators import evolution, graph_checks, listing
from tests.test_oracles import FOLDER
from tests.test_store_and_streams import records

def at():
    return F.lit("2025-03-01").cast("timestamp")

SOURCE = "struct<client_ref string, confidence double, tags array<string>, turns array<bigint>, occurred_at timestamp, speculate string>"
JOBS = "job_id string, request_id string, idempotency_key string, raw_memory_id string, tenant_id string, user_id string, agent_id string, status string, created_memory_ids array<string>"


def jobs(spark, *rows):
    return spark.createDataFrame([(f"j{i}", "r", key, "old-raw", None, "u", "default", status, ["old"]) for i, (key, status) in enumerate(rows)], JOBS)


def whole(spark, held, changed):
    return graph_checks.all_violations(evolution.replaced(held, changed)).collect()


def evidenced(spark, n=3):
    return records(spark, n).withColumn("source_memory_ids", F.array(F.concat(F.lit("raw-"), "memory_id")))


def test_direct_writes_and_replays(spark):
    cols = "idempotency_key string, tenant_id string, user_id string, agent_id string, source_session_id string, content string, layer string, occurred_at timestamp, tags array<string>, turns array<bigint>"
    rows = [("new", None, "u", "default", "s", "  kept  ", "l2_fact", None, [" A ", "a"], [1]), ("new", None, "u", "default", "s", "~ later", "l2_fact", None, None, None), ("used", None, "u", "default", "s", "again", "l2_fact", None, None, None), ("used", None, "w", "default", "s", "other owner", "l4_identity", None, None, None)]
    done = evolution.add_direct(jobs(spark, ("used", "accepted")), spark.createDataFrame(rows, cols), at())
    told = {(r.idempotency_key, r.user_id): (r.status, r.replayed, len(r.created_memory_ids)) for r in done.receipts.collect()}
    assert told == {("new", "u"): ("completed", False, 1), ("used", "u"): ("degraded", True, 1), ("used", "w"): ("completed", False, 1)}
    assert {(r.layer, r.visibility) for r in done.accepted.collect()} == {("l1_raw", "recallable")}
    made = {r.layer: r for r in done.completed.filter("user_id = 'u'").collect()}
    assert made["l2_fact"].content == "kept" and made["l2_fact"].tags == ["a"] and made["l2_fact"].source_memory_ids == [made["l1_raw"].memory_id]
    assert made["l1_raw"].content == "  kept  " and made["l1_raw"].visibility == "source_only"
    assert whole(spark, records(spark, 2), done.completed) == []
    assert evolution.add_direct(jobs(spark), spark.createDataFrame([], cols), at()).receipts.count() == 0


def test_new_heads(spark):
    rows = evidenced(spark, 4).withColumn("chain_id", F.when(F.col("memory_id") == "m2", F.lit("chain-2")).when(F.col("memory_id") == "m1", F.lit("chain-9")))
    one, two = ("a", 0.4, [" X "], [3], dt.datetime(2025, 1, 5), "maybe"), ("b", 0.8, ["y", "x"], [1, 3], dt.datetime(2025, 1, 6), None)
    plan = spark.createDataFrame([("op1", "SUPERSEDE", "raw", "new", "l2_fact", ["m0"], [one]), ("op2", "CONSOLIDATE", "raw", "both", "l2_fact", ["m3", "m2", "m1", "m2", "absent"], [two, one])], f"op_id string, kind string, raw_id string, content string, layer string, target_ids array<string>, sources array<{SOURCE}>")
    heads, targets = evolution.new_heads(rows, plan, at())
    by = {len(h.consolidates): h for h in heads.collect()}
    assert by[0].supersedes == ["m0"] and by[0].meta == '{"speculate":"maybe"}' and by[0].source_memory_ids == ["raw", "raw-m0"] and by[0].chain_id.startswith("chain-")
    big = by[3]
    assert big.consolidates == ["m3", "m2", "m1"] and big.chain_id == "chain-2" and big.confidence == 0.8 and big.tags == ["y", "x"] and big.source_turn_indexes == [1, 3]
    assert big.occurred_at == dt.datetime(2025, 1, 6) and big.meta == '{"speculations":{"a":"maybe"}}' and big.source_memory_ids == ["raw", "raw-m3", "raw-m2", "raw-m1"]
    kept = {t.memory_id: t for t in targets.collect()}
    assert kept["m1"].chain_id == "chain-9" and kept["m3"].chain_id == "chain-2" and all(t.status == "superseded" and t.visibility == "source_only" for t in kept.values())


def test_profiles(spark):
    rows = records(spark, 2).withColumn("layer", F.lit("l0_basic_info")).withColumn("meta", F.lit('{"profile":{"name":"old","city":"x"}}'))
    cols = "raw_id string, patch map<string,string>, turns array<bigint>, tenant_id string, user_id string, agent_id string, source_session_id string"
    patches = spark.createDataFrame([("r1", {"language": "zh", "name": "new", "shoe": "9"}, [2], None, "u", "default", "s"), ("r2", {"name": "first"}, None, None, "v", "default", None), ("r3", {"shoe": "9"}, None, None, "w", "default", None), ("r4", None, None, None, "x", "default", None)], cols)
    heads, priors = evolution.profiles(rows, patches, ["name", "language"], at())
    by = {h.user_id: h for h in heads.collect()}
    assert set(by) == {"u", "v"} and by["u"].content == "name: new\ncity: x\nlanguage: zh" and by["u"].revision == 2 and by["u"].supersedes == ["m0"] and by["v"].supersedes == [] and by["v"].revision == 1
    (prior,) = priors.collect()
    assert (prior.memory_id, prior.status, prior.superseded_by) == ("m0", "superseded", [by["u"].memory_id])


def test_extraction(spark):
    held = evidenced(spark, 3).withColumn("chain_id", F.when(F.col("memory_id") == "m1", F.lit("c")))
    asked = [("r1", "k1", None, "u", "default", "s", "said", None, [7], " told ", {"name": "n"}, None), ("r2", "k2", None, "u", "default", "s", "lost", None, [8], "no", None, "EXTRACTION_FAILED"), ("r3", "k3", None, "u", "default", "s", "nothing", None, [9], None, None, None)]
    requests = spark.createDataFrame(asked, "request_id string, idempotency_key string, tenant_id string, user_id string, agent_id string, source_session_id string, content string, occurred_at timestamp, turns array<bigint>, summary string, patch map<string,string>, failure string")
    src = [("r1", ref, ref + " text", "l2_fact", conf, [ref], [n], None, None) for n, (ref, conf) in enumerate([("a", 0.2), ("b", 0.9), ("c", 0.3), ("d", 0.4)])]
    sources = spark.createDataFrame([*src, ("r2", "a", "never", "l2_fact", 0.5, None, None, None, None)], "request_id string, client_ref string, content string, layer string, confidence double, tags array<string>, turns array<bigint>, occurred_at timestamp, speculate string")
    ops = [("o1", "r1", "ADD", ["a"], [], ""), ("o2", "r1", "NOOP", ["b"], ["m0"], ""), ("o3", "r1", "CONSOLIDATE", ["c", "d"], ["m1", "m2"], "joined"), ("o4", "r2", "ADD", ["a"], [], "")]
    operations = spark.createDataFrame(ops, "op_id string, request_id string, type string, source_refs array<string>, target_ids array<string>, content string")
    done = evolution.add_extract(held, jobs(spark), requests, sources, operations, ["name"], at())
    rows = {r.memory_id: r for r in done.completed.collect()}
    raw = {r.idempotency_key: r for r in rows.values() if r.layer == "l1_raw"}
    assert {k: r.visibility for k, r in raw.items()} == {"k1": "source_only", "k2": "recallable", "k3": "recallable"}
    assert rows["m0"].confidence == 0.9 and rows["m0"].source_memory_ids == ["raw-m0", raw["k1"].memory_id] and rows["m0"].tags == ["tea", "b"] and rows["m0"].status == "active"
    fresh = [r for r in rows.values() if r.memory_id not in ("m0", "m1", "m2") and r.layer != "l1_raw"]
    assert sorted((r.layer, r.content) for r in fresh) == [("l0_basic_info", "name: n"), ("l2_fact", "a text"), ("l2_fact", "joined"), ("l3_summary", "told")]
    assert rows["m1"].status == rows["m2"].status == "superseded" and rows["m2"].chain_id == "c"
    told = {r.idempotency_key: (r.status, len(r.created_memory_ids)) for r in done.receipts.collect()}
    assert told == {"k1": ("completed", 4), "k2": ("degraded", 0), "k3": ("completed", 0)}
    assert whole(spark, held, done.completed) == []
    twice = evolution.add_extract(held, done.jobs, requests, sources, operations, ["name"], at())
    assert twice.completed.count() == 0 and all(r.replayed for r in twice.receipts.collect())


def test_revisions(spark):
    held = evidenced(spark, 4).withColumn("status", F.when(F.col("memory_id") == "m3", "archived").otherwise(F.col("status")))
    cols = "idempotency_key string, tenant_id string, user_id string, agent_id string, source_session_id string, target_id string, action string, content string, expected_revision long"
    ask = [("a", "m0", "confirm", None, 5), ("b", "m1", "correct", "better", 5), ("c", "m2", "correct", " ", 5), ("d", "m3", "confirm", None, 5), ("e", "m2", "confirm", None, 4), ("f", "gone", "confirm", None, 5), ("used", "m2", "nonsense", None, 0), ("g", "m2", "confirm", "text", 5)]
    requests = spark.createDataFrame([(k, None, "u", "default", "s", target, act, text, rev) for k, target, act, text, rev in ask], cols)
    revisions = spark.createDataFrame([(None, "u", "default", 5)], "tenant_id string, user_id string, agent_id string, scope_revision long")
    done = evolution.revise(held, jobs(spark, ("used", "completed")), requests, at(), revisions)
    told = {r.idempotency_key: r.status for r in done.receipts.collect()}
    assert told == {"a": "completed", "b": "completed", "c": "invalid", "d": "invalid", "e": "revision_conflict", "f": "invalid", "g": "invalid", "used": "completed"}
    heads = {r.supersedes[0]: r for r in done.completed.collect() if r.supersedes}
    assert heads["m0"].content == "likes tea number0" and heads["m1"].content == "better" and heads["m1"].revision == 2 and heads["m1"].tags == ["tea"]
    assert whole(spark, held, done.completed) == []


def test_plan_faults(spark):
    sources = spark.createDataFrame([("r", "a", "l2_fact"), ("r", "b", "l2_fact"), ("r", "c", "l4_identity"), ("r", "d", "l2_fact")], "request_id string, client_ref string, layer string")
    short = spark.createDataFrame([("r", "a", "m0", "l2_fact"), ("r", "c", "m4", "l2_fact")], "request_id string, client_ref string, memory_id string, layer string")
    ops = [("1", "r", "SUPERSEDE", ["a"], ["m0", "m9"]), ("2", "r", "CONSOLIDATE", ["b", "c"], ["m4"]), ("3", "r", "ADD", ["b"], []), ("4", "r", "ADD", ["zz"], [])]
    plan = spark.createDataFrame(ops, "op_id string, request_id string, type string, source_refs array<string>, target_ids array<string>")
    got = {(r.fault, r.client_ref, r.target_id) for r in evolution.plan_faults(sources, plan, short).collect()}
    assert got == {("uncovered", "d", None), ("unknown_source", "zz", None), ("repeated_source", "b", None), ("sources_cross_layers", "b", None), ("unauthorized_target", None, "m9"), ("target_crosses_layers", "c", "m4")}


def test_observed_operations(spark):
    keys = "case_id string, memory_id string, source_memory_ids array<string>"
    after_cols = "case_id string, memory_id string, layer string, status string, visibility string, supersedes array<string>, consolidates array<string>, superseded_by array<string>, source_memory_ids array<string>"
    before, after, alias, raws = [], [], [], []

    def case(name, *rows):
        raws.append((name, "raw"))
        for i in (0, 1):
            before.append((name, f"old{i}", []))
            alias.append((name, f"a{i}", f"old{i}"))
        after.extend((name, *r) for r in rows)

    old = lambda i, status="active", by=(), evidence=(): (f"old{i}", "l2_fact", status, "recallable", [], [], list(by), list(evidence))
    new = lambda name, s=(), c=(), evidence=("raw",): (name, "l2_fact", "active", "recallable", list(s), list(c), [], list(evidence))
    case("add", new("h"), old(0), old(1))
    case("supersede", new("h", ["old0"]), old(0, "superseded", ["h"]), old(1))
    case("one-sided", new("h", ["old0"]), old(0), old(1))
    case("merge", new("h", [], ["old0", "old1"]), old(0, "superseded", ["h"]), old(1, "superseded", ["h"]))
    case("merge-one", new("h", [], ["old0"]), old(0, "superseded", ["h"]), old(1))
    case("unlinked", new("h", (), (), ["else"]), old(0), old(1))
    case("two", new("h"), new("g"), old(0), old(1))
    case("noop", old(0, evidence=["raw"]), old(1))
    case("noop-two", old(0, evidence=["raw"]), old(1, evidence=["raw"]))
    seen = evolution.observe_operations(spark.createDataFrame(before, keys), spark.createDataFrame(after, after_cols), spark.createDataFrame(alias, "case_id string, alias string, memory_id string"), spark.createDataFrame(raws, "case_id string, raw_id string"))
    got = {r.case_id: (r.operation, r.target_aliases) for r in seen.collect()}
    none = (None, [])
    assert got == {"add": ("ADD", []), "supersede": ("SUPERSEDE", ["a0"]), "one-sided": none, "merge": ("CONSOLIDATE", ["a0", "a1"]), "merge-one": none, "unlinked": none, "two": none, "noop": ("NOOP", ["a0"]), "noop-two": none}


def test_turns_and_messages(spark):
    rows = [("s", 1, "start"), ("s", 2, "start"), ("s", 3, "say"), ("s", 4, "end"), ("s", 5, "end"), ("t", 1, "say"), ("v", 1, "start"), ("v", 2, "say")]
    turns = spark.createDataFrame(rows, "k string, seq int, kind string")
    got = {(r.k, r.seq) for r in listing.turn_slice(turns, "k", "seq", F.col("kind") == "start", F.col("kind") == "end").collect()}
    assert got == {("s", 3), ("v", 2)}
    said = spark.createDataFrame([(1, "user", None), (2, "tool", None), (3, "plugin", "memory"), (4, "plugin", "calendar"), (5, None, None)], "i int, source_kind string, source_plugin string")
    assert {r.i for r in listing.spoken(said).collect()} == {1, 4, 5}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")
def test_plan_faults_get_the_named_targets_alone(spark, monkeypatch):
    """Of the whole shortlists only the rows that the operations name go into the checks."""
    seen, check = {}, evolution.plan_faults

    def spy(sources, operations, shortlists):
        seen["named"], seen["rows"] = evolution.named_targets(operations), shortlists
        return check(sources, operations, shortlists)

    monkeypatch.setattr(evolution, "plan_faults", spy)
    assert __spark_entry__.queries()["t12_plan_faults"](spark, FOLDER).count() > 0
    keys = ["request_id", "client_ref", "memory_id"]
    assert seen["rows"].count() > 0
    assert seen["rows"].join(seen["named"], keys, "left_anti").isEmpty()
