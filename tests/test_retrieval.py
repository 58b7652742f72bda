import datetime as dt
import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemospark.operators import metrics, retrieval
from tests.test_store_and_streams import records

T0 = dt.datetime(2025, 1, 1)


def queries(spark, *texts, session_only=False, session=None):
    rows = [(f"q{i}", None, "u", "default", session, session_only, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "query_id string, tenant_id string, user_id string, agent_id string, session_id string, session_only boolean, query_text string")


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("p", "c", "d1", "tea tea cup"), ("p", "c", "d2", "tea"), ("p", "c", "d3", ""), ("x", "c", "d4", "tea")], "pool string, channel string, memory_id string, body string")
    asked = spark.createDataFrame([("q", "p", "tea tea none")], "query_id string, pool string, body string")
    got = {r.memory_id: r.lexical for r in retrieval.bm25(asked, docs, 1.5, 0.75).collect()}
    mean, idf = 4 / 3, math.log((3 - 2 + 0.5) / (2 + 0.5) + 1)
    score = lambda f, n: round(idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * n / mean)), 9)
    assert got == {"d1": score(2, 3), "d2": score(1, 1)}


def test_prefilter_and_quotas(spark):
    base = records(spark, 6)
    rows = base.withColumn("layer", F.when(F.col("memory_id").isin("m0", "m1"), "l4_identity").otherwise(F.col("layer")))
    rows = rows.withColumn("valid_until", F.when(F.col("memory_id") == "m5", F.lit(T0).cast("timestamp")))
    rows = rows.withColumn("status", F.when(F.col("memory_id") == "m4", "deleted").otherwise(F.col("status")))
    config = retrieval.SearchConfig(recall_limit=1, profile_limit=1)
    hits = retrieval.search(rows, queries(spark, "tea"), F.lit("2025-02-01").cast("timestamp"), config).collect()
    by = {h.channel: h.memory_id for h in hits}
    assert len(hits) == 2 and by["profile"] in {"m0", "m1"} and by["normal"] in {"m2", "m3"}
    assert all(("profile" in h.matched_by) == (h.channel == "profile") for h in hits)
    ready = retrieval.prepare(rows, queries(spark, "tea", "!!!"), F.lit("2025-02-01").cast("timestamp"))
    told = retrieval.diagnostics(retrieval.search_prepared(ready, config), ready, 60.0).collect()
    assert {t.query_id: t.confidence > 0 for t in told} == {"q0": True, "q1": False}
    assert {t.degraded for t in told} == {"semantic:portable-hash,tag:unavailable"}
    assert retrieval.search(rows.limit(0), queries(spark, "tea"), F.lit("2025-02-01").cast("timestamp")).count() == 0


def test_session_pool(spark):
    rows = records(spark, 3).withColumn("source_session_id", F.when(F.col("memory_id") == "m1", F.lit("s")))
    at = F.lit("2025-02-01").cast("timestamp")
    only = retrieval.search(rows, queries(spark, "tea", session_only=True, session="s"), at).collect()
    assert [h.memory_id for h in only] == ["m1"]
    bare = retrieval.search(rows, queries(spark, "tea", session_only=True), at).collect()
    assert {h.memory_id for h in bare} == {"m0", "m2"}


def test_metric_variants(spark):
    rankings = spark.createDataFrame([("q", 1, "x"), ("q", 2, "x"), ("q", 3, "y"), ("r", 1, "z")], "query_id string, rank int, memory_id string")
    labels = spark.createDataFrame([("q", "y"), ("q", "w"), ("s", "v")], "query_id string, memory_id string")
    g = metrics.golden(rankings, labels).first()
    assert (g.scored_queries, g.relevant_items, g.recall5_micro, g.mrr10) == (2, 3, 0.333333, 0.25)  # y is second once x is one
    c = {r.query_id: r for r in metrics.cases(rankings, labels).collect()}
    assert c["q"].first_rank == 3 and c["q"].reciprocal == 0.333333 and c["s"].recall10 == 0
    h = {r.query_id: r for r in metrics.hard_checks(rankings, spark.createDataFrame([("q", "x")], "query_id string, memory_id string")).collect()}
    assert (h["q"].forbidden_hits, h["q"].forbidden_ids, h["q"].duplicate_ids) == (2, 1, 1)
    cells = spark.createDataFrame([("a", 0.5)], "cell string, value double")
    gates = spark.createDataFrame([("a", 0.5), ("b", 0.0)], "cell string, least double")
    assert {r.cell: r.passed for r in metrics.gate(cells, gates, ["cell"]).collect()} == {"a": True, "b": False}
    gain = spark.createDataFrame([(0.0, 0.1), (0.0, 0.0), (0.5, 0.6)], "b double, v double").select(metrics.relative_gain(F.col("b"), F.col("v")).alias("g")).collect()
    assert [round(x.g, 6) for x in gain] == [float("inf"), 0.0, 0.2]
    assert metrics.golden(rankings.limit(0), labels.limit(0)).first().mrr10 == 0


def test_a_failed_tokenizer_closes_the_lexical_channel(spark):
    at = F.lit("2025-02-01").cast("timestamp")
    rows = records(spark, 3).withColumn("content", F.when(F.col("memory_id") == "m1", F.lit("x" * 300 + " tea")).otherwise(F.col("content")))
    ready = retrieval.prepare(rows, queries(spark, "likes tea"), at)
    hits = retrieval.search_prepared(ready)
    assert {h.matched_by for h in hits.collect()} == {"semantic"}
    assert retrieval.diagnostics(hits, ready, 60.0).first().degraded == "lexical:tokenizer-unavailable,semantic:portable-hash,tag:unavailable"


def test_trained_space(spark):
    at = F.lit("2025-02-01").cast("timestamp")
    rows = records(spark, 4)
    kept = [("m0", "s", 2, [1.0, 0.0]), ("m1", "s", 2, [0.6, 0.8]), ("m2", "s", 2, [0.0, 0.0]), ("m3", "other", 3, [1.0, 0.0, 0.0]), ("m3", "s", 2, [-1.0, 0.0])]
    stored = spark.createDataFrame(kept, "memory_id string, space_id string, dimensions int, vector array<float>")
    asked = spark.createDataFrame([("q0", [1.0, 0.0])], "query_id string, vector array<float>")
    space = retrieval.Space("s", 2, stored, asked)
    ready = retrieval.prepare(rows, queries(spark, "zzz", "zzz"), at)
    hits = retrieval.search_prepared(ready, space=space)
    assert [(h.query_id, h.memory_id) for h in hits.orderBy("fused_rank").collect()] == [("q0", "m0"), ("q0", "m1")]
    told = {r.query_id: r.degraded for r in retrieval.diagnostics(hits, ready, 60.0, space).collect()}
    assert told == {"q0": "tag:unavailable", "q1": "semantic:provider-unavailable,tag:unavailable"}
    with pytest.raises(retrieval.SpaceMismatch):
        retrieval.search_prepared(ready, space=retrieval.Space("s", 3, stored, asked))


def test_marks_in_ids_keep_owners_apart(spark):
    rows = records(spark, 2).withColumn("user_id", F.when(F.col("memory_id") == "m0", "a|b").otherwise("a")).withColumn("agent_id", F.when(F.col("memory_id") == "m0", "c").otherwise("b|c"))
    assert rows.select(retrieval.scope_key()).distinct().count() == 2
    asked = queries(spark, "tea").withColumn("user_id", F.lit("a|b")).withColumn("agent_id", F.lit("c"))
    assert [h.memory_id for h in retrieval.search(rows, asked, F.lit("2025-02-01").cast("timestamp")).collect()] == ["m0"]


def test_context_counts_its_frame(spark):
    rows = records(spark, 2)
    hits = spark.createDataFrame([("q", "normal", "m0", 1), ("q", "normal", "m1", 2)], "query_id string, channel string, memory_id string, fused_rank int")
    text = "\n".join([retrieval.CONTEXT_HEAD, "- [m0] (l2_fact, confidence 0.50) likes tea number0", retrieval.CONTEXT_TAIL])
    got = retrieval.pack_context(hits, rows, len(text)).collect()
    assert [(r.memory_id, r.used_chars) for r in got] == [("m0", len(text))]
    assert retrieval.pack_context(hits, rows, len(text) - 1).count() == 0


def test_fixed_digits(spark):
    rows = spark.createDataFrame([(0.8333335,), (0.0078125,), (1 / 3,), (1234567.25,)], "x double").select(metrics.to_fixed(F.col("x")).alias("y")).collect()
    assert [r.y for r in rows] == [0.833333, 0.007813, 0.333333, 1234567.25]


def test_lifecycle_rates(spark):
    cols = "language string, fault_scenario string, expected string, observed string, receipt_status string, duplicate_measured boolean, no_new_active_derived boolean, evidence_attached boolean"
    rows = [("zh", "nominal", "SUPERSEDE", "SUPERSEDE", "completed", True, True, True), ("en", "nominal", "ADD", "SUPERSEDE", "completed", True, True, False), ("en", "nominal", "ADD", None, "completed", False, True, True), ("en", "nominal", None, "ADD", "completed", False, True, True), ("en", "invalid_json", "ADD", None, "degraded", False, True, False)]
    seen = spark.createDataFrame(rows, cols)
    c = {r.language: (r.true_positive, r.true_negative, r.false_positive, r.false_negative, r.accuracy) for r in metrics.confusion(seen).collect()}
    assert c == {None: (1, 1, 1, 0, 0.666667), "zh": (1, 0, 0, 0, 1.0), "en": (0, 1, 1, 0, 0.5)}
    assert {r.language: (r.total, r.compressed, r.value) for r in metrics.compression(seen).collect()} == {None: (2, 1, 0.5), "zh": (1, 1, 1.0), "en": (1, 0, 0.0)}
    assert {r.fault_scenario: (r.accepted, r.degraded) for r in metrics.degradation(seen).collect()} == {"nominal": (4, 0), "injected_model_failure": (0, 0), "invalid_json": (1, 1), "schema_failure": (0, 0)}
    assert metrics.confusion(seen.limit(0)).count() == 3


def _all_pairs(spark, seed, breaks_ties, n_docs=400, n_asks=12):
    """Random texts of few words, so that many scores tie, and the hits of the whole rankings by plain Python."""
    rng, words = random.Random(seed), [f"w{i}" for i in range(30)]
    body = lambda: " ".join(rng.choices(words, k=rng.randint(1, 6)))
    docs = [("p", "c", f"d{i:04d}", T0 + dt.timedelta(hours=rng.randint(0, 3)), body()) for i in range(n_docs)]
    asks = [(f"q{i}", "p", rng.choice(["factual", "conceptual", "navigational"]), body()) for i in range(n_asks)]
    hasher, want = retrieval._Hasher(), []
    cells = {d[2]: hasher(d[4]) for d in docs}
    norm = lambda c: math.sqrt(sum(v * v for v in c.values()))
    mean = sum(len(d[4].split()) for d in docs) / len(docs)
    for query, _, kind, said in asks:
        own, lexical, semantic = hasher(said), {}, {}
        for _, _, key, _, text in docs:
            dot = sum(v * cells[key].get(k, 0) for k, v in own.items())
            s = round(dot / (norm(own) * norm(cells[key])), 9) if norm(own) and norm(cells[key]) else 0
            if s >= 0.08:
                semantic[key] = s
            x = 0
            for w in set(said.split()):
                f, df = text.split().count(w), sum(w in d[4].split() for d in docs)
                x += math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(text.split()) / mean))
            if round(x, 9) > 0:
                lexical[key] = round(x, 9)
        xr = {key: r for r, key in enumerate(sorted(lexical, key=lambda k: (-lexical[k], k)), 1)}
        sr = {key: r for r, key in enumerate(sorted(semantic, key=lambda k: (-semantic[k], xr.get(k, 1 << 40) if breaks_ties else 0, k)), 1)}
        ws, wx = retrieval.WEIGHTS[kind]
        at = {d[2]: d[3].timestamp() for d in docs}
        score = lambda k: round((ws / (5 + sr[k]) if k in sr else 0) + (wx / (5 + xr[k]) if k in xr else 0), 12)  # noqa: B023, E731
        first = sorted({*sr, *xr}, key=lambda k: (-score(k), -at[k], sr.get(k, (1 << 40) + xr.get(k, 0)), k))[:8]  # noqa: B023
        want += [(query, k, r, sr.get(k), xr.get(k)) for r, k in enumerate(first, 1)]
    docs = spark.createDataFrame(docs, "pool string, channel string, memory_id string, updated_at timestamp, body string")
    asks = spark.createDataFrame(asks, "query_id string, pool string, intent string, body string")
    tokens = lambda rows: retrieval.with_cells(rows.withColumn("tokens", F.split("body", " ")), "body")
    return tokens(asks), tokens(docs.withColumn("ask_blocks", F.lit(3))), sorted(want)


@pytest.mark.parametrize("breaks_ties", [False, True])
def test_first_hits_are_those_of_the_whole_rankings(spark, breaks_ties):
    """Ranks far down one list count; only the first hits leave the tasks."""
    asks, docs, want = _all_pairs(spark, 7, breaks_ties)
    hits = retrieval.fused(asks, docs, 8, retrieval.SearchConfig(rrf_k=5.0), lexical_breaks_ties=breaks_ties)
    assert sorted((h.query_id, h.memory_id, h.fused_rank, h.semantic_rank, h.lexical_rank) for h in hits.collect()) == want
    assert any((s or 0) > 22 or (x or 0) > 22 for *_, s, x in want)


def test_a_search_leaves_nothing_but_its_hits_on_disk(spark):
    folder = retrieval.Staging(spark, "probe").root.removeprefix("file://").rsplit("/", 1)[0]
    before = set(os.listdir(folder))
    hits = retrieval.search(records(spark, 6), queries(spark, "tea"), F.lit("2025-02-01").cast("timestamp"))
    left = [d for d in set(os.listdir(folder)) - before if any(os.scandir(f"{folder}/{d}"))]
    assert hits.count() == 6 and [d.split("-")[0] for d in left] == ["hits"]


def test_bounded_ranks_are_those_of_whole_lists():
    """Few values, so that many tie: ranks counted below the bounds are those of a sort, also past the best of a list."""
    rng, counted = np.random.default_rng(3), 0
    for breaks_ties in (False, True):
        for n in (5, 60, 400):
            s, x, flat = rng.integers(0, 90, n).astype(float), rng.integers(0, 40, n).astype(float), np.zeros(n)
            lists = [(retrieval._best(s, 10, x if breaks_ties else flat, 26), s, 10, x if breaks_ties else flat), (retrieval._best(x, 1, flat, 26), x, 1, flat)]
            whole = np.zeros((2, n), int)
            for k, (_, values, least, tie) in enumerate(lists):
                order = [i for i in sorted(range(n), key=lambda i: (-values[i], -tie[i], i)) if values[i] >= least]  # noqa: B023
                whole[k, order] = range(1, len(order) + 1)
            score = np.where(whole > 0, np.array([[1.0], [0.8]]) / (5.0 + whole), 0).sum(axis=0)
            want = set(np.flatnonzero(score >= np.sort(score)[-min(n, 8)] - 1e-11)) & set(np.flatnonzero(score > 0))
            places, ranks = retrieval._first(np.union1d(lists[0][0], lists[1][0]), lists, (1.0, 0.8), 5.0, 8)
            assert set(places) == want or (n < 8 and set(places) == set(np.flatnonzero(score > 0)))
            assert (ranks == whole[:, places]).all()
            counted += (ranks > 26).sum()
    assert counted


def test_texts_are_packed_and_unpacked_whole():
    """Half of the shuffled bytes; wide numbers, empty and null lists and tokens, and texts in any script stay as they are."""
    schema = pa.schema([("key", pa.string()), ("tokens", pa.list_(pa.string())), ("dims", pa.list_(pa.int16())), ("cells", pa.list_(pa.int32()))])
    rows = [("a", ["tea", "茶叶", "", None, "x" * 300], [0, 255, 7], [1, -1, 2]), ("b", [], [], []), ("c", None, None, None), ("d", ["é"], [200], [70_000])]
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    batches = [b for at in (0, 1, 2, 3) for b in table.slice(at, 1).to_batches()] + table.slice(1).to_batches() + table.slice(0, 0).to_batches()
    got = retrieval._unpacked(pa.Table.from_batches(list(retrieval._pack(iter(batches)))))
    want = [{"key": k, "tokens": t or [], "dims": d or [], "cells": c or []} for k, t, d, c in rows]
    assert got.to_pylist() == want + want[1:]
    floats = pa.table({"key": ["e"], "tokens": pa.array([None], pa.list_(pa.string())), "dims": [[0, 1]], "cells": [[0.1, -2.5]]})
    assert retrieval._unpacked(pa.Table.from_batches(list(retrieval._pack(iter(floats.to_batches()))))).to_pylist() == [{"key": "e", "tokens": [], "dims": [0, 1], "cells": [0.1, -2.5]}]
    small = pa.table({"key": ["f"], "tokens": [["w%02d" % i for i in range(40)]], "dims": pa.array([list(range(96))], pa.list_(pa.int16())), "cells": pa.array([[1] * 96], pa.list_(pa.int32()))})
    assert len(next(retrieval._pack(iter(small.to_batches()))).column("packed")[0].as_py()) < 400  # 40 tokens of a Spark array alone take 648 bytes


def test_asked_and_stored_rows_are_shuffled_packed(spark):
    asks, docs, _ = _all_pairs(spark, 5, False, 40, 3)
    plan = retrieval.fused(asks, docs, 8, retrieval.SearchConfig())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_pack(") == 2
