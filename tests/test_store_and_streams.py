import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mnemospark.api import InvalidInput, Memory, Scope
from mnemospark.sources import embedding, store
from mnemospark.streaming import capture

T0 = dt.datetime(2025, 1, 1)


def records(spark, n=4, **over):
    base = {f.name: None for f in store.RECORD_SCHEMA.fields}
    rows = []
    for i in range(n):
        row = base | {
            "schema_version": 1, "memory_id": f"m{i}", "user_id": "u", "agent_id": "default", "layer": "l2_fact", "content": f"likes tea number{i}", "status": "active", "visibility": "recallable",
            "source_type": "explicit", "confidence": 0.5, "created_at": T0, "updated_at": T0 + dt.timedelta(hours=i), "revision": 1, "supersedes": [], "superseded_by": [], "consolidates": [], "source_memory_ids": [], "tags": ["tea"],
        } | over
        rows.append(tuple(row.values()))
    return spark.createDataFrame(rows, store.RECORD_SCHEMA)


def test_compare_and_set(spark, tmp_path):
    s = store.SnapshotStore(spark, f"file://{tmp_path}/s")
    assert s.revision() == 0 and s.read().count() == 0
    assert s.write(records(spark), 0) == 1
    with pytest.raises(store.RevisionConflict):
        s.write(records(spark), 0)
    assert s.write(records(spark, 2), 1) == 2
    assert s.read().count() == 2 and s.read(1).count() == 4


def test_a_lost_race_leaves_the_winner_alone(spark, tmp_path):
    """Two writers that have both seen revision 0: the second one's rows are not what readers of revision 1 see."""
    one, two = (store.SnapshotStore(spark, f"file://{tmp_path}/race") for _ in range(2))
    late = two._publish
    two._publish = lambda revision, folders: (one.write(records(spark, 4), 0), late(revision, folders))[1]
    with pytest.raises(store.RevisionConflict):
        two.write(records(spark, 1), 0)
    assert one.revision() == 1 and one.read().count() == 4 and two.read(1).count() == 4


def test_a_bad_state_is_not_committed(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/bad")
    with pytest.raises(store.InvalidState):
        m.import_records(records(spark, 2).withColumn("supersedes", F.array(F.lit("nowhere"))))
    assert m.store.revision() == 0
    for fault in (dict(layer="l9_other"), dict(user_id="else")):
        with pytest.raises(ValueError):
            m.import_records(records(spark, 1, **fault), Scope("u"))
    vectors = spark.createDataFrame([("m0", "s", 2, [1.0, 0.0])], store.EMBEDDING_SCHEMA)
    with pytest.raises(ValueError):
        m.import_records(records(spark, 1), Scope("u"), vectors, ("t", 2))
    assert m.import_records(records(spark, 1), Scope("u"), vectors, ("s", 2)) == 1
    assert m.export(Scope("u")).first().embeddings[0].vector == [1.0, 0.0]
    with pytest.raises(ValueError):
        store.import_records(m.records, records(spark, 2).unionByName(records(spark, 2, content="other")))


def test_writes_through_the_facade(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/w")
    cols = "idempotency_key string, tenant_id string, user_id string, agent_id string, source_session_id string, content string, layer string, occurred_at timestamp, tags array<string>, turns array<bigint>"
    asked = spark.createDataFrame([("k", None, "u", "default", "s", "green tea", "l2_fact", None, ["tea"], [1])], cols)
    (receipt,) = m.add(asked, "2025-01-02T03:04:05Z").collect()
    assert receipt.status == "completed" and m.store.revision() == 2
    assert m.add(asked, "2025-01-03").first().replayed and m.store.revision() == 2
    target = receipt.created_memory_ids[0]
    change = spark.createDataFrame([("c", None, "u", "default", "s", target, "correct", "black tea")], "idempotency_key string, tenant_id string, user_id string, agent_id string, source_session_id string, target_id string, action string, content string")
    (revised,) = m.revise(change, "2025-01-04").collect()
    assert m.store.revision() == 4 and m.get(target, Scope("u")).first().status == "superseded"
    record, proof, past = m.inspect(revised.created_memory_ids[0], Scope("u"))
    assert record.first().content == "black tea" and proof.count() == 1 and [r.relative_id for r in past.collect()] == [target]
    assert {r.status for r in m.store.read(table="jobs").collect()} == {"completed"}
    for bad in ("yesterday", "2025-13-01", None):
        with pytest.raises(InvalidInput):
            m.search("tea", Scope("u"), bad)


def test_import(spark):
    held = records(spark, 2)
    assert store.import_records(held, records(spark, 3)).count() == 3
    with pytest.raises(ValueError):
        store.import_records(held, records(spark, 3, content="other"))
    outcome = {r.memory_id: r.outcome for r in store.import_outcome(held, records(spark, 3)).collect()}
    assert outcome == {"m0": "same", "m1": "same", "m2": "new"}


def test_json(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps([{"memory_id": "a", "revision": 2}]))
    bad.write_text('[{"memory_id": "a", "revision": "x"}]')
    assert store.read_json_strict(spark, str(good), store.RECORD_SCHEMA).first().revision == 2
    with pytest.raises(Exception):
        store.read_json_strict(spark, str(bad), store.RECORD_SCHEMA).collect()
    store.export_json(records(spark).select("memory_id", "tags"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    report = spark.createDataFrame([(2, "b"), (1, "a")], "k int, a string")
    assert store.canonical_json(report, "k") == '[{"a": "a", "k": 1}, {"a": "b", "k": 2}]'


def test_facade(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/m")
    m.import_records(records(spark).withColumn("source_memory_ids", F.when(F.col("memory_id") == "m3", F.array(F.lit("m1"))).otherwise(F.col("source_memory_ids"))))
    assert m.import_records(records(spark, 1)) == 1  # nothing new, same revision
    scope = Scope("u")
    assert [r.memory_id for r in m.list(scope, 2).orderBy("place").collect()] == ["m3", "m2"]
    hits = m.search("tea number2", scope, "2025-02-01").collect()
    assert hits[0].memory_id == "m2" and "semantic" in hits[0].matched_by and "lexical" in hits[0].matched_by
    rows, total = m.page(scope, 1, 2, needle="TEA")
    assert total == 4 and [r.memory_id for r in rows.collect()] == ["m2", "m1"]
    changed = {r.memory_id: r.status for r in m.forget("m1", scope, "2025-02-02").collect()}
    assert changed == {"m1": "deleted", "m3": "deleted"}
    assert m.get("m1", scope).first().status == "deleted" and m.get("m1", Scope("v")).count() == 0
    assert m.health().first().n_records == 4
    assert m.export(Scope("nobody")).count() == 0
    for bad in ("", "  "):
        with pytest.raises(InvalidInput):
            m.search(bad, scope, "2025-02-01")
    with pytest.raises(InvalidInput):
        m.list(scope, 0)


class Flaky:
    def __init__(self, fail=0, status=503):
        self.fail, self.status, self.calls = fail, status, 0

    def __call__(self, texts):
        self.calls += 1
        if self.calls <= self.fail:
            raise embedding.ProviderError(self.status)
        return [(i, [float(len(t)), 1.0]) for i, t in reversed(list(enumerate(texts)))]


def test_embedding_connector(spark):
    config = embedding.ProviderConfig("s", 2, batch_size=2, first_wait_s=0.0)
    flaky = Flaky(2)
    got = embedding.embed_batch(flaky, ["a", "bbb"], config)
    assert flaky.calls == 3 and abs(got[1][0] / got[1][1] - 3) < 1e-9
    with pytest.raises(embedding.ProviderError):
        embedding.embed_batch(Flaky(1, 400), ["a"], config)
    with pytest.raises(embedding.ProviderError):
        embedding.embed_batch(Flaky(9), ["a"], config)
    with pytest.raises(embedding.ProviderError):
        embedding.embed_batch(lambda t: [(0, [1.0])], ["a"], config)
    for bad in (dict(space_id=" ", dimensions=2), dict(space_id="s", dimensions=0), dict(space_id="s", dimensions=2, endpoint="ftp://x"), dict(space_id="s", dimensions=2, endpoint="here")):
        with pytest.raises(ValueError):
            embedding.ProviderConfig(**bad)
    rows = spark.createDataFrame([("k1", "aa"), ("k2", None), ("k3", "c")], "key string, body string")
    provider = lambda texts: [(i, [float(len(t)), 1.0]) for i, t in enumerate(texts)]
    assert embedding.embed(rows, provider, config).count() == 3


def _stream(spark, tmp_path, rows, schema):
    folder = str(tmp_path / "in")
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_capture_drops_repeats(spark, tmp_path):
    schema = "session_id string, turn_id long, ts timestamp, text string"
    first = [("s", 1, T0, "a"), ("s", 2, T0, "b")]
    stream = _stream(spark, tmp_path, [first, [("s", 1, T0, "a"), ("s", 3, T0 + dt.timedelta(minutes=5), "c")]], schema)
    out = str(tmp_path / "out")
    capture.captured_turns(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(90)
    assert sorted(r.turn_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_recent_ring_and_windows_equal_batch(spark, tmp_path):
    schema = "scope string, event_id long, ts timestamp"
    rows = [[("a", i, T0 + dt.timedelta(minutes=i)) for i in range(k, k + 30)] for k in (0, 30)]
    stream = _stream(spark, tmp_path, rows, schema)
    seen = []
    capture.write_jobs(stream, lambda df, i: seen.append((i, df.count())), str(tmp_path / "cp1")).awaitTermination(90)
    assert sum(n for _, n in seen) == 60
    ring = capture.recent_by_scope(_stream2(spark, tmp_path, schema).withWatermark("ts", "1 hour"), 5)
    ring.writeStream.outputMode("update").format("memory").queryName("ring").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination(120)
    last = spark.sql("SELECT event_id FROM ring ORDER BY ts_us DESC, place LIMIT 1").first().event_id
    assert last == 59
    counts = capture.windowed_counts(_stream2(spark, tmp_path, schema), ["scope"], "10 minutes")
    counts.writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start().awaitTermination(120)
    batch = capture.windowed_counts(spark.read.parquet(str(tmp_path / "in")), ["scope"], "10 minutes")
    assert set(spark.table("win").collect()) == set(batch.collect())


def _stream2(spark, tmp_path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_stream_recall_ranks(spark, tmp_path):
    schema = "query_id string, tenant_id string, user_id string, agent_id string, session_id string, session_only boolean, query_text string"
    stream = _stream(spark, tmp_path, [[("q1", None, "u", "default", None, False, "tea number2")], [("q2", None, "w", "default", None, False, "tea")]], schema)
    got = []
    capture.recalls(stream, lambda: records(spark), lambda hits, i: got.extend(hits.collect()), str(tmp_path / "c"), F.lit("2025-02-01").cast("timestamp")).awaitTermination(120)
    assert {h.query_id for h in got} == {"q1"} and min(got, key=lambda h: h.fused_rank).memory_id == "m2"


def test_order_within_scopes_and_ring_of_all(spark):
    cols = "tenant_id string, user_id string, agent_id string, ts timestamp, capture_key string"
    batch = spark.createDataFrame([(None, "u", "a", T0, "k2"), (None, "u", "a", T0, "k1"), (None, "v", "a", T0, "k3")], cols)
    assert {r.capture_key: r.turn_in_scope for r in capture.in_scope_order(batch).collect()} == {"k1": 1, "k2": 2, "k3": 1}
    events = lambda lo, hi: spark.createDataFrame([("s", i, T0 + dt.timedelta(minutes=i)) for i in range(lo, hi)], "scope string, event_id long, ts timestamp")
    ring = capture.last_of_all(events(0, 6), events(4, 9), 5)
    assert sorted(r.event_id for r in ring.collect()) == [4, 5, 6, 7, 8]
