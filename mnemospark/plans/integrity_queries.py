"""Queries of the graph checks and the record transitions.

The checks see the whole record table and, beside it, the planted records below, of which every kind of
violation has some; operator and SQL get the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import evolution, graph_checks, retrieval
from mnemospark.plans import common_sql as q
from mnemospark.plans.reference_queries import SCOPE, _sources, as_of, emb, ext, job, live, rec
from mnemospark.plans.staging import Staging
from mnemospark.registry import Registry

registry = Registry()
add = registry.add

_KINDS = {
    "memory_id": "string", "user_id": "string", "agent_id": "string", "layer": "string", "status": "string", "visibility": "string", "source_type": "string", "content": "string", "chain_id": "string",
    "revision": "bigint", "supersedes": "array<string>", "superseded_by": "array<string>", "consolidates": "array<string>", "source_memory_ids": "array<string>",
}


def _row(memory_id, layer="l2_fact", status="active", visibility="recallable", chain=None, revision=1, over=(), by=(), merges=(), evidence=("planted-raw",), user="planted", agent="a", kind="explicit", content="planted"):
    return (memory_id, user, agent, layer, status, visibility, kind, content, chain, revision, list(over), list(by), list(merges), list(evidence))


_OLD = {"status": "superseded", "visibility": "source_only"}
PLANTED = [
    _row("planted-raw", layer="l1_raw", evidence=()),
    _row("planted-twice", content="one"), _row("planted-twice", content="two"),
    _row("planted-both", revision=2, over=["planted-both-old"], merges=["planted-both-old"]), _row("planted-both-old", by=["planted-both"], **_OLD),
    _row("planted-ring-1", by=["planted-ring-0", "planted-ring-2"]), _row("planted-ring-2", by=["planted-ring-1"]), _row("planted-ring-0"), _row("planted-own", by=["planted-own"]),
    _row("planted-tangle-1", by=["planted-tangle-2"]), _row("planted-tangle-2", by=["planted-tangle-3", "planted-tangle-1"]), _row("planted-tangle-3", by=["planted-tangle-1", "planted-between"]), _row("planted-between", by=["planted-ring-1"]),
    _row("planted-head", revision=3, over=["planted-kept", "planted-live"], chain="planted-links"), _row("planted-kept", status="archived", visibility="source_only", by=["planted-head"], revision=2, chain="planted-links"), _row("planted-live", by=["planted-head"], revision=3),
    _row("planted-two-1", chain="planted-chain"), _row("planted-two-2", chain="planted-chain"), _row("planted-else", chain="planted-chain", user="planted|a", agent="b"),
    _row("planted-cross", user="planted|a", agent="b", over=["planted-crossed"], revision=2), _row("planted-crossed", user="planted", agent="a|b", by=["planted-cross"], **_OLD),
    _row("planted-gone", status="deleted"), _row("planted-bare", kind="composite", evidence=()), _row("planted-layer", layer="l9_other"), _row("planted-lost", over=["planted-nowhere"], evidence=["planted-two-1", "planted-never"]),
]


def _value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, list):
        return "[" + ", ".join(map(_value, v)) + "]::VARCHAR[]"
    return str(v) if isinstance(v, int) else "'" + v + "'"


_ROWS = ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in PLANTED)
_ALL = f"planted({', '.join(_KINDS)}) AS (VALUES {_ROWS}), delivered AS (SELECT * FROM memory_record UNION ALL BY NAME SELECT * FROM planted)"
_PLANTED_REC = _ALL + ", " + q.REC.replace("FROM memory_record", "FROM delivered")

_EDGE = f"""WITH RECURSIVE {_PLANTED_REC}, ids AS (SELECT memory_id FROM rec),
edge AS (
  SELECT DISTINCT * FROM (
    SELECT memory_id AS src, unnest(supersedes) AS dst, 'supersedes' AS relation FROM rec UNION ALL SELECT memory_id, unnest(superseded_by), 'superseded_by' FROM rec
    UNION ALL SELECT memory_id, unnest(consolidates), 'consolidates' FROM rec UNION ALL SELECT memory_id, unnest(source_memory_ids), 'evidence' FROM rec) WHERE dst <> ''),
pair AS (SELECT DISTINCT src, dst FROM edge WHERE relation <> 'evidence'),
every AS (SELECT DISTINCT src, dst FROM edge),
forward AS (SELECT DISTINCT src, dst FROM edge WHERE relation IN ('supersedes', 'consolidates') AND dst IN (FROM ids)),
back AS (SELECT DISTINCT dst AS src, src AS dst FROM edge WHERE relation = 'superseded_by' AND dst IN (FROM ids)),
fp AS (SELECT f.src, f.dst, s.revision AS sr, d.revision AS dr, d.status AS ds, d.visibility AS dv, s.chain_id AS sc, d.chain_id AS dc FROM forward f JOIN rec s ON s.memory_id = f.src JOIN rec d ON d.memory_id = f.dst),
walk AS (SELECT dst AS start, src AS node FROM back UNION SELECT w.start, b.src FROM walk w JOIN back b ON b.dst = w.node),
ring AS (SELECT a.start, min(a.node) AS least FROM walk a JOIN walk b ON b.start = a.node AND b.node = a.start GROUP BY a.start)
"""

_HEADS = "SELECT min(memory_id) AS memory_id, chain_id AS other_id FROM rec WHERE chain_id IS NOT NULL AND status = 'active' AND visibility = 'recallable' GROUP BY scope, chain_id HAVING count(*) > 1"
_BODIES = {
    "c1": "SELECT memory_id, NULL::VARCHAR AS other_id FROM (SELECT DISTINCT * EXCLUDE (ingested_at) FROM delivered) GROUP BY memory_id HAVING count(*) > 1",
    "c2": "SELECT src AS memory_id, dst AS other_id FROM pair WHERE dst NOT IN (FROM ids)",
    "c3": "SELECT src AS memory_id, dst AS other_id FROM pair JOIN rec a ON a.memory_id = src JOIN rec b ON b.memory_id = dst WHERE a.scope <> b.scope",
    "c4": "SELECT a.src AS memory_id, a.dst AS other_id FROM edge a JOIN edge b ON a.src = b.src AND a.dst = b.dst WHERE a.relation = 'supersedes' AND b.relation = 'consolidates' AND a.dst IN (FROM ids)",
    "c5_forward": "SELECT src AS memory_id, dst AS other_id FROM (SELECT * FROM forward EXCEPT SELECT * FROM back)",
    "c5_backward": "SELECT dst AS memory_id, src AS other_id FROM (SELECT * FROM back EXCEPT SELECT * FROM forward)",
    "c6": "SELECT start AS memory_id, least AS other_id FROM ring",
    "c7": "SELECT src AS memory_id, dst AS other_id FROM fp WHERE sr <= dr",
    "c8": "SELECT dst AS memory_id, src AS other_id FROM fp WHERE NOT coalesce(ds IN ('superseded', 'archived', 'deleted') AND dv = 'source_only', false)",
    "c9": _HEADS,
    "c10": "SELECT memory_id, NULL::VARCHAR AS other_id FROM rec WHERE status = 'deleted' AND visibility = 'recallable'",
    "c11": "SELECT memory_id, NULL::VARCHAR AS other_id FROM rec WHERE status <> 'deleted' AND layer IN ('l2_fact', 'l3_summary', 'l4_identity') AND source_type IS DISTINCT FROM 'explicit' AND coalesce(len(source_memory_ids), 0) = 0",
    "c12_layer": "SELECT memory_id, NULL::VARCHAR AS other_id FROM rec WHERE layer IS NULL OR layer NOT IN ('l0_basic_info', 'l1_raw', 'l2_fact', 'l3_summary', 'l4_identity')",
    "c13_missing": "SELECT src AS memory_id, dst AS other_id FROM every WHERE dst NOT IN (FROM ids)",
    "c13_owner": "SELECT src AS memory_id, dst AS other_id FROM every JOIN rec a ON a.memory_id = src JOIN rec b ON b.memory_id = dst WHERE a.scope <> b.scope",
    "c13_evidence": "SELECT src AS memory_id, dst AS other_id FROM edge JOIN rec b ON b.memory_id = dst WHERE relation = 'evidence' AND b.layer IS DISTINCT FROM 'l1_raw'",
    "c13_forward": "SELECT src AS memory_id, dst AS other_id FROM (SELECT * FROM forward EXCEPT SELECT * FROM back)",
    "c13_backward": "SELECT dst AS memory_id, src AS other_id FROM (SELECT * FROM back EXCEPT SELECT * FROM forward)",
    "c13_revision": "SELECT src AS memory_id, dst AS other_id FROM fp WHERE sr <= dr",
    "c13_chain": "SELECT src AS memory_id, dst AS other_id FROM fp WHERE sc IS NULL OR dc IS NULL OR sc <> dc",
    "c13_predecessor": "SELECT dst AS memory_id, src AS other_id FROM fp WHERE NOT coalesce(ds = 'superseded' AND dv = 'source_only', false)",
    "c13_heads": _HEADS,
}

#: The spaces that vectors may be of; the table holds another one.
_SPACES = [("trained-lattice-v1", 64, "trained"), ("trained-lattice-v2", 64, "trained")]
_EMBEDDINGS = f"""emb AS (SELECT * FROM memory_embedding QUALIFY row_number() OVER (PARTITION BY memory_id, space_id ORDER BY ingested_at) = 1), {q.JOB},
space(space_id, dims) AS (VALUES {', '.join(f"('{s}', {d})" for s, d, _ in _SPACES)}),
judged AS (SELECT emb.memory_id, emb.space_id, dims, coalesce(dimensions = dims AND len(vector) = dims, false) AS fits, coalesce(len(list_filter(vector, lambda x: x <> 0)) > 0, false) AS used FROM emb LEFT JOIN space USING (space_id)),
waiting AS (SELECT memory_id FROM rec WHERE layer = 'l1_raw' AND memory_id IN (SELECT raw_memory_id FROM job WHERE status IN ('accepted', 'degraded')))"""
_BAD_EMBEDDINGS = """SELECT DISTINCT CASE WHEN dims IS NULL THEN 'c12_space' WHEN NOT fits THEN 'c12_width' ELSE 'c12_zero' END AS code, memory_id, space_id AS other_id FROM judged
WHERE dims IS NULL OR NOT fits OR NOT used AND memory_id NOT IN (FROM waiting)"""


def _union(*codes: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS code, memory_id, other_id FROM ({_BODIES[c]})" for c in codes)


def _planted(t, table):
    rows = t.spark.createDataFrame(PLANTED, ", ".join(f"{n} {k}" for n, k in _KINDS.items()))
    return table.unionByName(rows, allowMissingColumns=True)


def _state(t):
    """Each record once, the planted ones too."""
    return _planted(t, t.memory_record.drop("ingested_at")).dropDuplicates(["memory_id"])


def _deliveries(t):
    """The distinct contents of records: an id delivered with two contents is here twice."""
    return _planted(t, t.memory_record.drop("ingested_at")).distinct()


_CHECKS = {
    "c1_duplicate_id": (graph_checks.duplicate_ids, ["c1"]), "c2_missing_target": (graph_checks.missing_targets, ["c2"]), "c3_cross_owner": (graph_checks.crossing_scopes, ["c3"]), "c4_ambiguous": (graph_checks.ambiguous_types, ["c4"]),
    "c5_missing_reverse": (graph_checks.missing_reverse, ["c5_forward", "c5_backward"]), "c6_cycle": (graph_checks.cycles, ["c6"]), "c7_revision": (graph_checks.revisions_not_rising, ["c7"]), "c8_predecessor": (graph_checks.predecessor_states, ["c8"]),
    "c9_heads": (graph_checks.many_heads, ["c9"]), "c10_deleted_recallable": (graph_checks.deleted_recallable, ["c10"]), "c11_no_evidence": (graph_checks.without_evidence, ["c11"]), "c12_layers": (graph_checks.bad_layers, ["c12_layer"]),
    "c13_dataset": (graph_checks.dataset_checks, [c for c in _BODIES if c.startswith("c13")]),
}

for _name, (_check, _codes) in _CHECKS.items():
    add(_name, _EDGE + _union(*_codes))(lambda t, check=_check: check(_deliveries(t) if check is graph_checks.duplicate_ids else _state(t)))


def _spaces(t):
    return t.spark.createDataFrame(_SPACES, "space_id string, dimensions int, quality string")


@add("c12_embeddings", f"WITH {_PLANTED_REC}, {_EMBEDDINGS} {_BAD_EMBEDDINGS}")
def _(t):
    return graph_checks.bad_embeddings(_state(t), emb(t), job(t), _spaces(t))


_RANKS = {"c1": 1, "c2": 2, "c3": 3, "c4": 4, "c5_forward": 5, "c5_backward": 5, "c6": 6, "c7": 7, "c8": 8, "c9": 9, "c10": 10, "c11": 11, "c12_layer": 12, "c12_space": 12, "c12_width": 12, "c12_zero": 12}


@add("c0_all_violations", f"{_EDGE}, {_EMBEDDINGS}, found AS ({_union(*_BODIES)} UNION ALL {_BAD_EMBEDDINGS}) SELECT CASE code {' '.join(f'''WHEN '{c}' THEN {r}''' for c, r in _RANKS.items())} ELSE 13 END AS rank, * FROM found")
def _(t):
    return graph_checks.all_violations(_state(t), _deliveries(t), emb(t), job(t), _spaces(t), dataset=True)


# ---------------------------------------------------------------- transitions

_OWNER = ["tenant_id", "user_id", "agent_id"]


def _id(prefix: str, *parts: str) -> str:
    return f"'{prefix}' || sha256({' || chr(31) || '.join(parts)})[1:16]"


_REQUESTS = f"""WITH {q.JOB}, ask AS (
  SELECT 'doc-' || doc_id AS idempotency_key, {q.SCOPE} AS scope, text AS content, [lang, source, ' Kept '] AS tags FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT idempotency_key, scope, coalesce(code, 'x'), ['y'] FROM job WHERE idempotency_key IS NOT NULL),
once AS (SELECT * FROM ask QUALIFY row_number() OVER (PARTITION BY scope, idempotency_key ORDER BY content) = 1),
held AS (SELECT scope, idempotency_key, status AS job_status, raw_memory_id, created_memory_ids FROM job WHERE idempotency_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scope, idempotency_key ORDER BY job_id) = 1)
"""


def _direct(t):
    docs = t.documents.filter("text IS NOT NULL").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("idempotency_key"), *_OWNER, F.col("session_id").alias("source_session_id"), F.col("text").alias("content"), F.lit("l2_fact").alias("layer"),
        F.col("created_at").alias("occurred_at"), F.array("lang", "source", F.lit(" Kept ")).alias("tags"), F.array(F.lit(1)).cast("array<bigint>").alias("turns"),
    )
    again = job(t).filter("idempotency_key IS NOT NULL").select("idempotency_key", *_OWNER, F.lit(None).cast("string").alias("source_session_id"), F.coalesce("code", F.lit("x")).alias("content"), F.lit("l2_fact").alias("layer"), F.col("started_at").alias("occurred_at"), F.array(F.lit("y")).alias("tags"), F.array(F.lit(1)).cast("array<bigint>").alias("turns"))
    return evolution.add_direct(job(t), docs.unionByName(again), as_of())


@add("t1_receipts", _REQUESTS + """SELECT idempotency_key, scope, CASE WHEN job_status IS NULL OR job_status = 'completed' THEN 'completed' ELSE 'degraded' END AS status, job_status IS NOT NULL AS replayed,
  CASE WHEN job_status IS NULL THEN """ + _id("mem-", "'raw'", "scope", "idempotency_key") + " ELSE raw_memory_id END AS raw_memory_id, CASE WHEN job_status IS NULL THEN " + _id("mem-", "'direct'", "scope", "idempotency_key") + """
  ELSE coalesce(array_to_string(created_memory_ids, ','), '') END AS created FROM once LEFT JOIN held USING (scope, idempotency_key)""")
def _(t):
    return _direct(t).receipts.select("idempotency_key", SCOPE().alias("scope"), "status", "replayed", "raw_memory_id", F.array_join("created_memory_ids", ",").alias("created"))


@add("t1_records", _REQUESTS + f""", new AS (SELECT once.* FROM once LEFT JOIN held USING (scope, idempotency_key) WHERE job_status IS NULL)
SELECT {_id('mem-', "'raw'", 'scope', 'idempotency_key')} AS memory_id, scope, 'l1_raw' AS layer, 'source_only' AS visibility, md5(content) AS digest, '' AS tags, '' AS evidence, idempotency_key FROM new
UNION ALL SELECT {_id('mem-', "'direct'", 'scope', 'idempotency_key')}, scope, 'l2_fact', 'recallable', md5({q.trim('content[1:4000]')}), array_to_string({q.tags('tags')}, '|'), {_id('mem-', "'raw'", 'scope', 'idempotency_key')}, NULL FROM new""")
def _(t):
    return _direct(t).completed.select("memory_id", SCOPE().alias("scope"), "layer", "visibility", F.md5(F.col("content").cast("binary")).alias("digest"), F.array_join("tags", "|").alias("tags"), F.array_join("source_memory_ids", ",").alias("evidence"), "idempotency_key")


def _extraction(t):
    """A batch of extraction writes: of each request its sources, and an operation a source by how many turns support it.

    The operation's targets are the least recallable records of the owner and layer.
    """
    owner = rec(t).select(F.col("memory_id").alias("raw_memory_id"), *_OWNER, "source_session_id")
    rows = ext(t).join(owner, "raw_memory_id")
    first = rows.groupBy("request_id").agg(F.min_by(F.struct(*_OWNER, "source_session_id"), "extract_id").alias("o"), F.max("content").alias("content"), F.min("occurred_at").alias("occurred_at"), F.count_if(F.col("layer") == "l3_summary").alias("n_summaries"))
    failed = job(t).filter("status = 'degraded'").groupBy("request_id").agg(F.min("code").alias("failure"))
    asked = first.join(failed, "request_id", "left").select(
        "request_id", F.concat(F.lit("extract-"), "request_id").alias("idempotency_key"), "o.*", "content", "occurred_at", F.array(F.lit(1)).cast("array<bigint>").alias("turns"),
        F.when(F.col("n_summaries") > 0, F.col("content")).alias("summary"), F.create_map(F.lit("name"), F.col("o.user_id"), F.lit("shoe"), F.lit("x")).alias("patch"), "failure",
    )
    pool = retrieval.recallable(rec(t), as_of()).filter(F.col("layer").isin("l2_fact", "l4_identity")).groupBy(SCOPE().alias("scope"), "layer").agg(F.min("memory_id").alias("least"), F.max("memory_id").alias("most"))
    scoped = rows.filter(F.col("layer").isin("l2_fact", "l4_identity")).select("extract_id", "request_id", "client_ref", "layer", "content", "confidence", "tags", F.col("evidence_turn_indexes").alias("turns"), "occurred_at", "speculate").join(asked.select("request_id", SCOPE().alias("scope")), "request_id")
    met = scoped.join(pool, ["scope", "layer"], "left")
    n = F.coalesce(F.size("turns"), F.lit(0))
    kind = F.when(F.col("least").isNull() | (n <= 0), "ADD").when(n == 1, "NOOP").when((n == 2) | (F.col("least") == F.col("most")), "SUPERSEDE").otherwise("CONSOLIDATE")
    none = F.array().cast("array<string>")
    targets = F.when(kind == "ADD", none).when(kind == "CONSOLIDATE", F.array("least", "most")).otherwise(F.array("least"))
    operations = met.select(F.col("extract_id").alias("op_id"), "request_id", kind.alias("type"), F.array("client_ref").alias("source_refs"), targets.alias("target_ids"), F.concat("content", F.lit(" again")).alias("content"))
    return asked, scoped.drop("extract_id", "scope"), operations


@add("t2_extract")
def _(t):
    asked, sources, operations = _extraction(t)
    done = evolution.add_extract(rec(t), job(t), asked, sources, operations, ["name", "language"], as_of()).completed
    joined = lambda c: F.array_join(F.sort_array(c), ",").alias(c)
    return done.select("memory_id", "layer", "status", "visibility", "source_type", "revision", "chain_id", *[joined(c) for c in ("supersedes", "superseded_by", "consolidates", "source_memory_ids")], "meta")


@add("t2_receipts", f"""WITH {q.EXT}, {q.JOB}, {q.REC}, ask AS (SELECT request_id FROM ext JOIN rec ON rec.memory_id = ext.raw_memory_id GROUP BY 1)
SELECT 'extract-' || request_id AS idempotency_key, CASE WHEN request_id IN (SELECT request_id FROM job WHERE status = 'degraded') THEN 'degraded' ELSE 'completed' END AS status, false AS replayed FROM ask""")
def _(t):
    asked, sources, operations = _extraction(t)
    return evolution.add_extract(rec(t), job(t), asked, sources, operations, ["name", "language"], as_of()).receipts.select("idempotency_key", "status", "replayed")


_META = "CASE WHEN {x} IS NULL THEN '{{}}' ELSE '{{\"speculate\":' || to_json({x})::VARCHAR || '}}' END"


@add("t3_add", f"""WITH {q.EXT} SELECT 'mem-' || sha256(extract_id)[1:16] AS memory_id, layer, CASE WHEN speculate IS NULL THEN 'explicit' ELSE 'inferred' END AS source_type, array_to_string({q.tags('tags')}, '|') AS tags, raw_memory_id AS evidence,
  coalesce(array_to_string(list_sort(list_distinct(evidence_turn_indexes)), ','), '') AS turns, occurred_at, {_META.format(x='speculate')} AS meta FROM ext""")
def _(t):
    plan = ext(t).select(F.col("extract_id").alias("op_id"), F.col("raw_memory_id").alias("raw_id"), "content", "layer", "confidence", "tags", "speculate", "occurred_at", F.col("evidence_turn_indexes").alias("turns"))
    rows = evolution.added(plan, as_of())
    return rows.select("memory_id", "layer", "source_type", F.array_join("tags", "|").alias("tags"), F.get("source_memory_ids", 0).alias("evidence"), F.array_join(F.sort_array("source_turn_indexes").cast("array<string>"), ",").alias("turns"), "occurred_at", "meta")


def _plan(t):
    return ext(t).select(F.col("raw_memory_id").alias("target_id"), F.col("extract_id").alias("raw_id"), "confidence", "tags", F.col("evidence_turn_indexes").alias("turns"))


@add("t4_attach_evidence", f"""WITH {q.REC}, {q.EXT}, g AS (
  SELECT raw_memory_id AS memory_id, max(confidence) AS c, list(extract_id ORDER BY extract_id) AS raws, flatten(list(coalesce(tags, []) ORDER BY extract_id)) AS more, flatten(list(coalesce(evidence_turn_indexes, []) ORDER BY extract_id)) AS seen FROM ext WHERE raw_memory_id IS NOT NULL GROUP BY 1)
SELECT rec.memory_id, CASE WHEN g.c IS NULL THEN rec.confidence ELSE greatest(rec.confidence, g.c) END AS confidence, array_to_string(list_sort(list_distinct(list_concat(coalesce(source_memory_ids, []), raws))), ',') AS evidence,
  array_to_string({q.tags('list_concat(coalesce(tags, []), more)')}, '|') AS tags, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(source_turn_indexes, []), seen))), ','), '') AS turns FROM rec JOIN g USING (memory_id)""")
def _(t):
    hit = ext(t).select(F.col("raw_memory_id").alias("memory_id")).distinct()
    rows = evolution.attach_evidence(rec(t), _plan(t), as_of()).join(hit, "memory_id", "left_semi")
    return rows.select("memory_id", "confidence", F.array_join(F.sort_array("source_memory_ids"), ",").alias("evidence"), F.array_join("tags", "|").alias("tags"), F.array_join(F.sort_array("source_turn_indexes").cast("array<string>"), ",").alias("turns"))


# one operation a request and layer: SUPERSEDE of one source, CONSOLIDATE of several, over the records that the sources name
_OPS = f"""WITH {q.REC}, {q.EXT}, s AS (
  SELECT *, request_id || '/' || layer AS op_id, row_number() OVER (PARTITION BY request_id, layer ORDER BY client_ref, extract_id) AS k FROM ext WHERE layer IN ('l2_fact', 'l4_identity')),
op AS (SELECT op_id, any_value('raw-' || request_id) AS raw_id, any_value(layer) AS layer, count(*) AS n, max(confidence) AS confidence, arg_min(content, k) || ' merged' AS content, min(occurred_at) FILTER (k = 1) AS occurred_at,
  flatten(list(coalesce(tags, []) ORDER BY k)) AS tags, flatten(list(coalesce(evidence_turn_indexes, []) ORDER BY k)) AS turns, max(speculate) FILTER (k = 1) AS one,
  coalesce(string_agg(to_json(client_ref)::VARCHAR || ':' || to_json(speculate)::VARCHAR, ',' ORDER BY k) FILTER (speculate IS NOT NULL), '') AS many FROM s GROUP BY 1),
met AS (SELECT op_id, raw_memory_id AS target, k, rec.revision, rec.chain_id, rec.source_memory_ids FROM (SELECT op_id, raw_memory_id, min(k) AS k FROM s GROUP BY 1, 2) JOIN rec ON rec.memory_id = raw_memory_id),
head AS (SELECT op_id, max(revision) + 1 AS revision, coalesce(arg_min(chain_id, k) FILTER (chain_id IS NOT NULL), 'chain-' || sha256(op_id)[1:16]) AS chain, list(target ORDER BY k) AS targets, flatten(list(coalesce(source_memory_ids, []) ORDER BY k)) AS evidence FROM met GROUP BY 1)"""


def _operations(t):
    source = F.struct("client_ref", "confidence", "tags", F.col("evidence_turn_indexes").alias("turns"), "occurred_at", "speculate")
    rows = ext(t).filter(F.col("layer").isin("l2_fact", "l4_identity")).groupBy("request_id", "layer").agg(F.array_sort(F.collect_list(F.struct("client_ref", "extract_id", source.alias("source"), "content", "raw_memory_id"))).alias("m"))
    return rows.select(
        F.concat_ws("/", "request_id", "layer").alias("op_id"), F.when(F.size("m") > 1, "CONSOLIDATE").otherwise("SUPERSEDE").alias("kind"), F.concat(F.lit("raw-"), "request_id").alias("raw_id"), F.concat(F.get("m", 0)["content"], F.lit(" merged")).alias("content"),
        "layer", F.transform("m", lambda x: x["raw_memory_id"]).alias("target_ids"), F.transform("m", lambda x: x["source"]).alias("sources"),
    )


@add("t5_heads", _OPS + f""" SELECT 'mem-' || sha256(op_id)[1:16] AS memory_id, layer, {q.trim('content[1:4000]')} AS content, confidence, revision, chain AS chain_id, CASE WHEN n = 1 THEN array_to_string(targets, ',') ELSE '' END AS supersedes, CASE WHEN n > 1 THEN array_to_string(targets, ',') ELSE '' END AS consolidates,
  array_to_string(list_sort(list_distinct(list_concat([raw_id], evidence))), ',') AS evidence, array_to_string({q.tags('tags')}, '|') AS tags, coalesce(array_to_string(list_sort(list_distinct(turns)), ','), '') AS turns, occurred_at,
  CASE WHEN n = 1 THEN {_META.format(x='one')} ELSE '{{"speculations":{{' || many || '}}}}' END AS meta FROM op JOIN head USING (op_id)""")
def _(t):
    heads, _ = evolution.new_heads(rec(t), _operations(t), as_of())
    joined = lambda c, name=None: F.array_join(c, ",").alias(name or c)
    return heads.select(
        "memory_id", "layer", "content", "confidence", "revision", "chain_id", joined("supersedes"), joined("consolidates"), F.array_join(F.sort_array("source_memory_ids"), ",").alias("evidence"), F.array_join("tags", "|").alias("tags"),
        F.array_join(F.sort_array("source_turn_indexes").cast("array<string>"), ",").alias("turns"), "occurred_at", "meta",
    )


@add("t5_targets", _OPS + """, h AS (SELECT target, list('mem-' || sha256(op_id)[1:16]) AS heads, arg_min(chain, op_id) AS chain FROM (SELECT op_id, chain, unnest(targets) AS target FROM head) GROUP BY 1)
SELECT memory_id, 'superseded' AS status, 'source_only' AS visibility, coalesce(chain_id, chain) AS chain_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(superseded_by, []), heads))), ',') AS superseded_by FROM rec JOIN h ON h.target = rec.memory_id""")
def _(t):
    _, targets = evolution.new_heads(rec(t), _operations(t), as_of())
    return targets.select("memory_id", "status", "visibility", "chain_id", F.array_join(F.sort_array("superseded_by"), ",").alias("superseded_by"))


@add("t6_summaries", f"""WITH {q.EXT} SELECT {_id('mem-', "'summary'", 'extract_id')} AS memory_id, 'l3_summary' AS layer, 'composite' AS source_type, 0.8::DOUBLE AS confidence, cut AS content, extract_id AS evidence,
  coalesce(array_to_string(list_sort(evidence_turn_indexes), ','), '') AS turns FROM (SELECT *, {q.trim('content[1:4000]')} AS cut FROM ext) WHERE cut <> ''""")
def _(t):
    rows = evolution.summaries(ext(t).select(F.col("extract_id").alias("raw_id"), F.col("content").alias("summary"), F.col("evidence_turn_indexes").alias("turns")), as_of())
    return rows.select("memory_id", "layer", "source_type", "confidence", "content", F.get("source_memory_ids", 0).alias("evidence"), F.array_join(F.sort_array("source_turn_indexes").cast("array<string>"), ",").alias("turns"))


_PROFILE_META = '{"profile":{"name":"old","city":"here"}}'
_PROFILES = f"""WITH {q.REC}, w AS (SELECT scope, min(memory_id) AS raw_id, arg_min(user_id, memory_id) AS user_id, min(source_session_id) FILTER (k = 1) AS session FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY memory_id) AS k FROM rec WHERE layer = 'l1_raw') GROUP BY 1),
prior AS (SELECT * FROM rec WHERE layer = 'l0_basic_info' AND status = 'active' QUALIFY row_number() OVER (PARTITION BY scope ORDER BY memory_id) = 1)"""


def _patched(t):
    raws = rec(t).filter("layer = 'l1_raw'")
    named = lambda *more: F.create_map(F.lit("name"), F.col("user_id"), *more)
    patch = F.when(F.col("source_session_id").isNull(), named(F.lit("shoe"), F.lit("x"))).otherwise(named(F.lit("language"), F.col("source_session_id")))
    patches = raws.select(F.col("memory_id").alias("raw_id"), patch.alias("patch"), F.col("source_turn_indexes").alias("turns"), *_OWNER, "source_session_id")
    held = rec(t).withColumn("meta", F.when(F.col("layer") == "l0_basic_info", F.lit(_PROFILE_META)).otherwise(F.col("meta")))
    return evolution.profiles(held, patches, ["name", "language"], as_of())


@add("t7_profiles", _PROFILES + f""" SELECT {_id('mem-', "'profile'", 'raw_id')} AS memory_id, w.scope, 'name: ' || w.user_id || CASE WHEN memory_id IS NULL THEN '' ELSE chr(10) || 'city: here' END || CASE WHEN session IS NULL THEN '' ELSE chr(10) || 'language: ' || session END AS content,
  coalesce(chain_id, {_id('chain-', "'profile'", 'raw_id')}) AS chain_id, coalesce(revision, 0) + 1 AS revision, coalesce(memory_id, '') AS supersedes, array_to_string(list_sort(list_distinct(list_concat(coalesce(source_memory_ids, []), [raw_id]))), ',') AS evidence,
  '{{"profile":{{"name":' || to_json(w.user_id)::VARCHAR || CASE WHEN memory_id IS NULL THEN '' ELSE ',"city":"here"' END || CASE WHEN session IS NULL THEN '' ELSE ',"language":' || to_json(session)::VARCHAR END || '}}}}' AS meta FROM w LEFT JOIN prior USING (scope)""")
def _(t):
    heads, _ = _patched(t)
    return heads.select("memory_id", SCOPE().alias("scope"), "content", "chain_id", "revision", F.array_join("supersedes", ",").alias("supersedes"), F.array_join(F.sort_array("source_memory_ids"), ",").alias("evidence"), "meta")


@add("t7_priors", _PROFILES + f""" SELECT memory_id, 'superseded' AS status, 'source_only' AS visibility, {_id('mem-', "'profile'", 'raw_id')} AS superseded_by FROM w JOIN prior USING (scope)""")
def _(t):
    _, priors = _patched(t)
    return priors.select("memory_id", "status", "visibility", F.array_join("superseded_by", ",").alias("superseded_by"))


@add("t8_hide_raw", f"""WITH {q.REC}, {q.EXT} SELECT memory_id, CASE WHEN memory_id IN (SELECT raw_memory_id FROM ext WHERE raw_memory_id IS NOT NULL) THEN 'source_only' ELSE visibility END AS visibility FROM rec WHERE layer = 'l1_raw'""")
def _(t):
    return evolution.hide_raw(rec(t), ext(t).filter("raw_memory_id IS NOT NULL").select(F.col("raw_memory_id").alias("raw_id")))


@add("t9_forget", f"""WITH {q.REC}, gone AS (SELECT memory_id FROM rec WHERE status = 'archived'),
lost AS (SELECT memory_id, list(DISTINCT s) AS lost FROM (SELECT memory_id, unnest(source_memory_ids) AS s FROM rec) WHERE s IN (SELECT memory_id FROM gone) GROUP BY 1),
r AS (SELECT rec.*, g.memory_id IS NOT NULL AS target, l.lost, CASE WHEN l.lost IS NOT NULL AND g.memory_id IS NULL THEN list_filter(source_memory_ids, lambda x: x IS NULL OR NOT list_contains(l.lost, x)) ELSE source_memory_ids END AS kept
  FROM rec LEFT JOIN gone g ON g.memory_id = rec.memory_id LEFT JOIN lost l ON l.memory_id = rec.memory_id WHERE g.memory_id IS NOT NULL OR l.lost IS NOT NULL)
SELECT memory_id, CASE WHEN target OR len(kept) = 0 THEN 'deleted' ELSE status END AS status, CASE WHEN target OR len(kept) = 0 THEN 'source_only' ELSE visibility END AS visibility, array_to_string(list_sort(list_distinct(kept)), ',') AS evidence FROM r""")
def _(t):
    rows = evolution.forget(rec(t), rec(t).filter("status = 'archived'").select("memory_id"), as_of())
    return rows.select("memory_id", "status", "visibility", F.array_join(F.sort_array(F.array_distinct("source_memory_ids")), ",").alias("evidence"))


# every raw record, fact and identity is asked to be revised, and every used key is used again
_REVISIONS = f"""WITH {q.REC}, {q.JOB}, held AS (SELECT scope, idempotency_key, status AS job_status, raw_memory_id, created_memory_ids FROM job WHERE idempotency_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scope, idempotency_key ORDER BY job_id) = 1),
ask AS (SELECT scope, 'rev-' || memory_id AS idempotency_key, memory_id AS target_id FROM rec WHERE layer IN ('l1_raw', 'l2_fact', 'l4_identity') UNION ALL SELECT scope, idempotency_key, 'none' FROM (SELECT DISTINCT scope, idempotency_key FROM held)),
judged AS (SELECT ask.*, job_status, held.raw_memory_id, created_memory_ids, r.layer, r.revision, r.chain_id, r.source_session_id, r.content, r.tags,
  CASE WHEN job_status IS NOT NULL THEN CASE WHEN job_status = 'completed' THEN 'completed' ELSE 'degraded' END WHEN r.status = 'active' AND r.visibility = 'recallable' AND r.layer IN ('l2_fact', 'l4_identity') AND (source_session_id IS NULL OR length(r.content) + 12 <= 4000) THEN 'completed' ELSE 'invalid' END AS verdict
  FROM ask LEFT JOIN held USING (scope, idempotency_key) LEFT JOIN rec r ON r.memory_id = target_id AND r.scope = ask.scope)"""


def _revised(t):
    wanted = rec(t).filter(F.col("layer").isin("l1_raw", "l2_fact", "l4_identity"))
    confirm = F.col("source_session_id").isNull()
    asked = wanted.select(F.concat(F.lit("rev-"), "memory_id").alias("idempotency_key"), *_OWNER, "source_session_id", F.col("memory_id").alias("target_id"), F.when(confirm, "confirm").otherwise("correct").alias("action"), F.when(~confirm, F.concat("content", F.lit(" (corrected)"))).alias("content"))
    again = job(t).filter("idempotency_key IS NOT NULL").select("idempotency_key", *_OWNER, F.lit(None).cast("string").alias("source_session_id"), F.lit("none").alias("target_id"), F.lit("confirm").alias("action"), F.lit(None).cast("string").alias("content"))
    return evolution.revise(rec(t), job(t), asked.unionByName(again), as_of())


@add("t10_receipts", _REVISIONS + f""" SELECT idempotency_key, scope, verdict AS status, job_status IS NOT NULL AS replayed, CASE WHEN job_status IS NOT NULL THEN raw_memory_id WHEN verdict = 'completed' THEN {_id('mem-', "'raw'", 'scope', 'idempotency_key')} END AS raw_memory_id,
  CASE WHEN job_status IS NOT NULL THEN coalesce(array_to_string(created_memory_ids, ','), '') WHEN verdict = 'completed' THEN {_id('mem-', "'revised'", 'scope', 'idempotency_key')} ELSE '' END AS created FROM judged""")
def _(t):
    return _revised(t).receipts.select("idempotency_key", SCOPE().alias("scope"), "status", "replayed", "raw_memory_id", F.array_join("created_memory_ids", ",").alias("created"))


@add("t10_records", _REVISIONS + f""", good AS (SELECT *, {_id('mem-', "'raw'", 'scope', 'idempotency_key')} AS raw_id, {_id('mem-', "'revised'", 'scope', 'idempotency_key')} AS head_id, coalesce(chain_id, {_id('chain-', "'revised'", 'scope', 'idempotency_key')}) AS chain,
  CASE WHEN source_session_id IS NULL THEN content ELSE content || ' (corrected)' END AS said FROM judged WHERE verdict = 'completed' AND job_status IS NULL)
SELECT raw_id AS memory_id, 'l1_raw' AS layer, said AS content, 'active' AS status, 'source_only' AS visibility, 1 AS revision, NULL::VARCHAR AS chain_id, '' AS supersedes, '' AS superseded_by, '' AS evidence FROM good
UNION ALL SELECT head_id, layer, said, 'active', 'recallable', revision + 1, chain, target_id, '', raw_id FROM good
UNION ALL SELECT target_id, rec.layer, rec.content, 'superseded', 'source_only', rec.revision, chain, coalesce(array_to_string(rec.supersedes, ','), ''), head_id, coalesce(array_to_string(rec.source_memory_ids, ','), '') FROM good JOIN rec ON rec.memory_id = target_id""")
def _(t):
    joined = lambda c, name=None: F.coalesce(F.array_join(c, ","), F.lit("")).alias(name or c)
    return _revised(t).completed.select("memory_id", "layer", "content", "status", "visibility", "revision", "chain_id", joined("supersedes"), joined("superseded_by"), joined("source_memory_ids", "evidence"))


@add("t11_recover_jobs", f"WITH {q.JOB} SELECT job_id, CASE WHEN status = 'accepted' THEN 'degraded' ELSE status END AS status, CASE WHEN status = 'accepted' THEN 'INTERRUPTED' ELSE code END AS code, CASE WHEN status <> 'accepted' THEN duration_ms END AS duration_ms FROM job")
def _(t):
    return evolution.recover_jobs(job(t)).select("job_id", "status", "code", "duration_ms")


# plans with faults of every kind: sources that speculate are left out, two-source requests are consolidated besides, and a ghost is named
_PLANS = q.shortlist() + """, src AS (SELECT ext.request_id, client_ref, ext.layer, ext.extract_id, speculate, raw_memory_id FROM ext JOIN rec ON rec.memory_id = raw_memory_id WHERE ext.layer IN ('l2_fact', 'l4_identity')),
short AS (SELECT src.request_id, client_ref, hits.memory_id, fused_rank, rec.layer FROM hits JOIN src ON src.extract_id = query_id JOIN rec ON rec.memory_id = hits.memory_id),
top AS (SELECT request_id, client_ref, min(memory_id) AS best FROM short WHERE fused_rank = 1 GROUP BY 1, 2),
many AS (SELECT request_id, min(client_ref) AS a, max(client_ref) AS b, list(DISTINCT raw_memory_id) AS targets FROM src GROUP BY 1 HAVING count(DISTINCT client_ref) > 1),
op AS (SELECT extract_id AS op_id, request_id, 'SUPERSEDE' AS type, [client_ref] AS refs, [coalesce(best, raw_memory_id)] AS targets FROM src LEFT JOIN top USING (request_id, client_ref) WHERE speculate IS NULL
  UNION ALL SELECT 'all-' || request_id, request_id, 'CONSOLIDATE', [a, b], targets FROM many UNION ALL SELECT 'ghost-' || request_id, request_id, 'ADD', ['ghost'], []::VARCHAR[] FROM many),
named AS (SELECT op_id, request_id, type, unnest(refs) AS client_ref FROM op), uses AS (SELECT request_id, client_ref, count(*) AS n FROM named GROUP BY 1, 2),
layered AS (SELECT named.*, src.layer FROM named JOIN src USING (request_id, client_ref)),
wanted AS (SELECT DISTINCT op_id, request_id, unnest(targets) AS target_id FROM op WHERE type <> 'ADD'),
offered AS (SELECT op_id, memory_id AS target_id, min(short.layer) AS target_layer FROM layered JOIN short USING (request_id, client_ref) GROUP BY 1, 2)
SELECT 'uncovered' AS fault, request_id, client_ref, NULL::VARCHAR AS target_id FROM src WHERE (request_id, client_ref) NOT IN (SELECT (request_id, client_ref) FROM uses)
UNION SELECT 'unknown_source', request_id, client_ref, NULL FROM uses WHERE (request_id, client_ref) NOT IN (SELECT (request_id, client_ref) FROM src)
UNION SELECT 'repeated_source', request_id, client_ref, NULL FROM uses WHERE n > 1 AND (request_id, client_ref) IN (SELECT (request_id, client_ref) FROM src)
UNION SELECT 'sources_cross_layers', request_id, min(client_ref), NULL FROM layered WHERE type = 'CONSOLIDATE' GROUP BY op_id, request_id HAVING count(DISTINCT layer) > 1
UNION SELECT 'unauthorized_target', request_id, NULL, target_id FROM wanted WHERE (op_id, target_id) NOT IN (SELECT (op_id, target_id) FROM offered)
UNION SELECT 'target_crosses_layers', wanted.request_id, layered.client_ref, target_id FROM wanted JOIN offered USING (op_id, target_id) JOIN layered USING (op_id) WHERE layered.layer <> target_layer"""


@add("t12_plan_faults", _PLANS)
def _(t):
    stage = Staging(t.spark, "plans")
    asked = ext(t).select("request_id", "client_ref", "speculate", F.col("extract_id").alias("source_id")).join(_sources(t).drop("content"), "source_id").filter(F.col("layer").isin("l2_fact", "l4_identity"))
    asked = stage.cut(asked.select("source_id", "request_id", "client_ref", "speculate", "raw_memory_id", "layer"))
    hits = retrieval.shortlist(_sources(t), live(t), as_of())
    refs = asked.select("source_id", "request_id", "client_ref")
    top = hits.filter("shortlist_rank = 1").join(refs, "source_id").groupBy("request_id", "client_ref").agg(F.min("memory_id").alias("best"))
    keys = ["op_id", "request_id", "type", "source_refs", "target_ids"]
    one = asked.filter("speculate IS NULL").join(top, ["request_id", "client_ref"], "left").select(F.col("source_id").alias("op_id"), "request_id", F.lit("SUPERSEDE").alias("type"), F.array("client_ref").alias("source_refs"), F.array(F.coalesce("best", "raw_memory_id")).alias("target_ids"))
    many = asked.groupBy("request_id").agg(F.min("client_ref").alias("a"), F.max("client_ref").alias("b"), F.collect_set("raw_memory_id").alias("target_ids")).filter("a <> b")
    merged = many.select(F.concat(F.lit("all-"), "request_id").alias("op_id"), "request_id", F.lit("CONSOLIDATE").alias("type"), F.array("a", "b").alias("source_refs"), "target_ids")
    ghost = many.select(F.concat(F.lit("ghost-"), "request_id").alias("op_id"), "request_id", F.lit("ADD").alias("type"), F.array(F.lit("ghost")).alias("source_refs"), F.array().cast("array<string>").alias("target_ids"))
    operations = stage.cut(one.select(*keys).unionByName(merged.select(*keys)).unionByName(ghost.select(*keys)))
    named = evolution.named_targets(operations).join(refs, ["request_id", "client_ref"]).select("source_id", "memory_id")
    found = hits.select("source_id", "memory_id").join(named, ["source_id", "memory_id"], "left_semi").join(refs, "source_id").join(rec(t).select("memory_id", "layer"), "memory_id")
    found = stage.cut(found.select("request_id", "client_ref", "memory_id", "layer"))
    stage.drop(hits)
    return evolution.plan_faults(asked.select("request_id", "client_ref", "layer"), operations, found)


@add("t13_sanitize", f"""WITH {q.EXT}, c AS (SELECT *, {q.trim('content[1:200]')} AS cut, count(*) OVER (PARTITION BY request_id, client_ref) > 1 AS repeated_ref FROM ext)
SELECT extract_id, cut AS content, array_to_string({q.tags('tags')}, '|') AS tags, coalesce(array_to_string(list_sort(list_distinct(evidence_turn_indexes)), ','), '') AS turns, repeated_ref FROM c WHERE cut <> ''""")
def _(t):
    rows = evolution.sanitize_extraction(ext(t), 200)
    return rows.select("extract_id", "content", F.array_join("tags", "|").alias("tags"), F.array_join(F.sort_array("evidence_turn_indexes").cast("array<string>"), ",").alias("turns"), "repeated_ref")


# each raw record as a case: what its active derived records, all new, say of the write; records no longer active took it as evidence later
@add("t14_observe", f"""WITH {q.REC}, rel AS (SELECT DISTINCT l.case_id, rec.* FROM (SELECT memory_id, unnest(source_memory_ids) AS case_id FROM rec WHERE layer <> 'l1_raw') l JOIN rec USING (memory_id) WHERE case_id IN (SELECT memory_id FROM rec WHERE layer = 'l1_raw')),
fresh AS (SELECT * FROM rel WHERE status = 'active'), n AS (SELECT case_id, count(*) AS n FROM fresh GROUP BY 1), head AS (SELECT fresh.* FROM fresh JOIN n USING (case_id) WHERE n = 1),
target AS (SELECT h.case_id, h.memory_id AS head_id, x.target FROM head h, (SELECT case_id AS c, unnest(list_concat(coalesce(supersedes, []), coalesce(consolidates, []))) AS target FROM head) x WHERE x.c = h.case_id),
judged AS (SELECT t.case_id, bool_and(coalesce(r.memory_id IS NOT NULL AND r.memory_id <> head_id AND list_contains(r.superseded_by, head_id), false)) AS sound, string_agg('a-' || r.memory_id, ',' ORDER BY r.memory_id) AS named FROM target t LEFT JOIN rec r ON r.memory_id = t.target GROUP BY 1),
took AS (SELECT case_id, count(*) AS k, min('a-' || memory_id) AS one FROM rel WHERE status <> 'active' GROUP BY 1),
said AS (SELECT case_id, CASE WHEN coalesce(len(supersedes), 0) = 0 AND coalesce(len(consolidates), 0) = 0 THEN 'ADD' WHEN sound AND len(supersedes) > 0 AND coalesce(len(consolidates), 0) = 0 THEN 'SUPERSEDE' WHEN sound AND len(consolidates) > 1 AND coalesce(len(supersedes), 0) = 0 THEN 'CONSOLIDATE' END AS operation, named FROM head LEFT JOIN judged USING (case_id))
SELECT rec.memory_id AS case_id, CASE WHEN n.n IS NULL AND took.k = 1 THEN 'NOOP' ELSE said.operation END AS operation, CASE WHEN n.n IS NULL AND took.k = 1 THEN took.one WHEN said.operation IN ('SUPERSEDE', 'CONSOLIDATE') THEN named ELSE '' END AS target_aliases
FROM rec LEFT JOIN n ON n.case_id = rec.memory_id LEFT JOIN took ON took.case_id = rec.memory_id LEFT JOIN said ON said.case_id = rec.memory_id WHERE rec.layer = 'l1_raw'""")
def _(t):
    keys, cols = ["case_id", "memory_id"], ["layer", "status", "visibility", "supersedes", "consolidates", "superseded_by", "source_memory_ids"]
    raws = rec(t).filter("layer = 'l1_raw'").select(F.col("memory_id").alias("case_id"), F.col("memory_id").alias("raw_id"))
    rel = rec(t).filter("layer <> 'l1_raw'").select("memory_id", *cols, F.explode(F.array_distinct("source_memory_ids")).alias("case_id")).join(raws.select("case_id"), "case_id", "left_semi")
    none = F.array().cast("array<string>")
    links = rel.filter("status = 'active'").select("case_id", F.explode(F.concat(F.coalesce("supersedes", none), F.coalesce("consolidates", none))).alias("memory_id")).distinct()
    targets = links.join(rel.select(*keys), keys, "left_anti").join(rec(t).select("memory_id", *cols), "memory_id")
    after = rel.select(*keys, *cols).unionByName(targets.select(*keys, *cols))
    before = rel.filter("status <> 'active'").select(*keys).unionByName(targets.select(*keys)).withColumn("source_memory_ids", none)
    seen = evolution.observe_operations(before, after, before.select("case_id", F.concat(F.lit("a-"), "memory_id").alias("alias"), "memory_id"), raws)
    return seen.select("case_id", "operation", F.array_join("target_aliases", ",").alias("target_aliases"))
