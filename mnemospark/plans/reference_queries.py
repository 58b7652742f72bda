"""Queries of the retrieval, listing, evaluation, integrity and evolution operators, each with its SQL.

Names: the letter and number of the operator, then what it does; pr is a predicate.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.functions import text, vectors
from mnemospark.operators import evolution, graph_checks, listing, metrics, retrieval
from mnemospark.plans import common_sql as q
from mnemospark.registry import Registry

registry = Registry()
add = registry.add
SCOPE = retrieval.scope_key


def as_of():
    return F.lit(q.AS_OF).cast("timestamp")


def rec(t):
    """Each record once: redelivered copies differ in ingested_at alone."""
    return t.memory_record.drop("ingested_at").dropDuplicates(["memory_id"])


def live(t):
    """Recallable records, each once; copies of a record are recallable alike, so only these rows are shuffled."""
    return retrieval.recallable(t.memory_record, as_of()).drop("ingested_at").dropDuplicates(["memory_id"])


def ext(t):
    return t.extracted_memory.drop("ingested_at").dropDuplicates(["extract_id"])


def job(t):
    return t.memory_job.drop("ingested_at").dropDuplicates(["job_id"])


def qry(t):
    return t.query_fixture.drop("ingested_at").dropDuplicates(["query_id"])


def emb(t):
    return t.memory_embedding.drop("ingested_at").dropDuplicates(["memory_id", "space_id"])


_W = f"WITH {q.REC} "
_EMB = "emb AS (SELECT * FROM memory_embedding QUALIFY row_number() OVER (PARTITION BY memory_id, space_id ORDER BY ingested_at) = 1)"

# ---------------------------------------------------------------- sources


@add("s1_open_store", _W + """SELECT count(*) AS n_records, count(*) FILTER (confidence IS NULL OR isnan(confidence) OR confidence < 0 OR confidence > 1) AS bad_confidence,
  count(*) FILTER (revision IS NULL OR revision < 1) AS bad_revision, count(DISTINCT scope) AS n_scopes FROM rec""")
def _(t):
    sure = F.coalesce(F.col("confidence").between(0.0, 1.0) & ~F.isnan("confidence"), F.lit(False))
    return rec(t).agg(F.count(F.lit(1)).alias("n_records"), F.count_if(~sure).alias("bad_confidence"), F.count_if(F.coalesce(F.col("revision") < 1, F.lit(True))).alias("bad_revision"), F.countDistinct(SCOPE()).alias("n_scopes"))


@add("s2_read_scope", _W + "SELECT memory_id, layer, status FROM rec WHERE tenant_id = 'tenant-alder' AND user_id = 'user-00hub' AND agent_id = 'agent-concierge'")
def _(t):
    return rec(t).filter(listing.same_owner("tenant-alder", "user-00hub", "agent-concierge")).select("memory_id", "layer", "status")


@add("s4_scan_scopes", _W + "SELECT scope, count(*) AS n_records, max(updated_at) AS last_update FROM rec GROUP BY scope")
def _(t):
    return rec(t).groupBy(SCOPE().alias("scope")).agg(F.count(F.lit(1)).alias("n_records"), F.max("updated_at").alias("last_update"))


@add("s5_export", f"WITH {q.REC}, {_EMB} SELECT rec.memory_id, content, revision, space_id, len(vector) AS width FROM rec LEFT JOIN emb USING (memory_id)")
def _(t):
    return rec(t).select("memory_id", "content", "revision").join(emb(t).select("memory_id", "space_id", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("width")), "memory_id", "left")


@add("s6_import_outcome", """WITH d AS (SELECT memory_id, content, ingested_at, row_number() OVER (PARTITION BY memory_id ORDER BY ingested_at) AS k FROM memory_record),
old AS (SELECT memory_id, content FROM d WHERE k = 1 AND ingested_at < TIMESTAMPTZ '2025-06-01 00:00:00+00')
SELECT CASE WHEN old.memory_id IS NULL THEN 'new' WHEN old.content IS NOT DISTINCT FROM d.content THEN 'same' ELSE 'conflict' END AS outcome, count(*) AS n
FROM d LEFT JOIN old USING (memory_id) WHERE ingested_at >= TIMESTAMPTZ '2025-06-01 00:00:00+00' GROUP BY 1""")
def _(t):
    from mnemospark.sources.store import import_outcome

    rows = t.memory_record.select("memory_id", "content", "ingested_at")
    first = F.min("ingested_at").alias("first_seen")
    held = rows.filter(F.col("ingested_at") < as_of()).groupBy("memory_id").agg(first, F.min_by("content", "ingested_at").alias("content")).drop("first_seen")
    return import_outcome(held, rows.filter(F.col("ingested_at") >= as_of()).drop("ingested_at")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@add("s8_materialize", _W + f"""SELECT memory_id, count(*) AS n_dims, round(sqrt(sum(v * v)), 6) AS norm
FROM (SELECT memory_id, h % 256 AS dim, sum(CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END) AS v FROM (SELECT memory_id, unnest({q.feature_hashes('content')}) AS h FROM rec) GROUP BY 1, 2) WHERE v <> 0 GROUP BY memory_id""")
def _(t):
    cells = retrieval.hash_table(rec(t).select("memory_id", F.col("content").alias("body")), "memory_id").filter("cell <> 0")
    return cells.groupBy("memory_id").agg(F.count(F.lit(1)).alias("n_dims"), F.round(F.sqrt(F.sum(F.col("cell") * F.col("cell"))), 6).alias("norm"))


@add("s9_expand_groups", f"WITH {q.JOB} SELECT job_id, created_id, CAST(pos AS INT) AS pos FROM (SELECT job_id, unnest(created_memory_ids) AS created_id, generate_subscripts(created_memory_ids, 1) AS pos FROM job)")
def _(t):
    return job(t).select("job_id", F.inline(F.arrays_zip(F.col("created_memory_ids").alias("created_id"), F.transform("created_memory_ids", lambda x, i: (i + 1).cast("int")).alias("pos"))))


@add("s10_group_by_owner", _W + "SELECT scope, string_agg(memory_id, ',' ORDER BY memory_id) AS ids FROM rec GROUP BY scope")
def _(t):
    return rec(t).groupBy(SCOPE().alias("scope")).agg(F.array_join(F.sort_array(F.collect_list("memory_id")), ",").alias("ids"))


@add("s15_tool_summary", _W + "SELECT memory_id, layer, status, content, confidence, updated_at, revision FROM rec")
def _(t):
    return rec(t).select("memory_id", "layer", "status", "content", "confidence", "updated_at", "revision")


# ---------------------------------------------------------------- predicates


@add("pr1_prefilter", _W + f"SELECT memory_id FROM rec WHERE {q.RECALLABLE} AND layer IN ('l1_raw', 'l2_fact')")
def _(t):
    return retrieval.recallable(rec(t), as_of()).filter(F.col("layer").isin("l1_raw", "l2_fact")).select("memory_id")


@add("pr2_validity", _W + f"SELECT memory_id, {q.VALID} AS valid_now FROM rec")
def _(t):
    return rec(t).select("memory_id", retrieval.valid_at(as_of()).alias("valid_now"))


@add("pr3_active_at", _W + f"SELECT memory_id FROM rec WHERE status = 'active' AND {q.VALID}")
def _(t):
    return rec(t).filter((F.col("status") == "active") & retrieval.valid_at(as_of())).select("memory_id")


@add("pr4_channel", _W + f"SELECT {q.CHANNEL} AS channel, count(*) AS n FROM rec GROUP BY 1")
def _(t):
    return rec(t).groupBy(retrieval.channel(F.col("layer")).alias("channel")).agg(F.count(F.lit(1)).alias("n"))


@add("pr5_same_owner", f"WITH {q.REC}, {q.QRY} SELECT query_id, count(memory_id) AS n FROM qry JOIN rec USING (scope) GROUP BY query_id")
def _(t):
    owned = rec(t).groupBy(SCOPE().alias("scope")).agg(F.count(F.lit(1)).alias("n"))
    return qry(t).select("query_id", SCOPE().alias("scope")).join(owned, "scope").select("query_id", "n")


@add("pr6_reconcile_pool", _W + f"SELECT scope, layer, count(*) AS n FROM rec WHERE {q.RECALLABLE} AND layer IN ('l2_fact', 'l4_identity') GROUP BY 1, 2")
def _(t):
    return retrieval.recallable(rec(t), as_of()).filter(F.col("layer").isin("l2_fact", "l4_identity")).groupBy(SCOPE().alias("scope"), "layer").agg(F.count(F.lit(1)).alias("n"))


@add("pr8_manage_filter", _W + r"""SELECT memory_id FROM rec WHERE status = 'active' AND contains(lower(coalesce(content, '') || chr(10) || array_to_string(coalesce(tags, []), ' ')), 'ginger')""")
def _(t):
    return listing.matching(rec(t).filter("status = 'active'"), "Ginger").select("memory_id")


@add("pr9_safe_fields", _W + "SELECT " + ", ".join(f for f in listing.SAFE_FIELDS if f != "tags") + ", array_to_string(tags, '|') AS tags FROM rec")
def _(t):
    return rec(t).select(*[f for f in listing.SAFE_FIELDS if f != "tags"], F.array_join("tags", "|").alias("tags"))


@add("pr10_revisable", _W + "SELECT memory_id FROM rec WHERE status = 'active' AND visibility = 'recallable' AND layer IN ('l2_fact', 'l4_identity')")
def _(t):
    return rec(t).filter((F.col("status") == "active") & (F.col("visibility") == "recallable") & F.col("layer").isin("l2_fact", "l4_identity")).select("memory_id")


@add("pr12_usable_vectors", f"WITH {_EMB} SELECT memory_id, space_id FROM emb WHERE len(list_filter(vector, lambda x: x <> 0)) > 0")
def _(t):
    return emb(t).filter(vectors.non_zero(F.col("vector"))).select("memory_id", "space_id")


# ---------------------------------------------------------------- scalar functions


@add("f1_tokens", _W + f"SELECT memory_id, array_to_string({q.tokens('content')}, ' ') AS tokens FROM rec")
def _(t):
    return rec(t).select("memory_id", F.array_join(text.tokenize(F.col("content")), " ").alias("tokens"))


@add("f2_run_tokens", _W + f"SELECT memory_id, array_to_string({q.runs('content')}, ' ') AS tokens FROM rec")
def _(t):
    return rec(t).select("memory_id", F.array_join(text.tokenize_runs(F.col("content")), " ").alias("tokens"))


@add("f3_intent", f"WITH {q.QRY} SELECT query_id, {q.intent('query_text')} AS intent FROM qry")
def _(t):
    return qry(t).select("query_id", text.intent(F.col("query_text")).alias("intent"))


@add("f4_hash_cells", _W + f"""SELECT memory_id, CAST(h % 256 AS INT) AS dim, CAST(sum(CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS cell
FROM (SELECT memory_id, unnest({q.feature_hashes('content')}) AS h FROM rec) GROUP BY 1, 2""")
def _(t):
    return retrieval.hash_table(rec(t).select("memory_id", F.col("content").alias("body")), "memory_id")


@add("f5_unit_vectors", f"""WITH {_EMB}, ok AS (SELECT *, sqrt(list_sum(list_transform(vector, lambda x: x::DOUBLE * x::DOUBLE))) AS len FROM emb
  WHERE len(vector) = dimensions AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
part AS (SELECT memory_id, space_id, len, unnest(vector)::DOUBLE AS x, generate_subscripts(vector, 1) AS i FROM ok WHERE len > 0)
SELECT memory_id, space_id, count(*) AS n, round(sum(x / len), 6) AS total, round(sum(x / len * i), 6) AS weighted FROM part GROUP BY 1, 2""")
def _(t):
    unit = vectors.unit(F.col("vector"), F.col("dimensions"))
    rows = emb(t).select("memory_id", "space_id", unit.alias("u")).filter("u IS NOT NULL")
    fold = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6)
    return rows.select("memory_id", "space_id", F.size("u").cast("long").alias("n"), fold(F.col("u")).alias("total"), fold(F.transform("u", lambda x, i: x * (i + 1))).alias("weighted"))


@add("f6_tags", _W + f"SELECT memory_id, array_to_string({q.tags('tags')}, '|') AS tags FROM rec")
def _(t):
    return rec(t).select("memory_id", F.array_join(text.normalize_tags(F.col("tags")), "|").alias("tags"))


@add("f7_clip", _W + f"SELECT memory_id, {q.trim('content[1:120]')} AS clipped FROM rec")
def _(t):
    return rec(t).select("memory_id", text.clip(F.col("content"), 120).alias("clipped"))


@add("f8_profile_text", _W + """SELECT memory_id, 'layer: ' || layer || chr(10) || 'name: ' || user_id || CASE WHEN source_session_id IS NULL THEN '' ELSE chr(10) || 'language: ' || source_session_id END AS profile FROM rec""")
def _(t):
    old = F.create_map(F.lit("layer"), "layer", F.lit("name"), F.lit("old"))
    patch = F.when(F.col("source_session_id").isNull(), F.create_map(F.lit("name"), "user_id", F.lit("shoe"), F.lit("x"))).otherwise(F.create_map(F.lit("name"), "user_id", F.lit("language"), "source_session_id"))
    return rec(t).select("memory_id", text.profile_text(text.merge_profile(old, patch, ["name", "language"])).alias("profile"))


@add("f9_speculations", f"""WITH {q.EXT} SELECT request_id, '{{"speculations":{{' || string_agg(to_json(client_ref)::VARCHAR || ':' || to_json(speculate)::VARCHAR, ',' ORDER BY client_ref) || '}}}}' AS meta
FROM (SELECT request_id, client_ref, max(speculate) AS speculate FROM ext WHERE speculate IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    one = ext(t).filter("speculate IS NOT NULL").groupBy("request_id", "client_ref").agg(F.max("speculate").alias("speculate"))
    rows = one.groupBy("request_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("client_ref", "speculate")))).alias("speculations"))
    return rows.select("request_id", F.to_json(F.struct("speculations")).alias("meta"))


@add("f10_duration", f"WITH {q.JOB} SELECT job_id, greatest(0, epoch_ms(finished_at) - epoch_ms(started_at)) AS took_ms FROM job WHERE finished_at IS NOT NULL AND started_at IS NOT NULL")
def _(t):
    return job(t).filter("finished_at IS NOT NULL AND started_at IS NOT NULL").select("job_id", listing.duration_ms().alias("took_ms"))


_FIXED = "CASE WHEN {x} * 128 = floor({x} * 128) THEN round({x}, 6) ELSE printf('%.6f', {x})::DOUBLE END"


@add("f11_to_fixed", _W + "SELECT memory_id, " + _FIXED.format(x="(confidence / 3)") + " AS third, round(confidence / 3, 6) AS rounded FROM rec WHERE confidence BETWEEN 0 AND 1")
def _(t):
    third = F.col("confidence") / 3
    return rec(t).filter("confidence BETWEEN 0 AND 1").select("memory_id", metrics.to_fixed(third).alias("third"), F.round(third, 6).alias("rounded"))


@add("f13_meta_json", _W + "SELECT memory_id, json_extract_string(meta, '$.origin') AS origin, CAST(json_extract_string(meta, '$.speculations') AS BIGINT) AS speculations FROM rec WHERE meta IS NOT NULL")
def _(t):
    parsed = F.from_json("meta", "origin string, speculations bigint", {"mode": "FAILFAST"})
    return rec(t).filter("meta IS NOT NULL").select("memory_id", parsed.alias("m")).select("memory_id", "m.origin", "m.speculations")


@add("f13_turn_list", """SELECT session_id, '[' || string_agg('{"turn":' || k || ',"text":' || to_json(text)::VARCHAR || '}', ',' ORDER BY k) || ']' AS turns
FROM (SELECT session_id, text, row_number() OVER (PARTITION BY session_id ORDER BY created_at, doc_id) AS k FROM documents WHERE session_id IS NOT NULL AND text IS NOT NULL) GROUP BY 1""")
def _(t):
    order = Window.partitionBy("session_id").orderBy("created_at", "doc_id")
    rows = t.documents.filter("session_id IS NOT NULL AND text IS NOT NULL").select("session_id", F.row_number().over(order).alias("turn"), "text")
    return rows.groupBy("session_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "text")))).alias("turns"))


@add("f14_message_text", _W + f"""SELECT memory_id, {q.trim("coalesce(content || chr(10), '') || memory_id || '  '")} AS said FROM rec""")
def _(t):
    block = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("text"))
    blocks = F.array(block("text", F.col("content")), block("image", F.lit("no text")), block("text", F.concat("memory_id", F.lit("  "))))
    return rec(t).select("memory_id", text.message_text(blocks).alias("said"))


@add("f15_confidence_text", _W + "SELECT memory_id, printf('%.2f', confidence) AS shown FROM rec WHERE confidence BETWEEN 0 AND 1")
def _(t):
    return rec(t).filter("confidence BETWEEN 0 AND 1").select("memory_id", F.format_string("%.2f", F.bround(F.col("confidence"), 6)).alias("shown"))


@add("f17_stable_id", _W + "SELECT memory_id, 'mem-' || sha256(memory_id || chr(31) || layer)[1:16] AS new_id FROM rec")
def _(t):
    return rec(t).select("memory_id", evolution.stable_id("mem-", F.col("memory_id"), F.col("layer")).alias("new_id"))


# ---------------------------------------------------------------- ranking


@add("r1_cosine", f"""WITH {q.REC}, {_EMB}, usable AS (SELECT memory_id, space_id, vector::DOUBLE[] AS v FROM emb WHERE vector IS NOT NULL AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0),
link AS (SELECT DISTINCT memory_id, other_id FROM (SELECT memory_id, unnest(list_concat(coalesce(supersedes, []), coalesce(superseded_by, []), coalesce(consolidates, []), coalesce(source_memory_ids, []))) AS other_id FROM rec) WHERE other_id <> '')
SELECT l.memory_id, l.other_id, a.space_id, round(CASE WHEN len(a.v) = len(b.v) AND len(list_filter(a.v, lambda x: x <> 0)) > 0 AND len(list_filter(b.v, lambda x: x <> 0)) > 0
    THEN list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) ELSE 0 END, 6) AS similarity
FROM link l JOIN usable a ON a.memory_id = l.memory_id JOIN usable b ON b.memory_id = l.other_id AND b.space_id = a.space_id""")
def _(t):
    usable = emb(t).filter("vector IS NOT NULL").filter(~F.exists("vector", lambda x: x.isNull() | F.isnan(x))).select("memory_id", "space_id", "vector")
    links = graph_checks.edges(rec(t), *graph_checks.RELATIONS, "source_memory_ids").select(F.col("src").alias("memory_id"), F.col("dst").alias("other_id")).distinct()
    other = usable.select(F.col("memory_id").alias("other_id"), "space_id", F.col("vector").alias("vb"))
    met = links.join(usable, "memory_id").join(other, ["other_id", "space_id"])
    return met.select("memory_id", "other_id", "space_id", F.round(vectors.cosine(F.col("vector"), F.col("vb")), 6).alias("similarity"))


def _asked(t):
    return retrieval.query_pools(qry(t)).select("query_id", "pool", F.col("query_text").alias("body")).withColumn("intent", text.intent(F.col("body")))


def _documents(t, asked):
    rows = retrieval.document_pools(retrieval.recallable(rec(t), as_of()), asked)
    return rows.select("pool", "channel", "memory_id", retrieval.search_text().alias("body"), F.coalesce("content", F.lit("")).alias("content"))


@add("r2_bm25", q.search() + "SELECT query_id, channel, memory_id, round(s, 6) AS score FROM lex")
def _(t):
    asked = _asked(t)
    return retrieval.bm25(asked, _documents(t, asked), 1.5, 0.75).select("query_id", "channel", "memory_id", F.round("lexical", 6).alias("score"))


@add("r2_bm25_topk", q.search() + "SELECT query_id, channel, memory_id, r FROM lexr WHERE r <= 10")
def _(t):
    asked = _asked(t)
    hits = retrieval.bm25(asked, _documents(t, asked), 1.5, 0.75)
    order = Window.partitionBy("query_id", "channel").orderBy(F.desc("lexical"), "memory_id")
    return hits.withColumn("r", F.row_number().over(order)).filter("r <= 10").select("query_id", "channel", "memory_id", "r")


@add("r3_semantic_topk", q.search() + "SELECT query_id, channel, memory_id, r, round(s, 6) AS score FROM semr WHERE r <= 10")
def _(t):
    hits = retrieval.semantic_topk(retrieval.prepare(live(t), qry(t), as_of()), 10)
    return hits.select("query_id", "channel", "memory_id", F.col("semantic_rank").alias("r"), F.round("semantic", 6).alias("score"))


@add("r6_intent_weights", f"""WITH {q.QRY}, i AS (SELECT query_id, {q.intent('query_text')} AS intent FROM qry)
SELECT query_id, CAST(CASE intent WHEN 'navigational' THEN 0.4 WHEN 'conceptual' THEN 1.1 ELSE 1.0 END AS DOUBLE) AS semantic, CAST(CASE intent WHEN 'navigational' THEN 1.4 WHEN 'conceptual' THEN 0.5 ELSE 0.8 END AS DOUBLE) AS lexical FROM i""")
def _(t):
    intent = text.intent(F.col("query_text"))
    return qry(t).select("query_id", retrieval.weighted(intent, 0).alias("semantic"), retrieval.weighted(intent, 1).alias("lexical"))


def _hits(t, **limits):
    return retrieval.search(live(t), qry(t), as_of(), retrieval.SearchConfig(**limits))


_MATCHED = "concat_ws(',', CASE WHEN sr IS NOT NULL THEN 'semantic' END, CASE WHEN lr IS NOT NULL THEN 'lexical' END, CASE WHEN channel = 'profile' THEN 'profile' END)"


@add("r7_search_hits", q.search() + f"SELECT query_id, channel, memory_id, round(score, 9) AS score, fused_rank, {_MATCHED} AS matched_by FROM hits")
def _(t):
    return _hits(t).select("query_id", "channel", "memory_id", F.round("score", 9).alias("score"), "fused_rank", "matched_by")


@add("r11_diagnostics", q.search() + f""", top AS (
  SELECT query_id, avg(score) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY channel <> 'profile', fused_rank) AS k FROM hits) WHERE k <= 3 GROUP BY 1),
closed AS (SELECT DISTINCT pool FROM dt WHERE len(list_filter(toks, lambda x: length(x) > 256)) > 0 OR len(toks) > 100000)
SELECT ask.query_id, ask.intent, round(CASE WHEN mean IS NULL THEN 0.0 ELSE least(1.0, mean * 60) END, 6)::DOUBLE AS confidence,
  CASE WHEN pool IN (SELECT pool FROM closed) THEN 'lexical:tokenizer-unavailable,' ELSE '' END || 'semantic:portable-hash,tag:unavailable' AS degraded FROM ask LEFT JOIN top USING (query_id)""")
def _(t):
    ready = retrieval.prepare(live(t), qry(t), as_of())
    return retrieval.diagnostics(retrieval.search_prepared(ready), ready, 60.0)


def _strict(column, most: int):
    """A tokenizer with a limit: a longer run is a token that is no token, which counts as a failure."""
    return F.transform(text.tokenize(column), lambda x: F.when(F.length(x) <= most, x).otherwise(F.lit("")))


@add("r12_closed_channels", f"""WITH {q.REC}, {q.QRY}, ask AS (SELECT query_id, scope || '#' || CASE WHEN session_only THEN 's:' || coalesce(session_id, '') ELSE '*' END AS pool, query_text AS body FROM qry),
doc AS (SELECT scope || '#' || part AS pool, coalesce(content, '') || chr(10) || array_to_string(list_transform(coalesce(tags, []), lambda g: lower({q.trim("coalesce(g, '')")})), ' ') AS body
  FROM (SELECT *, unnest(['*', 's:' || coalesce(source_session_id, '')]) AS part FROM rec WHERE {q.RECALLABLE})),
bad AS (SELECT DISTINCT pool FROM (SELECT pool, unnest({q.tokens('body')}) AS w FROM doc) WHERE length(w) > 14),
own AS (SELECT DISTINCT query_id FROM (SELECT query_id, unnest({q.tokens('body')}) AS w FROM ask) WHERE length(w) > 14)
SELECT query_id, CASE WHEN pool IN (SELECT pool FROM bad) OR query_id IN (SELECT query_id FROM own) THEN 'lexical:tokenizer-unavailable,' ELSE '' END || 'semantic:portable-hash,tag:unavailable' AS degraded FROM ask""")
def _(t):
    ready = retrieval.prepare(live(t), qry(t), as_of(), tokenizer=lambda c: _strict(c, 14))
    return retrieval.diagnostics(retrieval.search_prepared(ready), ready, 60.0).select("query_id", "degraded")


_SPACE = ("trained-lattice-v2", 64)


@add("r3_trained_space", f"""WITH {q.REC}, {q.QRY}, {_EMB}, usable AS (SELECT memory_id, vector::DOUBLE[] AS v FROM emb WHERE space_id = '{_SPACE[0]}' AND len(vector) = {_SPACE[1]}
  AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
asked AS (SELECT query_id, v AS qv FROM (SELECT query_id, min(memory_id) AS memory_id FROM (SELECT query_id, unnest(relevant_ids) AS memory_id FROM qry) JOIN usable USING (memory_id) GROUP BY 1) JOIN usable USING (memory_id)),
ask AS (SELECT query_id, qv, scope || '#' || CASE WHEN session_only THEN 's:' || coalesce(session_id, '') ELSE '*' END AS pool FROM qry JOIN asked USING (query_id)),
doc AS (SELECT scope || '#' || part AS pool, {q.CHANNEL} AS channel, memory_id FROM (SELECT *, unnest(['*', 's:' || coalesce(source_session_id, '')]) AS part FROM rec WHERE {q.RECALLABLE})),
scored AS (SELECT query_id, channel, memory_id, round(list_dot_product(qv, v) / sqrt(list_dot_product(qv, qv) * list_dot_product(v, v)), 9) AS s FROM ask JOIN doc USING (pool) JOIN usable USING (memory_id))
SELECT query_id, channel, memory_id, row_number() OVER (PARTITION BY query_id, channel ORDER BY s DESC, memory_id) AS r FROM scored WHERE s >= 0.08 QUALIFY r <= 10""")
def _(t):
    ready = retrieval.prepare(live(t), qry(t), as_of())
    mine = emb(t).filter(F.col("space_id") == _SPACE[0])
    stored = retrieval._dense_cells(mine.select("memory_id", "vector"), "vector", _SPACE[1])
    first = qry(t).select("query_id", F.explode("relevant_ids").alias("memory_id")).join(stored, "memory_id").groupBy("query_id").agg(F.min("memory_id").alias("memory_id"))
    asked = ready.asked.select("query_id", "pool").join(first.join(stored, "memory_id").select("query_id", "dims", "cells"), "query_id")
    hits = retrieval.semantic_of(asked, ready.documents.select("pool", "channel", "memory_id").join(stored, "memory_id"), 0.08, _SPACE[1])
    order = Window.partitionBy("query_id", "channel").orderBy(F.desc("semantic"), "memory_id")
    return hits.withColumn("r", F.row_number().over(order)).filter("r <= 10").select("query_id", "channel", "memory_id", "r")


_RELATIVES = f"""WITH {q.REC}, l AS (
  SELECT memory_id, scope, unnest(list_concat([memory_id], coalesce(supersedes, []), coalesce(superseded_by, []), coalesce(consolidates, []))) AS relative_id FROM rec),
relative AS (
  SELECT l.memory_id, r.memory_id AS relative_id, r.revision AS relative_revision FROM l JOIN rec r ON r.memory_id = l.relative_id AND r.scope = l.scope
  UNION SELECT a.memory_id, b.memory_id, b.revision FROM rec a JOIN rec b ON a.scope = b.scope AND a.chain_id = b.chain_id)
"""


@add("r13_evolution", _RELATIVES + "SELECT * FROM relative")
def _(t):
    return retrieval.relatives(rec(t), rec(t))


def _sources(t):
    owner = rec(t).select(F.col("memory_id").alias("raw_memory_id"), "tenant_id", "user_id", "agent_id")
    return ext(t).select(F.col("extract_id").alias("source_id"), "raw_memory_id", "layer", "content").join(owner, "raw_memory_id")


@add("r14_shortlist", q.shortlist() + "SELECT query_id AS source_id, memory_id, round(score, 9) AS score, fused_rank AS shortlist_rank FROM hits")
def _(t):
    return retrieval.shortlist(_sources(t), live(t), as_of()).withColumn("score", F.round("score", 9))


@add("r15_catalog", q.shortlist() + "SELECT memory_id, min(query_id) AS first_source, count(*) AS n_sources FROM hits GROUP BY 1")
def _(t):
    return retrieval.shortlist(_sources(t), live(t), as_of()).groupBy("memory_id").agg(F.min("source_id").alias("first_source"), F.count(F.lit(1)).alias("n_sources"))


# ---------------------------------------------------------------- joins and sets


@add("j6_evidence", _W + "SELECT DISTINCT l.memory_id, l.source_id, r.status AS source_status FROM (SELECT memory_id, unnest(source_memory_ids) AS source_id FROM rec) l JOIN rec r ON r.memory_id = l.source_id WHERE l.source_id <> ''")
def _(t):
    return listing.evidence(rec(t))


@add("j7_history", _RELATIVES + """SELECT p.memory_id, p.relative_id, r.revision, row_number() OVER (PARTITION BY p.memory_id ORDER BY r.revision DESC, r.updated_at DESC NULLS LAST, p.relative_id) AS place
FROM relative p JOIN rec r ON r.memory_id = p.relative_id WHERE p.memory_id <> p.relative_id""")
def _(t):
    return listing.history(rec(t), retrieval.relatives(rec(t), rec(t)).select("memory_id", "relative_id"))


@add("j11_idempotency", f"WITH {q.REC}, {q.JOB} SELECT job_id, EXISTS (SELECT 1 FROM rec r WHERE r.idempotency_key = job.idempotency_key AND r.scope = job.scope) AS replayed FROM job WHERE idempotency_key IS NOT NULL")
def _(t):
    used = rec(t).filter("idempotency_key IS NOT NULL").select("idempotency_key", SCOPE().alias("scope")).distinct().withColumn("replayed", F.lit(True))
    return job(t).filter("idempotency_key IS NOT NULL").select("job_id", "idempotency_key", SCOPE().alias("scope")).join(used, ["idempotency_key", "scope"], "left").select("job_id", F.coalesce("replayed", F.lit(False)).alias("replayed"))


@add("j15_labels", q.search() + ", label AS (SELECT DISTINCT query_id, unnest(relevant_ids) AS memory_id FROM qry) SELECT h.query_id, h.memory_id, l.memory_id IS NOT NULL AS relevant FROM hits h LEFT JOIN label l USING (query_id, memory_id)")
def _(t):
    labels = qry(t).select("query_id", F.explode("relevant_ids").alias("memory_id")).distinct().withColumn("relevant", F.lit(True))
    return _hits(t).select("query_id", "memory_id").join(labels, ["query_id", "memory_id"], "left").select("query_id", "memory_id", F.coalesce("relevant", F.lit(False)).alias("relevant"))


@add("u1_channels", q.search() + "SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY channel <> 'profile', fused_rank) AS place FROM hits")
def _(t):
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("channel") == "profile", 0).otherwise(1), "fused_rank")
    return _hits(t).select("query_id", "memory_id", F.row_number().over(order).alias("place"))


# facts and identities together, and each request's least identity stated again
@add("u2_repeated_refs", f"WITH {q.EXT}, together AS (SELECT request_id, client_ref FROM ext UNION ALL SELECT request_id, min(client_ref) FROM ext WHERE layer = 'l4_identity' GROUP BY 1) SELECT request_id, client_ref, count(*) AS n FROM together GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    again = ext(t).filter("layer = 'l4_identity'").groupBy("request_id").agg(F.min("client_ref").alias("client_ref"))
    together = ext(t).select("request_id", "client_ref").unionByName(again)
    return together.groupBy("request_id", "client_ref").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@add("u4_new_records", _W + "SELECT memory_id FROM rec WHERE memory_id NOT IN (SELECT memory_id FROM memory_record WHERE ingested_at < TIMESTAMPTZ '2025-06-01 00:00:00+00')")
def _(t):
    held = t.memory_record.filter(F.col("ingested_at") < as_of()).select("memory_id")
    return rec(t).select("memory_id").join(held, "memory_id", "left_anti")


@add("u3_operations", q.shortlist() + f""", has AS (SELECT DISTINCT query_id FROM hits)
SELECT extract_id, CASE WHEN extract_id IN (SELECT query_id FROM has) THEN 'model' ELSE 'ADD' END AS operation FROM ext JOIN rec ON rec.memory_id = ext.raw_memory_id""")
def _(t):
    sources = _sources(t).select(F.col("source_id").alias("request_id"), F.col("source_id").alias("client_ref"))
    found = retrieval.shortlist(_sources(t), live(t), as_of()).select(F.col("source_id").alias("request_id"), F.col("source_id").alias("client_ref")).distinct()
    auto = evolution.automatic_additions(sources, found).select(F.col("client_ref").alias("extract_id"), F.lit("ADD").alias("operation"))
    return auto.unionByName(found.select(F.col("client_ref").alias("extract_id"), F.lit("model").alias("operation")))


@add("u5_relation_targets", _W + """SELECT DISTINCT src, dst FROM (
  SELECT memory_id AS src, unnest(list_concat(coalesce(supersedes, []), coalesce(consolidates, []), coalesce(superseded_by, []))) AS dst FROM rec) WHERE dst <> ''""")
def _(t):
    return graph_checks.edges(rec(t)).select("src", "dst").distinct()


# ---------------------------------------------------------------- aggregates


@add("a1_summary", _W + f"SELECT scope, status, layer, count(*) AS n, count(*) FILTER ({q.RECALLABLE}) AS n_recallable FROM rec GROUP BY 1, 2, 3")
def _(t):
    return listing.summary(rec(t), as_of())


@add("a2_jobs", f"WITH {q.JOB} SELECT status, count(*) AS n FROM job GROUP BY 1")
def _(t):
    return job(t).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@add("a3_health", _W + "SELECT count(*) AS n_records, count(DISTINCT scope) AS n_scopes FROM rec")
def _(t):
    return rec(t).agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct(SCOPE()).alias("n_scopes"))


@add("a4_agents", _W + "SELECT DISTINCT coalesce(tenant_id, '') AS tenant, user_id, agent FROM (SELECT tenant_id, user_id, agent_id AS agent FROM rec UNION ALL SELECT tenant_id, user_id, 'default' FROM rec)")
def _(t):
    return rec(t).select(F.coalesce("tenant_id", F.lit("")).alias("tenant"), "user_id", F.explode(F.array("agent_id", F.lit("default"))).alias("agent")).distinct()


@add("a5_tags", _W + "SELECT scope, coalesce(string_agg(DISTINCT g, ',' ORDER BY g), '') AS tags FROM (SELECT scope, unnest(CASE WHEN tags IS NULL OR len(tags) = 0 THEN [NULL] ELSE tags END) AS g FROM rec) GROUP BY scope")
def _(t):
    return listing.tags(rec(t))


def _labels(t, field="relevant_ids"):
    return qry(t).select("query_id", F.explode(field).alias("memory_id")).filter("memory_id <> ''").distinct()


def _rankings(t):
    return _hits(t, recall_limit=10, profile_limit=10).join(qry(t).select("query_id", F.col("channel").alias("wanted")), "query_id").filter("channel = wanted").select("query_id", F.col("fused_rank").alias("rank"), "memory_id")


_RANKED = q.search(recall=10, profile=10) + """, ranking AS (SELECT query_id, fused_rank AS rank, memory_id FROM hits JOIN qry USING (query_id) WHERE hits.channel = qry.channel),
label AS (SELECT DISTINCT query_id, memory_id FROM (SELECT query_id, unnest(relevant_ids) AS memory_id FROM qry) WHERE memory_id <> ''),
wanted AS (SELECT query_id, count(*) AS n FROM label GROUP BY 1),
got AS (SELECT query_id, count(*) FILTER (rank <= 5) AS h5, count(*) AS h10, min(rank) AS first_rank FROM ranking JOIN label USING (query_id, memory_id) WHERE rank <= 10 GROUP BY 1),
pq AS (SELECT query_id, n, coalesce(h5, 0) AS h5, coalesce(h10, 0) AS h10, first_rank FROM wanted LEFT JOIN got USING (query_id)),
cse AS (SELECT query_id, round(h5 / n, 6) AS recall5, round(h10 / n, 6) AS recall10, round(coalesce(1 / first_rank, 0), 6) AS reciprocal, first_rank FROM pq)
"""


@add("a6_golden", _RANKED + """SELECT count(*) AS scored_queries, sum(n)::BIGINT AS relevant_items, round(avg(h5 / n), 6) AS recall5_macro, round(sum(h5) / sum(n), 6) AS recall5_micro,
  round(avg(h10 / n), 6) AS recall10_macro, round(sum(h10) / sum(n), 6) AS recall10_micro, round(avg(coalesce(1 / first_rank, 0)), 6) AS mrr10 FROM pq""")
def _(t):
    return metrics.golden(_rankings(t), _labels(t))


@add("a7_cases", _RANKED + "SELECT * FROM cse")
def _(t):
    return metrics.cases(_rankings(t), _labels(t))


@add("a8_hard_checks", _RANKED + """, bad AS (SELECT DISTINCT query_id, memory_id FROM (SELECT query_id, unnest(forbidden_ids) AS memory_id FROM qry) WHERE memory_id <> '')
SELECT r.query_id, count(b.memory_id) AS forbidden_hits, count(DISTINCT b.memory_id) AS forbidden_ids, count(*) - count(DISTINCT r.memory_id) AS duplicate_ids FROM ranking r LEFT JOIN bad b USING (query_id, memory_id) GROUP BY 1""")
def _(t):
    return metrics.hard_checks(_rankings(t), _labels(t, "forbidden_ids"))


@add("a9_cells", _RANKED + f""", grid AS (SELECT * FROM (SELECT unnest({metrics.BUCKETS}) AS bucket), (SELECT unnest({metrics.LANGUAGES}) AS language)),
celled AS (SELECT bucket, language, count(*) AS n_queries, count(n) AS n_relevant, count(*) - count(n) AS n_negative, avg(h5 / n) AS recall5, avg(h10 / n) AS recall10, avg(CASE WHEN n IS NOT NULL THEN coalesce(1 / first_rank, 0) END) AS mrr10 FROM qry LEFT JOIN pq USING (query_id) GROUP BY 1, 2)
SELECT bucket, language, coalesce(n_queries, 0) AS n_queries, coalesce(n_relevant, 0) AS n_relevant, coalesce(n_negative, 0) AS n_negative, round(coalesce(recall5, 0), 6) AS recall5, round(coalesce(recall10, 0), 6) AS recall10, round(coalesce(mrr10, 0), 6) AS mrr10
FROM grid LEFT JOIN celled USING (bucket, language)""")
def _(t):
    return metrics.golden_cells(_rankings(t), _labels(t), qry(t))


@add("a10_embedding_cells", _RANKED + """SELECT bucket, language, count(*) AS n_queries, round(avg(recall5), 6) AS recall5, round(avg(recall10), 6) AS recall10, round(avg(reciprocal), 6) AS reciprocal
FROM cse JOIN qry USING (query_id) GROUP BY GROUPING SETS ((bucket), (bucket, language))""")
def _(t):
    return metrics.by_cells(metrics.cases(_rankings(t), _labels(t)), qry(t).select("query_id", "bucket", "language"), [["bucket"], ["bucket", "language"]])


def _mode_cases(t, tokenizer):
    hits = retrieval.search(live(t), qry(t), as_of(), retrieval.SearchConfig(recall_limit=10, profile_limit=10), tokenizer=tokenizer)
    ranked = hits.join(qry(t).select("query_id", F.col("channel").alias("wanted")), "query_id").filter("channel = wanted")
    return metrics.cases(ranked.select("query_id", F.col("fused_rank").alias("rank"), "memory_id"), _labels(t))


_MODES = {"legacy": (q.runs, text.tokenize_runs), "cjk_bigram": (q.tokens, text.tokenize)}


def _mode_sql(name):
    return f"""(SELECT '{name}' AS mode, * FROM ({q.search(_MODES[name][0], recall=10, profile=10)}, ranking AS (SELECT query_id, fused_rank AS rank, memory_id FROM hits JOIN qry USING (query_id) WHERE hits.channel = qry.channel),
label AS (SELECT DISTINCT query_id, memory_id FROM (SELECT query_id, unnest(relevant_ids) AS memory_id FROM qry) WHERE memory_id <> ''),
wanted AS (SELECT query_id, count(*) AS n FROM label GROUP BY 1),
got AS (SELECT query_id, count(*) FILTER (rank <= 5) AS h5, count(*) AS h10, min(rank) AS first_rank FROM ranking JOIN label USING (query_id, memory_id) WHERE rank <= 10 GROUP BY 1),
cse AS (SELECT query_id, round(coalesce(h5, 0) / n, 6) AS recall5, round(coalesce(h10, 0) / n, 6) AS recall10, round(coalesce(1 / first_rank, 0), 6) AS reciprocal FROM wanted LEFT JOIN got USING (query_id))
SELECT bucket, count(*) AS n_queries, round(avg(recall5), 6) AS recall5, round(avg(recall10), 6) AS recall10, round(avg(reciprocal), 6) AS reciprocal FROM cse JOIN qry USING (query_id) WHERE bucket <> 'filter' GROUP BY GROUPING SETS ((), (bucket))))"""


@add("a11_lexical_modes", f"""WITH m AS (SELECT * FROM {_mode_sql('legacy')} UNION ALL SELECT * FROM {_mode_sql('cjk_bigram')})
SELECT mode, bucket, n_queries, recall5, recall10, reciprocal FROM m
UNION ALL SELECT 'delta', NULL, b.n_queries, round(b.recall5 - a.recall5, 6), round(b.recall10 - a.recall10, 6), round(b.reciprocal - a.reciprocal, 6) FROM m a, m b WHERE a.mode = 'legacy' AND b.mode = 'cjk_bigram' AND a.bucket IS NULL AND b.bucket IS NULL""")
def _(t):
    return metrics.mode_report({name: _mode_cases(t, tokenizer) for name, (_, tokenizer) in _MODES.items()}, qry(t).select("query_id", "bucket"))


# Each write job as a case: what its created record's links say is expected, what the state bears out is observed.
_OBSERVED = f"""WITH {q.REC}, {q.JOB},
made AS (SELECT job_id, raw_memory_id, unnest(created_memory_ids) AS memory_id FROM job),
head AS (SELECT m.job_id, m.raw_memory_id, rec.* FROM made m JOIN rec USING (memory_id) WHERE layer <> 'l1_raw'),
one AS (SELECT job_id, count(*) AS n_heads, count(*) FILTER (status = 'active') AS n_live, min(memory_id) AS memory_id FROM head GROUP BY 1),
link AS (SELECT DISTINCT memory_id, other FROM (SELECT memory_id, unnest(list_concat(coalesce(supersedes, []), coalesce(consolidates, []))) AS other FROM rec) WHERE other <> ''),
sound AS (SELECT l.memory_id, bool_and(coalesce(list_contains(r.superseded_by, l.memory_id), false)) AS sound FROM link l LEFT JOIN rec r ON r.memory_id = l.other GROUP BY 1),
attached AS (SELECT DISTINCT s AS raw_memory_id FROM (SELECT unnest(source_memory_ids) AS s FROM rec WHERE layer <> 'l1_raw' AND status = 'active')),
obs AS (SELECT job.job_id, CASE WHEN regexp_matches(coalesce(raw.content, ''), '[\\x{{3400}}-\\x{{9fff}}]') THEN 'zh' ELSE 'en' END AS language,
  CASE WHEN job.code IS NULL THEN 'nominal' WHEN job.code IN ('EXTRACTION_FAILED', 'RECONCILE_FAILED') THEN 'injected_model_failure' WHEN job.code = 'INVALID_INPUT' THEN 'invalid_json' WHEN job.code = 'EMBEDDING_SPACE_MISMATCH' THEN 'schema_failure' ELSE 'other' END AS fault_scenario,
  CASE WHEN one.n_heads = 1 THEN CASE WHEN len(h.supersedes) > 0 THEN 'SUPERSEDE' WHEN len(h.consolidates) > 0 THEN 'CONSOLIDATE' ELSE 'ADD' END WHEN one.n_heads IS NULL THEN 'NOOP' END AS expected,
  CASE WHEN one.n_heads IS NULL THEN CASE WHEN job.raw_memory_id IN (SELECT raw_memory_id FROM attached) THEN 'NOOP' END
    WHEN one.n_heads = 1 AND h.status = 'active' AND list_contains(h.source_memory_ids, job.raw_memory_id) THEN
      CASE WHEN coalesce(len(h.supersedes), 0) = 0 AND coalesce(len(h.consolidates), 0) = 0 THEN 'ADD' WHEN sound AND len(h.supersedes) > 0 AND coalesce(len(h.consolidates), 0) = 0 THEN 'SUPERSEDE'
        WHEN sound AND len(h.consolidates) > 1 AND coalesce(len(h.supersedes), 0) = 0 THEN 'CONSOLIDATE' END END AS observed,
  CASE WHEN job.status = 'completed' THEN 'completed' ELSE 'degraded' END AS receipt_status, one.n_heads IS NULL AND job.status = 'completed' AS duplicate_measured,
  coalesce(one.n_live, 0) = 0 AS no_new_active_derived, job.raw_memory_id IS NOT NULL AND job.raw_memory_id IN (SELECT raw_memory_id FROM attached) AS evidence_attached
  FROM job LEFT JOIN one USING (job_id) LEFT JOIN rec h ON h.memory_id = one.memory_id AND one.n_heads = 1 LEFT JOIN sound ON sound.memory_id = h.memory_id LEFT JOIN rec raw ON raw.memory_id = job.raw_memory_id)
"""


def _observed(t):
    """(job_id, language, fault_scenario, expected, observed, receipt_status, duplicate_measured, no_new_active_derived, evidence_attached)."""
    none = F.array().cast("array<string>")
    records, jobs = rec(t), job(t)
    derived = records.filter("layer <> 'l1_raw'")
    made = jobs.select("job_id", F.explode("created_memory_ids").alias("memory_id")).join(derived.select("memory_id", "status"), "memory_id")
    one = made.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_heads"), F.count_if(F.col("status") == "active").alias("n_live"), F.min("memory_id").alias("head_id"))
    head = derived.select(F.col("memory_id").alias("head_id"), F.col("status").alias("head_status"), *[F.coalesce(c, none).alias(n) for c, n in (("supersedes", "s"), ("consolidates", "c"), ("source_memory_ids", "e"))])
    links = graph_checks.edges(records, "supersedes", "consolidates").select(F.col("src").alias("head_id"), F.col("dst").alias("other")).distinct()
    back = records.select(F.col("memory_id").alias("other"), F.explode("superseded_by").alias("head_id")).distinct().withColumn("back", F.lit(True))
    sound = links.join(back, ["other", "head_id"], "left").groupBy("head_id").agg(F.min(F.coalesce("back", F.lit(False)).cast("int")).alias("sound"))
    attached = derived.filter("status = 'active'").select(F.explode("source_memory_ids").alias("raw_memory_id")).distinct().withColumn("attached", F.lit(True))
    raw = records.select(F.col("memory_id").alias("raw_memory_id"), F.col("content").alias("raw_content"))
    rows = jobs.join(one, "job_id", "left").join(head.join(sound, "head_id", "left"), "head_id", "left").join(attached, "raw_memory_id", "left").join(raw, "raw_memory_id", "left")
    single, n_s, n_c, took = F.col("n_heads") == 1, F.size("s"), F.size("c"), F.coalesce("attached", F.lit(False))
    expected = F.when(single, F.when(n_s > 0, "SUPERSEDE").when(n_c > 0, "CONSOLIDATE").otherwise("ADD")).when(F.col("n_heads").isNull(), "NOOP")
    kind = F.when((n_s == 0) & (n_c == 0), "ADD").when((F.col("sound") == 1) & (n_s > 0) & (n_c == 0), "SUPERSEDE").when((F.col("sound") == 1) & (n_c > 1) & (n_s == 0), "CONSOLIDATE")
    observed = F.when(F.col("n_heads").isNull(), F.when(took, "NOOP")).when(single & (F.col("head_status") == "active") & F.array_contains("e", F.col("raw_memory_id")), kind)
    code = F.col("code")
    fault = F.when(code.isNull(), "nominal").when(code.isin("EXTRACTION_FAILED", "RECONCILE_FAILED"), "injected_model_failure").when(code == "INVALID_INPUT", "invalid_json").when(code == "EMBEDDING_SPACE_MISMATCH", "schema_failure").otherwise("other")
    return rows.select(
        "job_id", F.when(F.coalesce("raw_content", F.lit("")).rlike("[\\u3400-\\u9fff]"), "zh").otherwise("en").alias("language"), fault.alias("fault_scenario"), expected.alias("expected"), observed.alias("observed"),
        F.when(F.col("status") == "completed", "completed").otherwise("degraded").alias("receipt_status"), (F.col("n_heads").isNull() & (F.col("status") == "completed")).alias("duplicate_measured"),
        (F.coalesce("n_live", F.lit(0)) == 0).alias("no_new_active_derived"), took.alias("evidence_attached"),
    )


_LANGUAGES = "cell AS (SELECT unnest([NULL, 'zh', 'en']) AS language)"


@add("a12_confusion", _OBSERVED + f""", {_LANGUAGES}, n AS (SELECT *, coalesce(observed = 'SUPERSEDE', false) AS seen FROM obs WHERE fault_scenario = 'nominal' AND expected IS NOT NULL),
c AS (SELECT cell.language, count(*) FILTER (expected = 'SUPERSEDE' AND seen) AS true_positive, count(*) FILTER (expected <> 'SUPERSEDE' AND NOT seen) AS true_negative,
  count(*) FILTER (expected <> 'SUPERSEDE' AND seen) AS false_positive, count(*) FILTER (expected = 'SUPERSEDE' AND NOT seen) AS false_negative, count(n.job_id) AS total FROM cell LEFT JOIN n ON cell.language IS NULL OR cell.language = n.language GROUP BY 1)
SELECT language, true_positive, true_negative, false_positive, false_negative, CASE WHEN total = 0 THEN 0 ELSE round((true_positive + true_negative) / total, 6) END AS accuracy FROM c""")
def _(t):
    return metrics.confusion(_observed(t))


@add("a13_compression", _OBSERVED + f""", {_LANGUAGES}, m AS (SELECT * FROM obs WHERE duplicate_measured),
c AS (SELECT cell.language, count(m.job_id) AS total, count(*) FILTER (no_new_active_derived AND evidence_attached) AS compressed FROM cell LEFT JOIN m ON cell.language IS NULL OR cell.language = m.language GROUP BY 1)
SELECT language, total, compressed, CASE WHEN total = 0 THEN 0 ELSE round(compressed / total, 6) END AS value FROM c""")
def _(t):
    return metrics.compression(_observed(t))


@add("a14_degradation", _OBSERVED + f""", c AS (SELECT s.fault_scenario, count(obs.job_id) AS accepted, count(*) FILTER (receipt_status = 'degraded') AS degraded FROM (SELECT unnest({metrics.SCENARIOS}) AS fault_scenario) s LEFT JOIN obs USING (fault_scenario) GROUP BY 1)
SELECT fault_scenario, accepted, degraded, CASE WHEN accepted = 0 THEN 0 ELSE round(degraded / accepted, 6) END AS value FROM c""")
def _(t):
    return metrics.degradation(_observed(t))


@add("f16_conflict_label", _OBSERVED + """SELECT job_id, CASE WHEN expected IS NULL OR observed IS NULL THEN NULL WHEN expected = 'SUPERSEDE' THEN CASE WHEN observed = 'SUPERSEDE' THEN 'TP' ELSE 'FN' END
  WHEN observed = 'SUPERSEDE' THEN 'FP' ELSE 'TN' END AS label FROM obs""")
def _(t):
    return _observed(t).select("job_id", metrics.conflict_label(F.col("expected"), F.col("observed")).alias("label"))


@add("j17_mode_alignment", f"""WITH a AS (SELECT * FROM {_mode_sql('legacy').replace("SELECT bucket, count(*) AS n_queries, round(avg(recall5), 6) AS recall5, round(avg(recall10), 6) AS recall10, round(avg(reciprocal), 6) AS reciprocal FROM cse JOIN qry USING (query_id) WHERE bucket <> 'filter' GROUP BY GROUPING SETS ((), (bucket))", "SELECT * FROM cse")}),
b AS (SELECT * FROM {_mode_sql('cjk_bigram').replace("SELECT bucket, count(*) AS n_queries, round(avg(recall5), 6) AS recall5, round(avg(recall10), 6) AS recall10, round(avg(reciprocal), 6) AS reciprocal FROM cse JOIN qry USING (query_id) WHERE bucket <> 'filter' GROUP BY GROUPING SETS ((), (bucket))", "SELECT * FROM cse")})
SELECT query_id, a.recall10 AS legacy_recall10, b.recall10 AS cjk_bigram_recall10, a.reciprocal AS legacy_reciprocal, b.reciprocal AS cjk_bigram_reciprocal FROM a JOIN b USING (query_id)""")
def _(t):
    parts = [_mode_cases(t, tokenizer).select("query_id", F.col("recall10").alias(f"{name}_recall10"), F.col("reciprocal").alias(f"{name}_reciprocal")) for name, (_, tokenizer) in _MODES.items()]
    return parts[0].join(parts[1], "query_id")


@add("a16_scope_leaks", q.search() + f"SELECT count(*) AS n_hits, count(*) FILTER (rec.scope <> qry.scope OR NOT ({q.RECALLABLE.replace('status', 'rec.status')})) AS n_leaks FROM hits JOIN qry USING (query_id) JOIN rec USING (memory_id)")
def _(t):
    owner = rec(t).select("memory_id", SCOPE().alias("owner"), ((F.col("status") == "active") & (F.col("visibility") == "recallable") & retrieval.valid_at(as_of())).alias("ok"))
    joined = _hits(t).join(qry(t).select("query_id", SCOPE().alias("asked")), "query_id").join(owner, "memory_id")
    return joined.agg(F.count(F.lit(1)).alias("n_hits"), F.count_if((F.col("owner") != F.col("asked")) | ~F.col("ok")).alias("n_leaks"))


@add("a17_next_revision", _W + "SELECT chain_id, max(revision) + 1 AS next_revision, max(confidence) FILTER (NOT isnan(confidence)) AS confidence FROM rec WHERE chain_id IS NOT NULL GROUP BY 1")
def _(t):
    return rec(t).filter("chain_id IS NOT NULL").groupBy("chain_id").agg((F.max("revision") + 1).alias("next_revision"), F.max(F.when(~F.isnan("confidence"), F.col("confidence"))).alias("confidence"))


@add("a18_evidence_union", _W + "SELECT chain_id, string_agg(DISTINCT s, ',' ORDER BY s) AS evidence FROM (SELECT chain_id, unnest(source_memory_ids) AS s FROM rec WHERE chain_id IS NOT NULL) WHERE s <> '' GROUP BY 1")
def _(t):
    rows = rec(t).filter("chain_id IS NOT NULL").select("chain_id", F.explode("source_memory_ids").alias("s")).filter("s <> ''")
    return rows.groupBy("chain_id").agg(F.array_join(F.sort_array(F.collect_set("s")), ",").alias("evidence"))


# ---------------------------------------------------------------- windows and limits


@add("w3_list", _W + "SELECT scope, memory_id, row_number() OVER (PARTITION BY scope ORDER BY updated_at DESC NULLS LAST, memory_id) AS place FROM rec WHERE layer IN ('l2_fact', 'l3_summary') QUALIFY place <= 8")
def _(t):
    return listing.listed(rec(t), 8, layers=["l2_fact", "l3_summary"]).select(SCOPE().alias("scope"), "memory_id", "place")


@add("w4_page", _W + """, mine AS (SELECT * FROM rec WHERE tenant_id = 'tenant-alder' AND user_id = 'user-00hub' AND agent_id = 'agent-concierge' AND status = 'active')
SELECT memory_id, updated_at, (SELECT count(*) FROM mine) AS total FROM mine ORDER BY updated_at DESC NULLS LAST, memory_id LIMIT 25 OFFSET 25""")
def _(t):
    mine = rec(t).filter(listing.same_owner("tenant-alder", "user-00hub", "agent-concierge") & (F.col("status") == "active"))
    total = mine.agg(F.count(F.lit(1)).alias("total")).withColumn("k", F.lit(1))
    return listing.page(mine.select("memory_id", "updated_at"), 25, 25).withColumn("k", F.lit(1)).join(total, "k").select("memory_id", "updated_at", "total")


@add("w6_last_jobs", f"WITH {q.JOB} SELECT scope, job_id, row_number() OVER (PARTITION BY scope ORDER BY started_at DESC NULLS LAST, job_id) AS place FROM job QUALIFY place <= 30")
def _(t):
    return listing.last_jobs(job(t)).select(SCOPE().alias("scope"), "job_id", "place")


@add("w7_recent_recalls", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200) QUALIFY place <= 20")
def _(t):
    return listing.recent_events(t.events, "user_id", "ts", "event_id").select("user_id", "event_id", "place")


@add("w8_context", q.search() + f""", line AS (SELECT h.query_id, h.memory_id, h.channel, h.fused_rank, length('- [' || h.memory_id || '] (' || rec.layer || ', confidence ' || coalesce(printf('%.2f', confidence), '') || ') ' || coalesce(rec.content, '')) AS chars FROM hits h JOIN rec USING (memory_id)),
run AS (SELECT query_id, memory_id, row_number() OVER w AS line_no, sum(chars + 1) OVER (w ROWS UNBOUNDED PRECEDING) + {len(retrieval.CONTEXT_HEAD) + 1 + len(retrieval.CONTEXT_TAIL)} AS used_chars FROM line WINDOW w AS (PARTITION BY query_id ORDER BY channel <> 'profile', fused_rank))
SELECT query_id, memory_id, line_no, CAST(used_chars AS BIGINT) AS used_chars FROM run WHERE used_chars <= 1200""")
def _(t):
    return retrieval.pack_context(_hits(t), rec(t), 1200)


@add("w9_first_relevant", _RANKED + "SELECT query_id, first_rank FROM got")
def _(t):
    return metrics.per_query(_rankings(t), _labels(t), True).filter("first_rank IS NOT NULL").select("query_id", "first_rank")


@add("w10_turn_slice", """WITH s AS (SELECT user_id, max(event_id) AS a FROM events WHERE event_type = 'click' GROUP BY 1),
e AS (SELECT e.user_id, min(e.event_id) AS b FROM events e JOIN s USING (user_id) WHERE e.event_type = 'purchase' AND e.event_id > s.a GROUP BY 1)
SELECT e0.user_id, e0.event_id FROM events e0 JOIN s USING (user_id) LEFT JOIN e USING (user_id) WHERE e0.event_id > s.a AND (e.b IS NULL OR e0.event_id < e.b)""")
def _(t):
    return listing.turn_slice(t.events, "user_id", "event_id", F.col("event_type") == "click", F.col("event_type") == "purchase").select("user_id", "event_id")


@add("pr11_spoken", """SELECT event_id FROM events WHERE event_type NOT IN ('error', 'view')""")
def _(t):
    kind = F.when(F.col("event_type") == "error", "tool").when(F.col("event_type").isin("view", "signup"), "plugin").otherwise("user")
    plugin = F.when(F.col("event_type") == "view", "memory").when(F.col("event_type") == "signup", "calendar")
    return listing.spoken(t.events.withColumn("source_kind", kind).withColumn("source_plugin", plugin)).select("event_id")


@add("w12_operation_order", f"WITH {q.EXT} SELECT request_id, extract_id, row_number() OVER (PARTITION BY request_id ORDER BY list_min(evidence_turn_indexes) NULLS LAST, client_ref, extract_id) AS place FROM ext")
def _(t):
    order = Window.partitionBy("request_id").orderBy(F.asc_nulls_last(F.array_min("evidence_turn_indexes")), F.asc_nulls_last("client_ref"), "extract_id")
    return ext(t).select("request_id", "extract_id", F.row_number().over(order).alias("place"))


# ---------------------------------------------------------------- gates and totals


@add("a15_hard_totals", _RANKED + """, bad AS (SELECT DISTINCT query_id, memory_id FROM (SELECT query_id, unnest(forbidden_ids) AS memory_id FROM qry) WHERE memory_id <> '')
SELECT count(b.memory_id) AS forbidden_hits, count(*) - count(DISTINCT (r.query_id, r.memory_id)) AS duplicate_ids FROM ranking r LEFT JOIN bad b USING (query_id, memory_id)""")
def _(t):
    return metrics.hard_checks(_rankings(t), _labels(t, "forbidden_ids")).agg(F.coalesce(F.sum("forbidden_hits"), F.lit(0)).alias("forbidden_hits"), F.coalesce(F.sum("duplicate_ids"), F.lit(0)).alias("duplicate_ids"))


_GATES = [("current_head", 0.1), ("exact_id", 0.9), ("no_such_bucket", 0.0)]


@add("j14_gates", _RANKED + """, gate(bucket, least) AS (VALUES ('current_head', 0.1::DOUBLE), ('exact_id', 0.9::DOUBLE), ('no_such_bucket', 0.0::DOUBLE)),
cell AS (SELECT bucket, round(avg(recall10), 6) AS value FROM cse JOIN qry USING (query_id) GROUP BY bucket)
SELECT gate.bucket, least, value, coalesce(value + 2.220446049250313e-16 >= least, false) AS passed FROM gate LEFT JOIN cell USING (bucket)""")
def _(t):
    cells = metrics.cases(_rankings(t), _labels(t)).join(qry(t).select("query_id", "bucket"), "query_id").groupBy("bucket").agg(F.round(F.avg("recall10"), 6).alias("value"))
    gates = t.spark.createDataFrame(_GATES, "bucket string, least double")
    return metrics.gate(cells, gates, ["bucket"]).select("bucket", "least", "value", "passed")


@add("f12_relative_gain", f"""WITH m AS (SELECT * FROM {_mode_sql('legacy')} UNION ALL SELECT * FROM {_mode_sql('cjk_bigram')}),
p AS (SELECT max(recall10) FILTER (mode = 'legacy') AS b, max(recall10) FILTER (mode = 'cjk_bigram') AS v FROM m WHERE bucket IS NULL)
SELECT round(CASE WHEN b <> 0 THEN (v - b) / b WHEN v > 0 THEN 'inf'::DOUBLE ELSE 0 END, 6) AS gain FROM p""")
def _(t):
    values = []
    for name, tokenizer in (("b", text.tokenize_runs), ("v", text.tokenize)):
        scored = _mode_cases(t, tokenizer).join(qry(t).filter("bucket <> 'filter'").select("query_id"), "query_id", "left_semi")
        values.append(scored.agg(F.round(F.avg("recall10"), 6).alias(name)).withColumn("k", F.lit(1)))
    return values[0].join(values[1], "k").select(F.round(metrics.relative_gain(F.col("b"), F.col("v")), 6).alias("gain"))


@add("j1_get", _W + """SELECT memory_id, content FROM rec WHERE scope = '["tenant-alder","user-00hub","agent-concierge"]' AND memory_id = (SELECT min(memory_id) FROM rec WHERE scope = '["tenant-alder","user-00hub","agent-concierge"]')""")
def _(t):
    owner = listing.same_owner("tenant-alder", "user-00hub", "agent-concierge")
    first = rec(t).filter(owner).agg(F.min("memory_id").alias("memory_id"))
    return rec(t).filter(owner).select("memory_id", "content").join(first, "memory_id")
