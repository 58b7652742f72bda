"""Queries of the training-data problems on text and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.llm import mixing, near_duplicates, neighbours, packing, personal_information, survivorship, unify
from mnemospark.registry import Registry

registry = Registry()

_GROUPS = """
WITH RECURSIVE ids AS (SELECT DISTINCT memory_id FROM memory_record),
link AS (
  SELECT memory_id AS a, unnest(consolidates) AS b FROM memory_record),
ok AS (SELECT DISTINCT a, b FROM link WHERE a <> b AND b IN (SELECT memory_id FROM ids)),
both_ways AS (SELECT a, b FROM ok UNION SELECT b, a FROM ok),
reach AS (SELECT a AS start, b AS node FROM both_ways UNION SELECT r.start, w.b FROM reach r JOIN both_ways w ON w.a = r.node),
member AS (SELECT start AS memory_id, min(node) AS group_id FROM reach GROUP BY start),
rec AS (
  SELECT DISTINCT group_id, memory_id, status, content, occurred_at, source_session_id, valid_until, updated_at,
    CASE lower(trim(source_type)) WHEN 'explicit' THEN 0 WHEN 'composite' THEN 1 WHEN 'inferred' THEN 2 ELSE 3 END AS trust,
    CASE WHEN confidence BETWEEN 0 AND 1 AND NOT isnan(confidence) THEN confidence END AS sure
  FROM memory_record JOIN member USING (memory_id) WHERE status IS DISTINCT FROM 'deleted'),
slot AS (
  SELECT group_id, memory_id, trust, sure, updated_at, 'content' AS field_name, content AS value FROM rec
  UNION ALL SELECT group_id, memory_id, trust, sure, updated_at, 'occurred_at', strftime(occurred_at, '%Y') FROM rec
  UNION ALL SELECT group_id, memory_id, trust, sure, updated_at, 'source_session_id', source_session_id FROM rec
  UNION ALL SELECT group_id, memory_id, trust, sure, updated_at, 'valid_until', strftime(valid_until, '%Y') FROM rec),
won AS (
  SELECT group_id, field_name, memory_id AS from_id, value FROM slot WHERE value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY group_id, field_name ORDER BY trust, sure DESC NULLS LAST, updated_at DESC NULLS LAST, memory_id) = 1)
"""


@registry.add("p5_found", _GROUPS + "SELECT group_id, field_name, from_id FROM won")
def p5_found(t):
    return survivorship.field_survivors(t.memory_record)


_WON = ", ".join(f"max(value) FILTER (field_name = '{f}') AS {f}, max(from_id) FILTER (field_name = '{f}') AS {f}_from" for f in survivorship.FIELDS)


@registry.add("p5_survivors", _GROUPS.replace("strftime(occurred_at, '%Y')", "epoch_us(occurred_at)::VARCHAR").replace("strftime(valid_until, '%Y')", "epoch_us(valid_until)::VARCHAR") + f"SELECT group_id, {_WON} FROM won GROUP BY group_id")
def p5_survivors(t):
    rows = survivorship.surviving_records(t.memory_record)
    return rows.select("group_id", *[c for f in survivorship.FIELDS for c in ((F.unix_micros(f).cast("string").alias(f) if f in ("occurred_at", "valid_until") else F.col(f)), F.col(f"{f}_from"))])


_NEAR = r"""
WITH raw AS (
  SELECT memory_id AS row_id, content FROM memory_record UNION ALL SELECT extract_id, content FROM extracted_memory),
one AS (SELECT DISTINCT row_id, content FROM raw WHERE content IS NOT NULL AND row_id IS NOT NULL),
word AS (
  SELECT DISTINCT row_id, unnest(regexp_extract_all(regexp_replace(lower(content), '([㐀-鿿])', ' \1 ', 'g'), '[\p{L}\p{N}]+')) AS w FROM one),
size AS (SELECT row_id, count(*) AS n FROM word GROUP BY 1),
common AS (
  SELECT a.row_id AS x, b.row_id AS y, count(*) AS k FROM word a JOIN word b ON a.w = b.w AND a.row_id < b.row_id GROUP BY 1, 2),
pair AS (
  SELECT x AS row_id_a, y AS row_id_b FROM common JOIN size s ON s.row_id = x JOIN size t ON t.row_id = y WHERE k >= 0.6 * (s.n + t.n - k))
"""


def _contents(t):
    return t.memory_record.select(F.col("memory_id").alias("row_id"), "content").unionByName(t.extracted_memory.select(F.col("extract_id").alias("row_id"), "content"))


@registry.add("p1_found", _NEAR + "SELECT row_id_a, row_id_b FROM pair")
def p1_found(t):
    return near_duplicates.near_duplicate_pairs(_contents(t))


@registry.add(
    "p1_classes",
    _NEAR.replace("WITH raw", "WITH RECURSIVE raw")
    + """, link AS (SELECT row_id_a AS a, row_id_b AS b FROM pair UNION SELECT row_id_b, row_id_a FROM pair),
reach AS (SELECT row_id AS start, row_id AS node FROM size UNION SELECT r.start, l.b FROM reach r JOIN link l ON l.a = r.node)
SELECT start AS row_id, min(node) AS class_id, (SELECT count(*) FROM link WHERE a = start) AS n_links FROM reach GROUP BY start""",
)
def p1_classes(t):
    return near_duplicates.near_duplicate_classes(_contents(t))


@registry.add(
    "p4_found",
    """
WITH one AS (
  SELECT space_id, memory_id, CAST(vector AS DOUBLE[]) AS v FROM memory_embedding
  WHERE vector IS NOT NULL AND len(vector) = dimensions AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(vector, lambda x: x <> 0)) > 0
  QUALIFY row_number() OVER (PARTITION BY space_id, memory_id ORDER BY ingested_at) = 1),
near AS (
  SELECT a.space_id, a.memory_id AS x, b.memory_id AS y, list_cosine_similarity(a.v, b.v) AS s
  FROM one a JOIN one b ON a.space_id = b.space_id AND a.memory_id <> b.memory_id AND len(a.v) = len(b.v)
  QUALIFY row_number() OVER (PARTITION BY a.space_id, a.memory_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.memory_id) <= 10)
SELECT DISTINCT space_id, least(x, y) AS memory_id_a, greatest(x, y) AS memory_id_b FROM near WHERE s >= 0.90""",
)
def p4_found(t):
    return neighbours.similar_pairs(t.memory_embedding)


@registry.add("p4_neighbours")
def p4_neighbours(t):
    vectors = neighbours.usable_vectors(t.memory_embedding).select("space_id", F.col("memory_id").alias("key"), "vector")
    return neighbours.nearest(vectors).withColumn("similarity", F.round("similarity", 6))


@registry.add("p4_search")
def p4_search(t):
    vectors = t.embeddings.select(F.lit("embeddings").alias("space_id"), F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    asked = vectors.filter("key % 50 = 0").select(F.col("key").alias("query"), "space_id", "vector")
    return neighbours.graph_search(vectors, asked).withColumn("similarity", F.round("similarity", 6))


@registry.add("p4_search_memory")
def p4_search_memory(t):
    vectors = neighbours.usable_vectors(t.memory_embedding).select("space_id", F.col("memory_id").alias("key"), "vector")
    asked = vectors.filter(F.pmod(F.xxhash64("key"), F.lit(50)) == 0).select(F.concat_ws("/", "space_id", "key").alias("query"), "space_id", "vector")
    return neighbours.graph_search(vectors, asked).withColumn("similarity", F.round("similarity", 6))


def _bodies(t):
    return t.documents.select(F.col("doc_id").alias("key"), F.col("text").alias("body"))


_FORM = f"WITH form AS (SELECT doc_id, md5({unify.form_sql('text')}) AS digest FROM documents WHERE text IS NOT NULL)"


@registry.add("p9_found", _FORM + " SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM form a JOIN form b ON a.digest = b.digest AND a.doc_id < b.doc_id")
def p9_found(t):
    return unify.same_look_pairs(_bodies(t)).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


@registry.add("p9_classes", _FORM + " SELECT doc_id, min(doc_id) OVER (PARTITION BY digest) AS class_id, count(*) OVER (PARTITION BY digest) AS n_same FROM form")
def p9_classes(t):
    return unify.look_classes(_bodies(t)).withColumnRenamed("key", "doc_id")


@registry.add("p9_forms", f"SELECT doc_id, {unify.form_sql('text')} AS form FROM documents")
def p9_forms(t):
    return unify.consistent_forms(_bodies(t)).select(F.col("key").alias("doc_id"), "form")


@registry.add("p6_found")
def p6_found(t):
    found = personal_information.find_spans(_contents(t), t.name_lexicon)
    return found.select("row_id", "pii_type", "start_pos").distinct()


@registry.add("p6_redacted")
def p6_redacted(t):
    return personal_information.redact(_contents(t), t.name_lexicon)


def _items(t):
    return t.documents.select(F.col("doc_id").alias("item"), F.col("text").alias("body"))


@registry.add("p7_containers")
def p7_containers(t):
    return packing.fill_containers(_items(t), t.container_spec).withColumnRenamed("item", "doc_id")


@registry.add("p7_report")
def p7_report(t):
    return packing.container_report(packing.fill_containers(_items(t), t.container_spec))


def _sourced(t):
    return t.documents.select(F.col("doc_id").alias("item"), "source", F.col("text").alias("body"))


@registry.add("p8_mixture")
def p8_mixture(t):
    return mixing.mix_sources(_sourced(t), t.source_mix).withColumnRenamed("item", "doc_id")


@registry.add("p8_report")
def p8_report(t):
    return mixing.mixture_report(mixing.mix_sources(_sourced(t), t.source_mix), t.source_mix)
