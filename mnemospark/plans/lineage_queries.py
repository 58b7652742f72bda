"""Queries of the general data problems: orphan references and hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators.hierarchy import descendants, hierarchy, successor_links
from mnemospark.operators.orphans import orphan_references, orphan_report
from mnemospark.registry import Registry

registry = Registry()

_ORPHANS = """
WITH parent AS (
  SELECT memory_id, min(ingested_at) AS first_seen, bool_or(status = 'deleted') AS dead FROM memory_record GROUP BY 1),
ref AS (
  SELECT 'memory_record' AS ref_table, memory_id AS ref_id, 'source_memory_ids' AS ref_field, unnest(source_memory_ids) AS target_id, ingested_at FROM memory_record
  UNION ALL SELECT 'memory_record', memory_id, 'supersedes', unnest(supersedes), ingested_at FROM memory_record
  UNION ALL SELECT 'query_fixture', query_id, 'relevant_ids', unnest(relevant_ids), ingested_at FROM query_fixture
  UNION ALL SELECT 'memory_job', job_id, 'raw_memory_id', raw_memory_id, ingested_at FROM memory_job),
one AS (
  SELECT ref_table, ref_id, ref_field, target_id, min(ingested_at) AS seen FROM ref
  WHERE target_id IS NOT NULL AND target_id <> '' AND ref_id IS NOT NULL GROUP BY 1, 2, 3, 4),
found AS (
  SELECT ref_table, ref_id, ref_field, target_id,
    CASE WHEN p.memory_id IS NULL THEN 'missing' WHEN p.dead THEN 'deleted' WHEN p.first_seen > one.seen THEN 'late' END AS reason,
    strftime(one.seen, '%Y-%m') AS period
  FROM one LEFT JOIN parent p ON p.memory_id = one.target_id)
"""

_LINKS = """
WITH RECURSIVE ids AS (SELECT DISTINCT memory_id FROM memory_record),
edge AS (
  SELECT unnest(supersedes) AS child, memory_id AS parent FROM memory_record
  UNION ALL SELECT memory_id, unnest(superseded_by) FROM memory_record),
link AS (
  SELECT child, min(parent) AS parent FROM edge
  WHERE child <> '' AND parent <> '' AND child IN (SELECT memory_id FROM ids) AND parent IN (SELECT memory_id FROM ids) GROUP BY child),
reach AS (
  SELECT child AS start, parent AS node FROM link
  UNION SELECT r.start, l.parent FROM reach r JOIN link l ON l.child = r.node),
node AS (SELECT child AS n FROM link UNION SELECT parent FROM link),
top AS (SELECT start, node FROM reach WHERE node NOT IN (SELECT child FROM link)),
ring AS (SELECT start FROM reach WHERE start = node),
ring_of AS (SELECT start, min(node) AS least FROM reach WHERE node IN (SELECT start FROM ring) GROUP BY start),
steps AS (SELECT start, count(*) AS k FROM reach GROUP BY start),
tree AS (
  SELECT n AS memory_id, coalesce(top.node, ring_of.least, n) AS root_id,
    CAST(CASE WHEN top.node IS NOT NULL THEN steps.k WHEN ring_of.least IS NOT NULL THEN -1 ELSE 0 END AS BIGINT) AS depth
  FROM node LEFT JOIN top ON top.start = n LEFT JOIN ring_of ON ring_of.start = n LEFT JOIN steps ON steps.start = n)
"""


@registry.add("p2_found", _ORPHANS + "SELECT * FROM found WHERE reason IS NOT NULL")
def p2_found(t):
    return orphan_references({n: t[n] for n in ("memory_record", "query_fixture", "memory_job")})


@registry.add(
    "p2_report",
    _ORPHANS + "SELECT ref_table, ref_field, period, reason, count(*) AS n_references FROM found WHERE reason IS NOT NULL GROUP BY ALL",
)
def p2_report(t):
    return orphan_report({n: t[n] for n in ("memory_record", "query_fixture", "memory_job")})


@registry.add("p3_found", _LINKS + "SELECT memory_id, root_id, depth FROM tree")
def p3_found(t):
    return hierarchy(successor_links(t.memory_record)).select(F.col("node").alias("memory_id"), F.col("root").alias("root_id"), "depth")


@registry.add(
    "p3_paths",
    _LINKS
    + """, ordered AS (
  SELECT r.start, r.node, t.depth FROM reach r JOIN tree t ON t.memory_id = r.node WHERE r.start IN (SELECT start FROM top))
SELECT t.memory_id, t.root_id, t.depth,
  CASE WHEN t.depth >= 0 THEN t.memory_id || coalesce('/' || (SELECT string_agg(o.node, '/' ORDER BY o.depth DESC) FROM ordered o WHERE o.start = t.memory_id), '') END AS path
FROM tree t""",
)
def p3_paths(t):
    rows = hierarchy(successor_links(t.memory_record), with_paths=True)
    return rows.select(F.col("node").alias("memory_id"), F.col("root").alias("root_id"), "depth", F.array_join("path", "/").alias("path"))


@registry.add(
    "p3_descendants",
    _LINKS
    + """SELECT r.node AS ancestor, r.start AS descendant, s.depth - a.depth AS steps FROM reach r
JOIN tree s ON s.memory_id = r.start JOIN tree a ON a.memory_id = r.node WHERE s.depth > 0""",
)
def p3_descendants(t):
    return descendants(successor_links(t.memory_record))
