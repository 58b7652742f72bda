"""Evaluation sets in JSON: strict reading, groups expanded to records, records and queries as search tables.

A record's id is prefixed with its place in the file, since results tie in that order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators import metrics, retrieval
from mnemospark.sources.store import read_json_strict

_OWNER = "struct<tenantId: string, userId: string, agentId: string>"
_ITEM = "struct<id: string, content: string>"

# The fields of the two sets, and the names of the distractor lists.
DISTRACTORS = ["continuous_cjk", "punctuation_boundary", "short_term"]
_LISTS = f"struct<{', '.join(f'{d}: array<string>' for d in DISTRACTORS)}>"
LEXICAL = (
    f"evaluationTime string, groups array<struct<id: string, owner: {_OWNER}, sourceSessionId: string, records: array<{_ITEM}>, sharedInterference: array<{_ITEM}>, distractorCodes: {_LISTS}, distractorIds: {_LISTS}, "
    "queries: array<struct<id: string, bucket: string, split: string, query: string, relevantIds: array<string>>>>>, "
    f"filterRecords array<struct<id: string, owner: {_OWNER}, sourceSessionId: string, content: string, status: string, visibility: string, validUntil: string>>, "
    f"filterQueries array<struct<id: string, owner: {_OWNER}, sessionId: string, sessionOnly: boolean, query: string, forbiddenIds: array<string>>>"
)
EMBEDDING = (
    f"evaluationTime string, records array<struct<id: string, language: string, owner: {_OWNER}, sourceSessionId: string, content: string, tags: array<string>, status: string, visibility: string, createdAt: string>>, "
    f"queries array<struct<id: string, language: string, bucket: string, split: string, owner: {_OWNER}, sessionId: string, query: string, relevantIds: array<string>, forbiddenIds: array<string>>>"
)


@dataclass(frozen=True)
class EvaluationSet:
    """``records`` and ``queries`` as ``retrieval.search`` takes them; labels(query_id, memory_id); the time of evaluation."""

    records: DataFrame
    queries: DataFrame
    relevant: DataFrame
    forbidden: DataFrame
    as_of: Column


def _made(items: DataFrame, queries: DataFrame, as_of: Column) -> EvaluationSet:
    """``items(place, item)`` and ``queries(q)`` to tables."""
    keyed = items.select(F.concat(F.lpad(F.col("place").cast("string"), 6, "0"), F.lit("-"), F.col("item.id")).alias("memory_id"), "item.*")
    records = keyed.select(
        "memory_id", F.col("owner.tenantId").alias("tenant_id"), F.col("owner.userId").alias("user_id"), F.col("owner.agentId").alias("agent_id"), F.lit("l2_fact").alias("layer"), "content", "status", "visibility", F.col("sourceSessionId").alias("source_session_id"),
        F.lit(None).cast("timestamp").alias("valid_from"), F.col("validUntil").cast("timestamp").alias("valid_until"), F.coalesce(F.col("createdAt").cast("timestamp"), as_of).alias("updated_at"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )
    asked = queries.select(
        F.col("q.id").alias("query_id"), F.col("q.owner.tenantId").alias("tenant_id"), F.col("q.owner.userId").alias("user_id"), F.col("q.owner.agentId").alias("agent_id"), F.col("q.sessionId").alias("session_id"), F.coalesce("q.sessionOnly", F.lit(False)).alias("session_only"),
        F.col("q.query").alias("query_text"), F.col("q.bucket").alias("bucket"), F.col("q.language").alias("language"),
    )
    names = keyed.select("id", "memory_id")
    label = lambda field: queries.select(F.col("q.id").alias("query_id"), F.explode(f"q.{field}").alias("id")).distinct().join(names, "id").select("query_id", "memory_id")
    return EvaluationSet(records, asked, label("relevantIds"), label("forbiddenIds"), as_of)


def _struct(item: str, **given: Column) -> Column:
    """One shape for the records of both sets."""
    fields = {"id": "string", "owner": _OWNER, "sourceSessionId": "string", "content": "string", "status": "string", "visibility": "string", "validUntil": "string", "createdAt": "string", "tags": "array<string>"}
    return F.struct(*[given.get(f, F.lit(None)).cast(k).alias(f) for f, k in fields.items()]).alias(item)


def lexical_set(spark: SparkSession, path: str) -> EvaluationSet:
    """Groups of records, shared interference and coded distractors (identifiers and codes zipped by place), and the filter cases."""
    root = read_json_strict(spark, path, LEXICAL)
    group = root.select(F.posexplode("groups").alias("g", "group"))
    zipped = [F.transform(F.arrays_zip(F.col(f"group.distractorIds.{d}").alias("id"), F.col(f"group.distractorCodes.{d}").alias("content")), lambda x: F.struct(x["id"].alias("id"), x["content"].alias("content"))) for d in DISTRACTORS]
    rows = group.select("g", "group.owner", "group.sourceSessionId", F.posexplode(F.concat(F.col("group.records"), F.col("group.sharedInterference"), *zipped)).alias("p", "r"))
    inside = rows.select((F.col("g") * 1000 + F.col("p")).alias("place"), _struct("item", id=F.col("r.id"), content=F.col("r.content"), owner=F.col("owner"), sourceSessionId=F.col("sourceSessionId"), status=F.lit("active"), visibility=F.lit("recallable")))
    extra = root.select(F.posexplode("filterRecords").alias("p", "r")).select((F.col("p") + 900_000).alias("place"), _struct("item", **{f: F.col(f"r.{f}") for f in ("id", "owner", "sourceSessionId", "content", "status", "visibility", "validUntil")}))
    shape = lambda **c: F.struct(*[c.get(f, F.lit(None)).cast(k).alias(f) for f, k in {"id": "string", "bucket": "string", "language": "string", "owner": _OWNER, "sessionId": "string", "sessionOnly": "boolean", "query": "string", "relevantIds": "array<string>", "forbiddenIds": "array<string>"}.items()]).alias("q")
    asked = group.select("group.owner", F.explode("group.queries").alias("x")).select(shape(owner=F.col("owner"), **{f: F.col(f"x.{f}") for f in ("id", "bucket", "query", "relevantIds")}))
    filters = root.select(F.explode("filterQueries").alias("x")).select(shape(bucket=F.lit("filter"), **{f: F.col(f"x.{f}") for f in ("id", "owner", "sessionId", "sessionOnly", "query", "forbiddenIds")}))
    as_of = F.lit(root.select("evaluationTime").first()[0]).cast("timestamp")
    return _made(inside.unionByName(extra), asked.unionByName(filters), as_of)


def embedding_set(spark: SparkSession, path: str) -> EvaluationSet:
    """Records and queries of the synonym and exact buckets."""
    root = read_json_strict(spark, path, EMBEDDING)
    items = root.select(F.posexplode("records").alias("place", "r")).select("place", _struct("item", **{f: F.col(f"r.{f}") for f in ("id", "owner", "sourceSessionId", "content", "status", "visibility", "createdAt", "tags")}))
    asked = root.select(F.explode("queries").alias("x")).select(F.struct("x.id", "x.bucket", "x.language", "x.owner", "x.sessionId", F.lit(False).alias("sessionOnly"), "x.query", "x.relevantIds", "x.forbiddenIds").alias("q"))
    return _made(items, asked, F.lit(root.select("evaluationTime").first()[0]).cast("timestamp"))


def ranked(data: EvaluationSet, tokenizer, most: int = 10) -> DataFrame:
    """(query_id, rank, memory_id) of a set's queries."""
    hits = retrieval.search(data.records, data.queries, data.as_of, retrieval.SearchConfig(recall_limit=most), tokenizer=tokenizer)
    return hits.filter("channel = 'normal'").select("query_id", F.col("fused_rank").alias("rank"), "memory_id")


def scored(data: EvaluationSet, tokenizer) -> DataFrame:
    """The evaluators' cases of a set's labelled queries."""
    return metrics.cases(ranked(data, tokenizer), data.relevant)
