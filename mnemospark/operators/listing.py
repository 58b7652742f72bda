"""Listing, paging, lookup and summary of records and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.operators.retrieval import scope_key

#: The columns that may leave the engine: no vectors, meta or owner.
SAFE_FIELDS = ["memory_id", "layer", "content", "status", "visibility", "source_type", "confidence", "occurred_at", "valid_from", "valid_until", "created_at", "updated_at", "chain_id", "revision", "tags"]


def same_owner(tenant: str | None, user: str, agent: str) -> Column:
    """Rows of one owner, null-safe in the tenant; the session is no part of the owner."""
    return F.col("tenant_id").eqNullSafe(F.lit(tenant)) & (F.col("user_id") == user) & (F.col("agent_id") == agent)


def get(records: DataFrame, memory_id: str, owner: Column) -> DataFrame:
    return records.filter((F.col("memory_id") == memory_id) & owner)


def listed(records: DataFrame, limit: int | None, layers: list[str] | None = None, statuses: list[str] | None = None, session: str | None = None) -> DataFrame:
    """Newest first within each owner, at most ``limit`` rows of each; ties by id."""
    rows = records
    if layers is not None:
        rows = rows.filter(F.col("layer").isin(layers))
    if statuses is not None:
        rows = rows.filter(F.col("status").isin(statuses))
    if session is not None:
        rows = rows.filter(F.col("source_session_id") == session)
    place = F.row_number().over(Window.partitionBy(scope_key()).orderBy(F.desc_nulls_last("updated_at"), "memory_id"))
    rows = rows.withColumn("place", place)
    return rows if limit is None else rows.filter(F.col("place") <= limit)


def matching(records: DataFrame, needle: str) -> DataFrame:
    """Rows whose content or tags hold the needle, whatever the case."""
    hay = F.lower(F.concat(F.coalesce("content", F.lit("")), F.lit("\n"), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")))
    return records.filter(F.contains(hay, F.lit(needle.lower())))


def page(records: DataFrame, offset: int, size: int) -> DataFrame:
    """One page of all rows: updated_at newest first, then id."""
    return records.orderBy(F.desc_nulls_last("updated_at"), "memory_id").offset(offset).limit(size)


def history(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(memory_id, relative_id)`` without itself, revision and update newest first."""
    other = records.select(F.col("memory_id").alias("relative_id"), "revision", "updated_at")
    order = Window.partitionBy("memory_id").orderBy(F.desc("revision"), F.desc_nulls_last("updated_at"), "relative_id")
    return pairs.filter("memory_id <> relative_id").join(other, "relative_id").withColumn("place", F.row_number().over(order)).select("memory_id", "relative_id", "revision", "place")


def evidence(records: DataFrame) -> DataFrame:
    """(memory_id, source_id, source_status): existing evidence of each record."""
    links = records.select("memory_id", F.explode("source_memory_ids").alias("source_id")).filter("source_id <> ''").distinct()
    return links.join(records.select(F.col("memory_id").alias("source_id"), F.col("status").alias("source_status")), "source_id").select("memory_id", "source_id", "source_status")


def tags(records: DataFrame) -> DataFrame:
    """(scope, tags): each owner's distinct tags as stored, in order; null ones are none."""
    held = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull())
    return records.groupBy(scope_key().alias("scope")).agg(F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set(held)))), ",").alias("tags"))


def summary(records: DataFrame, as_of: Column) -> DataFrame:
    """(scope, status, layer, n, n_recallable): counts with what is recallable now."""
    from mnemospark.operators.retrieval import valid_at

    now = (F.col("status") == "active") & (F.col("visibility") == "recallable") & valid_at(as_of)
    return records.groupBy(scope_key().alias("scope"), "status", "layer").agg(F.count(F.lit(1)).alias("n"), F.count_if(now).alias("n_recallable"))


def last_jobs(jobs: DataFrame, most: int = 30) -> DataFrame:
    """Each owner's last jobs, newest first."""
    order = Window.partitionBy(scope_key()).orderBy(F.desc("started_at"), "job_id")
    return jobs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def recent_events(events: DataFrame, key: str, at: str, tie: str, ring: int = 200, most: int = 20) -> DataFrame:
    """The last ``most`` events of each key within the last ``ring`` events of all."""
    kept = events.orderBy(F.desc(at), F.desc(tie)).limit(ring)
    order = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return kept.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def turn_slice(turns: DataFrame, key: str, seq: str, start: Column, end: Column) -> DataFrame:
    """Rows after the last start of each key and before the first end that follows it; keys without a start give none."""
    begun = turns.filter(start).groupBy(key).agg(F.max(seq).alias("first_seq"))
    rows = turns.join(begun, key).filter(F.col(seq) > F.col("first_seq"))
    ended = rows.filter(end).groupBy(key).agg(F.min(seq).alias("last_seq"))
    return rows.join(ended, key, "left").filter(F.col("last_seq").isNull() | (F.col(seq) < F.col("last_seq"))).drop("first_seq", "last_seq")


def spoken(messages: DataFrame, kind: str = "source_kind", plugin: str = "source_plugin", own: str = "memory") -> DataFrame:
    """Messages that are neither a tool's nor this engine's own recall."""
    mine = (F.col(kind) == "plugin") & (F.col(plugin) == own)
    return messages.filter(~F.coalesce((F.col(kind) == "tool") | mine, F.lit(False)))


def duration_ms() -> Column:
    """finished_at - started_at in milliseconds, never below 0."""
    return F.greatest(F.lit(0), F.unix_millis("finished_at") - F.unix_millis("started_at")).cast("long")
