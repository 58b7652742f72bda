"""The engine's facade over one record table: search, list, get, page, forget, import, export, health."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators import evolution, graph_checks, listing, retrieval
from mnemospark.plans.staging import Staging
from mnemospark.sources.store import JOB_SCHEMA, SnapshotStore, import_faults, import_records


class InvalidInput(ValueError):
    """An argument that no plan can be made of."""


def non_empty(value: str, name: str, most: int = 50_000) -> str:
    if not isinstance(value, str) or not value.strip():
        raise InvalidInput(f"{name} must be a non-empty string")
    if len(value) > most:
        raise InvalidInput(f"{name} exceeds {most} characters")
    return value


def positive(value: int, name: str, least: int = 1, most: int = 2**53 - 1) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not least <= value <= most:
        raise InvalidInput(f"{name} must be an integer of {least} to {most}")
    return value


def utc(value: str, name: str) -> Column:
    """A timestamp literal of an ISO date or a date and time, in UTC where it ends in Z or names no zone."""
    if not re.fullmatch(r"\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d{1,6})?)?Z?)?", value if isinstance(value, str) else ""):
        raise InvalidInput(f"{name} must be an ISO date or UTC time")
    try:
        datetime.datetime.fromisoformat(value.removesuffix("Z"))
    except ValueError as error:
        raise InvalidInput(f"{name} is no date: {value}") from error
    return F.lit(value.removesuffix("Z") + ("" if len(value) == 10 else "+00:00")).cast("timestamp")


@dataclass(frozen=True)
class Scope:
    user_id: str
    agent_id: str = "default"
    tenant_id: str | None = None
    session_id: str | None = None

    def __post_init__(self) -> None:
        non_empty(self.user_id, "user_id")
        non_empty(self.agent_id, "agent_id")

    @property
    def owner(self):
        return listing.same_owner(self.tenant_id, self.user_id, self.agent_id)


class Memory:
    """Queries and transitions over the snapshots of a :class:`SnapshotStore`; every commit is checked against the state's invariants."""

    def __init__(self, spark: SparkSession, path: str, config: retrieval.SearchConfig = retrieval.SearchConfig(), lock=None):
        self.spark, self.store, self.config = spark, SnapshotStore(spark, path, lock), config

    @property
    def records(self) -> DataFrame:
        return self.store.read()

    def search(self, query: str, scope: Scope, as_of: str, session_only: bool = False, layers: list[str] | None = None, space: retrieval.Space | None = None) -> DataFrame:
        """Hits of one query, with the safe fields of their records; ``space`` searches trained vectors, its query is ``q``."""
        non_empty(query, "query")
        rows = [("q", scope.tenant_id, scope.user_id, scope.agent_id, scope.session_id, session_only, query)]
        asked = self.spark.createDataFrame(rows, "query_id string, tenant_id string, user_id string, agent_id string, session_id string, session_only boolean, query_text string")
        mine = self.records.filter(scope.owner)
        hits = retrieval.search(mine, asked, utc(as_of, "as_of"), self.config, layers, space=space)
        return hits.join(mine.select(*listing.SAFE_FIELDS), "memory_id").orderBy("channel", "fused_rank")

    def get(self, memory_id: str, scope: Scope) -> DataFrame:
        return listing.get(self.records, non_empty(memory_id, "memory_id"), scope.owner)

    def inspect(self, memory_id: str, scope: Scope) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(record, evidence, history) of one record, safe fields only."""
        mine = self.records.filter(scope.owner)
        one = mine.filter(F.col("memory_id") == non_empty(memory_id, "memory_id"))
        return one.select(*listing.SAFE_FIELDS), listing.evidence(mine).filter(F.col("memory_id") == memory_id), listing.history(mine, retrieval.relatives(mine, one).select("memory_id", "relative_id"))

    def list(self, scope: Scope, limit: int = 8, **filters) -> DataFrame:
        return listing.listed(self.records.filter(scope.owner), positive(limit, "limit"), **filters).select(*listing.SAFE_FIELDS, "place")

    def page(self, scope: Scope, offset: int = 0, size: int = 25, needle: str | None = None) -> tuple[DataFrame, int]:
        rows = self.records.filter(scope.owner)
        rows = listing.matching(rows, needle) if needle else rows
        return listing.page(rows.select(*listing.SAFE_FIELDS), positive(offset, "offset", 0), positive(size, "size", most=100)), rows.count()

    def _commit(self, at: int, **tables: DataFrame) -> int:
        return self.store.commit(at, lambda records, jobs, vectors: graph_checks.all_violations(records), **tables)

    def _two_phase(self, write: evolution.Write, at: int) -> DataFrame:
        """Commit the raw records and accepted jobs, then what was derived; returns the receipts."""
        receipts = Staging(self.spark, "receipts").cut(write.receipts)
        if receipts.filter("NOT replayed AND status IN ('completed', 'degraded')").isEmpty():
            return receipts
        held, jobs = self.store.read(at), self.store.read(at, "jobs")
        done = Staging(self.spark, "write")
        completed, made = done.cut(write.completed), done.cut(write.jobs)
        full = lambda rows: rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in JOB_SCHEMA.fields])
        fresh = made.withColumn("status", F.lit("accepted")).withColumn("created_memory_ids", F.array().cast("array<string>"))
        at = self._commit(at, records=held.unionByName(write.accepted.select(*held.columns)), jobs=jobs.unionByName(full(fresh)))
        self._commit(at, records=evolution.replaced(self.store.read(at), completed), jobs=jobs.unionByName(full(made)))
        return receipts

    def add(self, requests: DataFrame, as_of: str) -> DataFrame:
        """Write a batch of requests (see ``evolution.add_direct``): raw records first; returns the receipts."""
        at = self.store.revision()
        return self._two_phase(evolution.add_direct(self.store.read(at, "jobs"), requests, utc(as_of, "as_of")), at)

    def extract(self, requests: DataFrame, sources: DataFrame, operations: DataFrame, profile_fields: list[str], as_of: str) -> DataFrame:
        """Write a batch of requests with their extractions and plans (see ``evolution.add_extract``); returns the receipts."""
        at = self.store.revision()
        return self._two_phase(evolution.add_extract(self.store.read(at), self.store.read(at, "jobs"), requests, sources, operations, profile_fields, utc(as_of, "as_of")), at)

    def revise(self, requests: DataFrame, as_of: str) -> DataFrame:
        """Confirm or correct records (see ``evolution.revise``); returns the receipts."""
        at = self.store.revision()
        return self._two_phase(evolution.revise(self.store.read(at), self.store.read(at, "jobs"), requests, utc(as_of, "as_of")), at)

    def forget(self, memory_id: str, scope: Scope, as_of: str, expected_revision: int | None = None) -> DataFrame:
        """Soft-delete a record of the scope and commit; returns the changed rows."""
        at = self.store.revision() if expected_revision is None else expected_revision
        held = self.store.read(at)
        mine = held.filter(scope.owner)
        changed = evolution.forget(mine, mine.filter(F.col("memory_id") == memory_id).select("memory_id"), utc(as_of, "as_of"))
        fresh = changed.select("memory_id", *[F.col(c).alias(f"new_{c}") for c in ("status", "visibility", "source_memory_ids", "updated_at")])
        joined = held.join(fresh, "memory_id", "left")
        pick = lambda c: F.when(F.col("new_status").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
        self._commit(at, records=joined.select(*[pick(c) if c in ("status", "visibility", "source_memory_ids", "updated_at") else F.col(c) for c in held.columns]))
        return changed

    def import_records(self, incoming: DataFrame, scope: Scope | None = None, embeddings: DataFrame | None = None, space: tuple[str, int] | None = None) -> int:
        """All or nothing; the revision stays where nothing is new.  Reserved layers are refused, as are foreign owners where
        a scope is given and vectors that don't fit ``space``."""
        at = self.store.revision()
        held = self.store.read(at)
        faults = import_faults(incoming, scope.owner if scope else None, graph_checks.WRITABLE, embeddings, space)
        after = import_records(held, incoming, faults=faults)
        if incoming.join(held, "memory_id", "left_anti").isEmpty():
            return at
        vectors = {}
        if embeddings is not None:
            old = self.store.read(at, "embeddings")
            vectors["embeddings"] = old.unionByName(embeddings.select(*old.columns).join(old.select("memory_id", "space_id"), ["memory_id", "space_id"], "left_anti"))
        return self._commit(at, records=after, **vectors)

    def export(self, scope: Scope) -> DataFrame:
        """Records of the owner with their vectors, array<struct<space_id, dimensions, vector>>."""
        vectors = self.store.read(table="embeddings").groupBy("memory_id").agg(F.sort_array(F.collect_list(F.struct("space_id", "dimensions", "vector"))).alias("embeddings"))
        return self.records.filter(scope.owner).join(vectors, "memory_id", "left")

    def health(self) -> DataFrame:
        return self.records.agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct(retrieval.scope_key()).alias("n_scopes"))

    def violations(self) -> DataFrame:
        return graph_checks.all_violations(self.records)
