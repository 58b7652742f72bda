"""Record evolution as batch transformations: writes, reconciliation, revision, deletion, recovery, plan checks.

All transitions of a batch are applied to one snapshot at once with equi-joins on record ids; new ids are
digests of their natural key, so a repeated batch gives the same rows.  ``as_of`` is always a parameter.
A write has two commits: ``accepted`` (raw records and jobs) comes first and holds whatever follows, and
``completed`` adds what was derived.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import text
from mnemospark.operators.retrieval import scope_key
from mnemospark.plans.staging import Staging
from mnemospark.sources.store import RECORD_SCHEMA

_NONE = "array<string>"
_TURNS = "array<bigint>"
OWNER = ["tenant_id", "user_id", "agent_id"]

#: The confidence of summaries and profiles, and the longest content of a record.
SUMMARY_CONFIDENCE, PROFILE_CONFIDENCE, MOST_CHARS = 0.8, 0.9, 4000


def _list(name: str) -> Column:
    return F.coalesce(name, F.array().cast(_NONE))


def _turns(name: str) -> Column:
    return F.coalesce(name, F.array().cast(_TURNS))


def stable_id(prefix: str, *parts: Column) -> Column:
    """A record id that depends on its natural key alone."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16))


def record_rows(rows: DataFrame, as_of: Column, **values: Column) -> DataFrame:
    """Whole records of ``rows``: the given values, the owner and session of the row, and the state of a new record elsewhere."""
    fresh = {
        "schema_version": F.lit(1), "status": F.lit("active"), "visibility": F.lit("recallable"), "revision": F.lit(1), "source_type": F.lit("explicit"), "confidence": F.lit(1.0),
        "created_at": as_of, "updated_at": as_of,
        **{c: F.array() for c in ("supersedes", "superseded_by", "consolidates", "source_memory_ids", "source_turn_indexes", "tags")},
        **{c: F.col(c) for c in (*OWNER, "source_session_id") if c in rows.columns},
    }
    fresh |= values
    return rows.select(*[fresh.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD_SCHEMA.fields])


def replaced(records: DataFrame, changed: DataFrame) -> DataFrame:
    """``records`` with the rows of ``changed`` (whole records) in place of those of the same id, and with its new ones."""
    return records.join(changed.select("memory_id"), "memory_id", "left_anti").select(*records.columns).unionByName(changed.select(*records.columns))


# ---------------------------------------------------------------- writes


@dataclass(frozen=True)
class Write:
    """Result of a batch of writes: new and changed whole records, jobs, and a receipt for each request.

    ``jobs(job_id, request_id, idempotency_key, raw_memory_id, tenant_id, user_id, agent_id, status, created_memory_ids)``;
    ``receipts(idempotency_key, tenant_id, user_id, agent_id, status, replayed, raw_memory_id, created_memory_ids)``.
    """

    accepted: DataFrame
    completed: DataFrame
    jobs: DataFrame
    receipts: DataFrame


_RECEIPT = ["idempotency_key", *OWNER, "status", "replayed", "raw_memory_id", "created_memory_ids"]


def split_replays(requests: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new requests with raw_id and job_id, receipts of those whose key their owner has used before).

    Of requests of one owner and key in the same batch the first by content counts.
    """
    held = jobs.select(scope_key().alias("scope"), "idempotency_key", F.col("status").alias("job_status"), F.col("raw_memory_id").alias("job_raw"), F.col("created_memory_ids").alias("job_created"), "job_id")
    first = F.row_number().over(Window.partitionBy("scope", "idempotency_key").orderBy("job_id"))
    held = held.filter("idempotency_key IS NOT NULL").withColumn("k", first).filter("k = 1").drop("k", "job_id")
    asked = requests.withColumn("scope", scope_key())
    once = F.row_number().over(Window.partitionBy("scope", "idempotency_key").orderBy(F.asc_nulls_last("content")))
    joined = asked.withColumn("k", once).filter("k = 1").drop("k").join(held, ["scope", "idempotency_key"], "left")
    status = F.when(F.col("job_status") == "completed", "completed").otherwise("degraded")
    replayed = joined.filter("job_status IS NOT NULL").select("idempotency_key", *OWNER, status.alias("status"), F.lit(True).alias("replayed"), F.col("job_raw").alias("raw_memory_id"), _list("job_created").alias("created_memory_ids"))
    new = joined.filter("job_status IS NULL").drop("job_status", "job_raw", "job_created")
    return new.withColumn("raw_id", stable_id("mem-", F.lit("raw"), "scope", "idempotency_key")).withColumn("job_id", stable_id("job-", "scope", "idempotency_key")), replayed


def _finished(new: DataFrame, replayed: DataFrame, created: DataFrame, accepted: DataFrame, completed: DataFrame) -> Write:
    """``created(raw_id, created_memory_ids)``; requests without a row there came to nothing and are complete all the same."""
    met = new.join(created, "raw_id", "left").withColumn("created_memory_ids", _list("created_memory_ids"))
    job = met.select("job_id", F.concat(F.lit("req-"), F.substring("job_id", 5, 16)).alias("request_id"), "idempotency_key", F.col("raw_id").alias("raw_memory_id"), *OWNER, F.lit("completed").alias("status"), "created_memory_ids")
    receipt = met.select("idempotency_key", *OWNER, F.lit("completed").alias("status"), F.lit(False).alias("replayed"), F.col("raw_id").alias("raw_memory_id"), "created_memory_ids")
    return Write(accepted, completed, job, receipt.select(*_RECEIPT).unionByName(replayed.select(*_RECEIPT)))


def _raw_records(new: DataFrame, as_of: Column, **values: Column) -> DataFrame:
    return record_rows(new, as_of, memory_id=F.col("raw_id"), layer=F.lit("l1_raw"), content=F.col("content"), idempotency_key=F.col("idempotency_key"), **values)


def add_direct(jobs: DataFrame, requests: DataFrame, as_of: Column, most_chars: int = MOST_CHARS) -> Write:
    """Raw records and one derived record each of ``requests(idempotency_key, tenant_id, user_id, agent_id, source_session_id, content, layer, occurred_at, tags, turns)``.

    A key that its owner has used before changes nothing and gives the earlier receipt.  The raw record is
    recallable until the derived one stands; then it is kept as a source.
    """
    new, replayed = map(Staging(jobs.sparkSession, "requests").cut, split_replays(requests, jobs))
    carried = {"occurred_at": F.col("occurred_at"), "source_turn_indexes": _turns("turns")}
    accepted = _raw_records(new, as_of, **carried)
    made = stable_id("mem-", F.lit("direct"), "scope", "idempotency_key")
    derived = record_rows(new, as_of, memory_id=made, layer=F.col("layer"), content=text.clip(F.col("content"), most_chars), source_memory_ids=F.array("raw_id"), tags=text.normalize_tags(F.col("tags")), **carried)
    completed = accepted.withColumn("visibility", F.lit("source_only")).unionByName(derived)
    return _finished(new, replayed, new.select("raw_id", F.array(made).alias("created_memory_ids")), accepted, completed)


def sanitize_extraction(extracted: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """Extracted memories cut and trimmed, empty ones dropped; (request_id, client_ref) pairs that repeat are flagged."""
    repeats = extracted.groupBy("request_id", "client_ref").agg((F.count(F.lit(1)) > 1).alias("repeated_ref"))
    clean = extracted.withColumn("content", text.clip(F.col("content"), most_chars)).withColumn("tags", text.normalize_tags(F.col("tags")))
    clean = clean.withColumn("evidence_turn_indexes", F.array_distinct(_turns("evidence_turn_indexes"))) if "evidence_turn_indexes" in clean.columns else clean
    return clean.filter("content <> ''").join(repeats, ["request_id", "client_ref"])


# ---------------------------------------------------------------- reconciliation


def attach_evidence(records: DataFrame, plan: DataFrame, as_of: Column) -> DataFrame:
    """Records named by ``plan(target_id, raw_id, confidence, tags, turns)`` take its evidence; others are unchanged.

    Confidence becomes the greatest, evidence, turns and tags become unions in order of the raw id.
    """
    ordered = F.sort_array(F.collect_list(F.struct("raw_id", "tags", "turns")))
    grouped = plan.filter("target_id IS NOT NULL").groupBy("target_id").agg(F.max("confidence").alias("new_confidence"), ordered.alias("added"))
    joined = records.join(grouped, F.col("memory_id") == F.col("target_id"), "left")
    hit = F.col("target_id").isNotNull()
    turns = F.flatten(F.transform("added", lambda a: F.coalesce(a["turns"], F.array().cast(_TURNS))))
    tags = F.flatten(F.transform("added", lambda a: F.coalesce(a["tags"], F.array().cast(_NONE))))
    changed = {
        "confidence": F.greatest("confidence", "new_confidence"),
        "source_memory_ids": F.array_union(_list("source_memory_ids"), F.array_distinct(F.transform("added", lambda a: a["raw_id"]))),
        "source_turn_indexes": F.array_distinct(F.concat(_turns("source_turn_indexes"), turns)),
        "tags": text.normalize_tags(F.concat(_list("tags"), tags)),
        "updated_at": as_of,
    }
    return joined.select(*[F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in records.columns])


def _meta_of_one() -> Column:
    return F.when(F.col("speculate").isNotNull(), F.to_json(F.struct("speculate"))).otherwise(F.lit("{}"))


def added(plan: DataFrame, as_of: Column) -> DataFrame:
    """New records of ADD operations: explicit, or inferred where the source speculates.

    ``plan(op_id, raw_id, content, layer, confidence, tags, speculate, occurred_at, turns, owner and session columns)``.
    """
    kind = F.when(F.col("speculate").isNotNull(), "inferred").otherwise("explicit")
    return record_rows(
        plan, as_of, memory_id=stable_id("mem-", "op_id"), layer=F.col("layer"), content=F.col("content"), source_type=kind, confidence=F.col("confidence"), occurred_at=F.col("occurred_at"),
        tags=text.normalize_tags(F.col("tags")), source_memory_ids=F.array("raw_id"), source_turn_indexes=F.array_distinct(_turns("turns")), meta=_meta_of_one(),
    )


def hide_raw(records: DataFrame, used: DataFrame) -> DataFrame:
    """(memory_id, visibility): raw records whose extraction came to something are kept as sources only.

    ``used(raw_id)``: raw records with a created record or attached evidence; the others stay as they are.
    """
    hit = used.select(F.col("raw_id").alias("memory_id")).distinct().withColumn("used", F.lit(True))
    rows = records.filter("layer = 'l1_raw'").join(hit, "memory_id", "left")
    return rows.select("memory_id", F.when(F.col("used"), F.lit("source_only")).otherwise(F.col("visibility")).alias("visibility"))


def new_heads(records: DataFrame, plan: DataFrame, as_of: Column, most_chars: int = MOST_CHARS) -> tuple[DataFrame, DataFrame]:
    """(heads, targets), whole records: the new ones of SUPERSEDE and CONSOLIDATE operations, and their changed predecessors.

    ``plan(op_id, kind, raw_id, content, layer, target_ids, sources, owner and session columns)``; ``sources`` are the
    extracted memories of the operation in order, array<struct<client_ref, confidence, tags, turns, occurred_at, speculate>>.
    A head's revision is the greatest of its targets plus one; it takes the chain of the first target that has
    one, or a new one, inherits the targets' evidence in their order and the sources' tags and turns, the
    greatest confidence of its sources and the first one's time.  Targets that do not exist are left out.
    """
    state = records.select(F.col("memory_id").alias("target_id"), "revision", F.col("chain_id").alias("target_chain"), "source_memory_ids")
    linked = plan.select("op_id", F.posexplode(F.array_distinct("target_ids")).alias("place", "target_id")).join(state, "target_id")
    ordered = F.array_sort(F.collect_list(F.struct("place", "target_id", "target_chain", _list("source_memory_ids").alias("evidence"))))
    merged = linked.groupBy("op_id").agg((F.max("revision") + 1).alias("revision"), ordered.alias("met"))
    chained = F.filter("met", lambda m: m["target_chain"].isNotNull())
    head = plan.join(merged, "op_id").withColumn("targets", F.transform("met", lambda m: m["target_id"])).withColumn("head_id", stable_id("mem-", "op_id"))
    head = head.withColumn("chain", F.coalesce(F.get(F.transform(chained, lambda m: m["target_chain"]), 0), stable_id("chain-", "op_id")))
    none = F.array().cast(_NONE)
    alone = F.size("sources") == 1
    spoken = F.filter("sources", lambda s: s["speculate"].isNotNull())
    one = F.when(F.get("sources", 0)["speculate"].isNotNull(), F.to_json(F.struct(F.get("sources", 0)["speculate"].alias("speculate")))).otherwise(F.lit("{}"))
    many = F.to_json(F.struct(F.map_from_entries(F.transform(spoken, lambda s: F.struct(s["client_ref"], s["speculate"]))).alias("speculations")))
    heads = record_rows(
        head, as_of, memory_id=F.col("head_id"), layer=F.col("layer"), content=text.clip(F.col("content"), most_chars), source_type=F.lit("composite"),
        confidence=F.array_max(F.transform("sources", lambda s: s["confidence"])), occurred_at=F.get("sources", 0)["occurred_at"], chain_id=F.col("chain"), revision=F.col("revision"),
        supersedes=F.when(F.col("kind") == "SUPERSEDE", F.col("targets")).otherwise(none), consolidates=F.when(F.col("kind") == "CONSOLIDATE", F.col("targets")).otherwise(none),
        source_memory_ids=F.array_distinct(F.concat(F.array("raw_id"), F.flatten(F.transform("met", lambda m: m["evidence"])))),
        source_turn_indexes=F.array_distinct(F.flatten(F.transform("sources", lambda s: F.coalesce(s["turns"], F.array().cast(_TURNS))))),
        tags=text.normalize_tags(F.flatten(F.transform("sources", lambda s: F.coalesce(s["tags"], F.array().cast(_NONE))))),
        meta=F.when(alone, one).otherwise(many),
    )
    back = head.select(F.explode("targets").alias("target_id"), "head_id", "chain", "op_id").groupBy("target_id").agg(F.sort_array(F.collect_set("head_id")).alias("heads"), F.min_by("chain", "op_id").alias("head_chain"))
    changed = {
        "status": F.lit("superseded"), "visibility": F.lit("source_only"), "superseded_by": F.array_union(_list("superseded_by"), "heads"), "chain_id": F.coalesce("chain_id", "head_chain"), "updated_at": as_of,
    }
    met = records.join(back, F.col("memory_id") == F.col("target_id"))
    return heads, met.select(*[changed.get(c, F.col(c)).alias(c) for c in records.columns])


def summaries(raws: DataFrame, as_of: Column, most_chars: int = MOST_CHARS) -> DataFrame:
    """L3 records of ``raws(raw_id, summary, turns, owner and session columns)``; empty summaries give none."""
    rows = raws.withColumn("summary", text.clip(F.col("summary"), most_chars)).filter("summary <> ''")
    return record_rows(
        rows, as_of, memory_id=stable_id("mem-", F.lit("summary"), "raw_id"), layer=F.lit("l3_summary"), content=F.col("summary"), source_type=F.lit("composite"),
        confidence=F.lit(SUMMARY_CONFIDENCE), source_memory_ids=F.array("raw_id"), source_turn_indexes=_turns("turns"),
    )


def profiles(records: DataFrame, patches: DataFrame, allowed: list[str], as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(heads, priors), whole records: the new L0 profile of each owner in ``patches(raw_id, patch, turns, owner and session columns)``, and the ones superseded.

    Allowed fields of the patch, a map, replace those of the owner's active profile (the smallest id, were
    there several), which are kept in its ``meta`` under ``profile``; a patch without an allowed field gives
    nothing.  One patch an owner: of several the one of the smallest raw id counts.
    """
    none = F.create_map().cast("map<string,string>")
    wanted = patches.withColumn("patch", F.map_filter(F.coalesce("patch", none), lambda k, v: k.isin(allowed))).filter(F.size("patch") > 0).withColumn("scope", scope_key())
    wanted = wanted.withColumn("k", F.row_number().over(Window.partitionBy("scope").orderBy("raw_id"))).filter("k = 1").drop("k")
    active = records.filter("layer = 'l0_basic_info' AND status = 'active'").withColumn("scope", scope_key())
    active = active.withColumn("k", F.row_number().over(Window.partitionBy("scope").orderBy("memory_id"))).filter("k = 1").drop("k")
    prior = active.select("scope", F.col("memory_id").alias("prior_id"), F.col("chain_id").alias("prior_chain"), F.col("revision").alias("prior_revision"), F.col("source_memory_ids").alias("prior_evidence"), F.from_json("meta", "profile map<string,string>")["profile"].alias("old"))
    head = wanted.join(prior, "scope", "left").withColumn("profile", text.merge_profile(F.col("old"), F.col("patch"), allowed)).withColumn("head_id", stable_id("mem-", F.lit("profile"), "raw_id"))
    heads = record_rows(
        head, as_of, memory_id=F.col("head_id"), layer=F.lit("l0_basic_info"), content=text.profile_text(F.col("profile")), source_type=F.lit("composite"), confidence=F.lit(PROFILE_CONFIDENCE),
        chain_id=F.coalesce("prior_chain", stable_id("chain-", F.lit("profile"), "raw_id")), revision=F.coalesce("prior_revision", F.lit(0)) + 1,
        supersedes=F.when(F.col("prior_id").isNotNull(), F.array("prior_id")).otherwise(F.array().cast(_NONE)), source_memory_ids=F.array_union(_list("prior_evidence"), F.array("raw_id")),
        source_turn_indexes=_turns("turns"), meta=F.to_json(F.struct("profile")),
    )
    changed = {"status": F.lit("superseded"), "visibility": F.lit("source_only"), "superseded_by": F.array("head_id"), "updated_at": as_of}
    met = active.join(head.filter("prior_id IS NOT NULL").select(F.col("prior_id").alias("memory_id"), "head_id"), "memory_id")
    return heads, met.select(*[changed.get(c, F.col(c)).alias(c) for c in records.columns])


def automatic_additions(sources: DataFrame, shortlists: DataFrame) -> DataFrame:
    """(request_id, client_ref): sources whose shortlist is empty, which are added without asking a model."""
    return sources.select("request_id", "client_ref").join(shortlists.select("request_id", "client_ref").distinct(), ["request_id", "client_ref"], "left_anti")


def apply_extraction(records: DataFrame, sources: DataFrame, operations: DataFrame, raws: DataFrame, allowed: list[str], as_of: Column) -> DataFrame:
    """Whole records, new and changed, that a batch of checked reconciliation plans comes to.

    ``sources(request_id, client_ref, raw_id, content, layer, confidence, tags, turns, occurred_at, speculate)``;
    ``operations(op_id, request_id, type, source_refs, target_ids, content)`` with type ADD, NOOP, SUPERSEDE or
    CONSOLIDATE, in the order of ``source_refs``; ``raws(raw_id, summary, patch, turns, owner and session columns)``.
    ``records`` hold the raw records; those that came to something are kept as sources only.
    """
    stage = Staging(records.sparkSession, "extraction")
    owner = raws.select("raw_id", *OWNER, "source_session_id")
    named = operations.select("op_id", "request_id", "type", "target_ids", F.col("content").alias("said"), F.posexplode("source_refs").alias("place", "client_ref")).join(sources, ["request_id", "client_ref"])
    named = stage.cut(named.join(owner, "raw_id"))
    noop = named.filter("type = 'NOOP'").select(F.get("target_ids", 0).alias("target_id"), "raw_id", "confidence", "tags", "turns")
    members = F.array_sort(F.collect_list(F.struct("place", F.struct("client_ref", "confidence", "tags", "turns", "occurred_at", "speculate").alias("source"), "layer", "raw_id")))
    owned = [F.first(c).alias(c) for c in (*OWNER, "source_session_id")]
    built = named.filter("type IN ('SUPERSEDE', 'CONSOLIDATE')").groupBy("op_id", "type", "said", "target_ids").agg(members.alias("m"), *owned)
    built = stage.cut(built.select("op_id", F.col("type").alias("kind"), F.col("said").alias("content"), "target_ids", F.get("m", 0)["raw_id"].alias("raw_id"), F.get("m", 0)["layer"].alias("layer"), F.transform("m", lambda x: x["source"]).alias("sources"), *OWNER, "source_session_id"))
    # only the records that some operation names are read on
    touched = stage.cut(records.join(named.select(F.explode("target_ids").alias("memory_id")).distinct(), "memory_id", "left_semi"))
    grown = stage.cut(attach_evidence(touched, noop, as_of))
    heads, targets = map(stage.cut, new_heads(grown, built, as_of))
    profile, priors = map(stage.cut, profiles(records, raws, allowed, as_of))
    cols = records.columns
    created = stage.cut(added(named.filter("type = 'ADD'"), as_of).unionByName(heads).unionByName(summaries(raws, as_of)).unionByName(profile).select(*cols))
    changed = targets.select(*cols).unionByName(priors.select(*cols))
    taken = grown.join(noop.select(F.col("target_id").alias("memory_id")).distinct(), "memory_id", "left_semi").join(targets.select("memory_id"), "memory_id", "left_anti")
    used = created.select(F.explode("source_memory_ids").alias("raw_id")).unionByName(noop.select("raw_id")).distinct().join(raws.select("raw_id"), "raw_id", "left_semi")
    hidden = records.join(used.withColumnRenamed("raw_id", "memory_id"), "memory_id", "left_semi").select(*cols).withColumn("visibility", F.lit("source_only")).withColumn("updated_at", as_of)
    return stage.cut(created.unionByName(changed).unionByName(taken.select(*cols)).unionByName(hidden))


def add_extract(records: DataFrame, jobs: DataFrame, requests: DataFrame, sources: DataFrame, operations: DataFrame, allowed: list[str], as_of: Column) -> Write:
    """Raw records first, then what the plans of ``operations`` make of ``sources`` (see ``apply_extraction``; without raw_id).

    ``requests(request_id, idempotency_key, owner and session columns, content, occurred_at, turns, summary, patch, failure)``;
    a request with a ``failure`` code keeps its recallable raw record and a degraded job, and its plan is not applied.
    """
    new, replayed = map(Staging(jobs.sparkSession, "requests").cut, split_replays(requests, jobs))
    accepted = _raw_records(new, as_of, occurred_at=F.col("occurred_at"), source_turn_indexes=_turns("turns"))
    good = new.filter("failure IS NULL")
    raws = good.select("raw_id", "request_id", "summary", "patch", "turns", *OWNER, "source_session_id")
    mine = sources.join(raws.select("request_id", "raw_id"), "request_id")
    held = records.select(*[f.name for f in RECORD_SCHEMA.fields]).unionByName(accepted)
    changed = apply_extraction(held, mine, operations.join(raws.select("request_id"), "request_id", "left_semi"), raws, allowed, as_of)
    kept = accepted.join(changed.select("memory_id"), "memory_id", "left_anti").select(*accepted.columns)
    fresh = changed.filter("layer <> 'l1_raw'").join(records.select("memory_id"), "memory_id", "left_anti")
    made = fresh.select("memory_id", F.explode("source_memory_ids").alias("raw_id")).groupBy("raw_id").agg(F.sort_array(F.collect_set("memory_id")).alias("created_memory_ids"))
    done = _finished(new, replayed, made, accepted, changed.unionByName(kept))
    bad = new.filter("failure IS NOT NULL").select("job_id", F.lit(True).alias("failed"))
    failed = lambda df, key: df.join(bad.withColumnRenamed("job_id", key), key, "left").withColumn("status", F.when(F.col("failed"), "degraded").otherwise(F.col("status")))
    marked = done.receipts.join(done.jobs.select("job_id", F.col("raw_memory_id")), "raw_memory_id", "left")
    return Write(accepted, done.completed, failed(done.jobs, "job_id").drop("failed").select(*done.jobs.columns), failed(marked, "job_id").select(*_RECEIPT))


def revise(records: DataFrame, jobs: DataFrame, requests: DataFrame, as_of: Column, revisions: DataFrame | None = None) -> Write:
    """Confirmed or corrected records: a new raw record and a new head over each target.

    ``requests(idempotency_key, owner and session columns, target_id, action, content, expected_revision)``.  A used
    key gives the earlier receipt, whatever else the request says; then the owner's revision is compared, where
    ``revisions(tenant_id, user_id, agent_id, scope_revision)`` are given (status revision_conflict); only active
    recallable facts and identities of the owner can be revised (status invalid).
    """
    new, replayed = map(Staging(jobs.sparkSession, "requests").cut, split_replays(requests, jobs))
    target = records.select(scope_key().alias("scope"), *[F.col(c).alias(f"t_{c}") for c in ("memory_id", "layer", "content", "status", "visibility", "revision", "chain_id", "tags")])
    met = new.join(target, (new["scope"] == target["scope"]) & (F.col("target_id") == F.col("t_memory_id")), "left").drop(target["scope"])
    if revisions is not None:
        met = met.join(revisions.select(scope_key().alias("scope"), "scope_revision"), "scope", "left")
        stale = F.col("expected_revision") != F.coalesce("scope_revision", F.lit(0))
    else:
        stale = F.lit(False)
    fits = (F.col("t_status") == "active") & (F.col("t_visibility") == "recallable") & F.col("t_layer").isin("l2_fact", "l4_identity")
    words = F.coalesce(text.trim_all(F.col("content")) != "", F.lit(False)) & (F.length("content") <= MOST_CHARS)
    shaped = ((F.col("action") == "correct") & words) | ((F.col("action") == "confirm") & F.col("content").isNull())
    verdict = F.when(~F.coalesce(shaped, F.lit(False)), "invalid").when(F.coalesce(stale, F.lit(True)), "revision_conflict").when(~F.coalesce(fits, F.lit(False)), "invalid").otherwise("completed")
    met = met.withColumn("verdict", verdict)
    # of two requests of a batch on one target the first by key counts
    turn = F.row_number().over(Window.partitionBy("target_id", "verdict").orderBy("idempotency_key"))
    met = Staging(jobs.sparkSession, "revisions").cut(met.withColumn("verdict", F.when((F.col("verdict") == "completed") & (turn > 1), "invalid").otherwise(F.col("verdict"))))
    good = met.filter("verdict = 'completed'").withColumn("content", F.coalesce("content", "t_content")).withColumn("head_id", stable_id("mem-", F.lit("revised"), "scope", "idempotency_key"))
    good = good.withColumn("chain", F.coalesce("t_chain_id", stable_id("chain-", F.lit("revised"), "scope", "idempotency_key")))
    accepted = _raw_records(good, as_of, meta=F.to_json(F.struct(F.col("action").alias("managementAction"), F.col("target_id").alias("targetMemoryId"))))
    heads = record_rows(
        good, as_of, memory_id=F.col("head_id"), layer=F.col("t_layer"), content=F.col("content"), chain_id=F.col("chain"), revision=F.col("t_revision") + 1, supersedes=F.array("target_id"),
        source_memory_ids=F.array("raw_id"), tags=F.col("t_tags"), meta=F.to_json(F.struct(F.col("action").alias("managementAction"))),
    )
    changed = {"chain_id": F.col("chain"), "status": F.lit("superseded"), "visibility": F.lit("source_only"), "superseded_by": F.array("head_id"), "updated_at": as_of}
    olds = records.join(good.select(F.col("target_id").alias("memory_id"), "chain", "head_id"), "memory_id")
    olds = olds.select(*[changed.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in RECORD_SCHEMA.fields])
    done = _finished(good, replayed, good.select("raw_id", F.array("head_id").alias("created_memory_ids")), accepted, accepted.withColumn("visibility", F.lit("source_only")).unionByName(heads).unionByName(olds))
    refused = met.filter("verdict <> 'completed'").select("idempotency_key", *OWNER, F.col("verdict").alias("status"), F.lit(False).alias("replayed"), F.lit(None).cast("string").alias("raw_memory_id"), F.array().cast(_NONE).alias("created_memory_ids"))
    return Write(done.accepted, done.completed, done.jobs, done.receipts.unionByName(refused))


# ---------------------------------------------------------------- deletion and recovery


def forget(records: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """Records changed by forgetting ``ids(memory_id)``: (memory_id, status, visibility, source_memory_ids, updated_at).

    A forgotten record is deleted softly; its id leaves the evidence of others, and a record left without
    evidence is deleted too.  The cascade is one level deep.  Deleted and unknown ids change nothing.
    """
    gone = ids.select(F.col("memory_id").alias("gone_id")).distinct().join(records.filter("status <> 'deleted'").select(F.col("memory_id").alias("gone_id")), "gone_id")
    named = records.select("memory_id", F.explode("source_memory_ids").alias("gone_id")).join(gone, "gone_id").groupBy("memory_id").agg(F.collect_set("gone_id").alias("lost"))
    rows = records.join(gone, F.col("memory_id") == F.col("gone_id"), "left").join(named, "memory_id", "left").filter("gone_id IS NOT NULL OR lost IS NOT NULL")
    target = F.col("gone_id").isNotNull()
    left = F.when(F.col("lost").isNotNull() & ~target, F.array_except("source_memory_ids", "lost")).otherwise(F.col("source_memory_ids"))
    dead = target | (F.size(left) == 0)
    return rows.select(
        "memory_id",
        F.when(dead, F.lit("deleted")).otherwise(F.col("status")).alias("status"),
        F.when(dead, F.lit("source_only")).otherwise(F.col("visibility")).alias("visibility"),
        left.alias("source_memory_ids"),
        as_of.alias("updated_at"),
    )


def recover_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that a crash left accepted become degraded with code INTERRUPTED; duration and model calls go."""
    open_job = F.col("status") == "accepted"
    changed = {"status": F.lit("degraded"), "code": F.lit("INTERRUPTED"), "duration_ms": F.lit(None).cast("long"), "model_calls": F.lit(None).cast("long")}
    return jobs.select(*[F.when(open_job, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in jobs.columns])


# ---------------------------------------------------------------- checks of plans and outcomes


def named_targets(operations: DataFrame) -> DataFrame:
    """(request_id, client_ref, memory_id): sources and targets that meet in an operation, the only rows of the shortlists that ``plan_faults`` needs."""
    pairs = operations.select("request_id", F.explode(F.array_distinct("source_refs")).alias("client_ref"), "target_ids")
    return pairs.select("request_id", "client_ref", F.explode(F.array_distinct("target_ids")).alias("memory_id"))


def plan_faults(sources: DataFrame, operations: DataFrame, shortlists: DataFrame) -> DataFrame:
    """(fault, request_id, client_ref, target_id) of reconciliation plans; an empty result means they may be applied.

    ``sources(request_id, client_ref, layer)`` must each be covered by exactly one of
    ``operations(op_id, request_id, type, source_refs, target_ids)``; targets must be in the shortlist of one of the
    operation's sources, ``shortlists(request_id, client_ref, memory_id, layer)``, of the layer of all of them,
    and a consolidation's sources must be of one layer.
    """
    named = operations.select("op_id", "request_id", "type", F.explode("source_refs").alias("client_ref"))
    uses = named.groupBy("request_id", "client_ref").agg(F.count(F.lit(1)).alias("n_uses"))
    known = sources.select("request_id", "client_ref", "layer", F.lit(True).alias("known"))
    cover = known.join(uses, ["request_id", "client_ref"], "full")
    fault = lambda rows, name, *more: rows.select(F.lit(name).alias("fault"), "request_id", *(more or ("client_ref", F.lit(None).cast("string").alias("target_id"))))
    no_ref = F.lit(None).cast("string").alias("client_ref")
    layered = named.join(known.drop("known"), ["request_id", "client_ref"])
    crossing = layered.filter("type = 'CONSOLIDATE'").groupBy("op_id", "request_id").agg(F.countDistinct("layer").alias("n"), F.min("client_ref").alias("client_ref")).filter("n > 1")
    wanted = operations.filter("type <> 'ADD'").select("op_id", "request_id", F.explode(F.array_distinct("target_ids")).alias("target_id"))
    offered = wanted.select("op_id", "target_id").join(layered.select("op_id", "request_id", "client_ref"), "op_id")  # not every hit of every operation, only the named ones
    offered = offered.join(shortlists.select("request_id", "client_ref", F.col("memory_id").alias("target_id"), F.col("layer").alias("target_layer")), ["request_id", "client_ref", "target_id"])
    offered = offered.groupBy("op_id", "target_id").agg(F.min("target_layer").alias("target_layer"))
    strange = wanted.join(offered, ["op_id", "target_id"], "left_anti")
    met = wanted.join(offered, ["op_id", "target_id"]).join(layered.select("op_id", "client_ref", "layer"), "op_id").filter("NOT layer <=> target_layer")
    parts = [
        fault(cover.filter("n_uses IS NULL"), "uncovered"), fault(cover.filter("known IS NULL"), "unknown_source"), fault(cover.filter("known AND n_uses > 1"), "repeated_source"),
        fault(crossing, "sources_cross_layers"), fault(strange, "unauthorized_target", no_ref, "target_id"), fault(met, "target_crosses_layers", "client_ref", "target_id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def observe_operations(before: DataFrame, after: DataFrame, aliases: DataFrame, raws: DataFrame) -> DataFrame:
    """(case_id, operation, target_aliases): what each case's write did, judged from its states alone; null where that is not exactly one thing.

    ``before(case_id, memory_id, source_memory_ids)``; ``after(case_id, memory_id, layer, status, visibility, supersedes,
    consolidates, superseded_by, source_memory_ids)``; ``aliases(case_id, alias, memory_id)``; ``raws(case_id, raw_id)``.
    With one new active derived record: ADD without links, SUPERSEDE or CONSOLIDATE (two or more) where every
    link has an alias and its reverse, each linked to the raw record.  With none: NOOP where exactly one
    aliased record took the raw record as evidence.
    """
    keys = ["case_id", "memory_id"]
    live = (F.col("layer") != "l1_raw") & (F.col("status") == "active")
    fresh = after.filter(live).join(before.select(*keys), keys, "left_anti")
    counted = fresh.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_new"))
    head = fresh.join(counted.filter("n_new = 1"), "case_id").join(raws, "case_id")
    head = head.select("case_id", F.col("memory_id").alias("head_id"), F.coalesce(F.array_contains("source_memory_ids", F.col("raw_id")), F.lit(False)).alias("from_raw"), _list("supersedes").alias("s"), _list("consolidates").alias("c"))
    links = head.select("case_id", "head_id", F.explode(F.concat("s", "c")).alias("memory_id"))
    back = after.select(*keys, F.explode("superseded_by").alias("head_id")).distinct().withColumn("back", F.lit(True))
    alias = aliases.groupBy(*keys).agg(F.min("alias").alias("alias"))
    checked = links.join(back, [*keys, "head_id"], "left").join(alias, keys, "left")
    sound = checked.groupBy("case_id").agg(F.min((F.coalesce("back", F.lit(False)) & F.col("alias").isNotNull()).cast("int")).alias("sound"), F.sort_array(F.collect_list("alias")).alias("named"))
    judged = head.join(sound, "case_id", "left")
    n_s, n_c, ok = F.size("s"), F.size("c"), F.col("from_raw")
    kind = F.when(ok & (n_s == 0) & (n_c == 0), "ADD").when(ok & (n_s >= 1) & (n_c == 0) & (F.col("sound") == 1), "SUPERSEDE").when(ok & (n_c >= 2) & (n_s == 0) & (F.col("sound") == 1), "CONSOLIDATE")
    written = judged.select("case_id", kind.alias("operation"), F.when(kind.isNotNull() & (kind != "ADD"), F.col("named")).alias("target_aliases"))
    had = before.join(raws, "case_id").select(*keys, F.coalesce(F.array_contains("source_memory_ids", F.col("raw_id")), F.lit(False)).alias("had"))
    has = after.join(raws, "case_id").filter(F.array_contains("source_memory_ids", F.col("raw_id"))).select(*keys)
    took = aliases.join(had.filter("NOT had"), keys, "left_semi").join(has, keys, "left_semi").groupBy("case_id").agg(F.count(F.lit(1)).alias("n_took"), F.sort_array(F.collect_list("alias")).alias("took"))
    quiet = raws.select("case_id").join(counted, "case_id", "left_anti").join(took.filter("n_took = 1"), "case_id").select("case_id", F.lit("NOOP").alias("operation"), F.col("took").alias("target_aliases"))
    found = written.unionByName(quiet)
    return raws.select("case_id").distinct().join(found, "case_id", "left").select("case_id", "operation", F.coalesce("target_aliases", F.array().cast(_NONE)).alias("target_aliases"))
