"""Integrity of the evolution and evidence graphs: all violations, each with the rank of its check.

Every check is an equi-join, an anti-join or an aggregate, so a state of any size is checked at once.
Ranks follow the order in which a single-scope check would report: the least rank present is its answer.
The state's relations are supersedes, consolidates and superseded_by; evidence is checked in data sets only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.retrieval import scope_key
from mnemospark.operators.rings import on_rings
from mnemospark.plans.staging import Staging

#: The relation arrays, the layers that are derived from evidence, those that may be stored, and states of predecessors.
RELATIONS = ["supersedes", "consolidates", "superseded_by"]
DERIVED = ["l2_fact", "l3_summary", "l4_identity"]
WRITABLE = ["l0_basic_info", "l1_raw", "l2_fact", "l3_summary", "l4_identity"]
PREDECESSOR = ["superseded", "archived", "deleted"]


def edges(records: DataFrame, *fields: str) -> DataFrame:
    """(src, dst, relation): distinct non-empty elements of the relation arrays."""
    out = None
    for field in fields or RELATIONS:
        part = records.select(F.col("memory_id").alias("src"), F.explode(field).alias("dst"), F.lit(field).alias("relation")).filter("dst <> ''")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _pairs(records: DataFrame, *fields: str) -> DataFrame:
    return edges(records, *fields).select("src", "dst").distinct()


def _found(rows: DataFrame, code: str, subject: Column, other: Column | None = None) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), subject.alias("memory_id"), (other if other is not None else F.lit(None).cast("string")).alias("other_id"))


def duplicate_ids(records: DataFrame) -> DataFrame:
    return _found(records.groupBy("memory_id").count().filter("count > 1"), "c1", F.col("memory_id"))


def missing_targets(records: DataFrame, fields: list[str] = RELATIONS, code: str = "c2") -> DataFrame:
    return _found(_pairs(records, *fields).join(records.select(F.col("memory_id").alias("dst")), "dst", "left_anti"), code, F.col("src"), F.col("dst"))


def crossing_scopes(records: DataFrame, fields: list[str] = RELATIONS, code: str = "c3") -> DataFrame:
    owner = records.select("memory_id", scope_key().alias("scope"))
    left = _pairs(records, *fields).join(owner.select(F.col("memory_id").alias("src"), F.col("scope").alias("src_scope")), "src")
    both = left.join(owner.select(F.col("memory_id").alias("dst"), F.col("scope").alias("dst_scope")), "dst")
    return _found(both.filter("src_scope <> dst_scope"), code, F.col("src"), F.col("dst"))


def ambiguous_types(records: DataFrame) -> DataFrame:
    """Links of both kinds to a record that exists."""
    both = records.select(F.col("memory_id").alias("src"), F.explode(F.array_intersect("supersedes", "consolidates")).alias("dst")).filter("dst <> ''")
    return _found(both.join(records.select(F.col("memory_id").alias("dst")), "dst", "left_semi"), "c4", F.col("src"), F.col("dst"))


def missing_reverse(records: DataFrame, forward_code: str = "c5_forward", backward_code: str = "c5_backward") -> DataFrame:
    """Forward links without the back link, and back links without a forward one, between existing records."""
    ids = records.select(F.col("memory_id").alias("id"))
    forward = _pairs(records, "supersedes", "consolidates").join(ids, F.col("dst") == F.col("id"), "left_semi")
    back = edges(records, "superseded_by").select(F.col("dst").alias("src"), F.col("src").alias("dst")).join(ids, F.col("src") == F.col("id"), "left_semi")
    no_back = _found(forward.join(back, ["src", "dst"], "left_anti"), forward_code, F.col("src"), F.col("dst"))
    no_forward = _found(back.join(forward, ["src", "dst"], "left_anti"), backward_code, F.col("dst"), F.col("src"))
    return no_back.unionByName(no_forward)


def cycles(records: DataFrame) -> DataFrame:
    """Records that their own superseded_by links, all of them, lead back to; other_id is the least id of the ring or tangle."""
    ids = records.select(F.col("memory_id").alias("id"))
    links = edges(records, "superseded_by").join(ids, F.col("dst") == F.col("id"), "left_semi").select("src", "dst")
    return _found(on_rings(links), "c6", F.col("node"), F.col("ring"))


def _forward_pairs(records: DataFrame) -> DataFrame:
    state = lambda end: records.select(F.col("memory_id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("revision", "status", "visibility", "chain_id")])
    return _pairs(records, "supersedes", "consolidates").join(state("src"), "src").join(state("dst"), "dst")


def revisions_not_rising(records: DataFrame, code: str = "c7") -> DataFrame:
    return _found(_forward_pairs(records).filter("src_revision <= dst_revision"), code, F.col("src"), F.col("dst"))


def predecessor_states(records: DataFrame, allowed: list[str] = PREDECESSOR, code: str = "c8") -> DataFrame:
    fits = F.col("dst_status").isin(allowed) & (F.col("dst_visibility") == "source_only")
    return _found(_forward_pairs(records).filter(~F.coalesce(fits, F.lit(False))), code, F.col("dst"), F.col("src"))


def many_heads(records: DataFrame, code: str = "c9") -> DataFrame:
    """Chains of one owner with several active recallable records: the least of them, and the chain."""
    heads = records.filter("chain_id IS NOT NULL AND status = 'active' AND visibility = 'recallable'")
    return _found(heads.groupBy(scope_key(), "chain_id").agg(F.count(F.lit(1)).alias("n"), F.min("memory_id").alias("memory_id")).filter("n > 1"), code, F.col("memory_id"), F.col("chain_id"))


def deleted_recallable(records: DataFrame) -> DataFrame:
    return _found(records.filter("status = 'deleted' AND visibility = 'recallable'"), "c10", F.col("memory_id"))


def without_evidence(records: DataFrame) -> DataFrame:
    derived = (F.col("status") != "deleted") & F.col("layer").isin(DERIVED) & ~F.coalesce(F.col("source_type") == "explicit", F.lit(False))
    return _found(records.filter(derived & (F.coalesce(F.size("source_memory_ids"), F.lit(0)) <= 0)), "c11", F.col("memory_id"))


def bad_layers(records: DataFrame) -> DataFrame:
    return _found(records.filter(~F.coalesce(F.col("layer").isin(WRITABLE), F.lit(False))), "c12_layer", F.col("memory_id"))


def bad_embeddings(records: DataFrame, embeddings: DataFrame, jobs: DataFrame, spaces: DataFrame) -> DataFrame:
    """Vectors of a space or width that ``spaces(space_id, dimensions, quality)`` does not name, and zero vectors of trained spaces.

    A raw record with an accepted or degraded job of its own may wait with a zero vector.  ``spaces`` is a
    fixed table of a few rows.
    """
    known = spaces.select(F.col("space_id").alias("known_space"), F.col("dimensions").alias("known_dimensions"), "quality")
    rows = embeddings.join(F.broadcast(known), F.col("space_id") == F.col("known_space"), "left")
    strange = rows.filter("known_space IS NULL")
    width = (F.col("dimensions") == F.col("known_dimensions")) & (F.size("vector") == F.col("known_dimensions"))
    wide = rows.filter(F.col("known_space").isNotNull() & ~F.coalesce(width, F.lit(False)))
    zero = rows.filter(F.coalesce(width, F.lit(False)) & (F.col("quality") == "trained") & ~F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False)))
    waiting = jobs.filter(F.col("status").isin("accepted", "degraded")).select(F.col("raw_memory_id").alias("memory_id")).distinct()
    excused = records.filter("layer = 'l1_raw'").select("memory_id").join(waiting, "memory_id", "left_semi")
    parts = [(strange, "c12_space"), (wide, "c12_width"), (zero.join(excused, "memory_id", "left_anti"), "c12_zero")]
    found = [_found(part, code, F.col("memory_id"), F.col("space_id")) for part, code in parts]
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()


def dataset_checks(records: DataFrame) -> DataFrame:
    """The stricter checks of evaluation data: every reference resolves within its owner, evidence is raw, links go both ways,
    rise in revision and share a chain, predecessors are superseded sources, and a chain of an owner has one head."""
    fields = [*RELATIONS, "source_memory_ids"]
    layer = records.select(F.col("memory_id").alias("dst"), "layer")
    evidence = edges(records, "source_memory_ids").join(layer, "dst").filter(~F.coalesce(F.col("layer") == "l1_raw", F.lit(False)))
    pairs = _forward_pairs(records).filter("src_chain_id IS NULL OR dst_chain_id IS NULL OR src_chain_id <> dst_chain_id")
    parts = [
        missing_targets(records, fields, "c13_missing"),
        crossing_scopes(records, fields, "c13_owner"),
        _found(evidence, "c13_evidence", F.col("src"), F.col("dst")),
        missing_reverse(records, "c13_forward", "c13_backward"),
        revisions_not_rising(records, "c13_revision"),
        _found(pairs, "c13_chain", F.col("src"), F.col("dst")),
        predecessor_states(records, ["superseded"], "c13_predecessor"),
        many_heads(records, "c13_heads"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _linked(records: DataFrame) -> DataFrame:
    """``edges`` of all relations with the state of both ends; dst_scope is null where the target is missing."""
    state = lambda end: records.select(F.col("memory_id").alias(end), scope_key().alias(f"{end}_scope"), *[F.col(c).alias(f"{end}_{c}") for c in ("revision", "status", "visibility", "chain_id", "layer")])
    src = state("src").drop("src_status", "src_visibility", "src_layer")
    return edges(records, *RELATIONS, "source_memory_ids").join(src, "src").join(state("dst"), "dst", "left")


def _marked(rows: DataFrame, marks: list[tuple[int, str, Column, str, str | None]]) -> DataFrame:
    """(rank, code, memory_id, other_id) of every mark (rank, code, condition, subject, other) that a row meets."""
    other = lambda c: F.col(c) if c else F.lit(None).cast("string")
    found = [F.when(met, F.struct(F.lit(rank).alias("rank"), F.lit(code).alias("code"), F.col(subject).alias("memory_id"), other(c).alias("other_id"))) for rank, code, met, subject, c in marks]
    return rows.select(F.explode(F.array_compact(F.array(*found))).alias("m")).select("m.*")


def _link_violations(linked: DataFrame, dataset: bool) -> DataFrame:
    """c2, c3, c7, c8 and the data set's checks of single links."""
    there, evidence = F.col("dst_scope").isNotNull(), F.col("relation") == "source_memory_ids"
    forward = there & F.col("relation").isin("supersedes", "consolidates")
    crossing, falling = there & (F.col("src_scope") != F.col("dst_scope")), forward & (F.col("src_revision") <= F.col("dst_revision"))
    left_as = lambda allowed: forward & ~F.coalesce(F.col("dst_status").isin(allowed) & (F.col("dst_visibility") == "source_only"), F.lit(False))
    apart = forward & (F.col("src_chain_id").isNull() | F.col("dst_chain_id").isNull() | (F.col("src_chain_id") != F.col("dst_chain_id")))
    marks = [(2, "c2", ~there & ~evidence, "src", "dst"), (3, "c3", crossing & ~evidence, "src", "dst"), (7, "c7", falling, "src", "dst"), (8, "c8", left_as(PREDECESSOR), "dst", "src")]
    if dataset:
        raw = F.coalesce(F.col("dst_layer") == "l1_raw", F.lit(False))
        marks += [(13, "c13_missing", ~there, "src", "dst"), (13, "c13_owner", crossing, "src", "dst"), (13, "c13_evidence", there & evidence & ~raw, "src", "dst")]
        marks += [(13, "c13_revision", falling, "src", "dst"), (13, "c13_chain", apart, "src", "dst"), (13, "c13_predecessor", left_as(["superseded"]), "dst", "src")]
    return _marked(linked, marks).distinct()  # a pair may be linked by several relations


def _pair_violations(linked: DataFrame, dataset: bool) -> DataFrame:
    """c4, c5 and the data set's missing links: of a successor and its predecessor which of the three links there are."""
    back = F.col("relation") == "superseded_by"
    rows = linked.filter(F.col("dst_scope").isNotNull() & (F.col("relation") != "source_memory_ids"))
    rows = rows.select(F.when(back, F.col("dst")).otherwise(F.col("src")).alias("head"), F.when(back, F.col("src")).otherwise(F.col("dst")).alias("prior"), "relation")
    pairs = rows.groupBy("head", "prior").agg(*[F.max(F.col("relation") == r).alias(r) for r in RELATIONS])
    forward, back = F.col("supersedes") | F.col("consolidates"), F.col("superseded_by")
    marks = [(4, "c4", F.col("supersedes") & F.col("consolidates"), "head", "prior")]
    for rank, code in [(5, "c5"), (13, "c13")][: 1 + dataset]:
        marks += [(rank, f"{code}_forward", forward & ~back, "head", "prior"), (rank, f"{code}_backward", back & ~forward, "prior", "head")]
    return _marked(pairs, marks)


def all_violations(
    records: DataFrame, deliveries: DataFrame | None = None, embeddings: DataFrame | None = None, jobs: DataFrame | None = None, spaces: DataFrame | None = None, dataset: bool = False
) -> DataFrame:
    """(code, memory_id, other_id, rank) of every check over one state.

    ``deliveries`` are the distinct contents delivered, before one row an id was chosen; vectors are checked
    where ``embeddings``, ``jobs`` and ``spaces`` are given, at the rank of the layers; ``dataset`` adds the
    checks of evaluation data.  The links and the states of their ends are joined and staged once: the checks
    of links are conditions on that table, so that no plan joins again what another has joined.
    """
    stage = Staging(records.sparkSession, "violations")
    cols = ["memory_id", "tenant_id", "user_id", "agent_id", "layer", "status", "visibility", "source_type", "chain_id", "revision", *RELATIONS, "source_memory_ids"]
    deliveries = deliveries if deliveries is not None else records
    records = stage.cut(records.select(*cols))
    linked = stage.cut(_linked(records))
    order = ["code", "memory_id", "other_id", "rank"]
    ranked = lambda found, rank: found.withColumn("rank", F.lit(rank))
    links = linked.filter("relation = 'superseded_by' AND dst_scope IS NOT NULL").select("src", "dst")
    heads = stage.cut(ranked(many_heads(records), 9))
    parts = [ranked(duplicate_ids(deliveries), 1), _link_violations(linked, dataset), _pair_violations(linked, dataset), ranked(_found(on_rings(links), "c6", F.col("node"), F.col("ring")), 6)]
    parts += [ranked(deleted_recallable(records), 10), ranked(without_evidence(records), 11), ranked(bad_layers(records), 12)]
    if embeddings is not None and jobs is not None and spaces is not None:
        parts.append(ranked(bad_embeddings(records, embeddings, jobs, spaces), 12))
    out = heads.select(*order)
    if dataset:
        out = out.unionByName(heads.select(F.lit("c13_heads").alias("code"), "memory_id", "other_id", F.lit(13).alias("rank")))
    for found in parts:
        out = out.unionByName(stage.cut(found.select(*order)))
    stage.drop(linked)
    stage.drop(records)
    return out
