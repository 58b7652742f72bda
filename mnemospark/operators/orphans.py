"""References to keys that are missing, deleted or arrive later (problem 2).

Method: keys are hashed into ranges; in each range they are dictionary-encoded as integers, and
compressed bitmaps per range and day are built of the references (per field) and of the live
parents that had arrived before that day.  ``references AND-NOT parents`` leaves the bits that can
be orphans; they are decoded, given the parent's state and joined back to the referring rows, where
an exact comparison of the arrival times decides the day of arrival itself.

Scale: references are reduced to distinct (key, field, day) with map-side aggregation before the
range shuffle, so a target named by a third of all rows costs one row per field and day.  The number
of ranges follows the row count of the parents, so a range stays near ``RANGE_KEYS`` keys.

Defined results: null and empty reference elements, null ids of referring rows and null parent ids
are no references and no parents; redelivered rows count once, at their least ``ingested_at``; rows
without any ``ingested_at`` have a null period and are never late; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import bitmaps

#: Keys per dictionary range aimed at.
RANGE_KEYS = 40_000

#: The four reference fields: (table, key column, field, whether the field is an array).
FIELDS = [
    ("memory_record", "memory_id", "source_memory_ids", True),
    ("memory_record", "memory_id", "supersedes", True),
    ("query_fixture", "query_id", "relevant_ids", True),
    ("memory_job", "job_id", "raw_memory_id", False),
]

_NEVER = np.int32(2**31 - 1)


def references(tables: dict[str, DataFrame]) -> DataFrame:
    """(ref_table, ref_id, field, target_id, seen): one row per row id, field and target."""
    parts = []
    for name, key, field, many in FIELDS:
        target = F.explode(field) if many else F.col(field)
        parts.append(
            tables[name]
            .select(F.lit(name).alias("ref_table"), F.col(key).alias("ref_id"), F.lit(field).alias("ref_field"), target.alias("target_id"), "ingested_at")
            .filter("target_id <> '' AND ref_id IS NOT NULL")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("ref_table", "ref_id", "ref_field", "target_id").agg(F.min("ingested_at").alias("seen"))


def _day(column: str):
    return F.unix_date(F.to_date(column))


def _range_orphans(frame: pd.DataFrame) -> pd.DataFrame:
    """Reference AND-NOT parent over one key range; kind 'p' rows are parents."""
    codes, keys = pd.factorize(frame["key"].to_numpy(), sort=True)
    width = len(keys)
    is_parent = (frame["kind"] == "p").to_numpy()
    day = frame["day"].fillna(_NEVER).to_numpy(dtype=np.int64)
    parent_at = np.full(width, -1, dtype=np.int64)  # row number of each key's parent
    parent_at[codes[is_parent]] = np.flatnonzero(is_parent)
    dead = (frame["dead"] == True).to_numpy()  # noqa: E712 - nulls count as False

    live = is_parent & ~dead
    order = np.argsort(day[live], kind="stable")
    live_codes, live_days = codes[live][order].astype(np.uint32), day[live][order]
    refs = np.flatnonzero(~is_parent)
    refs = refs[np.lexsort((frame["ref_field"].to_numpy()[refs].astype(str), day[refs]))]
    out_rows: list[np.ndarray] = []
    arrived, used = bitmaps.build(np.empty(0), width), 0
    bounds = np.flatnonzero(np.r_[True, np.diff(day[refs]) != 0, True]) if refs.size else np.empty(0, dtype=int)
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        today = refs[lo:hi]
        until = np.searchsorted(live_days, day[today[0]], side="left")
        if until > used:
            arrived = bitmaps.union(arrived, bitmaps.build(live_codes[used:until], width), width)
            used = until
        fields = frame["ref_field"].to_numpy()[today]
        for field in pd.unique(fields):
            mine = today[fields == field]
            left = bitmaps.decode(bitmaps.and_not(bitmaps.build(codes[mine], width), arrived))
            out_rows.append(mine[np.isin(codes[mine], left)])
    kept = np.concatenate(out_rows) if out_rows else np.empty(0, dtype=int)
    at = parent_at[codes[kept]]
    has = at >= 0
    first = frame["first_seen"].to_numpy()[np.where(has, at, 0)] if len(frame) else np.empty(0)
    return pd.DataFrame(
        {
            "target_id": keys[codes[kept]] if width else np.empty(0, dtype=object),
            "ref_field": frame["ref_field"].to_numpy()[kept],
            "day": frame["day"].to_numpy()[kept],
            "state": np.where(~has, "missing", np.where(dead[np.where(has, at, 0)], "deleted", "live")) if len(kept) else np.empty(0, dtype=object),
            "first_us": pd.Series(np.where(has, first, None), dtype="Int64"),
        }
    )


def orphan_references(tables: dict[str, DataFrame]) -> DataFrame:
    """(ref_table, ref_id, ref_field, target_id, reason, period): each broken reference once."""
    record = tables["memory_record"]
    ranges = max(1, math.ceil(record.select("memory_id").count() * 2 / RANGE_KEYS))
    refs = references(tables).withColumn("day", _day("seen"))
    parents = (
        record.filter("memory_id IS NOT NULL")
        .groupBy(F.col("memory_id").alias("key"))
        .agg(F.min("ingested_at").alias("seen"), F.max(F.coalesce(F.col("status") == "deleted", F.lit(False))).alias("dead"))
        .select("key", F.lit("p").alias("kind"), F.lit(None).cast("string").alias("ref_field"), _day("seen").alias("day"), "dead", F.unix_micros("seen").alias("first_seen"))
    )
    wanted = refs.groupBy(F.col("target_id").alias("key"), "ref_field", "day").agg(F.lit("r").alias("kind"))
    wanted = wanted.select("key", "kind", "ref_field", "day", F.lit(None).cast("boolean").alias("dead"), F.lit(None).cast("long").alias("first_seen"))
    found = (
        parents.unionByName(wanted)
        .groupBy(F.pmod(F.xxhash64("key"), F.lit(ranges)))
        .applyInPandas(_range_orphans, "target_id string, ref_field string, day int, state string, first_us long")
    )
    late = F.col("first_us") > F.unix_micros("seen")
    reason = F.when(F.col("state") != "live", F.col("state")).when(late, F.lit("late"))
    return (
        refs.join(found, (refs["target_id"] == found["target_id"]) & (refs["ref_field"] == found["ref_field"]) & refs["day"].eqNullSafe(found["day"]))
        .select("ref_table", "ref_id", refs["ref_field"], refs["target_id"], reason.alias("reason"), F.date_format("seen", "yyyy-MM").alias("period"))
        .filter("reason IS NOT NULL")
    )


def orphan_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(ref_table, ref_field, period, reason, n_references): counts of broken references."""
    return orphan_references(tables).groupBy("ref_table", "ref_field", "period", "reason").agg(F.count(F.lit(1)).alias("n_references"))
