"""Best representative of each duplicate group, field by field (problem 5).

Groups are the connected components of ``consolidates``.  Members that are not deleted are ranked by
trust (source type, confidence), recency and id; for each field the first member with a value wins.
The rank is a window ordering per (group, field) cut at the first row, which Spark plans as a
``WindowGroupLimit`` before the shuffle: each task sends one row per group and field, so a group of a
third of all rows stays small on the wire and in the final window.

Defined results: redelivered rows are the same member; links to absent records, null and empty link
elements and self-links are ignored; a group whose members are all deleted or have no value gives no
row for the field; confidence null, NaN or outside 0..1 ranks last, as does a null updated_at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.operators.components import connected_components

FIELDS = ["content", "occurred_at", "source_session_id", "valid_until"]

#: Source types in order of trust; anything else follows.
TRUST = ["explicit", "composite", "inferred"]


def consolidation_links(record: DataFrame) -> DataFrame:
    """(a, b): links of ``consolidates`` between records that exist."""
    links = record.select(F.col("memory_id").alias("a"), F.explode("consolidates").alias("b")).filter("a IS NOT NULL AND b <> '' AND a <> b").distinct()
    ids = record.select("memory_id").distinct()
    return links.join(ids, links["b"] == ids["memory_id"], "left_semi")


def _trust(column):
    kind = F.lower(F.regexp_replace(column, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    rank = F.lit(len(TRUST))
    for i, name in reversed(list(enumerate(TRUST))):
        rank = F.when(kind == name, F.lit(i)).otherwise(rank)
    return rank


def _ranked(record: DataFrame, fields: list[str], values: bool) -> DataFrame:
    """The winning member of each group and field, with a struct of the field's value in its own type if asked for."""
    members = connected_components(consolidation_links(record))
    sure = F.col("confidence").between(0.0, 1.0) & ~F.isnan("confidence")
    kinds = {f.name: f.dataType.simpleString() for f in record.schema.fields}

    def slot(field: str):
        """One struct type for all fields: the field's own place holds its value, the others are null."""
        held = [(F.col(field) if f == field else F.lit(None).cast(kinds[f])).alias(f) for f in fields]
        return F.struct(F.lit(field).alias("field_name"), F.col(field).isNotNull().alias("has"), *([F.struct(*held).alias("value")] if values else []))

    rows = record.filter("memory_id IS NOT NULL AND (status IS NULL OR status <> 'deleted')").select(
        "memory_id", _trust(F.col("source_type")).alias("trust"), F.when(sure, F.col("confidence")).alias("sure"), "updated_at", F.array(*[slot(f) for f in fields]).alias("slots")
    )
    joined = rows.join(members, rows["memory_id"] == members["node"]).select(F.col("component").alias("group_id"), "memory_id", "trust", "sure", "updated_at", F.inline("slots")).filter("has")
    order = Window.partitionBy("group_id", "field_name").orderBy("trust", F.desc_nulls_last("sure"), F.desc_nulls_last("updated_at"), "memory_id")
    return joined.withColumn("place", F.row_number().over(order)).filter("place = 1")


def field_survivors(record: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(group_id, field_name, from_id): the member each field of the surviving record comes from."""
    return _ranked(record, fields or FIELDS, False).select("group_id", "field_name", F.col("memory_id").alias("from_id"))


def surviving_records(record: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row per group: group_id and for each field its value, in its own type, and the member it is from."""
    fields = fields or FIELDS
    won = _ranked(record, fields, True)
    picks = []
    for f in fields:
        mine = F.col("field_name") == f
        picks += [F.max(F.when(mine, F.col(f"value.{f}"))).alias(f), F.max(F.when(mine, F.col("memory_id"))).alias(f"{f}_from")]
    return won.groupBy("group_id").agg(*picks)
