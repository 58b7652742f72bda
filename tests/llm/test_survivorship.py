import datetime as dt

from mnemospark.llm.survivorship import field_survivors, surviving_records

T = dt.datetime(2025, 1, 1)
SCHEMA = ("memory_id string, consolidates array<string>, status string, source_type string, confidence double, updated_at timestamp, content string, occurred_at timestamp, "
          "source_session_id string, valid_until timestamp, ingested_at timestamp, group_id string, node string, place int")  # fmt: skip


def row(i, links=None, status="active", kind="explicit", sure=0.5, at=T, content=None, occurred=None, session=None, until=None):
    return (i, links, status, kind, sure, at, content, occurred, session, until, T, "g", "n", 1)


def found(spark, rows):
    return {(r.group_id, r.field_name): r.from_id for r in field_survivors(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_rank_field_by_field(spark):
    rows = [
        row("a", ["b", None, "", "gone", "a"], kind=" Inferred ", sure=0.9, content="A", session="s"),
        row("b", ["c"], kind="EXPLICIT", sure=0.1, content="B"),
        row("b", ["c"], kind="EXPLICIT", sure=0.1, content="B"),  # delivered twice
        row("c", None, kind="composite", sure=float("nan"), occurred=T, content="C"),
        row("d", ["c"], kind="composite", sure=2.0, occurred=T, at=T + dt.timedelta(1)),
        row("e", ["d"], status="deleted", kind="explicit", sure=1.0, until=T, content="E"),
        row("lone", content="L"),
        row("self", ["self"], content="S"),
        row(None, ["a"], content="N"),
    ]
    assert found(spark, rows) == {("a", "content"): "b", ("a", "source_session_id"): "a", ("a", "occurred_at"): "d"}


def test_ties_and_nulls(spark):
    rows = [row("x", ["y"], kind=None, sure=None, at=None, content="1"), row("y", kind=None, sure=None, at=None, content="2"), row("z", ["y"], kind="other", sure=None, at=T, content="3")]
    assert found(spark, rows) == {("x", "content"): "z"}
    rows[2] = row("z", ["y"], kind="other", sure=None, at=None, content="3")
    assert found(spark, rows) == {("x", "content"): "x"}
    assert found(spark, []) == {}


def test_whole_records_and_large_group(spark):
    rows = [row("m0000", content="first", sure=0.1)] + [row(f"m{i:04}", ["m0000"], content=f"c{i}", sure=i / 1000) for i in range(1, 900)]
    got = surviving_records(spark.createDataFrame(rows, SCHEMA), ["content", "source_session_id"]).collect()
    assert len(got) == 1 and got[0].content == "c899" and got[0].content_from == "m0899" and got[0].source_session_id is None
