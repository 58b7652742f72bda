import datetime as dt
import random

from mnemospark.functions import bitmaps
from mnemospark.operators.components import connected_components
from mnemospark.operators.hierarchy import descendants, hierarchy, successor_links
from mnemospark.operators.orphans import orphan_references

import numpy as np

L = "array<string>"


def day(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def brute(links):
    out = set()
    for k in set(links) | set(links.values()):
        x, seen = k, []
        while x in links and x not in seen:
            seen.append(x)
            x = links[x]
        out.add((k, min(seen[seen.index(x) :]), -1) if x in seen else (k, x, len(seen)))
    return out


def test_hierarchy_random(spark):
    rng = random.Random(7)
    links = {f"n{i:03}": f"n{i - 1:03}" for i in range(1, 60)}  # one long chain
    links |= {f"m{i:03}": f"m{rng.randrange(0, i):03}" for i in range(1, 80)}  # a random tree
    links |= {"r1": "r2", "r2": "r3", "r3": "r1", "h1": "r2", "h2": "h1", "s": "s", "t": "s"}  # rings
    got = hierarchy(spark.createDataFrame(list(links.items()), "child string, parent string"), with_paths=True).collect()
    assert {(r.node, r.root, r.depth) for r in got} == brute(links)
    for r in got:
        if r.depth < 0:
            assert r.path is None
        else:
            want = [r.node]
            while want[-1] in links:
                want.append(links[want[-1]])
            assert r.path == want


def test_hierarchy_empty_and_star(spark):
    assert hierarchy(spark.createDataFrame([], "child string, parent string")).count() == 0
    star = [(f"c{i}", "hub") for i in range(300)]
    frame = spark.createDataFrame(star, "child string, parent string")
    assert {(r.root, r.depth) for r in hierarchy(frame).collect()} == {("hub", 1), ("hub", 0)}
    assert descendants(frame).count() == 300


def test_links_from_records(spark):
    rows = [
        ("a", None, ["b", None, "", "gone"], 1),
        ("b", ["a"], None, 2),
        ("c", ["b", "b"], [], 3),
        ("c", ["b", "b"], [], 3),
        (None, ["a"], ["b"], 4),
    ]
    records = spark.createDataFrame(rows, f"memory_id string, supersedes {L}, superseded_by {L}, child int")
    got = {(r.child, r.parent) for r in successor_links(records.withColumnRenamed("child", "extra")).collect()}
    assert got == {("a", "b"), ("b", "c")}


def test_components(spark):
    pairs = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "y"), (None, "z"), ("q", "q"), ("c", "a")]
    pairs += [("p00", f"p{i:02}") for i in range(1, 60)] + [(f"z{i:02}", f"z{i + 1:02}") for i in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert {got[k] for k in "abc"} == {"a"} and got["y"] == "x" and "q" not in got and "z" not in got
    assert {got[f"p{i:02}"] for i in range(60)} == {"p00"} and {got[f"z{i:02}"] for i in range(41)} == {"z00"}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def _tables(spark, records, queries=(), jobs=()):
    return {
        "memory_record": spark.createDataFrame(list(records), f"memory_id string, status string, source_memory_ids {L}, supersedes {L}, ingested_at timestamp, key string, day int"),
        "query_fixture": spark.createDataFrame(list(queries), f"query_id string, relevant_ids {L}, ingested_at timestamp, seen string"),
        "memory_job": spark.createDataFrame(list(jobs), "job_id string, raw_memory_id string, ingested_at timestamp, kind string"),
    }


def test_orphans(spark):
    records = [
        ("a", "active", ["b", None, "", "nope", "nope"], None, day(10), "k", 1),
        ("a", "active", ["b", None, "", "nope", "nope"], None, day(60), "k", 1),  # delivered again
        ("b", "active", [], ["d"], day(10).replace(hour=5), "k", 1),  # later on the same day
        ("d", "deleted", None, None, day(1), "k", 1),
        ("e", None, ["a"], None, day(40), "k", 1),
        ("f", "active", ["g"], None, None, "k", 1),  # no arrival time
        ("g", "active", None, None, day(5), "k", 1),
        (None, "active", ["b"], None, day(3), "k", 1),
    ]
    queries = [("q", ["a", "late"], day(9), "x"), (None, ["nope"], day(9), "x")]
    jobs = [("j", "zz", day(31), "x"), ("j2", None, day(2), "x"), ("j3", "", day(2), "x")]
    got = {tuple(r) for r in orphan_references(_tables(spark, records, queries, jobs)).collect()}
    assert got == {
        ("memory_record", "a", "source_memory_ids", "b", "late", "2025-01"),
        ("memory_record", "a", "source_memory_ids", "nope", "missing", "2025-01"),
        ("memory_record", "b", "supersedes", "d", "deleted", "2025-01"),
        ("query_fixture", "q", "relevant_ids", "a", "late", "2025-01"),
        ("query_fixture", "q", "relevant_ids", "late", "missing", "2025-01"),
        ("memory_job", "j", "raw_memory_id", "zz", "missing", "2025-02"),
    }
    assert orphan_references(_tables(spark, [])).count() == 0


def test_orphans_hot_target(spark):
    records = [(f"m{i:04}", "active", ["hot" if i % 3 else "m0000"], None, day(i % 50), "k", 1) for i in range(900)]
    got = orphan_references(_tables(spark, records)).collect()
    assert sum(r.reason == "missing" for r in got) == 600


def test_bitmaps():
    rng = np.random.default_rng(1)
    for width, n, m in [(1, 0, 1), (1000, 3, 900), (1000, 700, 5), (5000, 2500, 2500), (64, 64, 0)]:
        a, b = rng.choice(width, n, replace=False), rng.choice(width, m, replace=False)
        x, y = bitmaps.build(a, width), bitmaps.build(b, width)
        assert set(bitmaps.decode(x)) == set(a)
        assert set(bitmaps.decode(bitmaps.and_not(x, y))) == set(a) - set(b)
        assert set(bitmaps.decode(bitmaps.union(x, y, width))) == set(a) | set(b)
