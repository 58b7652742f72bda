import datetime as dt

import numpy as np
import pytest

from mnemospark.llm import neighbours as nn

T = dt.datetime(2025, 1, 1)
SCHEMA = "memory_id string, space_id string, dimensions int, vector array<float>, ingested_at timestamp, id long, key string"


def frame(spark, rows):
    return spark.createDataFrame([(m, s, d, v, T, 1, "k") for m, s, d, v in rows], SCHEMA)


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[700:720] = x[:20] + rng.normal(scale=0.05, size=(20, 24))
    rows = [(f"v{i:04}", "s", 24, v.tolist()) for i, v in enumerate(x)]
    vectors = nn.usable_vectors(frame(spark, rows)).selectExpr("space_id", "memory_id AS key", "vector")
    got = {}
    for r in nn.nearest(vectors).collect():
        got.setdefault(r.key_a, set()).add(r.key_b)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hits = sum(len(got[f"v{i:04}"] & {f"v{j:04}" for j in np.argsort(-s[i])[:10]}) for i in range(len(x)))
    assert hits / (10 * len(x)) >= 0.9
    pairs = {(r.memory_id_a, r.memory_id_b) for r in nn.similar_pairs(frame(spark, rows)).collect()}
    a, b = np.nonzero(np.triu(s >= 0.9))
    assert pairs == {(f"v{i:04}", f"v{j:04}") for i, j in zip(a, b)}
    asked = vectors.filter("substring(key, 4, 2) IN ('00', '50')").selectExpr("key AS query", "space_id", "vector")
    near = {}
    for r in nn.graph_search(vectors, asked).collect():
        near.setdefault(r.query, set()).add(r.key)
    np.fill_diagonal(s, 2)
    right = [len(near[q] & {f"v{j:04}" for j in np.argsort(-s[int(q[1:])])[:10]}) for q in near]
    assert len(near) == asked.count() and sum(right) / (10 * len(right)) >= 0.9


@pytest.mark.parametrize("n,dim", [(3000, 32), (7000, 48)])
def test_recall_over_many_leaves(spark, n, dim):
    """Clustered vectors, several to many leaves: recall at 10 of every 20th vector."""
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(n // 25, dim))
    x = (centres[rng.integers(0, len(centres), n)] + rng.normal(scale=0.6, size=(n, dim))).astype(np.float32)
    rows = [(f"v{i:05}", "s", dim, v.tolist()) for i, v in enumerate(x)]
    vectors = nn.usable_vectors(frame(spark, rows)).selectExpr("space_id", "memory_id AS key", "vector")
    got = {}
    for r in nn.nearest(vectors).filter("substring(key_a, 5, 2) IN ('00', '20', '40', '60', '80')").collect():
        got.setdefault(int(r.key_a[1:]), set()).add(int(r.key_b[1:]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[sorted(got)] @ u.T
    s[np.arange(len(s)), sorted(got)] = -2
    hits = sum(len(got[i] & set(np.argsort(-s[k])[:10].tolist())) for k, i in enumerate(sorted(got)))
    assert hits / (10 * len(got)) >= 0.9


def test_quiet_points_are_left_out_without_loss(spark):
    """With most edges old, leaving points without fresh edges out gives the same improvements."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    codes = spark.createDataFrame([(i, bytes(nn._quantize(v[None, :])[0].tobytes())) for i, v in enumerate(x)], "id long, code binary")
    graph = spark.createDataFrame([(i, [(i + j) % 60 for j in (1, 7, 19)], [-0.9] * 3, [i % 9 == 0, False, False]) for i in range(60)], nn._LISTS)
    plain, quiet = ({(r.id, a) for r in nn._joined(graph, codes, 0, q).collect() for a in r.nbr} for q in (False, True))
    ends = {e for i in range(60) for j in (1, 7, 19) for e in ((i, (i + j) % 60), ((i + j) % 60, i))}  # an old edge's ends have met before
    assert plain - ends == quiet - ends and plain - ends


def test_dirty_vectors_and_spaces(spark):
    good = [1.0, 2.0, 3.0]
    rows = [("a", "s", 3, good), ("b", "s", 3, [1.0, 2.0, 3.01]), ("b", "s", 3, [1.0, 2.0, 3.01]), ("a", "t", 3, good), ("n", "s", 3, None), ("z", "s", 3, [0.0, 0.0, 0.0]), ("w", "s", 4, good),
            ("nan", "s", 3, [1.0, float("nan"), 2.0]), ("inf", "s", 3, [1.0, float("inf"), 2.0]), ("nul", "s", 3, [1.0, None, 2.0]), (None, "s", 3, good), ("x", None, 3, good), ("far", "s", 3, [-1.0, 0.0, 0.0])]
    assert {tuple(r) for r in nn.similar_pairs(frame(spark, rows)).collect()} == {("s", "a", "b")}
    assert nn.similar_pairs(frame(spark, [])).count() == 0


def test_one_vector_repeated(spark):
    rng = np.random.default_rng(1)
    rows = [(f"c{i:04}", "s", 8, [1.0] * 8) for i in range(700)] + [(f"o{i:04}", "s", 8, rng.normal(size=8).tolist()) for i in range(1400)]
    vectors = nn.usable_vectors(frame(spark, rows)).selectExpr("space_id", "memory_id AS key", "vector")
    got = nn.nearest(vectors).filter("key_a LIKE 'c%'").collect()
    assert len(got) == 7000 and all(r.similarity > 0.999999 for r in got)


def test_members_of_a_split_point_meet_in_later_iterations(spark, monkeypatch):
    """Nothing is fresh, and the hub's members are dealt to parts: every two meet within the iterations."""
    monkeypatch.setattr(nn, "MEET_MOST", 8)
    monkeypatch.setattr(nn, "MOST_ITERATIONS", 30)
    x = np.random.default_rng(2).normal(size=(13, 6)).astype(np.float32)
    codes = spark.createDataFrame([(i, bytes(nn._quantize(v[None, :])[0].tobytes())) for i, v in enumerate(x)], "id long, code binary")
    graph = spark.createDataFrame([(i, [0], [-1.0], [False]) for i in range(1, 13)], nn._LISTS).unionByName(spark.createDataFrame([(0, [1], [-1.0], [False])], nn._LISTS))
    met = set()
    for iteration in range(nn.MOST_ITERATIONS):
        got = nn._joined(graph, codes, iteration).collect()
        met |= {(r.id, n) for r in got for n in r.nbr if r.id and n}
        if len(met) == 12 * 11:
            break
    assert len(met) == 12 * 11


def test_search_goes_on_until_the_beam_settles(spark, monkeypatch):
    """A chain of vectors, each listing four at either side: more than eight rounds from the entries to the answer."""
    n = 900
    turn = np.linspace(0, 3, n)
    numbered = spark.createDataFrame([(i, f"k{i:04}", "s", "s\x012", [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(turn)], "id long, key string, space_id string, space string, vector array<double>")
    graph = spark.createDataFrame([(i, [j for j in range(max(0, i - 4), min(n, i + 5)) if j != i]) for i in range(n)], "id long, nbr array<long>")
    monkeypatch.setattr(nn, "neighbour_graph", lambda vectors, stage: (numbered, graph))
    asked = numbered.filter("id % 45 = 0").selectExpr("key AS query", "space_id", "vector")
    first = {r.query: r.key for r in nn.graph_search(numbered, asked, k=1, beam=6).collect()}
    assert len(first) == 20 and all(q == key for q, key in first.items())
