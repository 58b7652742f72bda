import random

import pytest
from pyspark.sql import functions as F

from mnemospark.llm import near_duplicates as nd

SCHEMA = "row_id string, content string, block long"


def frame(spark, rows):
    return spark.createDataFrame([(i, c, 1) for i, c in rows], SCHEMA)


def brute(rows, threshold=0.6):
    out = set()
    sets = [(i, nd.words(c)) for i, c in rows if i is not None and c is not None and nd.words(c)]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if i != j and len(a & b) >= threshold * len(a | b) - 1e-9:
                out.add((min(i, j), max(i, j)))
    return out


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + list("春夏秋冬东南西北山水花草木石云雨雪风")
    rows = []
    for g in range(n):
        base = [rng.choice(vocab) for _ in range(rng.randrange(8, 40))]
        for k in range(rng.randrange(1, 5)):
            words = list(base)
            for _ in range(rng.randrange(0, max(1, len(words) // 9))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rng.shuffle(words)
            rows.append((f"r{g:03}-{k}", " ".join(words).upper() if k % 2 else ", ".join(words)))
    return rows


def test_words():
    assert nd.words("Foo_bar, foo!  A1 山水B") == {"foo", "bar", "a1", "山", "水", "b"}
    assert nd.words("…") == set()


def test_against_brute_force(spark):
    rows = corpus()
    got = {(r.row_id_a, r.row_id_b) for r in nd.near_duplicate_pairs(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [("a", "same text here now"), ("b", "here now same TEXT"), ("b", "here now same TEXT"), ("c", None), (None, "same text here now"), ("d", ""), ("e", "…!"), ("f", "x"), ("g", "X"), ("long1", long), ("long2", long + " extra words")]
    got = {(r.row_id_a, r.row_id_b) for r in nd.near_duplicate_pairs(frame(spark, rows)).collect()}
    assert got == {("a", "b"), ("f", "g"), ("long1", "long2")}
    assert nd.near_duplicate_pairs(frame(spark, [])).count() == 0
    classes = {r.row_id: (r.class_id, r.n_links) for r in nd.near_duplicate_classes(frame(spark, rows)).collect()}
    assert classes["a"] == ("a", 1) and classes["b"] == ("a", 1) and classes["long2"] == ("long1", 1)
    assert set(classes) == {"a", "b", "f", "g", "long1", "long2"}


def test_copies_stay_compact(spark):
    rows = [(f"c{i:04}", "one fact told many times over") for i in range(600)] + [(f"x{i:04}", f"some text number{i} alone{i} word{i}") for i in range(600)]
    classes = {r.row_id: (r.class_id, r.n_links) for r in nd.near_duplicate_classes(frame(spark, rows)).collect()}
    assert classes["c0599"] == ("c0000", 599) and classes["x0001"] == ("x0001", 0)


def test_hot_blocks_are_split(spark):
    """Many different texts around one template: blocks above the bound still give every pair."""
    rng = random.Random(5)
    template = " ".join(f"rare{i}" for i in range(14))
    rows = [(f"h{i:02}", template + " " + " ".join(f"u{rng.randrange(10_000)}" for _ in range(3))) for i in range(40)]
    rows += [(f"o{i:03}", " ".join(f"z{rng.randrange(3_000)}" for _ in range(17))) for i in range(400)]
    got = {(r.row_id_a, r.row_id_b) for r in nd.near_duplicate_pairs(frame(spark, rows), hot_block=8).collect()}
    want = brute(rows)
    assert len(want) >= 700 and got == want


@pytest.mark.parametrize("hot", [nd.HOT_BLOCK, 16])
@pytest.mark.parametrize("shared,own", [(7, 2), (9, 2), (14, 3), (30, 8)])
def test_records_around_a_template(spark, shared, own, hot):
    """200 records that share a template, just above the threshold, among 3,000 others: every pair, hot or not."""
    rng = random.Random(shared)
    template = " ".join(f"t{i}" for i in range(shared))
    rows = [(f"h{i:03}", template + " " + " ".join(f"u{i}x{j}" for j in range(own))) for i in range(200)]
    rows += [(f"o{i:04}", " ".join(f"z{rng.randrange(2_000)}" for _ in range(shared + own))) for i in range(3_000)]
    got = {(r.row_id_a, r.row_id_b) for r in nd.near_duplicate_pairs(frame(spark, rows), hot_block=hot).collect()}
    inside = {p for p in got if p[0][0] == "h" and p[1][0] == "h"}
    assert len(inside) == 199 * 100 and all(p[0][0] == p[1][0] for p in got)


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_every_depth_is_exact(spark, monkeypatch, depth):
    """The depths of larger collections, forced on a small one of frequent words."""
    monkeypatch.setattr(nd, "path_depth", lambda total: depth)
    monkeypatch.setattr(nd, "COINCIDENCES", 2.0)
    rng = random.Random(depth)
    rows = [(f"q{i:04}", " ".join(f"w{x}" for x in rng.sample(range(90), rng.randrange(2, 60)))) for i in range(300)]
    for i in range(0, 300, 2):
        found = rows[i][1].split()
        rows.append((f"e{i:04}", " ".join([*found[: len(found) - rng.randrange(0, max(1, len(found) // 4) + 1)], f"w{rng.randrange(90)}"])))
    got = {(r.row_id_a, r.row_id_b) for r in nd.near_duplicate_pairs(frame(spark, rows)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("threshold", [0.8])
def test_other_threshold(spark, threshold):
    rows = corpus(9, 30)
    got = {(r.row_id_a, r.row_id_b) for r in nd.near_duplicate_pairs(frame(spark, rows), threshold).collect()}
    assert got == brute(rows, threshold)


def test_frequent_words_lose_no_pair(spark):
    """Every word in a tenth or more of the sets: no part of a set says much, and still every pair is found."""
    rng = random.Random(8)
    rows = [(f"q{i:04}", " ".join(f"w{x}" for x in rng.sample(range(60), rng.randrange(4, 26)))) for i in range(700)]
    for i in range(0, 700, 2):
        found = rows[i][1].split()
        rows.append((f"e{i:04}", " ".join([*found[: len(found) - rng.randrange(0, max(1, len(found) // 4) + 1)], f"w{rng.randrange(60)}"])))
    got = {(r.row_id_a, r.row_id_b) for r in nd.near_duplicate_pairs(frame(spark, rows)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("hot", [4096, 5])
def test_short_sets(spark, hot):
    """Sizes 1 to 8 against brute force, also where most blocks are hot."""
    rng = random.Random(21)
    rows = [("two", "red fox"), ("three", "a red fox")]
    rows += [(f"s{i:04}", " ".join(f"w{x}" for x in rng.sample(range(24), 1 + i % 8))) for i in range(640)]
    got = {(r.row_id_a, r.row_id_b) for r in nd.near_duplicate_pairs(frame(spark, rows), hot_block=hot).collect()}
    assert ("three", "two") in got and got == brute(rows)
