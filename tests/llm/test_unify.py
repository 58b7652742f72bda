import unicodedata

from mnemospark.llm import unify

SCHEMA = "key long, body string, digest string"
PAIRS = [
    ("Ａｂ１２", "Ab12"), ("café", "café"), ("a b　c", "a b c"), ("soft­hy​phen﻿", "softhyphen"), ("well‑known‐x", "well-known-x"), ("⼈⼭", "人山"), ("路北", "路北"),
    ("сору", "copy"), ("Аррlе", "Apple"), ("ΑΒΕ", "ABE"), ("ёж", "ëж"), ("ёж", "ëж"), ("ｅ́", "é"), ("օne", "one"), ("q̣̇", "q̣̇"),
]
APART = [("Ab", "ab"), ("cafe", "café"), ("x²", "x2"), ("a b", "b a"), ("a，b", "a,b"), ("a  b", "a b"), ("a-b", "ab"), ("é", "è"), ("", " "), ("①", "1"), ("ﬁ", "fi")]


def forms(spark, texts):
    rows = spark.createDataFrame([(i, t, "d") for i, t in enumerate(texts)], SCHEMA)
    return {r.key: r.form for r in unify.consistent_forms(rows).collect()}


def test_same_and_apart(spark):
    flat = [t for p in PAIRS + APART for t in p]
    got = forms(spark, flat)
    for i, (a, b) in enumerate(PAIRS + APART):
        assert (got[2 * i] == got[2 * i + 1]) == (i < len(PAIRS)), (a, b, got[2 * i], got[2 * i + 1])
    assert all(f == unicodedata.normalize("NFC", f) for f in got.values())
    assert forms(spark, list(got.values())) == got  # a form is its own form


def test_pairs_and_classes(spark):
    long = "長い文" * 50_000
    rows = [(5, "Ａ"), (3, "A"), (9, "Α"), (3, "A"), (1, None), (None, "A"), (7, ""), (8, "​"), (20, long), (21, long + "⁠")]
    frame = spark.createDataFrame([(k, b, "d") for k, b in rows], SCHEMA)
    assert {tuple(r) for r in unify.same_look_pairs(frame).collect()} == {(3, 5), (3, 9), (5, 9), (7, 8), (20, 21)}
    classes = {(r.key, r.class_id) for r in unify.look_classes(frame).collect()}
    assert classes == {(3, 3), (5, 3), (9, 3), (7, 7), (8, 7), (20, 20), (21, 20)}
    assert forms(spark, [None]) == {0: None}
    empty = spark.createDataFrame([], SCHEMA)
    assert unify.same_look_pairs(empty).count() == 0 and unify.look_classes(empty).count() == 0 and unify.consistent_forms(empty).count() == 0


def test_tables_are_one_to_one_characters():
    assert all(len(a) == 1 and len(b) == 1 for a, b in unify.character_map().items())
