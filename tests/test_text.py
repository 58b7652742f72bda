from pyspark.sql import functions as F

from mnemospark.functions import text, vectors
from mnemospark.operators import retrieval


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    cases = {
        "Hello World42": ["hello", "world42"],
        "机器学习": ["机器", "器学", "学习"],
        "我": ["我"],
        "用GPT模型": ["用", "gpt", "模型"],
        "a_b-c.d": ["a", "b", "c", "d"],
        "!!! ，。": [],
        "": [],
        "naïve": ["na", "ve"],
    }
    for body, want in cases.items():
        assert one(spark, text.tokenize(F.lit(body))) == want
    assert one(spark, text.tokenize(F.lit(None).cast("string"))) == []
    assert one(spark, text.tokenize_runs(F.lit("用GPT模型"))) == ["用", "gpt", "模型"]


def test_intent(spark):
    cases = {"see `x`": "navigational", "open /etc/hosts/": "navigational", "用user_id": "navigational", "camelCase here": "navigational", "Why so": "conceptual", "为什么": "conceptual", "plain words": "factual", "": "factual"}
    for body, want in cases.items():
        assert one(spark, text.intent(F.lit(body))) == want, body


def test_tags_and_clip(spark):
    tags = F.array(F.lit(" A "), F.lit("a"), F.lit(""), F.lit(None).cast("string"), F.lit(" B\t"))
    assert one(spark, text.normalize_tags(tags)) == ["a", "b"]
    assert one(spark, text.normalize_tags(F.lit(None).cast("array<string>"))) == []
    many = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: i.cast("string"))
    assert len(one(spark, text.normalize_tags(many))) == 32
    assert one(spark, text.clip(F.lit("　 ab  cd"), 5)) == "ab"


def test_hash_features_agree(spark):
    rows = spark.createDataFrame([("a", "Hello 世界 hello"), ("b", ""), ("c", None), ("d", "x")], "k string, body string")
    fast = {(r.k, r.dim): r.cell for r in retrieval.hash_table(rows, "k").collect()}
    slow = rows.select("k", F.inline(text.hash_cells(F.col("body")))).groupBy("k", "dim").agg(F.sum("sign").alias("cell"))
    assert fast == {(r.k, r.dim): r.cell for r in slow.collect()}
    assert one(spark, text.fnv1a(F.lit("t:世"))) == text.fnv1a_of("t:世")
    dense = {r.k: r.vector for r in retrieval.hash_embedding(rows, "k").collect()}
    assert abs(sum(x * x for x in dense["a"]) - 1) < 1e-9 and not any(dense["b"])


def test_vectors(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, vectors.cosine(arr(1, 0), arr(1, 1))) == 0.7071067811865475
    assert one(spark, vectors.cosine(arr(1, 0), arr(1, 1, 1))) == 0
    assert one(spark, vectors.cosine(arr(0, 0), arr(1, 1))) == 0
    assert one(spark, vectors.cosine(F.lit(None).cast("array<double>"), arr(1, 1))) == 0
    assert one(spark, vectors.unit(arr(3, 4), F.lit(2))) == [0.6, 0.8]
    assert one(spark, vectors.unit(arr(3, 4), F.lit(3))) is None
    assert one(spark, vectors.unit(arr(0, 0), F.lit(2))) is None
