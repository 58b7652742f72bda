"""Evaluation of rankings: recall, reciprocal rank, hard checks; conflict, duplicate and degradation rates.

Three evaluators differ on purpose.  ``golden`` removes repeated ids before it cuts, averages unrounded
values and counts every forbidden occurrence; ``embedding`` and ``lexical`` keep repeats, average the
rounded values of the cases and count distinct forbidden ids.

``rankings(query_id, rank, memory_id)`` with ranks from 1; ``labels(query_id, memory_id)`` distinct pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """The quotient rounded to six digits, 0 where the denominator is 0."""
    return F.coalesce(F.round(F.when(denominator != 0, numerator / denominator), 6), F.lit(0.0))


def to_fixed(value: Column) -> Column:
    """Six digits of the exact binary value, where ``round`` sees the shortest decimal one; exact ties go up."""
    tie = value * 128 == F.floor(value * 128)  # only multiples of 1/128 can lie midway between two sixth digits
    return F.when(tie, F.round(value, 6)).otherwise(F.regexp_replace(F.format_number(value, 6), ",", "").cast("double"))


def distinct_ranks(rankings: DataFrame) -> DataFrame:
    """Rankings without repeated ids, ranked anew by first occurrence."""
    first = rankings.groupBy("query_id", "memory_id").agg(F.min("rank").alias("first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).drop("first")


def per_query(rankings: DataFrame, relevant: DataFrame, keep_repeats: bool) -> DataFrame:
    """(query_id, n_relevant, hits5, hits10, first_rank) of every query with labels."""
    ranked = rankings if keep_repeats else distinct_ranks(rankings)
    wanted = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    met = ranked.filter("rank <= 10").join(relevant, ["query_id", "memory_id"])
    hit = lambda k: F.countDistinct(F.when(F.col("rank") <= k, F.col("memory_id")))
    got = met.groupBy("query_id").agg(hit(5).alias("hits5"), hit(10).alias("hits10"), F.min("rank").alias("first_rank"))
    return wanted.join(got, "query_id", "left").fillna(0, ["hits5", "hits10"])


def cases(rankings: DataFrame, relevant: DataFrame, keep_repeats: bool = True) -> DataFrame:
    """(query_id, recall5, recall10, reciprocal, first_rank), rounded to six digits."""
    rows = per_query(rankings, relevant, keep_repeats)
    return rows.select(
        "query_id",
        F.round(F.col("hits5") / F.col("n_relevant"), 6).alias("recall5"),
        F.round(F.col("hits10") / F.col("n_relevant"), 6).alias("recall10"),
        F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("reciprocal"),
        "first_rank",
    )


def golden(rankings: DataFrame, relevant: DataFrame) -> DataFrame:
    """One row: macro and micro recall at 5 and 10 and MRR at 10 over the queries with labels."""
    rows = per_query(rankings, relevant, keep_repeats=False)
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return rows.agg(
        F.count(F.lit(1)).alias("scored_queries"),
        F.coalesce(F.sum("n_relevant"), F.lit(0)).alias("relevant_items"),
        mean(F.col("hits5") / F.col("n_relevant")).alias("recall5_macro"),
        ratio(F.sum("hits5"), F.sum("n_relevant")).alias("recall5_micro"),
        mean(F.col("hits10") / F.col("n_relevant")).alias("recall10_macro"),
        ratio(F.sum("hits10"), F.sum("n_relevant")).alias("recall10_micro"),
        mean(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr10"),
    )


#: The cells of the retrieval report, and the scenarios and languages of the life-cycle report.
BUCKETS = ["synonym", "pronoun", "multi_topic", "current_head", "temporal", "cross_session", "exact_id"]
LANGUAGES = ["zh", "en"]
SCENARIOS = ["nominal", "injected_model_failure", "invalid_json", "schema_failure"]


def _grid(spark, columns: dict[str, list[str]]) -> DataFrame:
    rows = [[]]
    for values in columns.values():
        rows = [[*r, v] for r in rows for v in values]
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} string" for c in columns))


def golden_cells(rankings: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """(bucket, language, n_queries, n_relevant, n_negative, recall5, recall10, mrr10) of the fixed cells.

    Unrounded macro averages over distinct ids; queries without labels count as negative only, empty cells are 0.
    ``queries(query_id, bucket, language)``.
    """
    rows = queries.select("query_id", "bucket", "language").join(per_query(rankings, relevant, keep_repeats=False), "query_id", "left")
    scored = F.col("n_relevant").isNotNull()
    got = rows.groupBy("bucket", "language").agg(
        F.count(F.lit(1)).alias("n_queries"), F.count("n_relevant").alias("n_relevant"), F.count_if(~scored).alias("n_negative"),
        F.avg(F.col("hits5") / F.col("n_relevant")).alias("recall5"), F.avg(F.col("hits10") / F.col("n_relevant")).alias("recall10"),
        F.avg(F.when(scored, F.coalesce(1 / F.col("first_rank"), F.lit(0.0)))).alias("mrr10"),
    )
    cells = F.broadcast(_grid(queries.sparkSession, {"bucket": BUCKETS, "language": LANGUAGES})).join(got, ["bucket", "language"], "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_queries", "n_relevant", "n_negative")]
    return cells.select("bucket", "language", *counts, *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("recall5", "recall10", "mrr10")])


def by_cells(rows: DataFrame, attributes: DataFrame, cells: list[list[str]]) -> DataFrame:
    """Averages of the rounded ``cases`` over grouping sets of query attributes, in one pass; absent attributes are null."""
    joined = rows.join(attributes, "query_id")
    names = sorted({c for cell in cells for c in cell})
    sets = [[F.col(c) for c in cell] for cell in cells]
    out = joined.groupingSets(sets, *names).agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall5", "recall10", "reciprocal")])
    return out.select(*names, "n_queries", "recall5", "recall10", "reciprocal")


def mode_report(modes: dict[str, DataFrame], attributes: DataFrame, leave_out: str = "filter") -> DataFrame:
    """(mode, bucket, n_queries, recall5, recall10, reciprocal) of the cases of each tokenizer mode, overall (bucket null) and by bucket.

    Of two modes a row ``delta`` follows, the overall figures of the second less those of the first.
    """
    names, parts = list(modes), []
    for name in names:
        part = by_cells(modes[name], attributes.filter(F.col("bucket") != leave_out), [[], ["bucket"]])
        parts.append(part.select(F.lit(name).alias("mode"), "bucket", "n_queries", "recall5", "recall10", "reciprocal"))
    if len(names) == 2:
        one, two = (p.filter("bucket IS NULL").select(*[F.col(c).alias(f"{c}_{i}") for c in ("n_queries", "recall5", "recall10", "reciprocal")]).withColumn("k", F.lit(1)) for i, p in enumerate(parts))
        less = [F.round(F.col(f"{c}_1") - F.col(f"{c}_0"), 6).alias(c) for c in ("recall5", "recall10", "reciprocal")]
        parts.append(one.join(two, "k").select(F.lit("delta").alias("mode"), F.lit(None).cast("string").alias("bucket"), F.col("n_queries_1").alias("n_queries"), *less))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hard_checks(rankings: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(query_id, forbidden_hits, forbidden_ids, duplicate_ids): occurrences, distinct ids, repeats."""
    marked = rankings.join(forbidden.withColumn("bad", F.lit(True)), ["query_id", "memory_id"], "left")
    return marked.groupBy("query_id").agg(
        F.count_if(F.col("bad")).alias("forbidden_hits"),
        F.countDistinct(F.when(F.col("bad"), F.col("memory_id"))).alias("forbidden_ids"),
        (F.count(F.lit(1)) - F.countDistinct("memory_id")).alias("duplicate_ids"),
    )


def conflict_label(expected: Column, observed: Column) -> Column:
    """TP, FN, FP or TN of SUPERSEDE; null where either is unknown."""
    yes, seen = expected == "SUPERSEDE", observed == "SUPERSEDE"
    return F.when(expected.isNull() | observed.isNull(), F.lit(None)).when(yes, F.when(seen, "TP").otherwise("FN")).otherwise(F.when(seen, "FP").otherwise("TN"))


def _by_language(spark, rows: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """Counts of ``rows`` overall (language null) and for each fixed language, 0 where there are none."""
    got = rows.groupingSets([[], [F.col("language")]], "language").agg(*[c.alias(n) for n, c in counts.items()])
    grid = spark.createDataFrame([(None,), *[(x,) for x in LANGUAGES]], "cell string")
    met = F.broadcast(grid).join(got, F.col("cell").eqNullSafe(F.col("language")), "left")
    return met.select(F.col("cell").alias("language"), *[F.coalesce(n, F.lit(0)).alias(n) for n in counts])


def confusion(observations: DataFrame) -> DataFrame:
    """(language, true_positive, true_negative, false_positive, false_negative, accuracy): conflicts among nominal cases, overall and by language.

    ``observations(language, fault_scenario, expected, observed)``; cases without an expected operation are left
    out, and an unknown observed one is no conflict.
    """
    nominal = observations.filter("fault_scenario = 'nominal' AND expected IS NOT NULL")
    yes, seen = F.col("expected") == "SUPERSEDE", F.coalesce(F.col("observed") == "SUPERSEDE", F.lit(False))
    kinds = {"true_positive": yes & seen, "true_negative": ~yes & ~seen, "false_positive": ~yes & seen, "false_negative": yes & ~seen}
    counted = _by_language(observations.sparkSession, nominal, {n: F.count_if(c) for n, c in kinds.items()})
    right = F.col("true_positive") + F.col("true_negative")
    return counted.withColumn("accuracy", ratio(right, right + F.col("false_positive") + F.col("false_negative")))


def compression(observations: DataFrame) -> DataFrame:
    """(language, total, compressed, value): measured duplicates that made no new record and gave their evidence to the expected one."""
    measured = observations.filter("duplicate_measured")
    good = F.coalesce(F.col("no_new_active_derived") & F.col("evidence_attached"), F.lit(False))
    counted = _by_language(observations.sparkSession, measured, {"total": F.count(F.lit(1)), "compressed": F.count_if(good)})
    return counted.withColumn("value", ratio(F.col("compressed"), F.col("total")))


def degradation(observations: DataFrame) -> DataFrame:
    """(fault_scenario, accepted, degraded, value) of each fixed scenario."""
    got = observations.groupBy("fault_scenario").agg(F.count(F.lit(1)).alias("accepted"), F.count_if(F.col("receipt_status") == "degraded").alias("degraded"))
    rows = F.broadcast(_grid(observations.sparkSession, {"fault_scenario": SCENARIOS})).join(got, "fault_scenario", "left")
    rows = rows.select("fault_scenario", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("accepted", "degraded")])
    return rows.withColumn("value", ratio(F.col("degraded"), F.col("accepted")))


def relative_gain(baseline: Column, value: Column) -> Column:
    """(value - baseline) / baseline; from a zero baseline any gain is infinite and none is 0."""
    return F.when(baseline != 0, (value - baseline) / baseline).when(value > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def gate(cells: DataFrame, gates: DataFrame, keys: list[str], tolerance: float = 2.220446049250313e-16) -> DataFrame:
    """``gates(*keys, least)`` with the cell's value and whether it passes; a missing cell fails."""
    return gates.join(cells, keys, "left").withColumn("passed", F.coalesce(F.col("value") + tolerance >= F.col("least"), F.lit(False)))
