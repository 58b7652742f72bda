"""The k most similar vectors of every vector, by NN-descent (problem 4).

A neighbour graph is begun from random sign-hyperplane leaves (tables of leaves of about ``LEAF`` vectors,
all pairs in a leaf scored in one matrix product; a leaf costs far less than an iteration, so there are
``TABLES_PER_BIT`` tables for every bit of a leaf's name) and improved by NN-descent: every
vector sends itself to the vectors it lists, and all vectors that meet at one (the neighbours of a
neighbour) are scored against each other; what beats a vector's present k-th similarity is sent to it
and merged.  Queries from outside walk the graph greedily.

Scale: an iteration is three shuffles, of edges, of 2*n*k eight-bit quantized vectors and of the improvements.  No
step compares all vectors.  A leaf or a meeting point that is larger than its bound (one vector
repeated in a third of all rows, a hub) is split at random into groups of bounded size, so no group is
unbounded; a meeting point is split anew in every iteration, and its members are all scored each time,
so iterations mend what a split separates.  Similarities are computed on quantized vectors
(error about 0.001) while the graph is built and again in full precision for what is returned.

Defined results: vectors that are null, all zero, not of length ``dimensions``, holding a null or not
finite take no part, nor do rows with a null id or space; a redelivered (space_id, memory_id) is one
vector, its first by ingested_at if they differ; a space with one usable vector gives no row; ties go to
the smaller internal number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.plans.staging import Staging

K = 10
LISTED = 20
#: Tables of leaves per bit of a leaf's name: the more leaves, the rarer two near vectors share one, so tables grow with the bits.
TABLES_PER_BIT = 3
#: Best members of its leaf that a vector takes from each table.
LEAF_KEEP = 6
LEAF = 400
LEAF_MOST = 1600
MEET_MOST = 96
MOST_ITERATIONS = 10
#: NN-descent ends when this share of all listed neighbours, or less, came in the last iteration.
SETTLED = 0.05
#: Below this share of fresh edges, points without any are sought out and left out.
QUIET = 0.05
SEED = 20240229

_LISTS = "id long, nbr array<long>, sim array<float>, fresh array<boolean>"


def usable_vectors(rows: DataFrame) -> DataFrame:
    """(space_id, memory_id, vector, dim) of the rows that take part, each key once."""
    ok = rows.filter("space_id IS NOT NULL AND memory_id IS NOT NULL AND vector IS NOT NULL AND size(vector) = dimensions")
    ok = ok.filter(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0))
    first = F.row_number().over(Window.partitionBy("space_id", "memory_id").orderBy("ingested_at"))
    return ok.select("space_id", "memory_id", "vector", "ingested_at").withColumn("place", first).filter("place = 1").select("space_id", "memory_id", "vector", F.size("vector").alias("dim"))


def _quantize(x: np.ndarray) -> np.ndarray:
    scale = 127.0 / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-30)
    return np.rint(x * scale).astype(np.int8)


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, space, dim, vector) to (id, space, code): unit vectors in eight bits."""
    for batch in batches:
        vectors = batch.column("vector").to_pylist()
        codes = []
        for v in vectors:
            x = np.asarray(v, dtype=np.float64)
            x = x / np.abs(x).max()
            codes.append(_quantize(x[None, :])[0].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("space"), pa.array(codes, type=pa.binary())], names=["id", "space", "code"])


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows from quantized codes of one length."""
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.int8).reshape(len(column), -1).astype(np.float32)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _leaf_rows(bits: dict[str, int]):
    """(id, space, code) to (leaf, id, code), a row for each table; a leaf's number is made of space, table and signs."""
    number = {space: i for i, space in enumerate(sorted(bits))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            spaces = np.array(batch.column("space").to_pylist(), dtype=object)
            for space in np.unique(spaces):
                mine = batch.filter(pa.array(spaces == space))
                x = _matrix(mine.column("code"))
                b, dim = bits[space], x.shape[1]
                for table in range(_tables(b)):
                    if (table, b, dim) not in planes:
                        planes[table, b, dim] = np.random.default_rng([SEED, table, dim]).normal(size=(dim, max(b, 1))).astype(np.float32)
                    sign = (x @ planes[table, b, dim] > 0).astype(np.int64) @ (1 << np.arange(max(b, 1), dtype=np.int64)) if b else np.zeros(len(x), dtype=np.int64)
                    leaf = pa.array((np.int64(number[space]) << 48) + (np.int64(table) << 40) + sign)
                    yield pa.RecordBatch.from_arrays([leaf, mine.column("id"), mine.column("code")], names=["leaf", "id", "code"])

    return run


def _lists(ids: np.ndarray, nbr: list[np.ndarray], sim: list[np.ndarray], fresh: list[np.ndarray] | None = None) -> pa.RecordBatch:
    sizes = np.array([len(x) for x in nbr], dtype=np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    flat = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, dtype=t)
    known = flat(fresh, bool) if fresh is not None else np.ones(int(sizes.sum()), dtype=bool)
    parts = [pa.ListArray.from_arrays(offsets, pa.array(a)) for a in (flat(nbr, np.int64), flat(sim, np.float32), known)]
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), *parts], names=["id", "nbr", "sim", "fresh"])


def _tables(bits: int) -> int:
    return max(1, TABLES_PER_BIT * bits)


def _leaf_best(bits: dict[str, int]):
    """Function from a leaf, all pairs of which are scored, to each member's best."""
    keeps = [max(LEAF_KEEP, math.ceil(LISTED / _tables(bits[space]))) for space in sorted(bits)]

    def best_of(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        if len(ids) < 2:
            return pa.Table.from_batches([_lists(np.empty(0), [], [])])
        x = _matrix(table.column("code").combine_chunks())
        s = x @ x.T
        np.fill_diagonal(s, -3.0)
        keep = min(keeps[key[0].as_py() >> 48], len(ids) - 1)
        best = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
        return pa.Table.from_batches([_lists(ids, list(ids[best]), list(np.take_along_axis(s, best, axis=1)))])

    return best_of


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of one id, one after another, to its best ``LISTED`` distinct neighbours; a known one is no longer fresh."""
    for batch in batches:
        nbr, sim, fresh = (batch.column(c) for c in ("nbr", "sim", "fresh"))
        sizes = nbr.value_lengths().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        n, s, f = (c.flatten().to_numpy(zero_copy_only=False) for c in (nbr, sim, fresh))
        order = np.lexsort((f, n, owner))  # of equal neighbours the one that is not fresh comes first
        owner, n, s, f = owner[order], n[order], s[order], f[order]
        keep = np.r_[True, (owner[1:] != owner[:-1]) | (n[1:] != n[:-1])] if len(n) else np.empty(0, dtype=bool)
        owner, n, s, f = owner[keep], n[keep], s[keep], f[keep]
        order = np.lexsort((n, -s, owner))
        owner, n, s, f = owner[order], n[order], s[order], f[order]
        starts = np.searchsorted(owner, np.arange(len(sizes)))
        keep = np.arange(len(owner)) - starts[owner] < LISTED
        owner, n, s, f = owner[keep], n[keep], s[keep], f[keep]
        cut = np.searchsorted(owner, np.arange(len(sizes) + 1))
        parts = [pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(a)) for a in (n, s, f.astype(bool))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *parts], names=["id", "nbr", "sim", "fresh"])


def _merge(lists: DataFrame) -> DataFrame:
    gathered = lists.groupBy("id").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("nbr", "sim", "fresh")])
    return gathered.mapInArrow(_merged, _LISTS)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members that meet at one vector, scored against each other where one of the two came freshly."""
    for batch in batches:
        ids, sims, owners, n_rows = [], [], [], 0
        members, codes, least, fresh = (batch.column(c) for c in ("ids", "codes", "least", "fresh"))
        bounds = members.offsets.to_numpy()
        flat_ids = members.values.to_numpy(zero_copy_only=False)
        flat_least = least.values.to_numpy(zero_copy_only=False)
        flat_fresh = fresh.values.to_numpy(zero_copy_only=False)
        flat_codes = codes.values
        for i in range(len(batch)):
            lo, hi = bounds[i], bounds[i + 1]
            if hi - lo < 2:
                continue
            own, new = flat_ids[lo:hi], flat_fresh[lo:hi]
            once = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])  # sorted by id; an edge both ways brings a member twice
            new = np.maximum.reduceat(new, once)
            own, x = own[once], _matrix(flat_codes.slice(lo, hi - lo))[once]
            s = x @ x.T
            good = (s > flat_least[lo:hi][once, None]) & (new[:, None] | new[None, :])
            np.fill_diagonal(good, False)
            good &= own[:, None] != own[None, :]
            a, b = np.nonzero(good)
            if not len(a):
                continue
            ids.append(own[b])
            sims.append(s[a, b])
            owners.append(own[a])
            n_rows += len(a)
        if not n_rows:
            continue
        owner, nbr, sim = np.concatenate(owners), np.concatenate(ids), np.concatenate(sims)
        order = np.lexsort((-sim, nbr, owner))
        owner, nbr, sim = owner[order], nbr[order], sim[order]
        keep = np.r_[True, (owner[1:] != owner[:-1]) | (nbr[1:] != nbr[:-1])]
        owner, nbr, sim = owner[keep], nbr[keep], sim[keep]
        heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        offsets = pa.array(np.r_[heads, len(owner)].astype(np.int32))
        parts = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (nbr, sim.astype(np.float32), np.ones(len(nbr), dtype=bool))]
        yield pa.RecordBatch.from_arrays([pa.array(owner[heads]), *parts], names=["id", "nbr", "sim", "fresh"])


def _joined(graph: DataFrame, codes: DataFrame, iteration: int, quiet: bool = False) -> DataFrame:
    """One NN-descent iteration's improvements, as lists to merge.

    Members of a split point were not all together before, so there they count as fresh.  A point that no
    fresh edge touches has nothing to score; ``quiet`` leaves such points out before vectors are sent, which
    pays once most edges are old.
    """
    least = F.when(F.size("nbr") >= LISTED, F.element_at("sim", -1)).otherwise(F.lit(-2.0).cast("float"))
    edges = graph.select(F.col("id").alias("from_id"), F.explode(F.arrays_zip("nbr", "fresh")).alias("to")).select("from_id", F.col("to.nbr").alias("to_id"), F.col("to.fresh").alias("fresh"))
    # both ends of an edge meet at either: neighbours of neighbours along and against the edges
    along = edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("at"), "fresh")
    against = edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("at"), "fresh")
    itself = graph.select("id", F.col("id").alias("at"), F.lit(True).alias("fresh"))
    degree = edges.groupBy(F.col("to_id").alias("at")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MEET_MOST).select("at", F.ceil((F.col("n") + LISTED) / MEET_MOST).cast("int").alias("parts"))
    ends = along.unionByName(against)
    if quiet:
        live = ends.filter("fresh").select("at").unionByName(degree.select("at")).distinct()
        ends, itself = ends.join(live, "at", "left_semi"), itself.join(live, "at", "left_semi")
    meet = ends.select("id", "at", "fresh").unionByName(itself.select("id", "at", "fresh")).join(codes.select("id", "code").join(graph.select("id", least.alias("least")), "id"), "id")
    split = meet.join(degree, "at", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("at", "id", F.lit(iteration)), "parts")).otherwise(F.lit(0)))
    split = split.withColumn("fresh", F.col("fresh") | F.col("parts").isNotNull())
    rows = F.sort_array(F.collect_list(F.struct("id", "code", "least", "fresh")))
    groups = split.groupBy("at", "part").agg(rows.alias("m")).select(F.col("m.id").alias("ids"), F.col("m.code").alias("codes"), F.col("m.least").alias("least"), F.col("m.fresh").alias("fresh"))
    return groups.mapInArrow(_meetings, _LISTS)


def neighbour_graph(vectors: DataFrame, stage: Staging, most_iterations: int = MOST_ITERATIONS) -> tuple[DataFrame, DataFrame]:
    """(numbered vectors with id, graph of lists) of ``vectors(space_id, key, vector)``."""
    numbered = stage.cut(vectors.withColumn("id", F.monotonically_increasing_id()).withColumn("space", F.concat_ws("\x01", "space_id", F.size("vector").cast("string"))))
    sizes = {r["space"]: r["n"] for r in numbered.groupBy("space").agg(F.count(F.lit(1)).alias("n")).collect()}
    bits = {space: max(0, round(math.log2(n / LEAF))) if n > LEAF else 0 for space, n in sizes.items()}
    codes = stage.cut(numbered.select("id", "space", "vector").mapInArrow(_codes, "id long, space string, code binary"))
    leaves = codes.mapInArrow(_leaf_rows(bits), "leaf long, id long, code binary")
    crowded = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LEAF_MOST).select("leaf", F.ceil(F.col("n") / LEAF).cast("int").alias("parts"))
    placed = leaves.join(crowded, "leaf", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("leaf", "id"), "parts")).otherwise(F.lit(0)))
    begun = placed.select("leaf", "part", "id", "code").groupBy("leaf", "part").applyInArrow(_leaf_best(bits), _LISTS)
    graph, share = stage.cut(_merge(begun)), 1.0
    for iteration in range(most_iterations):
        old = graph.select("id", "nbr", "sim", F.transform("fresh", lambda x: F.lit(False)).alias("fresh"))
        after = stage.cut(_merge(old.unionByName(_joined(graph, codes, iteration, share < QUIET))))
        stage.drop(graph)
        graph = after
        came = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x))).alias("new"), F.sum(F.size("nbr")).alias("listed")).first()
        share = (came["new"] or 0) / max(came["listed"] or 0, 1)
        if share <= SETTLED:
            break
    return numbered, graph


def _cosine(a: str, b: str):
    x, y = F.transform(a, lambda v: v.cast("double")), F.transform(b, lambda v: v.cast("double"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda i, j: i * j), F.lit(0.0), lambda s, v: s + v)
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def nearest(vectors: DataFrame, k: int = K, at_least: float | None = None) -> DataFrame:
    """(space_id, key_a, key_b, similarity, place): of each vector its k most similar ones of its space.

    With ``at_least`` only those of that similarity, which spares the exact scoring of the others.
    """
    stage = Staging(vectors.sparkSession, "neighbours")
    numbered, graph = neighbour_graph(vectors.select("space_id", "key", "vector"), stage)
    rows = graph.select("id", F.posexplode(F.arrays_zip("nbr", "sim")).alias("pos", "n")).select("id", F.col("n.nbr").alias("other"), F.col("n.sim").alias("rough"), "pos")
    if at_least is not None:
        rows = rows.filter(F.col("rough") >= at_least - 0.01)
    rows = stage.cut(rows.filter(F.col("pos") < k + 4))
    left = numbered.select("id", "space_id", F.col("key").alias("key_a"), F.col("vector").alias("va"))
    right = numbered.select(F.col("id").alias("other"), F.col("key").alias("key_b"), F.col("vector").alias("vb"))
    scored = rows.join(left, "id").join(right, "other").select("space_id", "key_a", "key_b", _cosine("va", "vb").alias("similarity"))
    place = F.row_number().over(Window.partitionBy("space_id", "key_a").orderBy(F.desc("similarity"), "key_b"))
    out = scored.withColumn("place", place).filter(F.col("place") <= k)
    return out.filter(F.col("similarity") >= at_least) if at_least is not None else out


def similar_pairs(rows: DataFrame, at_least: float = 0.90, k: int = K) -> DataFrame:
    """(space_id, memory_id_a, memory_id_b), a < b: pairs at that cosine of which one is in the other's k best."""
    vectors = usable_vectors(rows).select("space_id", F.col("memory_id").alias("key"), "vector")
    found = nearest(vectors, k, at_least)
    return found.select("space_id", F.least("key_a", "key_b").alias("memory_id_a"), F.greatest("key_a", "key_b").alias("memory_id_b")).distinct()


def graph_search(vectors: DataFrame, queries: DataFrame, k: int = K, beam: int = 48) -> DataFrame:
    """(query, key, similarity, place): greedy search of the neighbour graph of ``vectors(space_id, key, vector)``.

    ``queries(query, space_id, vector)`` start at spread entry vectors of their space and length; each
    round opens the unopened members of a query's beam and keeps the best ``beam`` of what they list, until
    none is unopened (the beam only improves, so this ends).  ``query`` names one query over all spaces.
    """
    stage = Staging(vectors.sparkSession, "graph-search")
    numbered, graph = neighbour_graph(vectors.select("space_id", "key", "vector"), stage)
    known = numbered.select("id", F.col("vector").alias("vb"))
    ask = stage.cut(queries.select("query", F.concat_ws("\x01", "space_id", F.size("vector").cast("string")).alias("space"), F.col("vector").alias("va")))
    entry = numbered.withColumn("e", F.row_number().over(Window.partitionBy("space").orderBy(F.xxhash64("id")))).filter(F.col("e") <= beam).select("id", "space", F.col("vector").alias("vb"))
    scored = ask.join(entry, "space").select("query", "id", _cosine("va", "vb").alias("similarity"), F.lit(False).alias("opened"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    state = stage.cut(scored.withColumn("place", best).filter(F.col("place") <= beam).drop("place"))
    both_ways = stage.cut(
        graph.select("id", F.explode("nbr").alias("other"))
        .unionByName(graph.select(F.explode("nbr").alias("id"), F.col("id").alias("other")))
        .distinct()
    )
    while not state.filter("NOT opened").isEmpty():
        steps = state.filter("NOT opened").join(both_ways, "id").select("query", F.col("other").alias("id")).distinct().join(state.select("query", "id"), ["query", "id"], "left_anti")
        fresh = steps.join(ask, "query").join(known, "id").select("query", "id", _cosine("va", "vb").alias("similarity"), F.lit(False).alias("opened"))
        pool = state.withColumn("opened", F.lit(True)).unionByName(fresh)
        after = stage.cut(pool.withColumn("place", best).filter(F.col("place") <= beam).drop("place"))
        stage.drop(state)
        state = after
    named = state.join(numbered.select("id", "key"), "id")
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "key"))
    return named.withColumn("place", order).filter(F.col("place") <= k).select("query", "key", "similarity", "place")
