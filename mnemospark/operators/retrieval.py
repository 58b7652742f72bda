"""Hybrid retrieval of many queries over many owners at once.

Queries meet documents through *pools*: an owner's recallable records of one channel, all of them or one
session's.  BM25 statistics belong to a pool, not to a query, so they are counted once however many
queries share it, and only postings of asked-for terms are joined.  Scores are rounded to 9 digits before
they are ranked, which makes ties independent of the order of summation, and every rank ends in the id.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import text, vectors
from mnemospark.plans.staging import Staging


@dataclass(frozen=True)
class SearchConfig:
    """Fixed defaults of the search."""

    recall_limit: int = 8
    profile_limit: int = 4
    min_semantic_score: float = 0.08
    rrf_k: float = 60.0
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    reconcile_limit: int = 12
    max_context_chars: int = 6000


PROFILE_LAYERS = ["l0_basic_info", "l4_identity"]
DIGITS = 9

#: Channel weights by intent, (semantic, lexical).
WEIGHTS = {"navigational": (0.4, 1.4), "conceptual": (1.1, 0.5), "factual": (1.0, 0.8)}


def scope_key(tenant: str = "tenant_id", user: str = "user_id", agent: str = "agent_id") -> Column:
    """One text an owner: a JSON array, so that no mark inside an id can make two owners one; an absent tenant is empty."""
    return F.to_json(F.array(*[F.coalesce(c, F.lit("")) for c in (tenant, user, agent)]))


def channel(layer: Column) -> Column:
    return F.when(layer.isin(PROFILE_LAYERS), "profile").otherwise("normal")


def valid_at(as_of: Column) -> Column:
    """valid_from <= as_of < valid_until, null bounds being open."""
    return F.coalesce(F.col("valid_from") <= as_of, F.lit(True)) & F.coalesce(F.col("valid_until") > as_of, F.lit(True))


def recallable(records: DataFrame, as_of: Column) -> DataFrame:
    """Active, recallable and valid records."""
    return records.filter((F.col("status") == "active") & (F.col("visibility") == "recallable") & valid_at(as_of))


def search_text() -> Column:
    """Content and tags as one lexical document."""
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(text.trim_all(F.coalesce(t, F.lit("")))))
    return F.concat(F.coalesce("content", F.lit("")), F.lit("\n"), F.array_join(tags, " "))


def query_pools(queries: DataFrame) -> DataFrame:
    """queries with pool: the owner, and the session where the query asks for it alone."""
    session = F.when(F.coalesce("session_only", F.lit(False)), F.concat(F.lit("s:"), F.coalesce("session_id", F.lit("")))).otherwise(F.lit("*"))
    return queries.withColumn("pool", F.concat_ws("#", scope_key(), session))


def document_pools(records: DataFrame, queries: DataFrame) -> DataFrame:
    """A row per record and asked-for pool it is in, with its channel and the blocks that the pool's queries are dealt into."""
    pools = F.array(F.lit("*"), F.concat(F.lit("s:"), F.coalesce("source_session_id", F.lit(""))))
    rows = records.withColumn("part", F.explode(pools)).withColumn("pool", F.concat_ws("#", scope_key(), "part")).drop("part")
    return rows.withColumn("channel", channel(F.col("layer"))).join(asked_pools(queries), "pool")


def asked_pools(queries: DataFrame) -> DataFrame:
    """(pool, ask_blocks)"""
    return queries.groupBy("pool").agg(F.ceil(F.count(F.lit(1)) / POOL_BLOCK).cast("int").alias("ask_blocks"))


#: A tokenizer that gives more tokens than this, or a longer one, has failed.
MOST_TOKENS, MOST_TOKEN_CHARS = 100_000, 256


def tokenizer_failed(tokens: Column) -> Column:
    return (F.size(tokens) > MOST_TOKENS) | F.exists(tokens, lambda t: t.isNull() | (t == "") | (F.length(t) > MOST_TOKEN_CHARS))


def closed_lexical(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id): queries whose lexical channel closes, since the tokenizer failed on the query or on a document of its pool."""
    bad = documents.filter(tokenizer_failed(F.col("tokens"))).select("pool").distinct()
    own = asked.filter(tokenizer_failed(F.col("tokens"))).select("query_id", "pool")
    return asked.select("query_id", "pool").join(bad, "pool", "left_semi").unionByName(own).select("query_id").distinct()


def bm25_of(asked: DataFrame, documents: DataFrame, k1: float, b: float) -> DataFrame:
    """``bm25`` of asked(query_id, pool, tokens) and documents(pool, channel, memory_id, tokens)."""
    sizes = documents.groupBy("pool", "channel").agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("tokens")).alias("mean_len"))
    postings = documents.select("pool", "channel", "memory_id", F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term"))
    terms = asked.select("query_id", "pool", F.explode(F.array_distinct("tokens")).alias("term"))
    postings = postings.join(terms.select("pool", "term").distinct(), ["pool", "term"], "left_semi")
    tf = postings.groupBy("pool", "channel", "term", "memory_id").agg(F.count(F.lit(1)).alias("tf"), F.first("doc_len").alias("doc_len"))
    df = tf.groupBy("pool", "channel", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    mean = F.when(F.col("mean_len") > 0, F.col("mean_len")).otherwise(F.lit(1.0))
    gain = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / mean))
    scored = tf.join(df, ["pool", "channel", "term"]).join(sizes, ["pool", "channel"]).select("pool", "channel", "term", "memory_id", gain.alias("gain"))
    met = terms.join(scored, ["pool", "term"])
    return met.groupBy("query_id", "pool", "channel", "memory_id").agg(F.round(F.sum("gain"), DIGITS).alias("lexical")).filter("lexical > 0")


def bm25(queries: DataFrame, documents: DataFrame, k1: float, b: float, tokenizer: text.Tokenizer = text.tokenize) -> DataFrame:
    """(query_id, pool, channel, memory_id, lexical): BM25 of queries(query_id, pool, body) over documents(pool, channel, memory_id, body)."""
    asked = queries.select("query_id", "pool", tokenizer(F.col("body")).alias("tokens"))
    return bm25_of(asked, documents.select("pool", "channel", "memory_id", tokenizer(F.col("body")).alias("tokens")), k1, b)


class _Hasher:
    """Signed cells of texts, the features of each token hashed once a task."""

    def __init__(self) -> None:
        self.find, self.known = re.compile(text.RUNS).findall, {}

    def __call__(self, body: str | None) -> dict[int, int]:
        total: dict[int, int] = {}
        for token in self.find(body) if body else ():
            token = token.lower()
            own = self.known.get(token)
            if own is None:
                if len(self.known) > 500_000:
                    self.known.clear()
                own = self.known[token] = [(h % text.HASH_DIMENSIONS, 1 - 2 * (h & 1)) for h in map(text.fnv1a_of, text.features_of(token))]
            for dim, sign in own:
                total[dim] = total.get(dim, 0) + sign
        return total


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, body) to (key, dim, cell)."""
    hasher = _Hasher()
    for batch in batches:
        found = [hasher(body) for body in batch.column(1).to_pylist()]
        key = batch.column(0).take(pa.array([i for i, c in enumerate(found) for _ in c], pa.int64()))
        dims, cells = pa.array([d for c in found for d in c], pa.int32()), pa.array([v for c in found for v in c.values()], pa.int64())
        yield pa.RecordBatch.from_arrays([key, dims, cells], names=["key", "dim", "cell"])


def _cell_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with body last to rows with dims and cells in its place."""
    hasher = _Hasher()
    for batch in batches:
        found = [hasher(body) for body in batch.column(batch.num_columns - 1).to_pylist()]
        lists = [pa.array([list(c) for c in found], pa.list_(pa.int16())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(batch.columns[:-1] + lists, names=batch.schema.names[:-1] + ["dims", "cells"])


def _unit_matrix(table: pa.Table, width: int) -> np.ndarray:
    out = np.zeros((table.num_rows, width))
    dims, cells = table.column("dims").combine_chunks(), table.column("cells").combine_chunks()
    row = np.repeat(np.arange(table.num_rows), dims.value_lengths().to_numpy(zero_copy_only=False))
    out[row, dims.flatten().to_numpy(zero_copy_only=False)] = cells.flatten().to_numpy(zero_copy_only=False)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def hash_table(rows: DataFrame, key: str) -> DataFrame:
    """(key, dim, cell): signed cells of the hash space of ``rows(key, body)``, zeros kept.

    Arrow batches, since features repeat from text to text: hashing each token once is some ten times
    faster than the same expression in built-in functions (``text.hash_cells``).
    """
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), "body").mapInArrow(_cells, f"key {kind}, dim int, cell long").withColumnRenamed("key", key)


def hash_embedding(rows: DataFrame, key: str) -> DataFrame:
    """(key, vector): dense hash vectors; a text without tokens has the zero vector."""
    cells = rows.select(F.col(key), text.hash_cells(F.col("body")).alias("cells"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(text.HASH_DIMENSIONS - 1)), lambda i: F.aggregate(F.filter("cells", lambda c: c["dim"] == i), F.lit(0), lambda s, c: s + c["sign"]))
    cells = cells.select(key, dense.alias("raw"))
    length = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
    return cells.select(key, F.when(length > 0, F.transform("raw", lambda x: x / length)).otherwise(F.transform("raw", lambda x: x.cast("double"))).alias("vector"))


#: Documents, and queries, of a pool that are scored in one matrix product.
POOL_BLOCK = 2048


def with_cells(rows: DataFrame, body: str) -> DataFrame:
    """``rows`` with dims and cells, the sparse hash vector, in place of the text column ``body``."""
    kept = [c for c in rows.columns if c != body]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != body)
    return rows.select(*kept, body).mapInArrow(_cell_lists, f"{kinds}, dims array<smallint>, cells array<int>")


def _dense_cells(rows: DataFrame, vector: str, width: int) -> DataFrame:
    """``rows`` with dims and cells in place of a dense vector of that width; other, zero and unusable vectors are left out."""
    good = (F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & vectors.non_zero(F.col(vector))
    dims = F.sequence(F.lit(0), F.lit(width - 1))
    return rows.filter(F.coalesce(good, F.lit(False))).withColumn("dims", dims).withColumn("cells", F.transform(vector, lambda x: x.cast("double"))).drop(vector)


def semantic_of(asks: DataFrame, docs: DataFrame, least: float, width: int = text.HASH_DIMENSIONS) -> DataFrame:
    """``semantic`` of asks(query_id, pool, dims, cells) and docs(pool, channel, memory_id, dims, cells)."""
    asks, docs = asks.filter("size(dims) > 0"), docs.filter("size(dims) > 0")
    blocks = lambda n: F.ceil(F.col(n) / POOL_BLOCK).cast("int")
    n_docs = docs.groupBy("pool", "channel").agg(F.count(F.lit(1)).alias("n")).select("pool", "channel", blocks("n").alias("doc_blocks"))
    n_asks = asks.groupBy("pool").agg(F.count(F.lit(1)).alias("n")).select("pool", blocks("n").alias("ask_blocks"))
    grid = n_docs.join(n_asks, "pool")
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    docs = docs.join(grid, ["pool", "channel"]).withColumn("doc_block", part("memory_id", "doc_blocks")).withColumn("ask_block", each("ask_blocks"))
    asks = asks.join(grid, "pool").withColumn("ask_block", part("query_id", "ask_blocks")).withColumn("doc_block", each("doc_blocks"))
    keys = ["pool", "channel", "doc_block", "ask_block"]
    named = [F.col(k).alias(k) for k in keys]  # both sides may stem from one table
    left, right = asks.select(*named, "query_id", "dims", "cells"), docs.select(*named, "memory_id", "dims", "cells")

    def score(key: tuple, a: pa.Table, d: pa.Table) -> pa.Table:
        kinds = pa.schema([("query_id", pa.string()), ("pool", pa.string()), ("channel", pa.string()), ("memory_id", pa.string()), ("semantic", pa.float64())])
        if not a.num_rows or not d.num_rows:
            return kinds.empty_table()
        s = np.round(_unit_matrix(a, width) @ _unit_matrix(d, width).T, DIGITS)
        i, j = np.nonzero(s >= least)
        pool, channel_name = key[0].as_py(), key[1].as_py()
        ids, docs_of = a.column("query_id").combine_chunks(), d.column("memory_id").combine_chunks()
        cols = [ids.take(pa.array(i)), pa.array([pool] * len(i), pa.string()), pa.array([channel_name] * len(i), pa.string()), docs_of.take(pa.array(j)), pa.array(s[i, j])]
        return pa.Table.from_arrays(cols, schema=kinds)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, "query_id string, pool string, channel string, memory_id string, semantic double")


def semantic_topk(ready: Prepared, most: int, config: SearchConfig = SearchConfig()) -> DataFrame:
    """(query_id, channel, memory_id, semantic, semantic_rank): the first ``most`` of every query and channel by the cosine of hash vectors."""
    none = F.lit(None).cast("array<string>")
    hits = fused(ready.asked.withColumn("tokens", none), ready.documents.withColumn("tokens", none), most, config)
    return hits.select("query_id", "channel", "memory_id", "semantic", "semantic_rank")


def _rank(*order: Column) -> Column:
    return F.row_number().over(Window.partitionBy("query_id", "channel").orderBy(*order, "memory_id"))


def weighted(intent: Column, place: int) -> Column:
    out = F.lit(WEIGHTS["factual"][place])
    for name in ("conceptual", "navigational"):
        out = F.when(intent == name, F.lit(WEIGHTS[name][place])).otherwise(out)
    return out


def _table_lists(table: pa.Table, name: str) -> tuple[np.ndarray, pa.Array]:
    """Lengths of the lists of a column, nulls being empty, and their elements in a row."""
    lists = table.column(name).combine_chunks()
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


def _sparse(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, dim, cell, length of each row) of the vectors in dims and cells."""
    sizes, dims = _table_lists(table, "dims")
    cells = _table_lists(table, "cells")[1].to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    norms = np.sqrt(np.bincount(row, weights=cells.astype(np.float64) ** 2, minlength=len(sizes)))
    return row, dims.to_numpy(zero_copy_only=False), cells, norms


def _dense(row: np.ndarray, dims: np.ndarray, cells: np.ndarray, norms: np.ndarray, width: int, kind: type) -> np.ndarray:
    out = np.zeros((len(norms), width), kind)
    out[row, dims] = cells
    return out


class _Postings:
    """BM25 gains of the asked terms in the documents of a pool and channel."""

    def __init__(self, asks: pa.Table, docs: pa.Table, k1: float, b: float):
        ask_sizes, ask_terms = _table_lists(asks, "tokens")
        sizes, terms = _table_lists(docs, "tokens")
        known, n = pc.unique(ask_terms.drop_null()), docs.num_rows
        of = lambda flat: pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        term, row = of(terms), np.repeat(np.arange(n), sizes)
        pairs, tf = np.unique(term[term >= 0] * n + row[term >= 0], return_counts=True)
        term, self.doc = pairs // n, pairs % n
        df = np.bincount(term, minlength=len(known))
        mean = sizes.sum() / n or 1.0
        self.gain = np.log((n - df + 0.5) / (df + 0.5) + 1)[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[self.doc] / mean))
        self.ends = np.concatenate([[0], np.cumsum(df)])
        asked = of(ask_terms)
        pairs = np.unique(np.repeat(np.arange(asks.num_rows), ask_sizes)[asked >= 0] * max(1, len(known)) + asked[asked >= 0])
        self.term, self.firsts = pairs % max(1, len(known)), np.searchsorted(pairs // max(1, len(known)), np.arange(asks.num_rows + 1))

    def scores(self, first: int, last: int, n: int) -> np.ndarray:
        out = np.zeros((last - first, n))
        for i in range(first, last):
            for t in self.term[self.firsts[i] : self.firsts[i + 1]]:
                own = slice(self.ends[t], self.ends[t + 1])
                out[i - first, self.doc[own]] += self.gain[own]
        return _units(out)


def _units(scores: np.ndarray) -> np.ndarray:
    """Scores in whole units of their last digit."""
    return np.rint(np.multiply(scores, 10.0**DIGITS, out=scores), out=scores)


def _best(values: np.ndarray, least: float, tie: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` of the places with at least ``least``, by descending values, descending tie and place."""
    hits = np.flatnonzero(values >= least)
    if len(hits) > most:
        own = values[hits]
        hits = hits[own >= np.partition(own, len(own) - most)[len(own) - most]]
    return hits[np.lexsort((-tie[hits], -values[hits]))][:most]


def _ranks_in(places: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Ranks of ``places`` in ``best``, 0 for others."""
    at = np.argsort(best, kind="stable")
    found = np.searchsorted(best, places, sorter=at) if len(best) else np.zeros(len(places), np.int64)
    inside = np.zeros(len(places), bool)
    inside[found < len(best)] = best[at[found[found < len(best)]]] == places[found < len(best)]
    out = np.zeros(len(places), np.int64)
    out[inside] = at[found[inside]] + 1
    return out


def _rank_of(place: int, values: np.ndarray, tie: np.ndarray) -> int:
    """The rank of a place among all, in the order of ``_best``."""
    above = np.count_nonzero(values > values[place])
    if np.count_nonzero(values >= values[place]) > above + 1:
        same = np.flatnonzero(values == values[place])
        above += np.count_nonzero((tie[same] > tie[place]) | ((tie[same] == tie[place]) & (same < place)))
    return 1 + above


def _first(places: np.ndarray, lists: list[tuple], weights: tuple, rrf_k: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``places`` those that reach the m-th score, and their ranks by list; ``lists`` has (best, values, least, tie) of each, and every place is in some best.

    Past the best of a list a rank is above their number, which bounds its part; ranks are counted from the highest
    bound down, until a bound is below the m-th score.
    """
    ranks = np.stack([_ranks_in(places, best) for best, *_ in lists])
    parts = np.where(ranks > 0, np.array(weights)[:, None] / (rrf_k + ranks), 0.0)
    uncounted = np.stack([(r == 0) & (values[places] >= least) for r, (_, values, least, _) in zip(ranks, lists, strict=True)])
    score = parts.sum(axis=0)
    bound = score + sum(u * w / (rrf_k + len(best) + 1) for u, w, (best, *_) in zip(uncounted, weights, lists, strict=True))
    bar = lambda: np.partition(score, len(score) - most)[len(score) - most] - 1e-11 if len(score) > most else -1.0
    least_score, left = bar(), np.flatnonzero(uncounted.any(axis=0))
    for j in left[np.argsort(-bound[left], kind="stable")]:
        if bound[j] < least_score:
            break
        for k, (_, values, _, tie) in enumerate(lists):
            if uncounted[k, j]:
                ranks[k, j] = _rank_of(places[j], values, tie)
                parts[k, j] = weights[k] / (rrf_k + ranks[k, j])
        uncounted[:, j] = False
        score[j] = parts[:, j].sum()
        if score[j] > least_score:
            least_score = bar()
    kept = ~uncounted.any(axis=0) & (score >= least_score)
    return places[kept], ranks[:, kept]


#: Of a packed text: kind and number of the lengths of its tokens, of its dims and of its cells.
_HEAD = struct.Struct("<cicici")


def _narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest kind that holds them all, others as float64."""
    if values.dtype.kind not in "iu":
        return values.astype("<f8")
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    return values.astype("b" if -128 <= low and high < 128 else "B" if low >= 0 and high < 256 else "<i4" if -(1 << 31) <= low and high < 1 << 31 else "<i8")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with tokens, dims and cells last to rows with one packed value in their place; null lists are empty."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        n_tokens, tokens = _table_lists(table, "tokens")
        lengths = pc.fill_null(pc.binary_length(tokens), -1).to_numpy(zero_copy_only=False)
        said, buffer = tokens.fill_null(""), b""
        if len(said):
            first = np.frombuffer(said.buffers()[1], np.int32)[said.offset : said.offset + len(said) + 1].astype(np.int64)
            buffer = memoryview(said.buffers()[2] or b"")
        else:
            first = np.zeros(1, np.int64)
        parts, kinds, ends = [], [], []
        for sizes, values in ((n_tokens, lengths), *((n, x.to_numpy(zero_copy_only=False)) for n, x in (_table_lists(table, c) for c in ("dims", "cells")))):
            values, end = _narrow(values), np.concatenate([[0], np.cumsum(sizes)])
            parts.append(memoryview(values.tobytes()))
            kinds.append(values.dtype.char.encode())
            ends.append((end.tolist(), (end * values.itemsize).tolist()))
        first = first[np.asarray(ends[0][0], np.int64)].tolist()
        packed = []
        for i in range(batch.num_rows):
            counts = [own[i + 1] - own[i] for own, _ in ends]
            head = _HEAD.pack(kinds[0], counts[0], kinds[1], counts[1], kinds[2], counts[2])
            packed.append(b"".join([head, *(x[at[i] : at[i + 1]] for x, (_, at) in zip(parts, ends, strict=True)), buffer[first[i] : first[i + 1]]]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(packed, pa.binary())], names=[*batch.schema.names[:-3], "packed"])


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` with tokens, dims and cells packed into one column, half of their size in a shuffle."""
    kept = [c for c in rows.columns if c not in ("tokens", "dims", "cells")]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, "tokens", "dims", "cells").mapInArrow(_pack, f"{kinds}, packed binary")


def _unpacked(table: pa.Table) -> pa.Table:
    """``packed`` undone."""
    rows, parts, counts, said = table.column("packed").to_pylist(), [[], [], []], [[], [], []], []
    for row in rows:
        head, at = _HEAD.unpack_from(row), _HEAD.size
        for k in range(3):
            parts[k].append(np.frombuffer(row, np.dtype(head[2 * k].decode()), head[2 * k + 1], at))
            counts[k].append(head[2 * k + 1])
            at += parts[k][-1].nbytes
        said.append(row[at:])
    lengths, dims, cells = (np.concatenate(x) if x else np.zeros(0, np.int8) for x in parts)
    offsets = np.concatenate([[0], np.cumsum(np.maximum(lengths.astype(np.int64), 0))])
    known = pa.array(lengths >= 0).buffers()[1]
    tokens = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(b"".join(said)), known)
    lists = [pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int64), x) for n, x in zip(counts, (tokens, pa.array(dims), pa.array(cells)), strict=True)]
    return table.drop_columns("packed").append_column("tokens", lists[0]).append_column("dims", lists[1]).append_column("cells", lists[2])


#: Scores of queries and documents that a task holds at a time, and products of their cells.
SCORES_AT_ONCE, PRODUCTS_AT_ONCE = 1_000_000, 6_000_000


def fused(asks: DataFrame, docs: DataFrame, most: int, config: SearchConfig, width: int = text.HASH_DIMENSIONS, lexical_breaks_ties: bool = False) -> DataFrame:
    """(query_id, channel, memory_id, score, matched_by, fused_rank, semantic_rank, lexical_rank, semantic): the first ``most`` by weighted reciprocal ranks.

    ``asks(query_id, pool, intent, tokens, dims, cells)``, null tokens closing the lexical channel, and
    ``docs(pool, channel, memory_id, updated_at, tokens, dims, cells, ask_blocks)``.

    A task has the documents of a pool and channel and a block of its queries, so both rankings are whole
    where they are made and only the first hits leave it.  One of the first m by fused score is among the
    first rrf_k + 2 m of one of the two rankings: past them both parts together are below the share of the m-th of
    the heavier one.  The ranks of these are counted over all hits where they can reach the m-th score, and those that
    do go to the exact ranking.
    """
    keys = ["pool", "channel", "ask_block"]
    grid = docs.select("pool", "channel", "ask_blocks").distinct()
    named = [F.col(k).alias(k) for k in keys]  # both sides may stem from one table
    left = packed(asks.select("query_id", "pool", "intent", "tokens", "dims", "cells")).join(grid, "pool").withColumn("ask_block", F.pmod(F.xxhash64("query_id"), F.col("ask_blocks")).cast("int")).select(*named, "query_id", "intent", "packed")
    right = packed(docs.select("pool", "channel", "ask_blocks", "memory_id", "updated_at", "tokens", "dims", "cells")).withColumn("ask_block", F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1))).select(*named, "memory_id", "updated_at", "packed")
    k1, b, rrf_k, least, near = config.bm25_k1, config.bm25_b, config.rrf_k, config.min_semantic_score, int(np.ceil(config.rrf_k)) + 2 * most + 1
    floor = np.rint(least * 10.0**DIGITS)
    kind = docs.schema["updated_at"].dataType.simpleString()

    def score(key: tuple, a: pa.Table, d: pa.Table) -> pa.Table:
        names = ["query_id", "channel", "intent", "memory_id", "updated_at", "semantic_rank", "lexical_rank", "semantic"]
        queries, places, ranks, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((2, 0), np.int64)], [np.zeros(0)]
        n = d.num_rows
        if a.num_rows and n:
            d = d.take(pc.sort_indices(d.column("memory_id")))  # so that equal scores are in order of the id
            a, d = _unpacked(a), _unpacked(d)
            postings, one, two = _Postings(a, d, k1, b), _sparse(a), _sparse(d)
            whole = one[2].dtype.kind == "i" and one[3].max() * two[3].max() < 1 << 24  # products of whole cells are exact then
            one_m, two_m = (_dense(*x, width, np.float32 if whole else np.float64) for x in (one, two))
            weights = [WEIGHTS.get(x, WEIGHTS["factual"]) for x in a.column("intent").to_pylist()]
            step, flat = max(1, SCORES_AT_ONCE // n), np.zeros(n)
            many = step * max(1, PRODUCTS_AT_ONCE // SCORES_AT_ONCE)
            for first in range(0, a.num_rows, step):
                last = min(first + step, a.num_rows)
                if first % many == 0:  # a product of many rows takes half the time of its parts
                    products = one_m[first : first + many] @ two_m.T
                lexical = postings.scores(first, last, n)
                semantic = np.divide(products[first % many : first % many + last - first], np.maximum(two[3], 1e-300), dtype=np.float64)
                semantic = _units(np.divide(semantic, np.maximum(one[3][first:last, None], 1e-300), out=semantic))
                for i in range(first, last):
                    s, x = semantic[i - first], lexical[i - first]
                    s_tie = x if lexical_breaks_ties else flat  # of equal lexical scores the place decides, as in their rank
                    s_best, x_best = _best(s, floor, s_tie, near), _best(x, 1, flat, near)
                    near_ones = np.union1d(s_best, x_best)
                    if not len(near_ones):
                        continue
                    near_ones, r = _first(near_ones, [(s_best, s, floor, s_tie), (x_best, x, 1, flat)], weights[i], rrf_k, most)
                    queries.append(np.full(len(near_ones), i))
                    places.append(near_ones)
                    ranks.append(r)
                    values.append(s[near_ones] / 10.0**DIGITS)
        i, j, r, s = pa.array(np.concatenate(queries)), pa.array(np.concatenate(places)), np.concatenate(ranks, axis=1), np.concatenate(values)
        cols = [a.column("query_id").take(i), pa.array([key[1].as_py()] * len(i), pa.string()), a.column("intent").take(i), d.column("memory_id").take(j), d.column("updated_at").take(j)]
        return pa.table([*cols, *[pa.array(x.astype(np.int32), mask=x == 0) for x in r], pa.array(s, mask=r[0] == 0)], names=names)

    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, f"query_id string, channel string, intent string, memory_id string, updated_at {kind}, semantic_rank int, lexical_rank int, semantic double")
    part = lambda place, rank: F.coalesce(weighted(F.col("intent"), place) / (rrf_k + F.col(rank)), F.lit(0.0))
    score_of = F.round(part(0, "semantic_rank") + part(1, "lexical_rank"), 12)
    names = F.array_compact(F.array(F.when(F.col("semantic_rank").isNotNull(), "semantic"), F.when(F.col("lexical_rank").isNotNull(), "lexical"), F.when(F.col("channel") == "profile", "profile")))
    met = met.withColumn("score", score_of).withColumn("matched_by", F.array_join(names, ","))
    first = F.coalesce(F.col("semantic_rank").cast("long"), F.lit(1 << 40) + F.col("lexical_rank"))
    met = met.withColumn("fused_rank", _rank(F.desc("score"), F.desc_nulls_last("updated_at"), first)).filter(F.col("fused_rank") <= most)
    return met.select("query_id", "channel", "memory_id", "score", "matched_by", "fused_rank", "semantic_rank", "lexical_rank", "semantic")


@dataclass(frozen=True)
class Space:
    """A trained vector space to search in: stored vectors and the queries' vectors, both of ``dimensions``.

    ``stored(memory_id, space_id, dimensions, vector)`` may hold other spaces, which take no part;
    ``asked(query_id, vector)`` lacks the queries whose provider failed.
    """

    space_id: str
    dimensions: int
    stored: DataFrame
    asked: DataFrame


class SpaceMismatch(ValueError):
    """Stored vectors of the searched space have another width."""


@dataclass(frozen=True)
class Prepared:
    """Queries and documents of a search, tokenized and hashed once."""

    asked: DataFrame
    documents: DataFrame


def prepare(records: DataFrame, queries: DataFrame, as_of: Column, layers: list[str] | None = None, tokenizer: text.Tokenizer = text.tokenize) -> Prepared:
    """Queries with pool, intent, tokens and cells; recallable documents of their pools with tokens and cells.  Both are staged, since every part of a search reads them."""
    stage = Staging(records.sparkSession, "search")
    asked = query_pools(queries).select("query_id", "pool", text.intent(F.col("query_text")).alias("intent"), tokenizer(F.col("query_text")).alias("tokens"), F.col("query_text").alias("body"))
    pool = recallable(records, as_of)
    if layers is not None:
        pool = pool.filter(F.col("layer").isin(layers))
    asked = stage.cut(with_cells(asked, "body"))
    documents = document_pools(pool, asked).select("pool", "channel", "ask_blocks", "memory_id", "updated_at", tokenizer(search_text()).alias("tokens"), F.coalesce("content", F.lit("")).alias("body"))
    return Prepared(asked, stage.cut(with_cells(documents, "body")))


def _open(ready: Prepared) -> DataFrame:
    """The queries, without tokens where the lexical channel is closed."""
    closed = closed_lexical(ready.asked, ready.documents).withColumn("closed", F.lit(True))
    return ready.asked.join(closed, "query_id", "left").withColumn("tokens", F.when(F.col("closed").isNull(), F.col("tokens"))).drop("closed")


def search_prepared(ready: Prepared, config: SearchConfig = SearchConfig(), space: Space | None = None) -> DataFrame:
    """Ranked hits of ``prepare``, each channel cut at its own quota; queries whose tokenizer failed have no lexical hits."""
    asked, documents, width = _open(ready), ready.documents, text.HASH_DIMENSIONS
    if space is not None:
        mine, width = space.stored.filter(F.col("space_id") == space.space_id), space.dimensions
        if not mine.filter((F.col("dimensions") != space.dimensions) | F.col("dimensions").isNull()).isEmpty():
            raise SpaceMismatch(f"space {space.space_id} holds vectors of another width than {space.dimensions}")
        stored = _dense_cells(mine.select("memory_id", "vector").dropDuplicates(["memory_id"]), "vector", width)
        vectors_of = _dense_cells(space.asked.select("query_id", "vector"), "vector", width)
        asked, documents = asked.drop("dims", "cells").join(vectors_of, "query_id", "left"), documents.drop("dims", "cells").join(stored, "memory_id", "left")
    hits = fused(asked, documents, max(config.profile_limit, config.recall_limit), config, width).drop("semantic")
    most = F.when(F.col("channel") == "profile", F.lit(config.profile_limit)).otherwise(F.lit(config.recall_limit))
    return hits.filter(F.col("fused_rank") <= most)


def _settled(hits: DataFrame, ready: Prepared) -> DataFrame:
    """``hits`` staged, and the tables they were made of removed."""
    stage = Staging(hits.sparkSession, "hits")
    out = stage.cut(hits)
    stage.drop(ready.asked)
    stage.drop(ready.documents)
    return out


def search(
    records: DataFrame, queries: DataFrame, as_of: Column, config: SearchConfig = SearchConfig(), layers: list[str] | None = None, tokenizer: text.Tokenizer = text.tokenize, space: Space | None = None
) -> DataFrame:
    """Ranked hits of every query within its owner's records, each channel cut at its own quota.

    ``queries(query_id, tenant_id, user_id, agent_id, session_id, session_only, query_text)``; the semantic channel
    is the hash space, or the trained ``space``.  The hits are staged, and nothing else of the search stays on disk.
    """
    ready = prepare(records, queries, as_of, layers, tokenizer)
    return _settled(search_prepared(ready, config, space), ready)


def diagnostics(hits: DataFrame, ready: Prepared, rrf_k: float, space: Space | None = None) -> DataFrame:
    """(query_id, intent, confidence, degraded): confidence is the mean score of the first three hits, profile before normal, times rrf_k.

    ``degraded`` names the channels that were closed or are of the portable kind.
    """
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("channel") == "profile", 0).otherwise(1), "fused_rank")
    top = hits.withColumn("place", F.row_number().over(order)).filter("place <= 3").groupBy("query_id").agg(F.avg("score").alias("mean"))
    rows = ready.asked.select("query_id", "pool", "intent").join(top, "query_id", "left")
    confidence = F.round(F.when(F.col("mean").isNotNull(), F.least(F.lit(1.0), F.col("mean") * rrf_k)).otherwise(F.lit(0.0)), 6)
    rows = rows.join(closed_lexical(ready.asked, ready.documents).withColumn("no_lexical", F.lit(True)), "query_id", "left")
    flags = [F.when(F.col("no_lexical"), "lexical:tokenizer-unavailable")]
    if space is None:
        flags.append(F.lit("semantic:portable-hash"))
    else:  # the provider is asked only where a query has candidates
        pools = ready.documents.select("pool").distinct().withColumn("any_document", F.lit(True))
        rows = rows.join(pools, "pool", "left").join(space.asked.select("query_id").distinct().withColumn("embedded", F.lit(True)), "query_id", "left")
        flags.append(F.when(F.col("any_document") & F.col("embedded").isNull(), "semantic:provider-unavailable"))
    names = F.array_compact(F.array(*flags, F.lit("tag:unavailable")))
    return rows.select("query_id", "intent", confidence.alias("confidence"), F.array_join(names, ",").alias("degraded"))


def relatives(records: DataFrame, keys: DataFrame) -> DataFrame:
    """(memory_id, relative_id, relative_revision): records tied to each key by a link or the chain, itself included.

    A union of equi-joins, never a join on an OR.
    """
    mine = records.join(keys.select("memory_id").distinct(), "memory_id", "left_semi")
    scoped = mine.select("memory_id", scope_key().alias("scope"), "chain_id", "supersedes", "superseded_by", "consolidates")
    none = F.array().cast("array<string>")
    ids = F.array_union(F.array("memory_id"), F.flatten(F.array(*[F.coalesce(c, none) for c in ("supersedes", "superseded_by", "consolidates")])))
    other = records.select(F.col("memory_id").alias("relative_id"), scope_key().alias("scope"), F.col("chain_id"), F.col("revision").alias("relative_revision"))
    by_id = scoped.select("memory_id", "scope", F.explode(ids).alias("relative_id")).join(other.drop("chain_id"), ["scope", "relative_id"])
    by_chain = scoped.filter("chain_id IS NOT NULL").select("memory_id", "scope", "chain_id").join(other, ["scope", "chain_id"])
    cols = ["memory_id", "relative_id", "relative_revision"]
    return by_id.select(*cols).unionByName(by_chain.select(*cols)).distinct()


#: The frame of a recall context.
CONTEXT_HEAD = "<memory-recall>\nUse these records as fallible background. Prefer the current user message when they conflict."
CONTEXT_TAIL = "</memory-recall>"


def context_line(confidence: Column) -> Column:
    shown = F.when(confidence.isNotNull(), F.format_string("%.2f", F.bround(confidence, 6)))
    return F.concat(F.lit("- ["), F.col("memory_id"), F.lit("] ("), F.col("layer"), F.lit(", confidence "), F.coalesce(shown, F.lit("")), F.lit(") "), F.coalesce("content", F.lit("")))


def pack_context(hits: DataFrame, records: DataFrame, budget: int) -> DataFrame:
    """(query_id, memory_id, line_no, used_chars): hits in order until the next line would exceed the character budget.

    used_chars is the length of the whole text up to the line, with its head, its closing tag and the breaks between.
    """
    rows = hits.join(records.select("memory_id", F.length(context_line(F.col("confidence"))).alias("chars")), "memory_id")
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("channel") == "profile", 0).otherwise(1), "fused_rank")
    frame = len(CONTEXT_HEAD) + 1 + len(CONTEXT_TAIL)
    rows = rows.withColumn("line_no", F.row_number().over(order)).withColumn("used_chars", F.sum(F.col("chars") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) + frame)
    return rows.filter(F.col("used_chars") <= budget).select("query_id", "memory_id", "line_no", "used_chars")


def shortlist(extracted: DataFrame, records: DataFrame, as_of: Column, config: SearchConfig = SearchConfig(), tokenizer: text.Tokenizer = text.tokenize) -> DataFrame:
    """(source_id, memory_id, score, shortlist_rank): of each extracted memory the records it may be reconciled with.

    The pool is the owner's recallable records of the same layer (l2_fact or l4_identity); equal cosines are
    ordered by lexical rank.  ``extracted(source_id, tenant_id, user_id, agent_id, layer, content)``.
    """
    layers = F.col("layer").isin("l2_fact", "l4_identity")
    stage = Staging(records.sparkSession, "shortlist")
    pool = F.concat_ws("#", scope_key(), "layer").alias("pool")
    asked = extracted.filter(layers).select(F.col("source_id").alias("query_id"), pool, text.intent(F.col("content")).alias("intent"), tokenizer(F.col("content")).alias("tokens"), F.col("content").alias("body"))
    asked = stage.cut(with_cells(asked, "body"))
    documents = recallable(records, as_of).filter(layers).select(pool, F.lit("all").alias("channel"), "memory_id", "updated_at", tokenizer(search_text()).alias("tokens"), F.coalesce("content", F.lit("")).alias("body"))
    ready = Prepared(asked, stage.cut(with_cells(documents.join(asked_pools(asked), "pool"), "body")))
    hits = _settled(fused(_open(ready), ready.documents, config.reconcile_limit, config, lexical_breaks_ties=True), ready)
    out = hits.select(F.col("query_id").alias("source_id"), "memory_id", "score", F.col("fused_rank").alias("shortlist_rank"))
    out.staged_path = hits.staged_path
    return out
