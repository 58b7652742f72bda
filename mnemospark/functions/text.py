"""Text functions as Column factories: tokenizers, query intent, tags, trimming, hashed features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token runs, intent patterns and terms, hash parameters.
RUNS = r"([a-zA-Z0-9]+|[\u3400-\u9fff]+)"
NAVIGATIONAL = [
    r"`[^`]+`|\"[^\"]{2,}\"|'[^']{2,}'",
    r"[/\\][A-Za-z0-9_.-]+[/\\]|https?://\S+",
    r"(?<![A-Za-z0-9_])[a-z][a-z0-9]*_[a-z0-9_]+(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])[A-Za-z][a-z0-9]+[A-Z][A-Za-z0-9]*(?![A-Za-z0-9_])",
    r"(?<![A-Za-z0-9_])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![A-Za-z0-9_])",
]
CONCEPTUAL = ["how", "why", "explain", "approach", "strategy", "tend", "overall", "pattern", "怎么", "为什么", "如何", "倾向", "风格", "整体", "通常", "模式"]
FNV_OFFSET, FNV_PRIME, HASH_DIMENSIONS = 2166136261, 16777619, 256
BLANK = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

Tokenizer = Callable[[Column], Column]


def _pairs(run: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))


def runs(text: Column) -> Column:
    """Runs of ASCII letters and digits and of basic Han, in order; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUNS), 1)


def tokenize(text: Column) -> Column:
    """ASCII runs in lower case; Han runs as overlapping pairs, a single Han character by itself."""

    def one(run: Column) -> Column:
        han = F.when(F.length(run) == 1, F.array(run)).otherwise(_pairs(run))
        return F.when(run.rlike("^[a-zA-Z0-9]"), F.array(F.lower(run))).otherwise(han)

    return F.flatten(F.transform(runs(text), one))


def tokenize_runs(text: Column) -> Column:
    """Whole runs in lower case: the tokens of the hash space."""
    return F.transform(runs(text), F.lower)


def intent(query: Column) -> Column:
    """navigational, conceptual or factual."""
    navigational = F.lit(False)
    for pattern in NAVIGATIONAL:
        navigational = navigational | query.rlike(pattern)
    conceptual = F.lit(False)
    for term in CONCEPTUAL:
        conceptual = conceptual | F.contains(F.lower(query), F.lit(term))
    return F.when(navigational, "navigational").when(conceptual, "conceptual").otherwise("factual")


def trim_all(text: Column) -> Column:
    """Blanks of any kind off both ends."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def clip(text: Column, most: int) -> Column:
    """The first ``most`` characters, trimmed."""
    return trim_all(F.substring(text, 1, most))


def normalize_tags(tags: Column, most: int = 32) -> Column:
    """Trimmed, lower-case, non-empty and distinct tags in order, the first ``most``; null tags are none."""
    clean = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(trim_all(t)))
    return F.slice(F.array_distinct(F.filter(clean, lambda t: t.isNotNull() & (t != ""))), 1, most)


def profile_text(profile: Column) -> Column:
    """``key: value`` lines of a map in its order."""
    return F.array_join(F.transform(F.map_entries(profile), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")


def merge_profile(old: Column, patch: Column, allowed: list[str]) -> Column:
    """Allowed fields of ``patch`` over ``old``: fields of ``old`` keep their place, new ones follow."""
    none = F.create_map().cast("map<string,string>")
    accepted = F.map_filter(F.coalesce(patch, none), lambda k, v: k.isin(allowed))
    held = F.coalesce(old, none)
    has = lambda m, k: F.coalesce(F.array_contains(F.map_keys(m), k), F.lit(False))
    kept = F.transform(F.map_entries(held), lambda e: F.struct(e["key"].alias("key"), F.when(has(accepted, e["key"]), F.element_at(accepted, e["key"])).otherwise(e["value"]).alias("value")))
    new = F.filter(F.map_entries(accepted), lambda e: ~has(held, e["key"]))
    return F.map_from_entries(F.concat(kept, new))


def message_text(blocks: Column) -> Column:
    """The text blocks of a message, array<struct<type, text>>, one a line and trimmed; other blocks are left out."""
    return trim_all(F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n"))


def features(text: Column) -> Column:
    """Features of the hash space: t:token and b:pair of every run."""

    def one(token: Column) -> Column:
        pairs = F.when(F.length(token) > 1, F.transform(_pairs(token), lambda p: F.concat(F.lit("b:"), p))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(F.concat(F.lit("t:"), token)), pairs)

    return F.flatten(F.transform(tokenize_runs(text), one))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over code points, as a non-negative long."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(points, F.lit(FNV_OFFSET).cast("long"), lambda h, p: (h.bitwiseXOR(p) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)))


def features_of(token: str) -> list[str]:
    """The features of one run in lower case."""
    return ["t:" + token, *("b:" + token[i : i + 2] for i in range(len(token) - 1))]


def fnv1a_of(feature: str) -> int:
    """``fnv1a`` of a Python string."""
    h = FNV_OFFSET
    for c in feature:
        h = ((h ^ ord(c)) * FNV_PRIME) & 0xFFFFFFFF
    return h


def hash_cells(text: Column) -> Column:
    """array<struct<dim, sign>>: one signed cell per feature."""
    return F.transform(F.transform(features(text), fnv1a), lambda h: F.struct((h % HASH_DIMENSIONS).cast("int").alias("dim"), F.when(h % 2 == 0, F.lit(1)).otherwise(F.lit(-1)).alias("sign")))
