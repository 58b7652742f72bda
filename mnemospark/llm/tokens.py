"""Sizes of texts in tokens of a public tokenizer, counted in Arrow batches."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary lies, unless a caller says otherwise; read on the executors, never copied.
TOKENIZER = os.environ.get("MNEMOSPARK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Fixed value: the pattern that splits text before the merges of byte-level BPE rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, object] = {}


def encoder(path: str = TOKENIZER):
    """The tiktoken encoder of a rank file, loaded once a process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def with_tokens(rows: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``rows`` with its column body replaced by n_tokens; a null body has 0 tokens."""
    kept = [f for f in rows.schema.fields if f.name != "body"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n_tokens long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            n = pa.array([len(encode(t)) if t else 0 for t in batch.column("body").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [n], names=[f.name for f in kept] + ["n_tokens"])

    return rows.mapInArrow(run, schema)
