"""A connector for remote embedding providers: batched, retried and order-restoring, run on the executors.

Offline by default: the provider is a picklable callable ``provider(texts) -> list[(index, vector)]``; the
hash space of ``operators.retrieval`` needs none.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Statuses worth another try.
RETRIED = {408, 429, *range(500, 600)}


class ProviderError(Exception):
    def __init__(self, status: int, message: str = ""):
        super().__init__(message or f"provider answered {status}")
        self.status = status


@dataclass(frozen=True)
class ProviderConfig:
    space_id: str
    dimensions: int
    batch_size: int = 64
    retries: int = 3
    first_wait_s: float = 0.25
    endpoint: str = ""

    def __post_init__(self) -> None:
        if not self.space_id.strip() or self.dimensions < 1 or self.batch_size < 1 or self.retries < 0:
            raise ValueError("a provider needs a space, dimensions and a batch of at least 1")
        address = urlparse(self.endpoint)
        if self.endpoint and (address.scheme not in ("http", "https") or not address.netloc):
            raise ValueError(f"no http or https address: {self.endpoint}")


def embed_batch(provider: Callable[[list[str]], list[tuple[int, list[float]]]], texts: list[str], config: ProviderConfig) -> list[np.ndarray]:
    """Vectors of ``texts`` in their order; wrong widths, gaps, repeats and non-finite values are errors."""
    wait = config.first_wait_s
    for attempt in range(config.retries + 1):
        try:
            answer = provider(texts)
            break
        except ProviderError as error:
            if error.status not in RETRIED or attempt == config.retries:
                raise
            time.sleep(wait)
            wait *= 2
    placed: list[np.ndarray | None] = [None] * len(texts)
    for index, vector in answer:
        if not 0 <= index < len(texts) or placed[index] is not None:
            raise ProviderError(422, "indexes of the answer don't match the batch")
        x = np.asarray(vector, dtype=np.float64)
        if x.shape != (config.dimensions,) or not np.isfinite(x).all() or not x.any():
            raise ProviderError(422, "a vector of the answer is unusable")
        placed[index] = x / np.linalg.norm(x)
    if any(x is None for x in placed):
        raise ProviderError(422, "the answer lacks vectors")
    return placed


def embed(rows: DataFrame, provider: Callable[[list[str]], list[tuple[int, list[float]]]], config: ProviderConfig) -> DataFrame:
    """(key, space_id, dimensions, vector) of ``rows(key, body)``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), config.batch_size):
                part = frame.iloc[lo : lo + config.batch_size]
                found = embed_batch(provider, part["body"].fillna("").tolist(), config)
                yield pd.DataFrame({"key": part["key"], "space_id": config.space_id, "dimensions": config.dimensions, "vector": list(found)})

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "body").mapInPandas(run, f"key {kind}, space_id string, dimensions int, vector array<double>")
