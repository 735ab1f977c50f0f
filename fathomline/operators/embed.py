"""Embedding of chunks: a protocol, and a deterministic embedder that needs no model."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.session import bounded_batches

#: White space between tokens, besides the space.
BLANKS = "\t\n\r\f"


class Embedder(Protocol):
    """A picklable object that turns texts into vectors; it is called with the texts of a batch on the executors."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


#: Tokens whose bucket a worker remembers.
REMEMBERED = 200_000


class _Buckets(dict):
    """The bucket of each token, made when it is first asked for; -1 for the empty one."""

    def __init__(self, dim: int) -> None:
        super().__init__({"": -1})
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
            self[""] = -1
        b = self[token] = int(hashlib.md5(token.encode()).hexdigest()[:4], 16) % self.dim
        return b

    def __reduce__(self):
        return _Buckets, (self.dim,)


class HashEmbedder:
    """Counts of tokens in buckets by the first four hexadecimal digits of their md5, scaled to length 1. Tokens are what
    white space separates, in lower case; a text without tokens has no vector. The counts of all texts of a batch are one
    histogram."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim
        self._bucket = _Buckets(dim)

    def embed(self, texts: list[str]) -> np.ndarray:
        found, sizes = array("q"), [0]
        for text in texts:
            text = text.lower()
            for c in BLANKS:
                text = text.replace(c, " ")
            found.extend(map(self._bucket.__getitem__, text.split(" ")))
            sizes.append(len(found))
        at = np.repeat(np.arange(len(texts)), np.diff(sizes))
        bucket = np.frombuffer(found, np.int64) if found else np.empty(0, np.int64)
        real = bucket >= 0
        out = np.bincount(at[real] * self.dim + bucket[real], minlength=len(texts) * self.dim).reshape(len(texts), self.dim).astype(np.float64)
        n = np.sqrt((out * out).sum(1, keepdims=True))
        return np.where(n > 0, out / np.maximum(n, 1e-300), np.nan)


def embed(chunks: DataFrame, embedder: Embedder, text: str = "chunk", data_col: str = "data", element: str = "float") -> DataFrame:
    """chunks with their vectors instead of their texts; rows with a null text or without vector don't come out. No shuffle;
    a failed batch is repeated with its task, none is lost."""
    bounded_batches(chunks.sparkSession)
    keep = [c for c in chunks.columns if c not in (text, data_col)]
    d = chunks.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != "_text"), f"`{data_col}` array<{element}>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = np.asarray(embedder.embed(part.column(len(keep)).to_pylist()), np.float32 if element == "float" else np.float64)
                good = np.flatnonzero(np.isfinite(x).all(1))
                take = pa.array(good)
                ends = pa.array(np.arange(len(good) + 1, dtype=np.int32) * x.shape[1])
                data = pa.ListArray.from_arrays(ends, pa.array(x[good].reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(take) for k in range(len(keep))), data], [*keep, data_col])

    return d.mapInArrow(run, schema)
